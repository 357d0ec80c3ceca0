"""The pipeline's stages, each against what its own input asks for."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]


def test_run(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(500)])
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 60))
        if i % 6 == 0:
            text[5:8] = ["scoundrel", "numbskull", "blockhead"]
        if i % 10 == 1:
            text.append("token=abcdefghijkl")
        rows.append((i, " ".join(text), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "s1", 0) for i in range(50)]  # exact copies
    spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / "out" / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        seen[name] = docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    clean = {r[0] for r in rows if "scoundrel" not in r[1]}
    kept = {r["doc_id"] for r in seen["toxicity"].collect()}
    assert len(kept & clean) >= 0.98 * len(clean) and len(kept - clean) <= 3
    single = [r["doc_id"] for r in seen["near_dedup"].collect()]
    assert len(single) == len(set(single)) and {i for i in kept if i < 1000} == set(single)
    redacted = {r["doc_id"]: r for r in seen["secrets"].collect()}
    assert set(redacted) == set(single)
    for i, r in redacted.items():
        assert ("[SECRET]" in r["text"]) == (i % 10 == 1) and "token=" not in r["text"] and r["n_chars"] == len(r["text"])
    size = sum(len(r["text"].split()) for r in redacted.values())
    taken = sum(len(r["text"].split()) for r in seen["mixing"].collect())
    assert abs(taken - 1.5 * size) <= 0.005 * 1.5 * size + 4
    packed = seen["packing"].collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in seen["mixing"].collect()}
    assert all(r["offset"] + r["length"] <= 2048 for r in packed)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))
    assert re.match("s[0-3]", rows[0][3])


def test_stages_with_nulls_repeated_ids_and_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(20)
    long = " ".join(rng.choice([f"w{i}" for i in range(900)], 20_000))
    rows = [(None, "one two three"), (None, "four five six"), (None, None), (1, ""), (1, "seven eight"), (1, "seven eight"), (2, None), (3, long), (4, "token=abcdefgh12 x")]
    docs = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None) for k, (i, t) in enumerate(rows)], SCHEMA)
    for k, name in enumerate(("_score", "_row", "_node", "_keys", "_secrets", "row", "slot", "doc", "size", "number", "_group", "found", "made")):
        docs = docs.withColumn(name, F.lit(k))
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    empty = {name: stage(spark, docs.limit(0), str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    for name in ("toxicity", "near_dedup", "secrets", "mixing"):
        assert seen[name].columns == docs.columns and all(r["slot"] == 6 and r["_score"] == 0 for r in seen[name].collect())
    assert all(df.count() == 0 for df in empty.values())
    every = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    assert every(seen["toxicity"]) == sorted((str(i), t or "") for i, t in rows)
    assert every(seen["near_dedup"]) == sorted({("None", "one two three"), ("None", "four five six"), ("1", ""), ("1", "seven eight"), ("3", long), ("4", "token=abcdefgh12 x")})
    assert every(seen["secrets"]) == sorted((str(i), "[SECRET] x" if i == 4 else t or "") for i, t in rows)
    assert {r["doc_id"] for r in seen["packing"].collect()} == {i for i, _ in rows}


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = np.random.default_rng(12)
    words = np.array([f"w{i}" for i in range(5000)])

    def sets(text):
        own = text.lower().split()
        return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}

    texts = []
    for n in (100, 400, 1500) * 6:
        base = list(rng.choice(words, n))
        texts.append(" ".join(base))
        for changed in (n // 100, n // 60, n // 20):  # the last is under 0.8
            copy = list(base)
            for at in rng.choice(n, changed, replace=False):
                copy[at] = "changed"
            texts.append(" ".join(copy).upper())
    texts += ["two words", "Two  words", "", None, "  "]
    alike = [[len(a & b) >= 0.8 * len(a | b) for b in map(sets, (t or "" for t in texts))] for a in map(sets, (t or "" for t in texts))]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike[i][j]:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert 20 <= len(set(group)) <= len(texts) - 30
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(group))
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_every_pair_of_a_hot_key_is_compared(spark):
    from pricelake.llm import near_copies

    rng = np.random.default_rng(13)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in rng.choice(60, 2, replace=False):
            copy[at] = f"x{rng.integers(0, 3)}"
        texts.append(" ".join(copy))
    own = {near_copies.xxhash.xxh3_64_intdigest(s.tobytes()): s for s in (near_copies.shingles(t.encode(), 5) for t in texts)}
    nodes = [(n - (1 << 64) if n >> 63 else n, t) for n, t in {near_copies.xxhash.xxh3_64_intdigest(near_copies.shingles(t.encode(), 5).tobytes()): t for t in texts}.items()]
    rows = spark.createDataFrame([(n, t, [7]) for n, t in nodes], "_node long, text string, _keys array<long>")
    got = {r["node"]: r["component"] for r in near_copies.components(rows, 5, 0.8, tile=16).collect()}
    assert len(own) == len(nodes)
    sets = [set(near_copies.shingles(t.encode(), 5).tolist()) for _, t in nodes]
    group = [n for n, _ in nodes]
    for i in range(len(nodes)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, old = min(group[i], group[j]), {group[i], group[j]}
                group = [low if g in old else g for g in group]
    assert [got.get(n, n) for n, _ in nodes] == group and len(set(group)) > 1


def test_simhash_names_candidates_that_share_no_band(spark):
    from pricelake.llm import near_copies

    rng = np.random.default_rng(31)
    words = np.array([f"w{i}" for i in range(5000)])
    base = list(rng.choice(words, 400))
    texts = [" ".join(base), " ".join([*base[:-1], "changed"]), " ".join([*base[:-2], "other", "end"]), " ".join(rng.choice(words, 400)), " ".join(rng.choice(words, 400))]
    near, far = 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF
    prints = [near, near ^ 0b111, near, near ^ 0b1, far]  # the fourth text is only alike in its fingerprint
    rows = spark.createDataFrame([(10 + i, t, [i], p) for i, (t, p) in enumerate(zip(texts, prints, strict=True))], "_node long, text string, _keys array<long>, _print long")
    got = {r["node"]: r["component"] for r in near_copies.components(rows, 5, 0.8).collect()}
    assert got == {10: 10, 11: 10, 12: 10}
    made = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string").select(F.struct("doc_id", "text").alias("doc"))
    made = made.mapInArrow(near_copies._nodes(5), "doc struct<doc_id: long, text: string>, _node long, _keys array<long>, _print long").collect()
    own = near_copies.shingles(b"a b c d e f", 5).tolist()
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in own) > len(own))
    assert {r["doc"]["doc_id"]: r["_print"] & (2**64 - 1) for r in made} == {1: want, 2: 0}


def test_packing_search_keeps_one_table_of_counts():
    import tracemalloc

    from pricelake.llm import packing

    rng = np.random.default_rng(5)
    counts = dict(zip(rng.choice(np.arange(30, 2049), 1500, replace=False).tolist(), rng.integers(1, 40, 1500).tolist(), strict=True))
    tracemalloc.start()
    try:
        plan = packing.completed(counts, 2048, nodes=400)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4e6, peak  # a table of counts in each entry of the stack took 22 MB here, and 600 in the driver on check_h
    got: dict[int, int] = {}
    for filling, times in plan:
        assert times > 0 and sum(n * c for n, c in filling) <= 2048
        for n, c in filling:
            got[n] = got.get(n, 0) + c * times
    assert got == counts


def test_packing_sends_documents_in_batches_bound_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    from pricelake.llm import packing

    def sizes(path, capacity, with_ids, remembered):
        def run(batches):  # a piece for each batch, with the batch's rows and bytes in place of its own
            for batch in batches:
                row = [batch.column(0)[0].as_py(), 0, batch.num_rows, 1, batch.nbytes, None]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        return run

    monkeypatch.setattr(packing, "_pieces", sizes)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('abcdefghij', 330)").alias("text"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = packing.packed(docs, "unread", with_ids=False).collect()
    assert sum(r["start"] for r in rows) == 4000
    assert max(r["ids_crc32"] for r in rows) < 2.4e6  # without the bound, one batch of 13 MB
    assert spark.conf.get(key) == before
    spark.conf.set(key, "64k")  # the session's own bound holds
    try:
        rows = packing.packed(docs, "unread", with_ids=False).collect()
        assert max(r["ids_crc32"] for r in rows) < 80_000 and spark.conf.get(key) == "64k"
    finally:
        spark.conf.unset(key)


def test_packing_tasks_of_a_worker_share_a_tokenizer(monkeypatch):
    import pyarrow as pa
    from pyspark import cloudpickle

    from pricelake.llm import packing

    made = []

    class Counted:
        def __init__(self, path, remembered):
            made.append(path)

        def __call__(self, texts):
            return [b"\1\0\0\0" for _ in texts]

    monkeypatch.setattr(packing, "WordTokenizer", Counted)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", None])], names=["doc_id", "text"])
    command = cloudpickle.dumps(packing._pieces("shared", 2048, False, 9))
    made.clear()
    for _ in range(3):  # each task unpickles it anew
        rows = [r for b in cloudpickle.loads(command)(iter([batch])) for r in b.to_pylist()]
        assert [(r["doc_id"], r["length"]) for r in rows] == [(1, 2), (2, 2)]
    assert len(packing._tokenizers) == 1
    list(cloudpickle.loads(cloudpickle.dumps(packing._placed(None)))(iter([])))
    assert not packing._tokenizers  # nothing is kept beside the numbering
