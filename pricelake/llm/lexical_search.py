"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

The index is written in shards of consecutive rows, without a shuffle: for each term of a shard its postings in blocks of
BLOCK, as gaps and counts in the fewest bytes, with each block's last document and its greatest impact. A query moves its
lists' pointers over whole blocks first, by these alone: where the sum of the blocks' greatest impacts can't reach the tenth
best score so far, nothing is decompressed. The pivots, ranges of documents where it can, are scored in full, those with
the greatest bounds first, so the threshold is high early. Shards give ten documents a query; the best ten of these are the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, written

#: Postings of a block; documents and bytes of text of a shard (it ends after the text that passes that); queries of a set; bytes of
#: their terms that are broadcast, and in how many parts a term's shards are joined beyond that.
BLOCK, SHARD_DOCS, SHARD_BYTES = 128, 1 << 16, 24_000_000
QUERIES, SENT_BYTES, SALTS = 256, 32_000_000, 64

# What separates terms, and the constants of a score.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UNIT, _COUNT, _LENGTH = 1_000_000_000, 1000, 8

_TABLE = bytearray(range(256))
for _c in range(128):
    _TABLE[_c] = ord(chr(_c).lower()) if chr(_c).isalnum() else 0x20

_INDEX = "shard long, term string, n long, header binary, mosts binary, payload binary"
_HITS = "query long, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters, digits and all beyond ASCII, A-Z lower-cased."""
    return text.translate(bytes(_TABLE)).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = every = 0
    for batch in batches_of(batches, 512):
        for text in batch.column(0):
            n = len(terms(text.as_buffer().to_pybytes())) if text.is_valid else 0
            docs, every = docs + (n > 0), every + n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([every], pa.int64())], names=["docs", "every"])


def totals(docs: DataFrame) -> tuple[int, int]:
    """How many texts have a term, and how many terms there are with repeats."""
    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_counted, "docs long, every long")
    row = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("every"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length adds under its scores: 10 and 90 times its length over the mean one, rounded down."""
    return 10 + (90 * lengths.astype(np.int64) * n_docs) // max(1, n_terms)


def impacts(counts: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score for each unit of its weight."""
    counts = counts.astype(np.int64)
    return (_UNIT * counts) // (_COUNT * counts + _LENGTH * norm)


def _packed(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of unsigned numbers in the fewest bytes each: the width of a block's numbers, and all bytes, block by block."""
    largest = np.maximum.reduceat(values, starts)
    width = np.select([largest < 1 << 8, largest < 1 << 16], [1, 2], 4)
    each = np.repeat(width, np.diff([*starts, values.size]))
    bytes_ = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return width, bytes_[np.arange(4) < each[:, None]]


def _shard(number: int, ids: list, texts: list[bytes], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """A shard's postings, a row per term, and with a null term a row with its documents' ids and norms."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))  # so that ties are by ascending id
    vocabulary: dict[bytes, int] = {}
    codes, lengths = [], np.zeros(len(ids), dtype=np.int64)
    for place, i in enumerate(order):
        found = terms(texts[i])
        lengths[place] = len(found)
        codes.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in found), dtype=np.int64, count=len(found)))
    norm = norms(lengths, n_docs, n_terms)
    known = np.array([ids[i] is not None for i in order])
    places = np.array([ids[i] or 0 for i in order], dtype="<i8")
    yield _rows([number], [None], [len(ids)], [places.tobytes()], [norm.astype("<i8").tobytes()], [known.tobytes()])
    if not vocabulary:
        return
    keys = (np.concatenate(codes) << np.int64(32)) | np.repeat(np.arange(len(ids)), lengths)
    keys, counts = np.unique(keys, return_counts=True)
    term, doc = keys >> np.int64(32), keys & np.int64(0xFFFFFFFF)
    impact = impacts(counts, norm[doc])
    first = np.searchsorted(term, np.arange(len(vocabulary)))
    rank = np.arange(term.size) - first[term]
    starts = np.flatnonzero(rank % BLOCK == 0)
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = 0  # a block begins at the document that its header names
    ends = np.append(starts[1:], term.size) - 1
    wide_gaps, gap_bytes = _packed(gaps, starts)
    wide_counts, count_bytes = _packed(counts, starts)
    size = ends - starts + 1
    # Block by block: the gaps, then the counts.
    length = size * (wide_gaps + wide_counts)
    begin = np.cumsum(length) - length
    payload = np.empty(int(length.sum()), dtype=np.uint8)
    at = np.arange(gap_bytes.size) + np.repeat(begin - (np.cumsum(size * wide_gaps) - size * wide_gaps), size * wide_gaps)
    payload[at] = gap_bytes
    at = np.arange(count_bytes.size) + np.repeat(begin + size * wide_gaps - (np.cumsum(size * wide_counts) - size * wide_counts), size * wide_counts)
    payload[at] = count_bytes
    header = np.stack([doc[starts], doc[ends], size, wide_gaps, wide_counts], axis=1).astype("<i4")
    mosts = np.maximum.reduceat(impact, starts).astype("<i8")
    owner = term[starts]
    cut = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    bytes_at = np.append(begin, payload.size)[cut]
    names = list(vocabulary)
    for low in range(0, len(names), 50_000):
        high = min(len(names), low + 50_000)
        pick = lambda data: [data[cut[k] : cut[k + 1]].tobytes() for k in range(low, high)]  # noqa: B023, E731
        n = np.diff(np.append(first, term.size))[low:high]
        body = [payload[bytes_at[k] : bytes_at[k + 1]].tobytes() for k in range(low, high)]
        yield _rows([number] * (high - low), [t.decode() for t in names[low:high]], n, pick(header), pick(mosts), body)


def _rows(*values) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(values, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _INDEX.split(", ")])


def _shards(n_docs: int, n_terms: int, most_docs: int, most_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches_of(batches, 512):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                raw = text.as_buffer().to_pybytes()
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
                if len(ids) == most_docs or size >= most_bytes:
                    yield from _shard(number, ids, texts, n_docs, n_terms)
                    number += 1
                    ids, texts, size = [], [], 0
        if ids:
            yield from _shard(number, ids, texts, n_docs, n_terms)

    return run


@dataclass(frozen=True)
class Index:
    """The written shards, and how many documents have a term."""

    shards: DataFrame
    n_docs: int


def index(docs: DataFrame) -> Index:
    """The index of ``docs`` (doc_id, text): every text that isn't null is in one shard, every term of it in a posting."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs, n_terms = totals(docs)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return Index(written(rows.mapInArrow(_shards(n_docs, n_terms, SHARD_DOCS, SHARD_BYTES), _INDEX)), n_docs)


# --- search -----------------------------------------------------------------------------------------------------------


class Postings:
    """A term's postings in a shard; blocks are decompressed when they are first needed."""

    def __init__(self, n: int, header: bytes, mosts: bytes, payload: bytes, norm: np.ndarray):
        self.first, self.last, self.size, self.wide_gaps, self.wide_counts = np.frombuffer(header, dtype="<i4").reshape(-1, 5).T.astype(np.int64)
        self.most = np.frombuffer(mosts, dtype="<i8")
        self.payload, self.norm = np.frombuffer(payload, dtype=np.uint8), norm
        length = self.size * (self.wide_gaps + self.wide_counts)
        self.begin = np.cumsum(length) - length
        self.docs, self.impacts = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.open = np.zeros(self.size.size, dtype=bool)

    def _numbers(self, blocks: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
        """The numbers of blocks of one width: (blocks, BLOCK), those after a block's end being whatever follows."""
        at = begin[:, None, None] + np.arange(BLOCK)[None, :, None] * width + np.arange(width)[None, None, :]
        raw = self.payload[np.minimum(at, self.payload.size - 1)].astype(np.int64)
        return (raw << (8 * np.arange(width))).sum(axis=2)

    def of(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks."""
        at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        at = at[at < self.docs.size]
        shut = blocks[~self.open[blocks]]
        for wide_gaps in (1, 2, 4):
            for wide_counts in (1, 2, 4):
                some = shut[(self.wide_gaps[shut] == wide_gaps) & (self.wide_counts[shut] == wide_counts)]
                if not some.size:
                    continue
                docs = self.first[some][:, None] + np.cumsum(self._numbers(some, self.begin[some], wide_gaps), axis=1)
                counts = self._numbers(some, self.begin[some] + self.size[some] * wide_gaps, wide_counts)
                inside = np.arange(BLOCK) < self.size[some][:, None]
                place = (some[:, None] * BLOCK + np.arange(BLOCK))[inside]
                self.docs[place] = docs[inside]
                self.impacts[place] = impacts(counts[inside], self.norm[docs[inside]])
        self.open[shut] = True
        return self.docs[at], self.impacts[at]


def best(lists: list[tuple[int, Postings]], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of ``n`` with the highest sums of weight times impact above 0, ties by ascending number, and the sums."""
    lists = [(weight, postings) for weight, postings in lists if weight > 0]
    docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not lists:
        return docs, scores
    # Shallow moves: how much the blocks that hold a document could give it changes only where a block begins or ends.
    change = np.zeros(n + 1, dtype=np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    for weight, postings in lists:
        bound = weight * postings.most
        change[postings.first] += bound  # a list's blocks begin and end at different documents
        change[postings.last + 1] -= bound
        edge[postings.first] = edge[postings.last + 1] = True
    starts = np.flatnonzero(edge[:n])
    bounds = np.cumsum(change)[starts]
    ends = np.append(starts[1:], n)
    order = np.argsort(-bounds, kind="stable")
    starts, ends, bounds = starts[order], ends[order], bounds[order]
    covered = np.cumsum(ends - starts)
    total, at, step = np.zeros(n, dtype=np.int64), 0, 64
    while True:
        floor = max(1, int(scores[-1]) if scores.size == k else 1)
        stop = int(np.searchsorted(-bounds, -floor, side="right"))  # an equal score may belong to a smaller number
        if at >= stop:
            return docs, scores
        to = min(stop, 1 + int(np.searchsorted(covered, (covered[at - 1] if at else 0) + step)))
        here = np.zeros(n + 1, dtype=np.int64)
        here[starts[at:to]] += 1
        np.subtract.at(here, ends[at:to], 1)
        pivots = np.cumsum(here)[:n] > 0
        before = np.concatenate([[0], np.cumsum(pivots)])
        for weight, postings in lists:
            blocks = np.flatnonzero(before[postings.last + 1] > before[postings.first])
            if blocks.size:
                found, impact = postings.of(blocks)
                inside = pivots[found]
                total[found[inside]] += weight * impact[inside]
        new = np.flatnonzero(pivots & (total >= floor))
        docs, scores = np.concatenate([docs, new]), np.concatenate([scores, total[new]])
        top = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[top], scores[top]
        at, step = to, step * 4


def _searched(k: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        (own,) = (r for r in rows if r["wanted"] is None)
        ids, norm, known = (np.frombuffer(own[c], dtype=d) for c, d in (("header", "<i8"), ("mosts", "<i8"), ("payload", bool)))
        queries: dict[int, list[tuple[int, Postings]]] = {}
        for r in rows:
            if r["wanted"] is not None:
                postings = Postings(r["n"], r["header"], r["mosts"], r["payload"], norm)
                for query in r["wanted"]:
                    queries.setdefault(query, []).append((r["weight"], postings))
        hits = [(q, *best(lists, ids.size, k)) for q, lists in sorted(queries.items())]
        docs = np.concatenate([d for _, d, _ in hits] or [np.zeros(0, dtype=np.int64)])
        return pa.table({
            "query": pa.array(np.repeat([q for q, _, _ in hits], [d.size for _, d, _ in hits]), pa.int64()),
            "doc_id": pa.array(ids[docs], pa.int64(), mask=~known[docs]),
            "score": pa.array(np.concatenate([s for _, _, s in hits] or [np.zeros(0, dtype=np.int64)]), pa.int64()),
        })

    return run


def search(made: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    Needs item_id and text; more columns are ignored. A null text has no terms; items without a document have no rows; rows with
    the same item_id are queries of their own. Equal scores are ranked by ascending doc_id, null ones last.
    """
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    found = F.array_distinct(F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(f"[^{SEPARATORS}]+"), F.lit(0)))
    asked = written(items.select("item_id", found.alias("terms")).withColumn("query", F.monotonically_increasing_id()))
    sets = max(1, -(-asked.count() // QUERIES))
    terms_ = asked.select(F.pmod(F.xxhash64("query"), F.lit(sets)).cast("int").alias("set"), "query", F.explode("terms").alias("term"))
    wanted = written(terms_.groupBy("set", "term").agg(F.collect_list("query").alias("wanted")))
    postings = made.shards.where("term IS NOT NULL")
    frequency = postings.select("term", "n").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(made.n_docs)) + 2) / (2 * F.col("df") + 1))).cast("long")
    wanted = written(wanted.join(frequency, "term").select("set", "term", "wanted", weight.alias("weight")))
    size = wanted.agg(F.coalesce(F.sum(F.length("term") * 4 + F.size("wanted") * 8 + 64), F.lit(0))).first()[0]
    if size <= SENT_BYTES:
        joined = postings.join(F.broadcast(wanted), "term")
    else:  # a common term is in every shard, so its shards are joined in parts
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = postings.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")
    columns = ["set", "shard", "n", "header", "mosts", "payload", "wanted", "weight"]
    own = made.shards.where("term IS NULL").withColumns({
        "set": F.explode(F.sequence(F.lit(0), F.lit(sets - 1))), "wanted": F.lit(None).cast("array<long>"), "weight": F.lit(None).cast("long"),
    })
    hits = own.select(columns).union(joined.select(columns)).groupBy("set", "shard").applyInArrow(_searched(k), _HITS)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search`` of ``items`` in an index of ``docs``, made for it. An empty table on either side gives an empty result."""
    return search(index(docs), items, k)
