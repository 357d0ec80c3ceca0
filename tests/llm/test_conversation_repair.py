"""Conversation repair against a brute-force search of the edits, and the query against its SQL."""

import hashlib
import heapq
import os
import re
import zlib

import numpy as np
import pytest

from pricelake.llm import conversation_repair, oracle, queries

SCHEMA = "conv_id long, turn long, role string, text string, copies int, place string, inner int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        if not bare.strip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Dijkstra over (cost, edits, turns that come out): the first complete one is the cheapest with the least edits."""
    marks, n = faults(rows), len(rows)
    grammar, start = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"s?(ua)*u?\Z")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, roles, out = heapq.heappop(heap)
        if i == n and grammar.match(roles):
            return cost, edits, out
        key = i, roles[-1:] + str(len(roles) > 1)
        if key in done:
            continue
        done.add(key)
        step = [(5, "I", i, r, (r, "")) for r in ("user", "assistant")]
        if i < n:
            role, text = rows[i]
            step.append((2, "D", i + 1, None, None))
            if marks[i] in (None, "truncated"):
                late = 5 * (marks[i] == "truncated")
                step += [(late, "K", i + 1, role, (role, text)), *((late + 1, "R", i + 1, r, (r, text)) for r in ("user", "assistant"))]
        for price, edit, j, role, turn in step:
            next_ = roles if role is None else roles + (role[:1] or "-")
            if start.match(next_):
                heapq.heappush(heap, (cost + price, edits + edit, j, next_, out if turn is None else (*out, turn)))
    raise AssertionError


def brute(conversations):
    want = {}
    for conv_id, rows in conversations.items():
        rows = sorted(((t is not None, t or 0, r or " ", hashlib.sha256((x if x is not None else " ").encode()).hexdigest(), x if x is not None else " ") for t, r, x in rows), key=lambda r: r[:4])
        turns = [t for known, t, *_ in rows if known]
        said = [(r, x) for _, _, r, _, x in rows]
        cost, edits, out = cheapest(said)
        marks = faults(said)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
        want[conv_id] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, edits, digest), out
    return want


def made(rng, n, most):
    texts = ["Yes.", "no", "What?", " ", "", "Fine! \n", "é.", " ", "Long " * 40 + ".", "a:b\nc."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User"]
    pick = lambda of: of[int(rng.integers(len(of)))]
    return {c: [(int(rng.integers(-3, most)) if rng.random() > 0.05 else None, pick(roles), pick(texts) if rng.random() > 0.5 else f"{rng.integers(9**9)}{pick('.x')}") for _ in range(int(rng.integers(1, most)))] for c in range(n)}


def check(spark, conversations, parts=4):
    rows = [(c, t, r, x, 1, "p", 2) for c, turns in conversations.items() for t, r, x in turns]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.report(frame).collect()}
    want = brute(conversations)
    assert got == {c: w for c, (w, _) in want.items()}
    mended = {c: [] for c in conversations}
    for r in sorted(conversation_repair.repaired(frame).collect(), key=lambda r: (r["place"], r["position"])):
        mended[r["conv_id"]].append((r["role"], r["text"]))
    assert mended == {c: list(out) for c, (_, out) in want.items()}


def test_against_search(spark):
    rng = np.random.default_rng(12)
    conversations = made(rng, 150, 9) | {200 + k: v for k, v in made(rng, 4, 40).items()}
    conversations[None] = [(0, None, None), (1, "user", "Hello."), (None, "user", "Hello."), (None, None, "x")]
    conversations[998] = [(0, "system", "Be kind.")]
    conversations[999] = [(5, "user", "Go on."), (5, "assistant", "On."), (5, "assistant", "On.")]
    check(spark, conversations)


def test_conversations_of_many_blocks(spark, monkeypatch):
    for rows, size in ((3, 10**6), (1, 10**6), (50, 30)):
        monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", rows)
        monkeypatch.setattr(conversation_repair, "BLOCK_BYTES", size)
        check(spark, made(np.random.default_rng(rows), 12, 30), parts=3)


def test_most_rows_in_one_conversation(spark):
    rng = np.random.default_rng(5)
    conversations = made(rng, 10, 8)
    conversations[77] = [(i, r, x) for i, (_, r, x) in enumerate(made(rng, 1, 2)[0] * 50)] + [(None, "user", "Same.")] * 60
    check(spark, conversations)


def test_block_matrices_are_the_programme():
    rng = np.random.default_rng(6)
    code, fault = rng.integers(0, 4, (11, 20)), rng.integers(0, 4, (11, 20))
    length = np.full(20, 11)
    ends = np.repeat(conversation_repair._ENDED[:, None], 20, axis=1)
    whole = conversation_repair.costs(code, fault, length, ends)[0]
    late = conversation_repair.costs(code[6:], fault[6:], length - 6, ends)[0]
    for e in range(4):
        only = np.full((4, 20), conversation_repair._FAR)
        only[e] = 0
        part = conversation_repair.costs(code[:6], fault[:6], length - 5, only)[0] + late[e]
        best = part if e == 0 else np.minimum(best, part)  # noqa: F821
    assert (best == whole).all()


def test_dropped_and_empty(spark):
    rows = [(1, 0, "user", "a.", 0, "p", 2), (2, None, None, None, 1, "p", 2), (3, 0, "user", "A.", 2, "p", 2), (3, 9, "assistant", "B.", 1, "p", 2)]
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 0, 0, 0, 0, 0, "", nothing) and got[2] == (0, 1, 0, 0, 0, 2, "D", nothing)
    assert got[3] == (8, 0, 1, 0, 1, 2, "KDK", hashlib.sha256(b"user:A.\nassistant:B.").hexdigest())
    assert conversation_repair.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage(spark):
    rows = [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"Text. {t}?") for c in range(60) for t in range(4)]
    frame = spark.createDataFrame([*rows, (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"], r["copies"]) for r in conversation_repair.damaged(frame).collect()}
    seen = set()
    for c, t, role, text in rows:
        code = zlib.crc32(f"{c}:{t}".encode()) % 20
        seen.add(min(code, 5))
        copies = {0: 0, 3: 2}.get(code, 1)
        assert got[c, t] == ("user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text, copies)
    assert seen == set(range(6)) and got[None, None][1] in (" ", "")


def test_query_matches_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    made_ = queries.op12_conversation_repair(spark, d)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    answer = con.execute(oracle.SQL["op12_conversation_repair"])
    assert [c[0] for c in answer.description] == made_.columns
    assert sorted(map(tuple, made_.collect())) == sorted(answer.fetchall())
