"""Best-fit packing of tokenised documents by bin completion.

Documents become pieces of at most ``capacity`` tokens. How many pieces there are of each length is a table of at most
``capacity`` rows, whatever the corpus size, and the search runs on that: around the largest length left, it enumerates
the undominated fillings of a sequence, takes each as often as the counts allow, and prunes by waste against the best
solution so far, which at first is best-fit decreasing. Pieces are then numbered within their length and take the slots
that the chosen fillings give to that length. No task sees more than its own pieces and the table of fillings.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, batches_of, give_back, running_sum, written

Filling = tuple[tuple[int, int], ...]  # (length, copies), largest first

#: Below this (Latin-1) a code point needs no normalisation, and lower-casing does not depend on its neighbours.
_PLAIN = 0x100
_letters = "".join(re.escape(chr(c)) for c in range(_PLAIN) if unicodedata.category(chr(c))[0] == "L")
_numbers = "".join(re.escape(chr(c)) for c in range(_PLAIN) if unicodedata.category(chr(c))[0] == "N")
_WORDS = re.compile(rf"[{_letters}]+|[{_numbers}]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0{_letters}{_numbers}]+")
#: A Python worker remembers the ids of up to so many words, and of as many before them, of which those that come again are kept.
REMEMBERED = 150_000
#: Bytes of documents that go to a Python worker at once.
BATCH_BYTES = 2 << 20


class WordTokenizer:
    """Token ids of whole texts, as bytes of little-endian unsigned 32-bit ids.

    The tokenizer splits a text into words and codes each by itself, the last token of a word ending in a mark of its
    own. So the codes of a word are kept and reused; new words are coded together, a space between them, and told apart
    by that mark. Texts with characters outside the plain range, and texts with the content of an added token, which the
    tokenizer looks for before it splits words, go through the tokenizer as they are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        give_back()  # what reading the file took
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        mark = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if mark and token.endswith(mark)]] = True
        added = {t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content}
        self.added = re.compile("|".join(map(re.escape, sorted(added))) or "(?!)")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, words: list[str]) -> None:
        joined = " ".join(words)
        ids = self.whole(joined)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if stops.size != len(words) or self.added.search(joined):  # a word that the tokenizer splits, or words that make an added token
            self.known.update((w, self.whole(w).tobytes()) for w in words)
            return
        codes, stops = ids.tobytes(), (4 * stops).tolist()
        self.known.update((w, codes[a:b]) for w, a, b in zip(words, [0, *stops[:-1]], stops, strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.remembered:
            self.before, self.known = self.known, {}
        out: list[bytes | None] = [None] * len(texts)
        words, codes, new = {}, {}, {}
        for i, text in enumerate(texts):
            if not text.isascii():
                try:
                    text.encode("latin-1")
                except UnicodeEncodeError:
                    out[i] = self.whole(text).tobytes()
                    continue
            lower = text.lower()
            if self.added.search(lower):
                out[i] = self.whole(text).tobytes()
                continue
            words[i] = _WORDS.findall(lower)
            codes[i] = list(map(self.known.get, words[i]))
            if None in codes[i]:
                new[i] = [k for k, c in enumerate(codes[i]) if c is None]
        if new:
            missing = dict.fromkeys(words[i][k] for i, places in new.items() for k in places)
            self.known.update((w, self.before[w]) for w in missing if w in self.before)
            unknown = [w for w in missing if w not in self.before]
            if unknown:
                self.learn(unknown)
            for i, places in new.items():
                own, coded = words[i], codes[i]
                for k in places:
                    coded[k] = self.known[own[k]]
        for i, coded in codes.items():
            out[i] = b"".join(coded)
        return out


_tokenizers: dict[tuple[str, int], WordTokenizer] = {}


def _tokenizer(path: str, remembered: int) -> WordTokenizer:
    """This process's tokenizer. A worker's tasks share it by way of this module: what a task unpickles has globals of its own."""
    if (path, remembered) not in _tokenizers:
        _tokenizers[path, remembered] = WordTokenizer(path, remembered)
    return _tokenizers[path, remembered]


def _forget() -> None:
    """Drops this process's tokenizers, with the words that they remember."""
    if _tokenizers:
        _tokenizers.clear()
        give_back()


def _pieces(path: str, capacity: int, with_ids: bool, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenize = _tokenizer(path, remembered)
        for batch in batches_of(batches, 64):
            out: list[tuple] = []
            coded = tokenize([text or "" for text in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids += b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of each document: its ids by the tokenizer, then id 0, cut every ``capacity`` ids."""
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(tokenizer, capacity, with_ids, remembered), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    )


class _Left:
    """How many pieces of each length are left, and which lengths there are as bits."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.bits = sum(1 << n for n in self.counts)

    def largest(self, room: int) -> int:
        """The largest length up to ``room``, or 0."""
        return (self.bits & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 and self.bits & ((1 << (room + 1)) - 2) else 0

    def take(self, filling: Filling, times: int) -> None:
        for n, copies in filling:
            self.counts[n] -= copies * times
            if not self.counts[n]:
                del self.counts[n]
                self.bits &= ~(1 << n)

    def put_back(self, filling: Filling, times: int) -> None:
        for n, copies in filling:
            self.counts[n] = self.counts.get(n, 0) + copies * times
            self.bits |= 1 << n


def fillings(left: _Left, capacity: int, wanted: int = 3, nodes: int = 400) -> list[Filling]:
    """Undominated fillings with the largest length left, least waste first, at most ``wanted``.

    A set of lengths whose sum is no more than one length that is there is dominated by that length: it could be put
    in its place. The enumeration goes from large to small, so what comes first is best fit; it ends when enough
    fillings without waste are found, or after so many nodes.
    """
    top = left.largest(capacity)
    used = {top: 1}
    found: dict[Filling, int] = {}
    steps = 0

    def search(room: int, most: int, floor: int, filled: int) -> None:
        nonlocal steps
        steps += 1
        n = left.largest(min(room, most))
        while n and used.get(n, 0) >= left.counts[n]:
            n = left.largest(n - 1)
        if not n:
            if filled > floor or not found:
                key = tuple(sorted(used.items(), reverse=True))
                found.setdefault(tuple((k, c) for k, c in key if c), room)
            return
        best = n
        while n:
            if used.get(n, 0) < left.counts[n]:
                used[n] = used.get(n, 0) + 1
                search(room - n, n, floor if n == best else max(floor, filled + best), filled + n)
                used[n] -= 1
                if n == room:  # nothing else fills this room better
                    return
            if steps >= nodes or sum(w == 0 for w in found.values()) >= wanted:
                return
            n = left.largest(n - 1)

    search(capacity - top, capacity, -1, 0)
    return [f for f, _ in sorted(found.items(), key=lambda x: x[1])[:wanted]]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts of lengths: each length goes to the fullest sequences that take it."""
    open_: dict[int, dict[Filling, int]] = {}  # by room left
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in open_ if r >= n), default=None)
            if room is None:
                per = min(capacity // n, left)
                times = left // per
                open_.setdefault(capacity - n * per, {})
                group = open_[capacity - n * per]
                group[((n, per),)] = group.get(((n, per),), 0) + times
                left -= per * times
                continue
            filling, times = next(iter(open_[room].items()))
            per = min(room // n, left)
            moved = min(times, left // per)
            group = open_[room]
            group[filling] -= moved
            if not group[filling]:
                del group[filling]
                if not group:
                    del open_[room]
            new = open_.setdefault(room - n * per, {})
            new[(*filling, (n, per))] = new.get((*filling, (n, per)), 0) + moved
            left -= per * moved
    return [(f, t) for group in open_.values() for f, t in group.items()]


def fewest_possible(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's lower bound of the sequences.

    For a length a up to half the capacity: pieces over capacity - a are alone, those over half are one to a sequence, and
    the pieces from a to half must go into the room beside these or into sequences of their own. The best a counts.
    """
    n = np.zeros(capacity + 1, dtype=np.int64)
    for length, times in counts.items():
        n[length] = times
    number, tokens = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    least = -(-int(tokens[-1]) // capacity)
    for a in range(1, half + 1):
        if a > 1 and not n[a] and not n[capacity - a + 1]:
            continue
        middle, middle_tokens = number[capacity - a] - number[half], tokens[capacity - a] - tokens[half]
        rest = tokens[half] - tokens[a - 1] - (middle * capacity - middle_tokens)
        least = max(least, int(number[-1] - number[half] + max(0, -(-rest // capacity))))
    return least


def completed(counts: dict[int, int], capacity: int, nodes: int = 20_000, widest: int = 12) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used, in as few sequences as the search finds.

    Depth-first branch and bound; a branch ends when its sequences, and what the rest needs at least, are no fewer than
    the best solution has, which at first is best fit's. Each node has a branch for each of its best fillings, taken as often as the
    counts allow. While the lower bound isn't met, the search begins anew with twice as many fillings a node, up to
    ``widest``, and now also takes a filling half as often, or once. It stops at the lower bound, or after ``nodes`` nodes.
    """
    best = best_fit(counts, capacity)
    fewest, least, width, spent = sum(t for _, t in best), fewest_possible(counts, capacity), 3, 0
    total = sum(n * c for n, c in counts.items())
    while fewest > least and width <= widest and spent < nodes:
        # Each entry: how many fillings come before its own, its own and how often, the tokens left and the sequences made after it.
        stack = [(0, (), 0, total, 0)]
        left, taken = _Left(counts), []  # one table for the branch at hand; what was taken is put back on the way to another
        limit = spent + (nodes - spent) // 2 if 2 * width <= widest else nodes
        while stack and fewest > least and spent < limit:
            spent += 1
            depth, filling, times, tokens, made = stack.pop()
            if made + -(-tokens // capacity) >= fewest:
                continue
            while len(taken) > depth:
                left.put_back(*taken.pop())
            left.take(filling, times)
            taken.append((filling, times))
            if not left.counts:
                fewest, best = made, taken[:0:-1]  # without the root's empty one
                continue
            branches = []
            for filling in fillings(left, capacity, width, 130 * width):
                most = min(left.counts[n] // c for n, c in filling)
                branches += [(filling, t) for t in ({most} if width == 3 else {most, max(1, most // 2), 1})]
            # Least waste, taken most often, is looked at first.
            branches.sort(key=lambda b: (sum(n * c for n, c in b[0]), b[1]))
            for filling, times in branches:
                stack.append((len(taken), filling, times, tokens - times * sum(n * c for n, c in filling), made + times))
        width *= 2
    return best


def _slots(plan: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """For each length a row per filling with it: first slot, copies, first sequence, offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for n, copies in filling:
            rows.setdefault(n, []).append((taken.get(n, 0), copies, sequence, offset))
            taken[n] = taken.get(n, 0) + copies * times
            offset += n * copies
        sequence += times
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def _placed(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()  # all pieces are made; the same workers serve now
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            number = batch.column(names.index("number")).to_numpy()
            sequence, offset = np.zeros(length.size, dtype=np.int64), np.zeros(length.size, dtype=np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                table = slots.value[int(n)]
                row = table[np.searchsorted(table[:, 0], number[own], side="right") - 1]
                inside = number[own] - row[:, 0]
                sequence[own] = row[:, 2] + inside // row[:, 1]
                offset[own] = row[:, 3] + inside % row[:, 1] * n
            kept = [i for i, name in enumerate(names) if name != "number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], names=[*(names[i] for i in kept), "sequence_id", "offset"]
            )

    return run


def packed(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = True, nodes: int = 20_000, widest: int = 12, remembered: int = REMEMBERED
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Needs doc_id and text; more columns are ignored. Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and with ``with_ids`` the piece's ids as bytes. A null or empty text is the id 0 alone; only
    documents of over ``capacity`` ids are cut. Repeated rows are packed each. An empty table gives no rows. ``nodes`` and
    ``widest`` bound the search (see ``completed``), not the documents; ``gap`` tells how far the packing may be from the best.
    ``remembered`` is how many words' ids a worker keeps, for speed alone.
    """
    spark = docs.sparkSession
    made = pieces(docs, tokenizer, capacity, with_ids, remembered)
    with batch_bytes(spark, BATCH_BYTES):
        made = written(made if with_ids else made.drop("ids"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.sparkContext.broadcast(_slots(completed(counts, capacity, nodes, widest)))
    buckets = max(1, max(counts.values(), default=0) // 20_000)
    spread = F.xxhash64("doc_id", "piece")
    numbered = running_sum(made, ["length"], [F.col(c) for c in ("doc_id", "piece", "ids_crc32")], F.lit(1), spread, buckets, "number")
    numbered = numbered.select(*made.columns, "number")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema) + ", sequence_id long, offset long"
    return numbered.mapInArrow(_placed(slots), schema)



def gap(packed_rows: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """Of a packing: the sequences that it has, and the fewest that any can have by the lower bound."""
    counts = {r["length"]: r["n"] for r in packed_rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    return packed_rows.select("sequence_id").distinct().count(), fewest_possible(counts, capacity)
