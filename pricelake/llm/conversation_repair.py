"""Cheapest repair of conversations: a dynamic programme over all conversations of a bucket at once, turn by turn.

Rows are sorted over the cluster and cut into blocks, mostly a conversation each; a conversation that is long, or that two
partitions share, has several. Blocks of like length form tensors with time first. Backwards, each turn's row updates the
costs of all blocks and all states of the role grammar at once, and the costs are kept; forwards, the edits of all blocks
are read off them. For a conversation of several blocks a block's costs are a matrix from entry to exit state; running
products over the blocks tell each block the costs behind it and the state it is entered in, so no task holds a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, written

#: A block has at most so many rows and, but for its last row, bytes of text; a tensor so many cells.
BLOCK_ROWS, BLOCK_BYTES, CELLS = 4096, 1_000_000, 1 << 18
RETITLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5

# States: nothing yet, after the system's turn, after a user's, after an assistant's. The grammar is (s?(ua)+)?
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])  # the state after the turn of user or assistant that fits
_OTHER = 3  # code of an initial that is not s, u or a
_KEEP = np.full((4, 4), -1)
_KEEP[_NONE, 0], _KEEP[_NONE, 1], _KEEP[_SYSTEM, 1], _KEEP[_ASSISTANT, 1], _KEEP[_USER, 2] = _SYSTEM, _USER, _USER, _USER, _ASSISTANT
_FAR = np.int64(1) << np.int64(60)
_ENDED = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)  # what is still to be inserted at a conversation's end
_FINE, _BLANK, _REPEATED, _TRUNCATED = range(4)

_BLOCK = "conv_id long, inner boolean, turns array<long>, roles array<string>, texts array<string>"
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "conv_id long, place long, cost long, blank long, duplicate long, truncated long, illegal long, audit string, first_code int, last_code int, turns array<long>, repaired string, pieces long"
_TURNS = "conv_id long, place long, position long, edit string, role string, text string"


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` as faults of a fixed kind would leave them, by crc32 of ``conv_id:turn`` modulo 20; nulls count as one space.

    The column ``copies`` tells how often a row is there after it: 0 for a dropped one, 2 for a repeated one.
    """
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    role = F.when(code == 4, "user").otherwise(told("role"))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


# --- blocks -----------------------------------------------------------------------------------------------------------


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    a, b = column[:-1], column[1:]
    known = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return known | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def _cut(block_rows: int, block_bytes: int) -> Callable:
    """Rows in order to blocks. ``inner`` ones are whole conversations for certain: begun and ended within the partition."""

    def emit(rows: pa.RecordBatch, starts: np.ndarray, inner: np.ndarray) -> pa.RecordBatch:
        copies = rows.column(4).to_numpy(zero_copy_only=False)
        live = np.repeat(np.arange(rows.num_rows), copies)
        offsets = pa.array(np.concatenate([[0], np.cumsum(copies)])[[*starts, rows.num_rows]], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, rows.column(k).take(pa.array(live))) for k in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(starts)), pa.array(inner), *lists], names=["conv_id", "inner", "turns", "roles", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        outer, at, size = True, 0, 0  # of rest's conversation: begun elsewhere or cut, rows and bytes before rest
        for batch in batches_of(batches, 8192):
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            if not rows.num_rows:
                continue
            new = np.concatenate([[False], _differs(rows.column(0))])
            conversation = np.cumsum(new)
            first = np.concatenate([[0], np.flatnonzero(new)])
            copies = rows.column(4).to_numpy(zero_copy_only=False)
            bytes_ = pc.fill_null(pc.binary_length(rows.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64) * copies
            number, before = np.cumsum(copies) - copies, np.cumsum(bytes_) - bytes_
            number, before = number - number[first][conversation], before - before[first][conversation]
            number[conversation == 0] += at
            before[conversation == 0] += size
            block = number // block_rows + before // block_bytes
            edge = new | np.concatenate([[False], block[1:] != block[:-1]])
            starts = np.concatenate([[0], np.flatnonzero(edge)])
            if starts.size > 1:
                # A block is inner if its conversation begins with it (and isn't the partition's first) and the next one begins after it.
                begins = new[starts]
                begins[0] = not outer
                inner = begins[:-1] & new[starts[1:]]
                yield emit(rows.slice(0, starts[-1]), starts[:-1], inner)
                outer = not begins[-1]
            last = int(starts[-1])
            at, size = int(number[last]), int(before[last])
            rest = rows.slice(last)
        if rest is not None and rest.num_rows:
            yield emit(rest, np.array([0]), np.array([False]))

    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """Conversations as rows of lists, in the order of their turns (nulls first), then role and a hash of the text."""
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    rows = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("int")
    )
    rows = rows.withColumns({"hash": F.sha2("text", 256), "salt": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "hash", "salt"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut = line.select("conv_id", "turn", "role", "text", "copies").mapInArrow(_cut(BLOCK_ROWS, BLOCK_BYTES), _BLOCK)
    return written(cut.withColumn("place", F.monotonically_increasing_id()))


# --- tensors ----------------------------------------------------------------------------------------------------------


def costs(code: np.ndarray, fault: np.ndarray, length: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from before each turn to the end, by time, state and block, given that from each state at the block's end."""
    turns, blocks = code.shape
    out = np.empty((turns + 1, 4, blocks), dtype=np.int64)
    out[turns] = ends
    for t in range(turns - 1, -1, -1):
        after = out[t + 1]
        must, extra = (fault[t] == _BLANK) | (fault[t] == _REPEATED), np.where(fault[t] == _TRUNCATED, UNFINISHED, 0)
        goal = _KEEP[:, code[t]]
        kept = np.where((goal >= 0) & ~must, np.take_along_axis(after, np.maximum(goal, 0), axis=0) + extra, _FAR)
        retitled = np.where(must, _FAR, after[_NEXT] + extra + RETITLE)
        here = np.minimum(np.minimum(after + DELETE, kept), retitled)
        for _ in range(2):
            here = np.minimum(here, here[_NEXT] + INSERT)
        out[t] = np.where(t < length, np.minimum(here, _FAR), after)
    return out


def traced(code: np.ndarray, fault: np.ndarray, length: np.ndarray, cost: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits and the states after them, by block and step, and the exit states. A turn has two steps: an insert before it, and its own edit.

    Of edits that keep to the least cost, the one with the smallest letter is taken; it decides the state that follows, so
    the string of letters is the least of all.
    """
    turns, blocks = code.shape
    letters, states = np.zeros((2 * turns + 2, blocks), dtype=np.uint8), np.zeros((2 * turns + 2, blocks), dtype=np.int8)
    every = np.arange(blocks)
    for t in range(turns):
        live = t < length
        must, extra = (fault[t] == _BLANK) | (fault[t] == _REPEATED), np.where(fault[t] == _TRUNCATED, UNFINISHED, 0)
        now, after = cost[t], cost[t + 1]
        drop = after[state, every] + DELETE == now[state, every]
        put = live & ~drop & (now[_NEXT[state], every] + INSERT == now[state, every])
        letters[2 * t, put] = ord("I")
        state = np.where(put, _NEXT[state], state)
        states[2 * t] = state
        drop = live & (after[state, every] + DELETE == now[state, every])
        goal = _KEEP[state, code[t]]
        keep = live & ~drop & ~must & (goal >= 0) & (after[np.maximum(goal, 0), every] + extra == now[state, every])
        retitle = live & ~drop & ~keep
        letters[2 * t + 1] = np.select([drop, keep, retitle], [ord("D"), ord("K"), ord("R")], 0)
        state = np.where(keep, goal, np.where(retitle, _NEXT[state], state))
        states[2 * t + 1] = state
    for step in (2 * turns, 2 * turns + 1):
        put = last & ((state == _USER) | (state == _SYSTEM))
        letters[step, put] = ord("I")
        state = np.where(put, _NEXT[state], state)
        states[step] = state
    return letters.T, states.T, state


def _flags(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


class _Rows:
    """The turns of a batch of blocks, one after another: codes of initials, faults, and where each block begins."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.length = column("turns").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.block = np.repeat(np.arange(batch.num_rows), self.length)
        self.turns, self.roles, self.texts = (column(c).flatten() for c in ("turns", "roles", "texts"))
        initial = pc.index_in(pc.utf8_slice_codeunits(self.roles, 0, 1), value_set=pa.array(["s", "u", "a"]))
        self.code = _flags(pc.fill_null(initial, _OTHER)).astype(np.int64)
        blank = ~_flags(pc.match_substring_regex(self.texts, r"[^\x20\x09-\x0D]"))
        ended = _flags(pc.match_substring_regex(self.texts, r"[.!?][\x20\x09-\x0D]*\z"))
        role, text = (_flags(pc.dictionary_encode(c).indices).astype(np.int64) for c in (self.roles, self.texts))
        seen = np.stack([self.block, role, text], axis=1)
        first = np.zeros(self.block.size, dtype=bool)
        if first.size:
            first[np.unique(seen, axis=0, return_index=True)[1]] = True
        self.first = first
        repeated = ~first
        if "repeated" in batch.schema.names:  # seen in an earlier block
            told = column("repeated")
            counts = pc.fill_null(told.value_lengths(), 0).to_numpy(zero_copy_only=False)
            repeated[np.repeat(self.start, counts) + told.flatten().to_numpy(zero_copy_only=False)] = True
        self.fault = np.select([blank, repeated, ~ended], [_BLANK, _REPEATED, _TRUNCATED], _FINE)

    def count(self, which: np.ndarray) -> np.ndarray:
        return np.bincount(self.block[which], minlength=self.length.size)

    def illegal(self) -> np.ndarray:
        """How many neighbours within each block don't follow each other."""
        a, b = self.code[:-1], self.code[1:]
        fits = ((a == 0) | (a == 2)) & (b == 1) | (a == 1) & (b == 2)
        return np.bincount(self.block[1:][~fits & (self.block[1:] == self.block[:-1])], minlength=self.length.size)

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of like length, with their codes and faults by time and block."""
        order = np.argsort(self.length, kind="stable")
        at = 0
        while at < order.size:
            shortest = self.length[order[at]]
            end = int(np.searchsorted(self.length[order], 2 * shortest + 4, side="right"))
            longest = max(1, int(self.length[order[end - 1]]))
            picked = order[at : min(end, at + max(1, CELLS // longest))]
            turns = int(self.length[picked].max(initial=0))
            index = self.start[picked][None, :] + np.arange(turns)[:, None]
            inside = np.arange(turns)[:, None] < self.length[picked][None, :]
            index = np.where(inside, index, 0)
            empty = np.zeros(index.shape, dtype=np.int64)
            yield picked, self.code[index] if turns else empty, self.fault[index] if turns else empty
            at += picked.size


def _repaired(rows: _Rows, ends: np.ndarray, entry: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Costs from each block's entry to the end, and as lists by block: edits, and the roles and texts of the turns that come out."""
    cost = np.zeros(rows.length.size, dtype=np.int64)
    parts = [tuple(np.zeros(0, dtype=np.int64) for _ in range(4))]
    for picked, code, fault in rows.buckets():
        length = rows.length[picked]
        table = costs(code, fault, length, ends[:, picked])
        cost[picked] = table[0, entry[picked], np.arange(picked.size)]
        letters, states, _ = traced(code, fault, length, table, entry[picked], last[picked])
        which, step = np.nonzero(letters)
        parts.append((picked[which], step, letters[which, step], states[which, step]))
    block, step, letter, state = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(block, kind="stable")
    block, step, letter, state = block[order].astype(np.int64), step[order], letter[order], state[order]

    def listed(values: pa.Array, of: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows.length.size))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    stays = letter != ord("D")
    block_, step_, letter_, state_ = block[stays], step[stays], letter[stays], state[stays]
    source = pa.array(rows.start[block_] + step_ // 2, pa.int64(), mask=letter_ == ord("I"))
    role = pc.if_else(pa.array(letter_ == ord("K")), rows.roles.take(source), pa.array(["user", "assistant"]).take(pa.array((state_ != _USER).astype(np.int8))))
    text = pc.fill_null(rows.texts.take(source), "")
    return cost, [listed(_named(letter), block), listed(_named(letter_), block_), listed(role, block_), listed(text, block_)]


def _named(letters: np.ndarray) -> pa.Array:
    return pa.array(list("DIKR")).take(pa.array(np.searchsorted(np.frombuffer(b"DIKR", dtype=np.uint8), letters)))


def _joined(roles: pa.Array, texts: pa.Array) -> pa.Array:
    """Each block's turns as ``role:text``, a line each."""
    lines = pc.binary_join_element_wise(roles.flatten(), texts.flatten(), ":")
    return pc.binary_join(pa.ListArray.from_arrays(roles.offsets, lines), "\n")


def _turn_numbers(rows: _Rows) -> list[list[int]]:
    """[least, greatest, how many different ones] of each block's turn numbers, which are in order; empty without any."""
    at = np.flatnonzero(_flags(pc.is_valid(rows.turns)))
    block, turn = rows.block[at], _flags(rows.turns.take(pa.array(at))).astype(np.int64)
    out: list[list[int]] = [[] for _ in range(rows.length.size)]
    if at.size:
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (turn[1:] != turn[:-1])])
        different = np.bincount(block[new], minlength=rows.length.size)
        which, first = np.unique(block, return_index=True)
        for b, low, high in zip(which.tolist(), turn[first].tolist(), turn[[*(first[1:] - 1), -1]].tolist(), strict=True):
            out[b] = [low, high, int(different[b])]
    return out


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([c.cast(kinds[t]) if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


# --- whole conversations ----------------------------------------------------------------------------------------------


def _of_whole(rows: _Rows) -> tuple[np.ndarray, list[pa.Array]]:
    n = rows.length.size
    return _repaired(rows, np.repeat(_ENDED[:, None], n, axis=1), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool))


def _report_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 1024):
        rows = _Rows(batch)
        cost, (edits, _, roles, texts) = _of_whole(rows)
        gaps = [t[1] - t[0] + 1 - t[2] if t else 0 for t in _turn_numbers(rows)]
        digests = [hashlib.sha256(t.as_buffer()).hexdigest() for t in _joined(roles, texts)]
        counts = [rows.count(rows.fault == fault) for fault in (_BLANK, _REPEATED, _TRUNCATED)]
        yield _batch(_REPORT, [batch.column(0), gaps, *counts, rows.illegal(), cost, pc.binary_join(edits, ""), digests])


def _turns_of(batch: pa.RecordBatch, parts: list[pa.Array]) -> pa.RecordBatch:
    _, kinds, roles, texts = parts
    block = pa.array(np.repeat(np.arange(batch.num_rows), kinds.value_lengths().to_numpy(zero_copy_only=False)))
    place = batch.column(batch.schema.get_field_index("place"))
    position = np.arange(len(block)) - kinds.offsets.to_numpy()[:-1][block.to_numpy()]
    return _batch(_TURNS, [batch.column(0).take(block), place.take(block), position, kinds.flatten(), roles.flatten(), texts.flatten()])


def _turns_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 1024):
        yield _turns_of(batch, _of_whole(_Rows(batch))[1])


# --- conversations of several blocks ----------------------------------------------------------------------------------


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's different turns: a digest of role and text, and where the first of them is."""
    for batch in batches_of(batches, 64):
        rows = _Rows(batch)
        at = np.flatnonzero(rows.first)
        roles, texts = (c.take(pa.array(at)).to_pylist() for c in (rows.roles, rows.texts))
        keys = [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest() for r, t in zip(roles, texts, strict=True)]
        block = pa.array(rows.block[at])
        place = batch.column(batch.schema.get_field_index("place"))
        yield _batch("conv_id long, place long, at int, key binary", [batch.column(0).take(block), place.take(block), at - rows.start[rows.block[at]], keys])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's least costs from entry state (slow) to exit state (fast)."""
    for batch in batches_of(batches, 64):
        rows = _Rows(batch)
        out = np.zeros((batch.num_rows, 4, 4), dtype=np.int64)
        for picked, code, fault in rows.buckets():
            for exit_ in range(4):
                ends = np.full((4, picked.size), _FAR)
                ends[exit_] = 0
                out[picked, :, exit_] = costs(code, fault, rows.length[picked], ends)[0].T
        place = batch.column(batch.schema.get_field_index("place"))
        yield _batch("conv_id long, place long, costs array<long>", [batch.column(0), place, out.reshape(-1, 16).tolist()])


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the last to the first of a conversation: the costs from each state at the block's end."""
    before = conversation = None
    for batch in batches:
        told = []
        for conv_id, place, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            last = before is None or conv_id != conversation
            ends = _ENDED if last else before
            told.append((place, ends.tolist(), last))
            before = np.minimum((np.array(matrix).reshape(4, 4) + ends[None, :]).min(axis=1), _FAR)
            conversation = conv_id
        yield _batch("place long, ends array<long>, last boolean", list(zip(*told, strict=True)) or [[], [], []])


def _told(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _flags(batch.column(batch.schema.get_field_index(name)))


def _ends_of(batch: pa.RecordBatch) -> np.ndarray:
    ends = batch.column(batch.schema.get_field_index("ends"))
    return _flags(ends.flatten()).reshape(-1, 4).T


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each block is left in, for each state that it may be entered in."""
    for batch in batches_of(batches, 64):
        rows, ends, last = _Rows(batch), _ends_of(batch), _told(batch, "last")
        out = np.zeros((batch.num_rows, 4), dtype=np.int64)
        for picked, code, fault in rows.buckets():
            length = rows.length[picked]
            table = costs(code, fault, length, ends[:, picked])
            for entry in range(4):
                out[picked, entry] = traced(code, fault, length, table, np.full(picked.size, entry), last[picked])[2]
        place = batch.column(batch.schema.get_field_index("place"))
        yield _batch("conv_id long, place long, exits array<int>", [batch.column(0), place, out.tolist()])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the first to the last of a conversation: the state that each is entered in."""
    state = conversation = None
    for batch in batches:
        told = []
        for conv_id, place, exits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv_id != conversation:
                state = _NONE
            told.append((place, state))
            state, conversation = exits[state], conv_id
        yield _batch("place long, entry int", list(zip(*told, strict=True)) or [[], []])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 64):
        rows = _Rows(batch)
        cost, (edits, kinds, roles, texts) = _repaired(rows, _ends_of(batch), _told(batch, "entry").astype(np.int64), _told(batch, "last"))
        counts = [rows.count(rows.fault == fault) for fault in (_BLANK, _REPEATED, _TRUNCATED)]
        full = rows.length > 0
        first, last = (np.full(rows.length.size, -1) for _ in range(2))
        first[full], last[full] = rows.code[rows.start[full]], rows.code[(rows.start + rows.length - 1)[full]]
        place = batch.column(batch.schema.get_field_index("place"))
        columns = [batch.column(0), place, cost, *counts, rows.illegal(), pc.binary_join(edits, ""), first, last, _turn_numbers(rows), _joined(roles, texts), kinds.value_lengths()]
        yield _batch(_PIECE, columns)


def _turns_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 64):
        parts = _repaired(_Rows(batch), _ends_of(batch), _told(batch, "entry").astype(np.int64), _told(batch, "last"))[1]
        yield _turns_of(batch, parts)


class _Sum:
    """A conversation's report, its blocks added one by one in their order."""

    def __init__(self, conv_id: int | None, cost: int):
        self.conv_id, self.cost, self.counts, self.audit, self.code, self.turns, self.lines = conv_id, cost, [0, 0, 0, 0], [], -1, [], 0
        self.digest = hashlib.sha256()

    def add(self, counts: list[int], audit: str, first: int, last: int, turns: list[int], repaired: str, lines: int) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if first >= 0:
            self.counts[3] += self.code >= 0 and (self.code, first) not in ((0, 1), (1, 2), (2, 1))
            self.code = last
        self.audit.append(audit)
        if turns and self.turns:
            turns = [self.turns[0], turns[1], self.turns[2] + turns[2] - (self.turns[1] == turns[0])]
        self.turns = turns or self.turns
        if lines:
            self.digest.update((("\n" if self.lines else "") + repaired).encode())
            self.lines += lines

    def row(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return (self.conv_id, gaps, *self.counts, self.cost, "".join(self.audit), self.digest.hexdigest())


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to reports. A conversation's text goes by piece by piece; what is kept of it is its digest and its edits."""
    now = None
    for batch in batches_of(batches, 64):
        done = []
        for conv_id, _, cost, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                done += [now.row()] if now is not None else []
                now = _Sum(conv_id, cost)
            now.add(more[:4], *more[4:])
        if done:
            yield _batch(_REPORT, list(zip(*done, strict=True)))
    if now is not None:
        yield _batch(_REPORT, list(zip(now.row(), strict=True)))


def _in_order(frame: DataFrame, place: Column | str = "place") -> DataFrame:
    return frame.repartition("conv_id").sortWithinPartitions("conv_id", place)


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with what their own tensors don't tell: turns seen in earlier blocks, costs behind, the state of entry, and whether it is the last."""
    firsts = blocks.mapInArrow(_firsts, "conv_id long, place long, at int, key binary")
    again = firsts.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id", "key").orderBy("place"))).where("_n > 1")
    repeats = again.groupBy("place").agg(F.collect_list("at").alias("repeated"))  # at most a block's rows
    blocks = written(blocks.join(repeats, "place", "left").select("conv_id", "place", "turns", "roles", "texts", "repeated"))
    matrices = blocks.mapInArrow(_matrices, "conv_id long, place long, costs array<long>")
    behind = _in_order(matrices, F.desc("place")).mapInArrow(_behind, "place long, ends array<long>, last boolean")
    blocks = written(blocks.join(behind, "place").select("conv_id", "place", "turns", "roles", "texts", "repeated", "ends", "last"))
    entries = _in_order(blocks.mapInArrow(_exits, "conv_id long, place long, exits array<int>")).mapInArrow(_entries, "place long, entry int")
    return blocks.join(entries, "place").select(*blocks.columns, "entry")


def report(rows: DataFrame) -> DataFrame:
    """One row per conv_id with its faults, the least cost of mending it, the edits and a digest of the mended conversation.

    Needs conv_id, turn, role and text; a column ``copies`` tells how often a row counts (once without it; a conversation all of
    whose rows count 0 times is there with zeros, no edits and the digest of nothing); more columns are ignored. Null roles and
    texts are one space. Rows are in the order of turn, nulls first; of one turn by role, then a hash of the text. Rows with a
    null conv_id are one conversation. An empty table gives an empty result.

    The digest of a conversation of several blocks is read through by one task, piece by piece: SHA-256 can't be divided.
    """
    blocks = _blocks(rows)
    whole = blocks.where("inner").select("conv_id", "turns", "roles", "texts").mapInArrow(_report_whole, _REPORT)
    pieces = _placed(blocks.where("NOT inner")).mapInArrow(_pieces, _PIECE)
    return whole.union(_in_order(pieces).mapInArrow(_summed, _REPORT))


def repaired(rows: DataFrame) -> DataFrame:
    """The mended conversations, a row per turn: conv_id, place and position (to sort by), edit (K, R or I), role and text."""
    blocks = _blocks(rows)
    whole = blocks.where("inner").select("conv_id", "turns", "roles", "texts", "place").mapInArrow(_turns_whole, _TURNS)
    return whole.union(_placed(blocks.where("NOT inner")).mapInArrow(_turns_pieces, _TURNS))
