"""Suffix-array dedup: a radix sort of suffixes that looks no deeper than the threshold.

Only the order of suffixes up to their first LENGTH bytes matters, and of that only
which suffixes are equal so far: groups that are equal after the last pass are
exactly the repeated windows. The passes go from the most significant digit on,
each within the groups of the one before, and a suffix alone in its group leaves:

1. the digit is the least of the window's ANCHOR-byte hashes, with its distance from
   the start. Neighbouring suffixes mostly have the same least hash, so they are kept
   as one run, with one question for the run;
2. the digit is what all windows of a piece of a run, PIECE starts, have in common. A
   piece whose whole neighbourhood, the union of its windows, occurs twice is
   settled: all its windows do;
3. the digit is the rest of the window, for the starts of pieces still open.

Of equal unions and windows the one at the least doc_id, and there the leftmost, is the
first; what all others cover has an earlier copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text
from .rounds import ASKED, BASES, Rolling, answer, answers_of, asked, asked_table, batched, columns, from_planes, groups, mixed

LENGTH = 400
ANCHOR = 128
PIECE = 32
#: Starts worked on at once when least hashes are looked for; a place in them has 24 bits.
SEGMENT = 1 << 20

CUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, n_later long"
_ANCHORS, _UNIONS, _COMMON, _WINDOWS = range(4)
_LOW = np.uint64((1 << 24) - 1)
#: What each byte counts as in hashes.
CODES = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, in time linear in len(x)."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Batch:
    """The bytes of a batch in a row, and the runs of its window starts."""

    def __init__(self, table: pa.Table):
        self.number = table["batch"][0].as_py()
        self.ids, self.texts = columns(table)
        self.order = np.array([-(1 << 63) if i is None else i for i in self.ids], np.int64)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.values = CODES[data]
        self.hash = [Rolling(self.values, BASES[0])]
        # Window starts, document by document, lie where LENGTH bytes are left.
        room = np.zeros(len(data) + 1, np.int64)
        fits = np.flatnonzero(sizes >= LENGTH)
        room[self.first[fits]] += 1
        np.add.at(room, self.first[fits + 1] - LENGTH + 1, -1)
        starts = np.flatnonzero(np.cumsum(room)[:-1])
        anchor = self.anchors(starts, len(data))
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(starts) else np.zeros(0, np.int64)
        self.anchor, self.low = anchor[new], starts[new]
        self.high = starts[np.append(new[1:], len(starts))[: len(new)] - 1] if len(new) else self.low
        self.cores, self.core_of, self.core_count = np.unique(self.hash[0].of(self.anchor, self.anchor + ANCHOR), return_inverse=True, return_counts=True)

    def anchors(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Where the least hash of each start's window begins, the leftmost of equals."""
        out = np.zeros(len(starts), np.int64)
        width = LENGTH - ANCHOR + 1
        for lo in range(0, n, SEGMENT):
            a, b = np.searchsorted(starts, [lo, lo + SEGMENT])
            if b == a:
                continue
            value = self.hash[0].windows(lo, min(n, lo + SEGMENT + LENGTH) - ANCHOR + 1, ANCHOR)
            value &= ~_LOW
            value |= np.arange(len(value), dtype=np.uint64)
            out[a:b] = lo + (sliding_least(value, width)[starts[a:b] - lo] & _LOW).astype(np.int64)
        return out

    def keys(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits that tell byte strings apart, sorted with duplicates: what is mixed in besides is salt."""
        h, g = [r.of(start, end) for r in self.hash]
        return mixed(h + mixed(salt.astype(np.uint64) + np.uint64(1))), (g >> np.uint64(32)).astype(np.uint32)

    def cut_pieces(self, elsewhere: np.ndarray) -> None:
        """Pieces of the runs whose anchor occurs twice, with the keys of their unions and common parts."""
        self.hash.append(Rolling(self.values, BASES[1]))
        runs = np.flatnonzero((elsewhere | (self.core_count > 1))[self.core_of])
        p, lo, hi = self.anchor[runs], self.low[runs], self.high[runs]
        j0, j1 = (p - hi) // PIECE, (p - lo) // PIECE
        many = j1 - j0 + 1
        of = np.repeat(np.arange(len(runs)), many)
        j = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + j0[of]
        p = p[of]
        self.piece_low = np.maximum(lo[of], p - PIECE * j - PIECE + 1)
        self.piece_high = np.minimum(hi[of], p - PIECE * j)
        doc = np.searchsorted(self.first, p, "right") - 1
        left, right = p - PIECE * j - PIECE + 1, p - PIECE * j + LENGTH
        a, b = np.maximum(left, self.first[doc]), np.minimum(right, self.first[doc + 1])
        self.union = Keys(*self.keys(a, b, j * 1_000_000 + (a - left) * 1000 + (right - b)))
        c = p - PIECE * j
        self.union_ids = self.order[doc[self.union.head]]
        self.common = Keys(*self.keys(c, c + LENGTH - PIECE + 1, j))
        # One union for each common part, or 0 where the batch has several.
        u = self.union.place[self.common.head]
        one = np.ones(len(self.common.head), bool)
        np.logical_and.at(one, self.common.place, self.union.place == u[self.common.place])
        h = self.union.keys[u]
        self.one_union = np.where(one, (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1), 0).astype(np.uint32)

    def open_windows(self, unions: np.ndarray, mixed_common: np.ndarray) -> None:
        """Settles pieces whose union occurs twice; lists the windows of those that are open."""
        self.settled = ((self.union.count > 1) | unions[:, 0])[self.union.place]
        self.stands = np.zeros(len(self.union.place), bool)  # the first piece of each union
        self.stands[self.union.head] = unions[:, 1]
        ask = (mixed_common | (self.one_union == 0))[self.common.place] & (~self.settled | self.stands)
        lo, hi = self.piece_low[ask], self.piece_high[ask]
        many = hi - lo + 1
        self.open = np.sort(np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many))
        self.window = Keys(*self.keys(self.open, self.open + LENGTH, np.zeros(len(self.open))))
        self.window_ids = self.order[np.searchsorted(self.first, self.open[self.window.head], "right") - 1]

    def covered(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes a repeated window covers, and which one that also starts earlier."""
        first = np.zeros(len(self.open), bool)
        first[self.window.head] = windows[:, 1]
        # All windows of a first piece are first themselves, but for those that are open.
        repeated = self.union_of(self.settled, self.open[((self.window.count > 1) | windows[:, 0])[self.window.place]])
        return repeated, self.union_of(self.settled & ~self.stands, self.open[~first])

    def union_of(self, pieces: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which bytes the windows of these pieces and at these starts cover."""
        steps = np.zeros(int(self.first[-1]) + 1, np.int64)
        np.add.at(steps, self.piece_low[pieces], 1)
        np.add.at(steps, self.piece_high[pieces] + LENGTH, -1)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + LENGTH, -1)
        return np.cumsum(steps)[:-1] > 0


class Keys:
    """Distinct (key, check) in order; place: where each row's is; head: a row of each; count: rows of each."""

    def __init__(self, keys: np.ndarray, checks: np.ndarray):
        order, number = groups(checks, keys)
        new = np.flatnonzero(np.diff(number, prepend=-1)) if len(order) else np.zeros(0, np.int64)
        self.head = order[new]
        self.keys, self.checks = keys[self.head], checks[self.head]
        self.count = np.diff(np.append(new, len(order)))
        self.place = np.zeros(len(order), np.int64)
        self.place[order] = number


def reply(kind: int, owner: np.ndarray, batches: np.ndarray, keys: np.ndarray, more: list[bytes]) -> np.ndarray:
    """Anchors: in another batch too? Unions and windows: that, and is the least id in this batch? Common parts: of several unions?"""
    if kind == _ANCHORS:
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        return count[back] > 1
    second = np.dtype(np.uint32 if kind == _COMMON else np.int64)
    cut = [4 * (len(m) // (4 + second.itemsize)) for m in more]
    checks = np.concatenate([from_planes(m[:c], np.uint32) for m, c in zip(more, cut, strict=True)])
    last = np.concatenate([from_planes(m[c:], second) for m, c in zip(more, cut, strict=True)])
    order, number = groups(last, checks, keys)
    value = last[order]
    same = np.zeros(len(order), bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    group = np.cumsum(~same) - 1
    first = np.flatnonzero(~same)
    size = np.diff(np.append(first, len(order)))
    out = np.zeros((len(order), 2), bool)
    if kind == _COMMON:
        several = (value[first] == 0) | (value[first + size - 1] != value[first])
        out[order, 0] = several[group] & (size[group] > 0)
        return out[:, 0]
    out[order, 0], out[order, 1] = size[group] > 1, ~same
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """CUT: what is left of each document without bytes covered by a repeated window, and the spans taken out.

    A window is LENGTH bytes of a document's UTF-8; it is repeated where the same
    bytes start anywhere else, in the same document too and overlapping too. Windows
    are judged on the input. Spans are maximal, by start, ends exclusive. kept may
    break characters, so it is binary. Null or empty text: no bytes, no spans. Rows
    that repeat are documents like any others, so texts of LENGTH bytes or more that
    repeat go wholly. n_later counts the bytes taken out that a window covers which
    also starts earlier: at a smaller doc_id, or before in the same document; a null
    id comes first, and rows that repeat an id follow each other in order of text.
    Other columns are not read. batch_bytes bounds what one task
    call holds, long single texts aside.
    """
    base = keyed_text(docs, id_col, text_col)
    dealt, buckets = batched(base, F.col("text"), batch_bytes)

    def first_pass(table: pa.Table) -> pa.Table:
        batch = Batch(table)
        return asked_table(asked(batch.number, _ANCHORS, batch.cores, [], buckets))

    def pieces(table: pa.Table, answers: pa.Table) -> Batch:
        batch = Batch(table)
        batch.cut_pieces(answers_of(answers, _ANCHORS, batch.cores, buckets)[:, 0])
        return batch

    def second_pass(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return asked_table([])
        batch = pieces(table, answers)
        rows = asked(batch.number, _UNIONS, batch.union.keys, [batch.union.checks, batch.union_ids], buckets)
        return asked_table(rows + asked(batch.number, _COMMON, batch.common.keys, [batch.common.checks, batch.one_union], buckets))

    def windows(table: pa.Table, answers: pa.Table) -> Batch:
        batch = pieces(table, answers)
        batch.open_windows(answers_of(answers, _UNIONS, batch.union.keys, buckets, 2), answers_of(answers, _COMMON, batch.common.keys, buckets)[:, 0])
        return batch

    def third_pass(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return asked_table([])
        batch = windows(table, answers)
        return asked_table(asked(batch.number, _WINDOWS, batch.window.keys, [batch.window.checks, batch.window_ids], buckets))

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary()), ("n_later", pa.int64())])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        batch = windows(table, answers)
        gone, later = batch.covered(answers_of(answers, _WINDOWS, batch.window.keys, buckets, 2))
        rows = []
        for k, text in enumerate(batch.texts):
            out = gone[batch.first[k] : batch.first[k + 1]]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8))).tolist()
            spans = list(zip(turns[::2], turns[1::2], strict=True))
            kept = b"".join(text[a:b] for a, b in zip([0, *turns[1::2]], [*turns[::2], len(text)], strict=True)) if spans else text
            rows.append((batch.ids[k], len(text), [{"start": a, "end": b} for a, b in spans], kept, int(later[batch.first[k] : batch.first[k + 1]].sum())))
        return pa.table({f.name: pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)}, schema)

    by_batch = dealt.groupBy("batch")
    one = answer(by_batch.applyInArrow(first_pass, ASKED), reply)
    two = one.unionByName(answer(by_batch.cogroup(one.groupBy("batch")).applyInArrow(second_pass, ASKED), reply))
    three = two.unionByName(answer(by_batch.cogroup(two.groupBy("batch")).applyInArrow(third_pass, ASKED), reply))
    return by_batch.cogroup(three.groupBy("batch")).applyInArrow(cut, CUT)
