"""Substring dedup by difference-cover anchors.

Short windows are hashed only where the place in the document, modulo PERIOD, is
in COVER. Any two places have a common shift below PERIOD that brings both onto
COVER, so that two equal long windows always share an anchor at an equal distance
from their starts. Windows around anchors that occur twice are then extended to
their whole length and compared as such.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text
from .rounds import ASKED, BASES, Rolling, answer, answers_of, asked, asked_table, batched, columns, from_planes, groups

#: A perfect difference set: every residue is the difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20
ANCHOR = WINDOW - PERIOD + 1

KEPT = "doc_id long, n_words long, n_removed long, kept string"


class Batch:
    """The words of a batch in a row, with hashes of anchors and windows."""

    def __init__(self, table: pa.Table):
        self.ids, texts = columns(table)
        self.words = [t.split() for t in texts]  # bytes split at space and 9 to 13
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.first[-1])
        values = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(self.words)), np.uint64, n)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        place, end = np.arange(n) - self.first[self.owner], self.first[self.owner + 1]
        self.at = np.arange(n)
        self.starts = self.at[self.at + WINDOW <= end]
        cover = np.isin(np.arange(PERIOD), COVER)
        long_enough = sizes[self.owner] >= WINDOW
        self.anchors = self.at[cover[place % PERIOD] & (self.at + ANCHOR <= end) & long_enough]
        self.hash = [Rolling(values, b) for b in BASES]
        self.cores, self.core_of, self.core_count = np.unique(self.hash[0].of(self.anchors, self.anchors + ANCHOR), return_inverse=True, return_counts=True)

    def candidates(self, elsewhere: np.ndarray) -> None:
        """Keeps the windows that hold an anchor that occurs twice, and hashes them; ties go to the earliest place."""
        again = np.zeros(len(self.at) + 1, np.int64)
        again[self.anchors + 1] = (elsewhere | (self.core_count > 1))[self.core_of]
        again = np.cumsum(again)
        self.starts = self.starts[again[self.starts + PERIOD] > again[self.starts]]
        h, g = [r.of(self.starts, self.starts + WINDOW) for r in self.hash]
        g = (g >> np.uint64(32)).astype(np.uint32)
        order, number = groups(self.starts, g, h)
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]) if len(order) else np.zeros(0, bool)
        self.order, self.number = order, np.cumsum(new) - 1
        self.head = order[new]  # the earliest window of each key, keys in order
        self.keys, self.checks = h[self.head], g[self.head]
        ids = np.array([-(1 << 63) if i is None else i for i in self.ids], np.int64)
        self.key_ids = ids[self.owner[self.starts[self.head]]]

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """Which words a window covers that starts earlier as well."""
        late = earlier[self.number] if len(self.number) else np.zeros(0, bool)
        first = np.zeros(len(self.order), bool)
        first[np.searchsorted(self.number, np.arange(len(self.head)))] = True
        hit = self.starts[self.order[late | ~first]]
        steps = np.zeros(len(self.at) + 1, np.int64)
        np.add.at(steps, hit, 1)
        np.add.at(steps, hit + WINDOW, -1)
        return np.cumsum(steps)[:-1] > 0


def seen_elsewhere(kind: int, owner: np.ndarray, batches: np.ndarray, keys: np.ndarray, more: list[bytes]) -> np.ndarray:
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[back] > 1


def seen_earlier(kind: int, owner: np.ndarray, batches: np.ndarray, keys: np.ndarray, more: list[bytes]) -> np.ndarray:
    """Another batch has the key at a smaller doc_id; batches never have a doc_id in common."""
    checks, ids = [], []
    for m in more:
        n = len(m) // 12
        checks.append(from_planes(m[: 4 * n], np.uint32)), ids.append(from_planes(m[4 * n :], np.int64))
    checks, ids = np.concatenate(checks), np.concatenate(ids)
    order = np.lexsort((ids, checks, keys))
    new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])])
    least = ids[order][new][np.cumsum(new) - 1]
    out = np.zeros(len(keys), bool)
    out[order] = ids[order] > least
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """KEPT: the words of each document that no window covers which also starts earlier.

    Words are what stands between spaces and the characters 9 to 13; a window is 20
    consecutive words of a document. Earlier means a smaller doc_id, or an earlier
    start in the same document; a null id comes first, and rows that repeat an id
    follow each other in order of text. Windows are judged on the input. Null or
    empty text: no words. Other columns are not read. batch_bytes bounds what one
    task call holds, long single texts aside.
    """
    base = keyed_text(docs, id_col, text_col)
    dealt, buckets = batched(base, F.col("text"), batch_bytes)

    def name_anchors(table: pa.Table) -> pa.Table:
        return asked_table(asked(table["batch"][0].as_py(), 0, Batch(table).cores, [], buckets))

    def name_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return asked_table([])
        batch = Batch(table)
        batch.candidates(answers_of(answers, 0, batch.cores, buckets)[:, 0])
        rows = asked(table["batch"][0].as_py(), 1, batch.keys, [batch.checks, batch.key_ids], buckets)
        return asked_table(rows)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        batch = Batch(table)
        batch.candidates(answers_of(answers, 0, batch.cores, buckets)[:, 0])
        gone = batch.removed(answers_of(answers, 1, batch.keys, buckets)[:, 0])
        rows = []
        for k, words in enumerate(batch.words):
            out = gone[batch.first[k] : batch.first[k + 1]]
            kept = [w for w, g in zip(words, out.tolist(), strict=True) if not g] if out.any() else words
            rows.append((batch.ids[k], len(words), int(out.sum()), b" ".join(kept).decode()))
        return pa.table({f.name: pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)}, schema)

    by_batch = dealt.groupBy("batch")
    anchors = answer(by_batch.applyInArrow(name_anchors, ASKED), seen_elsewhere)
    windows = answer(by_batch.cogroup(anchors.groupBy("batch")).applyInArrow(name_windows, ASKED), seen_earlier)
    return by_batch.cogroup(anchors.unionByName(windows).groupBy("batch")).applyInArrow(cut, KEPT)
