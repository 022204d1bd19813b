"""Benchmark decontamination by spaced-seed hashing.

A mask such as 11011011 hashes the tokens under its ones and ignores the others,
so that a hit survives a substituted token under a zero (Ma, Tromp & Li,
Bioinformatics 2002). Hits of training windows on benchmark windows give the
diagonals to look at; each is verified token by token, allowing substitutions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keyed_text

#: Every stretch of 13 or more tokens of which 80 % are equal has a hit of one of these.
MASKS = ("11011011", "1110010111", "1011101101", "110001000111", "1110101001")
#: The same for items of 5 to 15 tokens, by their number; shorter items must be equal throughout.
SHORT_MASKS = {
    5: ("111", "1101"), 6: ("111", "1101"), 7: ("11011", "1111"), 8: ("111011", "11111", "110111"), 9: ("1111011", "1101111", "111111"),
    10: ("111011", "11010011", "11111"), 11: ("111011", "11010011", "11111"), 12: ("111011", "11010011", "11111"), 13: ("111011", "11010011"),
    14: ("11101011", "101100111", "111111"), 15: ("111011", "11111"),
}
#: Gained by an equal token, lost by a substituted one: a stretch pays off while about four fifths agree.
MATCH, MISMATCH = 1, -4

_TOKEN = re.compile(r"\w+")
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)

HITS = "doc_id long, item_id long, doc_start int, item_start int, n_tokens int, n_equal int"


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def mask_offsets(length: int) -> list[np.ndarray]:
    """Offsets under the ones of each mask of an item of so many tokens; one of under 5 has one mask of all its tokens."""
    masks = ("1" * length,) if length < min(SHORT_MASKS) else SHORT_MASKS.get(length, MASKS)
    return [np.array([k for k, c in enumerate(m) if c == "1"]) for m in masks]


def first_hash(offsets: np.ndarray) -> np.uint64:
    """What hashes of a mask begin with, so that masks differ."""
    return np.uint64((len(offsets) * 0x9FB21C651E98DF25 + int(offsets[-1])) % (1 << 64))


def seed_hashes(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of the tokens under the mask for every start; ids are uint64."""
    n = len(ids) - int(offsets[-1])
    out = np.full(max(n, 0), first_hash(offsets))
    if n > 0:
        for k, at in enumerate(offsets):
            out = (out ^ (ids[at : at + n] * _PRIMES[k])) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def aligned(a: np.ndarray, b: np.ndarray, diagonal: int, least: int, share: float) -> tuple[int, int, int, int] | None:
    """(start in a, start in b, tokens, equal tokens) of the best stretch of a[i] against b[i - diagonal], if long and equal enough."""
    lo, hi = max(0, diagonal), min(len(a), len(b) + diagonal)
    if hi - lo < least:
        return None
    same = a[lo:hi] == b[lo - diagonal : hi - diagonal]
    sums = np.concatenate([[0], np.cumsum(np.where(same, MATCH, MISMATCH))])
    low = np.minimum.accumulate(sums)
    end = int((sums - low).argmax())
    start = int(sums[: end + 1].argmin())
    size, equal = end - start, int(same[start:end].sum())
    if size < least or equal < share * size:
        return None
    return lo + start, lo + start - diagonal, size, equal


def longest(a: np.ndarray, b: np.ndarray, diagonal: int, least: int, share: float) -> tuple[int, int, int, int] | None:
    """As aligned(), of the longest stretch that is long and equal enough (ties: more equal tokens, then the earliest)."""
    lo, hi = max(0, diagonal), min(len(a), len(b) + diagonal)
    if hi - lo < least:
        return None
    same = a[lo:hi] == b[lo - diagonal : hi - diagonal]
    part = Fraction(str(share))  # in whole numbers, so that exactly `share` is enough
    sums = np.concatenate([[0], np.cumsum(np.where(same, part.denominator - part.numerator, -part.numerator))])
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums)  # the leftmost place whose sum is not above that of the end
    sizes = np.arange(len(sums)) - starts
    size = int(sizes.max())
    if not size or size < least:
        return None
    ends = np.flatnonzero(sizes == size)
    start = int(ends[(sums[ends] - sums[ends - size]).argmax()]) - size
    return lo + start, lo + start - diagonal, size, int(same[start : start + size].sum())


#: Ways to look at a diagonal: the top-scoring stretch only, or every stretch.
STRETCHES: dict[str, Callable[[np.ndarray, np.ndarray, int, int, float], tuple[int, int, int, int] | None]] = {"top": aligned, "longest": longest}


class Index:
    """Benchmark items as token ids, and their seeds in order of hash."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        hashes, owners, places, kinds = [], [], [], []
        self.offsets: list[np.ndarray] = []
        known: dict[tuple, int] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)], np.uint64)
            if not len(ids):
                continue
            self.items.append((item_id, ids))
            for offsets in mask_offsets(len(ids)):
                kind = known.setdefault(tuple(offsets), len(known))
                if kind == len(self.offsets):
                    self.offsets.append(offsets)
                h = seed_hashes(ids, offsets)
                hashes.append(h), kinds.append(np.full(len(h), kind)), owners.append(np.full(len(h), len(self.items) - 1)), places.append(np.arange(len(h)))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        h, k = cat(hashes, np.uint64), cat(kinds, np.int64)
        order = np.lexsort((h, k))
        self.bounds = np.searchsorted(k[order], np.arange(len(self.offsets) + 1))
        self.hashes, self.owners, self.places = h[order], cat(owners, np.int64)[order], cat(places, np.int64)[order]

    def overlaps(self, text: str, least: int, share: float, stretch: str = "longest") -> list[tuple[int, int, int, int, int]]:
        """(item, doc start, item start, tokens, equal tokens) of the best verified stretch with each item."""
        get = self.vocabulary.get
        ids = np.array([get(t, 0) for t in tokens(text)], np.uint64)
        known = ids > 0
        if not known.any():
            return []
        found: set[tuple[int, int]] = set()
        for kind, offsets in enumerate(self.offsets):
            n = len(ids) - int(offsets[-1])
            if n <= 0:
                continue
            at = np.flatnonzero(known[:n])
            for o in offsets[1:]:  # a seed of the benchmark holds benchmark words only
                at = at[known[at + o]]
                if not len(at):
                    break
            if not len(at):
                continue
            h = np.full(len(at), first_hash(offsets))
            for k, o in enumerate(offsets):
                h = (h ^ (ids[at + o] * _PRIMES[k])) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            own = self.hashes[self.bounds[kind] : self.bounds[kind + 1]]
            lo, hi = np.searchsorted(own, h), np.searchsorted(own, h, "right")
            for q in np.flatnonzero(hi > lo):
                for r in range(self.bounds[kind] + lo[q], self.bounds[kind] + hi[q]):
                    found.add((int(self.owners[r]), int(at[q] - self.places[r])))
        best: dict[int, tuple] = {}
        for owner, diagonal in sorted(found):
            item_id, item = self.items[owner]
            if hit := STRETCHES[stretch](ids, item, diagonal, enough(len(item), least, share), share):
                rank = (hit[2], hit[3], -hit[0])
                if item_id not in best or rank > best[item_id][0]:
                    best[item_id] = (rank, hit)
        return [(item, *hit) for item, (_, hit) in sorted(best.items())]


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, broadcast_chars: int = 4 << 20, broadcast_items: int = 1 << 16, stretch: str = "longest") -> DataFrame:
    """One row for each document and benchmark item that share a stretch: HITS.

    A stretch has `least` tokens or more, or `share` of a shorter item's, of which
    `share` are equal at equal distance; the longest is reported (ties: more equal
    tokens, then the earliest). None is missed for a least of 13 or more and a share of
    0.8 or more; with stretch "top" only the best-scoring one (MATCH, MISMATCH) of each
    diagonal is looked at, which is faster and misses some. Very long texts are
    read whole, one at a time. The benchmark goes to every executor where it has
    at most broadcast_chars characters in at most broadcast_items rows, else seeds
    are joined by a shuffle with the same result. Null or empty texts on either
    side share nothing. Rows that repeat give rows that repeat on the training
    side; items with equal ids count as one, the best of them is reported.
    """
    bounded_batches(docs.sparkSession)
    docs, items = keyed_text(docs), keyed_text(benchmark, "item_id").withColumnRenamed("doc_id", "item_id")
    index = small_index(items, broadcast_chars, broadcast_items)
    if index is None:
        return overlaps_by_shuffle(docs, items, least, share, stretch)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch["doc_id"].astype(object), batch["text"], strict=True) for hit in index.overlaps(text, least, share, stretch)]
            yield as_hits(rows)

    return docs.mapInPandas(found, HITS)


def small_index(items: DataFrame, broadcast_chars: int, broadcast_items: int) -> Index | None:
    """The benchmark's index, if its size allows to hold it in every worker."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count("*").alias("n")).first()
    if size["chars"] > broadcast_chars or size["n"] > broadcast_items:
        return None
    return Index([tuple(r) for r in items.orderBy(*items.columns).collect()])


def enough(length: int, least: int, share: float) -> int:
    return min(least, math.ceil(share * length))


def as_hits(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"], dtype=object)
    for c in out.columns:
        out[c] = out[c].map(lambda v: None if v is None or v != v else int(v)).astype("Int64")
    return out


def overlaps_by_shuffle(docs: DataFrame, items: DataFrame, least: int, share: float, stretch: str = "longest") -> DataFrame:
    """As overlaps(), for a benchmark of any size: seeds of both sides meet by hash.

    Seeds of training windows that no benchmark window has leave in the join; a
    frequent seed is one row a document, mask and place, split by AQE's skew join.
    Documents are keyed by id and text, so that equal ids stay apart.
    """
    token_ids = lambda text: np.array([xxhash.xxh64_intdigest(t) for t in tokens(text)], np.uint64)

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [min(len(tokens(t)), max(SHORT_MASKS) + 1) for t in batch["text"]]})

    sizes = [r["n"] for r in items.select("text").mapInPandas(lengths, "n int").where("n > 0").distinct().collect()]
    kinds_of_items = [np.array(o) for o in sorted({tuple(map(int, o)) for n in sizes for o in mask_offsets(n)})]

    def seeds(batches: Iterator[pd.DataFrame], every_kind: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                ids = token_ids(text)
                kinds = kinds_of_items if every_kind else mask_offsets(len(ids)) if len(ids) else []
                for offsets in kinds:
                    h = seed_hashes(ids, offsets).view(np.int64)
                    out.append(pd.DataFrame({"key": key, "seed": h, "place": np.arange(len(h))}))
            yield pd.concat(out) if out else pd.DataFrame({"key": [], "seed": [], "place": []})

    schema = "key string, seed long, place int"
    key = lambda i: F.sha2(F.concat_ws(" ", F.coalesce(F.col(i).cast("string"), F.lit("null")), "text"), 256)
    left, right = docs.withColumn("key", key("doc_id")), items.withColumn("key", key("item_id")).dropDuplicates(["key"])
    ours = left.dropDuplicates(["key"]).select("key", "text").mapInPandas(lambda b: seeds(b, True), schema)
    theirs = right.select("key", "text").mapInPandas(lambda b: seeds(b, False), schema).withColumnsRenamed({"key": "item_key", "place": "item_place"})
    # Both texts go once to a pair, with all its diagonals; a pair has at most as many as both texts have tokens.
    met = ours.join(theirs, "seed").select("key", "item_key", (F.col("place") - F.col("item_place")).alias("diagonal"))
    pairs = met.groupBy("key", "item_key").agg(F.collect_set("diagonal").alias("diagonals"))
    both = pairs.join(left.select("key", "doc_id", F.col("text").alias("doc_text")), "key").join(right.select(F.col("key").alias("item_key"), "item_id", F.col("text").alias("item_text")), "item_key")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, item, diagonals, a, b in zip(batch["doc_id"].astype(object), batch["item_id"].astype(object), batch["diagonals"], batch["doc_text"], batch["item_text"], strict=True):
                x, y = token_ids(a), token_ids(b)
                for diagonal in map(int, diagonals):
                    if hit := STRETCHES[stretch](x, y, diagonal, enough(len(y), least, share), share):
                        rows.append((doc, item, *hit))
            yield as_hits(rows)

    hits = both.mapInPandas(verified, HITS)
    rank = F.struct("n_tokens", "n_equal", -F.col("doc_start"), "item_start")
    best = hits.groupBy("doc_id", "item_id").agg(F.max(rank).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b")["col3"]).cast("int").alias("doc_start"), F.col("b.item_start"), F.col("b.n_tokens"), F.col("b.n_equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, broadcast_chars: int = 4 << 20, broadcast_items: int = 1 << 16, stretch: str = "longest") -> DataFrame:
    """docs without the rows that share a stretch with a benchmark item, as overlaps() finds it; other columns stay as they are."""
    bounded_batches(docs.sparkSession)
    index = small_index(keyed_text(benchmark, "item_id"), broadcast_chars, broadcast_items)
    if index is not None:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            return pd.Series([not shared.value.overlaps(t or "", least, share, stretch) for t in texts], dtype=bool)

        return docs.where(clean(F.coalesce("text", F.lit(""))))
    bad = overlaps(docs, benchmark, least, share, broadcast_chars, broadcast_items, stretch).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")
