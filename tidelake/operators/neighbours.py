"""Nearest neighbours on scaled axes, exact, of which most pairs are never compared.

Halving along the widest axis deals items to cells of some thousands, whose number grows with
the items; a query's k-th nearest of a sample is a first bound, and only cells that reach into
it are asked. There the same halving leaves boxes of a few items, and again only those within
the bound are compared, so that a query's work hardly grows with the items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An axis: "linear", "log", or the period of one that goes round; and the least span that it is scaled by.
Axis = tuple[str | float, float]


def on_axes(items: DataFrame, axes: Mapping[str, Axis], *others: DataFrame, name: str = "__at") -> tuple[list[DataFrame], list[float | None]]:
    """[items, *others] with an array of coordinates, and the period of each, all in spans of the items.

    A row with a null coordinate, or one on a log axis that is not above 0, is left out.
    """

    def plain(c: str) -> Column:
        kind, v = axes[c][0], F.col(c).cast("double")
        return F.when(v > 0, F.log(v)) if kind == "log" else v if kind == "linear" else F.pmod(v, F.lit(float(kind)))

    ends = items.agg(*[f(plain(c)).alias(f"{n}{k}") for k, c in enumerate(axes) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    spans = [max((ends[f"hi{k}"] or 0) - (ends[f"lo{k}"] or 0), axes[c][1]) for k, c in enumerate(axes)]
    at = F.array(*[plain(c) / s for c, s in zip(axes, spans, strict=True)])
    out = [df.withColumn(name, at).where(F.forall(name, lambda x: x.isNotNull())) for df in (items, *others)]
    return out, [None if isinstance(axes[c][0], str) else axes[c][0] / s for c, s in zip(axes, spans, strict=True)]


def distance(a: Column, b: Column, periods: Sequence[float | None] | None = None) -> Column:
    """Euclidean distance of arrays, the short way round on axes with a period."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if periods and any(periods):
        gaps = F.zip_with(gaps, F.array(*[F.lit(p).cast("double") for p in periods]), lambda d, p: F.when(p.isNull(), d).otherwise(F.least(d, p - d)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, d: s + d * d))


@dataclass(frozen=True)
class Halves:
    """Points halved along their widest axis until a node has `most` of them at most, or equal ones only.

    order: of the points by leaf. By node: axis (-1: a leaf), cut, children (below holds what
    is at most the cut), and the range of order that it holds. lo and hi: what a node can hold.
    """

    order: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    parent: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, most: int, lo: np.ndarray, hi: np.ndarray) -> Halves:
        order, nodes, left = np.arange(len(points)), [[-1, 0.0, -1, -1, -1, 0, len(points), lo, hi]], [0]
        while left:
            at = left.pop()
            start, stop, low, high = nodes[at][5:]
            block = points[order[start:stop]]
            span = block.max(0) - block.min(0) if stop > start else np.zeros(1)
            k = int(span.argmax())
            if stop - start <= most or not span[k] > 0:
                continue
            by = np.argsort(block[:, k], kind="stable")
            order[start:stop] = order[start:stop][by]
            values = block[by, k]
            cut = values[(len(values) - 1) // 2]
            if cut == values[-1]:
                cut = values[np.searchsorted(values, cut) - 1]
            middle = start + int(np.searchsorted(values, cut, "right"))
            first, second = high.copy(), low.copy()
            first[k] = second[k] = cut
            nodes[at][:4] = k, cut, len(nodes), len(nodes) + 1
            left += [len(nodes), len(nodes) + 1]
            nodes += [[-1, 0.0, -1, -1, at, start, middle, low, first], [-1, 0.0, -1, -1, at, middle, stop, second, high]]
        return cls(order, *[np.array(x) for x in zip(*nodes, strict=True)])

    def leaves(self, points: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The node that each point falls to; nodes of which `last` is true are not looked into."""
        node, open_ = np.zeros(len(points), np.int64), np.arange(len(points))
        while len(open_):
            at = node[open_]
            open_, at = open_[~last[at]], at[~last[at]]
            node[open_] = np.where(points[open_, self.axis[at]] <= self.cut[at], self.below[at], self.above[at])
        return node


def _outside(points: np.ndarray, lo: np.ndarray, hi: np.ndarray, periods: Sequence[float | None]) -> np.ndarray:
    """How far points are from boxes, at least."""
    total = 0.0
    for k, p in enumerate(periods):
        x = points[..., k]
        gap = np.maximum(np.maximum(lo[..., k] - x, x - hi[..., k]), 0)
        for turned in (x - p, x + p) if p else ():
            gap = np.minimum(gap, np.maximum(np.maximum(lo[..., k] - turned, turned - hi[..., k]), 0))
        total = total + gap * gap
    return np.sqrt(total)


def _apart(a: np.ndarray, b: np.ndarray, periods: Sequence[float | None]) -> np.ndarray:
    """distance() of points."""
    total = 0.0
    for k, p in enumerate(periods):
        gap = np.abs(a[..., k] - b[..., k])
        gap = np.minimum(gap, p - gap) if p else gap
        total = total + gap * gap
    return np.sqrt(total)


def _points(column: pa.ChunkedArray | pa.Array, axes: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, axes)


#: Items of a cell that one task looks at together, and of a box in it.
_CELL, _BOX = 4096, 16
#: Numbers in the sample of vectors that goes to the driver and every task (8 MB).
_SAMPLED = 1 << 20


def nearest_pruned(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, vector: str, k: int, periods: Sequence[float | None] | None = None, same: bool = True, sample: int = 256) -> DataFrame:
    """(query, item, distance, rank, compared): each query's k nearest items, ties (to twelve decimals) by item; compared is how many items its distance was worked out to.

    same: ids are of one table, and an item is not its own neighbour. Vectors are of one
    length; those with a null or non-finite coordinate take no part. A sample, of an eighth
    of the items and `sample` vectors at least and 2^20 numbers at most, goes to the driver
    and every task; it only sets bounds. Of equal vectors only those that can count are dealt.
    """
    wanted = k + same
    whole = F.forall("__v", lambda x: x.isNotNull() & (F.abs(x) < math.inf))
    taken = lambda df, key, name: df.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("__v")).where(F.col("__v").isNotNull() & whole)
    held, asked = taken(items, item_id, "item"), taken(queries, query_id, "query")
    some = held.select(F.size("__v").alias("n")).first()
    if not some:
        return asked.select("query").limit(0).join(held.select("item"), F.lit(False)).select("query", "item", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("compared"))
    axes = some.n
    turns = [float(p) if p else None for p in periods or [None] * axes]
    ends = held.agg(F.count("*").alias("n"), *[f(F.col("__v")[c]).alias(f"{name}{c}") for c in range(axes) for f, name in ((F.min, "lo"), (F.max, "hi"))]).first()
    most = min(max(_SAMPLED // axes, 1), max(sample, ends.n // 8))
    drawn = _points(held.where(F.pmod(F.xxhash64("item"), F.lit(max(ends.n // most, 1))) == 0).select("__v").toArrow()["__v"], axes)
    lo, hi = (np.array([ends[f"{name}{c}"] for c in range(axes)], float) for name in ("lo", "hi"))
    tree = Halves.of(drawn, max(16, 4 * wanted), lo, hi)
    drawn, sizes = drawn[tree.order], tree.stop - tree.start
    leaf = tree.axis < 0
    cell = leaf | (sizes * ends.n <= _CELL * len(drawn))
    kinds = dict(held.dtypes) | dict(asked.dtypes)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(tree.leaves(_points(batch["__v"], axes), cell)), batch["item"], batch["__v"]], ["cell", "item", "__v"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _points(batch["__v"], axes)
            bound, node = np.full(len(at), np.inf), tree.leaves(at, leaf)
            while (short := (sizes[node] < wanted) & (node > 0)).any():
                node[short] = tree.parent[node[short]]
            by = np.argsort(node, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(node[by])) + 1):
                near = drawn[tree.start[node[own[0]]] : tree.stop[node[own[0]]]] if len(own) else drawn[:0]
                if len(near) >= wanted:
                    bound[own] = np.partition(_apart(at[own][:, None], near[None], turns), wanted - 1, axis=1)[:, wanted - 1] * (1 + 1e-9) + 1e-12
            query, node, out = np.arange(len(at)), np.zeros(len(at), np.int64), []
            while len(query):
                reached = _outside(at[query], tree.lo[node], tree.hi[node], turns) <= bound[query]
                query, node = query[reached], node[reached]
                out.append((query[cell[node]], node[cell[node]]))
                query, node = query[~cell[node]], node[~cell[node]]
                query, node = np.concatenate([query, query]), np.concatenate([tree.below[node], tree.above[node]])
            query, node = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (query, node)
            yield pa.record_batch([pa.array(node), batch["query"].take(pa.array(query)), batch["__v"].take(pa.array(query)), pa.array(bound[query])], ["cell", "query", "__v", "__b"])

    def compared(asking: pa.Table, there: pa.Table) -> pa.Table:
        names, ids, v = asking["query"].combine_chunks(), there["item"].combine_chunks(), _points(there["__v"], axes)
        at, bound, found = _points(asking["__v"], axes), asking["__b"].to_numpy(), []
        if len(v) and len(at):
            boxes = Halves.of(v, _BOX, v.min(0), v.max(0))
            v, ids = v[boxes.order], ids.take(pa.array(boxes.order))
            small = np.sort(boxes.start[boxes.axis < 0])
            count = np.diff(small, append=len(v))
            low, high = np.minimum.reduceat(v, small), np.maximum.reduceat(v, small)
            own = (names.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)) if same else None
            step = max((1 << 20) // len(v), 1)
            for first in range(0, len(at), step):
                part = at[first : first + step]
                query, box = np.nonzero(_outside(part[:, None], low[None], high[None], turns) <= bound[first : first + step, None])
                n = count[box]
                item = np.repeat(small[box] - np.cumsum(n) + n, n) + np.arange(n.sum())
                query = np.repeat(query, n)
                if same:
                    other = own[0][first + query] != own[1][item]
                    query, item = query[other], item[other]
                looked = np.bincount(query, minlength=len(part))
                d = _apart(part[query], v[item], turns)
                close = d <= bound[first + query]
                query, item, d = query[close], item[close], d[close]
                by = np.lexsort((d, query))
                query, item, d = query[by], item[by], d[by]
                begin = np.searchsorted(query, np.arange(len(part)))
                until = np.append(begin[1:], len(query))
                # Up to the k-th, and what ties with it to twelve decimals.
                limit = np.where(until - begin >= k, d[np.minimum(begin + k - 1, len(d) - 1)] if len(d) else 0.0, np.inf) + 2e-12
                good = d <= limit[query]
                found.append((first + query[good], item[good], d[good]))
                # What was looked at counts once a query, with or without a neighbour here.
                found.append((first + np.flatnonzero(looked), np.full(np.count_nonzero(looked), -1), looked[looked > 0].astype(float)))
        query, item, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        near = item >= 0
        return pa.table({"query": names.take(pa.array(query)), "item": ids.take(pa.array(item, mask=~near)), "distance": pa.array(d.astype(float), mask=~near), "seen": np.where(near, 0, d).astype(np.int64)})

    like = Window.partitionBy("__v").orderBy("item")
    counted = held.withColumn("__r", F.row_number().over(like)).where(F.col("__r") <= wanted).drop("__r")
    cells = counted.mapInArrow(dealt, f"cell long, item {kinds['item']}, __v array<double>").groupBy("cell")
    reach = asked.mapInArrow(spread, f"cell long, query {kinds['query']}, __v array<double>, __b double").groupBy("cell")
    near = reach.cogroup(cells).applyInArrow(compared, f"query {kinds['query']}, item {kinds['item']}, distance double, seen long")
    by = Window.partitionBy("query")
    ranked = near.withColumns({"rank": F.row_number().over(by.orderBy(F.col("distance").isNull(), F.round("distance", 12), "item")), "compared": F.sum("seen").over(by)})
    return ranked.where((F.col("rank") <= k) & F.col("distance").isNotNull()).select("query", "item", "distance", "rank", "compared")
