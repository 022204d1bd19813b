"""Joins, dedup and set operators beyond the built-in ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.scan import placed
from tidelake.operators.storage import Scratch, bounded, ensure_checkpoint_dir


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str], missing: str = "reason") -> DataFrame:
    """Left rows with a right row's values; where there is none, nulls and the reason "not found". Right keys are unique."""
    side = right.select(*on, *values, F.lit(True).alias("__hit"))
    return left.join(side, list(on), "left").withColumn(missing, F.when(F.col("__hit").isNull(), "not found")).drop("__hit")


def lookup_one(left: DataFrame, index: DataFrame, on: Sequence[str], values: Sequence[str], missing: str = "reason") -> DataFrame:
    """As lookup(), for an index whose keys may repeat: a target with several entries gets none of them, and the reason "ambiguous"."""
    side = index.groupBy(*on).agg(*[F.first(v).alias(v) for v in values], F.count("*").alias("__n"))
    found = left.join(side, list(on), "left").withColumn(missing, F.when(F.col("__n").isNull(), "not found").when(F.col("__n") > 1, "ambiguous"))
    return found.withColumns({v: F.when(F.col("__n") == 1, F.col(v)) for v in values}).drop("__n")


def paired(base: DataFrame, other: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of both sides by key with other - base of each value as delta_*."""
    a = base.select(*on, *[F.col(v).alias(f"base_{v}") for v in values])
    b = other.select(*on, *[F.col(v).alias(f"other_{v}") for v in values])
    return a.join(b, list(on)).withColumns({f"delta_{v}": F.col(f"other_{v}") - F.col(f"base_{v}") for v in values})


def pareto_2d(df: DataFrame, by: Sequence[str], smaller: str, larger: str) -> DataFrame:
    """Rows that no row of their group dominates: at most as much of one, at least as much of the other, better in one.

    One sort per group: a row stands if its `larger` is the best of its own
    `smaller` and above every row of less.
    """
    w = Window.partitionBy(*by).orderBy(smaller)
    less = F.max("__top").over(w.rowsBetween(Window.unboundedPreceding, -1))
    tops = df.groupBy(*by, smaller).agg(F.max(larger).alias("__top"))
    ahead = tops.withColumn("__less", less).where(F.col("__less").isNull() | (F.col("__top") > F.col("__less")))
    keys = [*by, smaller]
    return df.join(ahead.select(*keys, "__top"), keys).where(F.col(larger) == F.col("__top")).drop("__top")


def best(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in a full order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")


def dedup_counted(df: DataFrame, key: Sequence[str], keep: str, name: str = "n") -> DataFrame:
    """One row a key: its least `keep` and how many rows it stands for."""
    return df.groupBy(*key).agg(F.min(keep).alias(keep), F.count("*").alias(name))


def closure(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(ancestor, node, depth) of all pairs that edges lead to; the least depth, self pairs of cycles left out.

    Paths double in each round, so rounds follow the logarithm of the longest path;
    only paths found in the last round are led on. Parents may be of any type that
    can be compared, structs too.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    with Scratch(edges.sparkSession) as scratch:
        new = scratch.store(edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("node")).distinct().withColumn("depth", F.lit(1)))
        done = new
        while not new.isEmpty():
            longer = new.alias("x").join(done.alias("y"), F.col("x.node") == F.col("y.ancestor")).select(F.col("x.ancestor").alias("ancestor"), F.col("y.node").alias("node"), (F.col("x.depth") + F.col("y.depth")).alias("depth"))
            new = scratch.store(longer.groupBy("ancestor", "node").agg(F.min("depth").alias("depth")).join(done.select("ancestor", "node"), ["ancestor", "node"], "left_anti"))
            done = scratch.store(done.unionByName(new))
        return done.checkpoint().where("ancestor != node")


def shared_prefix(a: DataFrame, b: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """by, n_a, n_b, shared: how many first rows of two runs agree, row by row in order, nulls being equal; runs may differ in length."""
    w = Window.partitionBy(*by).orderBy(*order)
    side = lambda df, s: df.select(*by, F.row_number().over(w).alias("__k"), F.struct(value).alias(s))
    both = side(a, "__a").join(side(b, "__b"), [*by, "__k"], "full")
    differ = F.min(F.when(~F.coalesce(F.col("__a").eqNullSafe(F.col("__b")), F.lit(False)), F.col("__k")))
    sums = both.groupBy(*by).agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), differ.alias("__d"))
    return sums.select(*by, "n_a", "n_b", F.coalesce(F.col("__d") - 1, F.col("n_a")).cast("long").alias("shared"))


def aligned(a: DataFrame, b: DataFrame, by: Sequence[str], time: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows of a with the value of b's row of the same group and time, of groups whose times are the same on both sides, each once; groups that differ in one time are left out whole."""
    key = [*by, *time]
    side = b.groupBy(*key).agg(F.first(value).alias(name), F.count("*").alias("__nb"))
    both = a.withColumn("__na", F.lit(True)).join(side, key, "full")
    twice = F.count("*").over(Window.partitionBy(*key)) > 1
    wrong = both.withColumn("__w", F.col("__na").isNull() | F.col("__nb").isNull() | (F.col("__nb") > 1) | twice)
    whole = wrong.groupBy(*by).agg(F.bool_or("__w").alias("__w")).where("NOT __w").select(*by)
    return wrong.drop("__w", "__na", "__nb").join(whole, list(by), "left_semi")


def inverse_distance(near: DataFrame, items: DataFrame, item_id: str, value: str, name: str) -> DataFrame:
    """query and the mean of its near items' values, weighted by 1 / distance^2; at distance 0 the mean of those items alone. near as of nearest()."""
    known = near.join(items.select(F.col(item_id).alias("item"), F.col(value).alias("__v")), "item")
    at = F.avg(F.when(F.col("distance") == 0, F.col("__v")))
    w = F.when(F.col("distance") > 0, 1 / (F.col("distance") * F.col("distance")))
    return known.groupBy("query").agg(F.coalesce(at, F.sum(w * F.col("__v")) / F.sum(w)).alias(name))


def bracket(axis: DataFrame, points: DataFrame, at: str, period: float | None = None) -> DataFrame:
    """points with lo, hi and w: the axis values on both sides and the share of hi; clipped at the ends, or going round where the axis has a period.

    axis has one column of few distinct values, MOST_STEPS at most; it goes to every task as one array.
    """
    known = axis.select(F.col(axis.columns[0]).cast("double").alias("v")).distinct().agg(F.array_sort(F.collect_set("v")).alias("__axis")).select(bounded("__axis").alias("__axis"))
    both = points.join(F.broadcast(known))  # one row
    x = F.pmod(F.col(at).cast("double"), F.lit(period)) if period else F.col(at).cast("double")
    below, above = F.array_max(F.filter("__axis", lambda v: v <= x)), F.array_min(F.filter("__axis", lambda v: v > x))
    first, last = F.array_min("__axis"), F.array_max("__axis")
    lo, hi = F.coalesce(below, last if period else first), F.coalesce(above, first if period else last)
    gap = F.pmod(hi - lo, F.lit(period)) if period else hi - lo
    part = F.pmod(x - lo, F.lit(period)) if period else x - lo
    return both.withColumns({"lo": lo, "hi": hi, "w": F.when(gap > 0, F.greatest(part, F.lit(0.0)) / F.when(gap > 0, gap)).otherwise(0.0)}).drop("__axis")


#: Queries and items that one task holds against each other, and pairs worked out at once (of which an array takes 8 MB).
_ASKED, _HELD, _PAIRS = 4096, 16384, 1 << 20


def nearest(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, vector: str, k: int) -> DataFrame:
    """(query, item, distance, rank) of each query's k nearest items by Euclidean distance, ties by item id; exact.

    Blocks of queries meet blocks of items, as many as the tables need: all pairs are
    bounded by a product of matrices, and those that can be among the k nearest of their
    block are worked out in full. A distance to or from a null vector, one with nulls or
    one of another length is null, and comes last; NaN comes before it.
    """
    blocks = lambda df, size: max(-(-df.count() // size), 1)
    n, m = blocks(queries, _ASKED), blocks(items, _HELD)
    dealt = lambda df, key, name, mine, own, all_, other: df.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("__v"), F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(all_ - 1))).alias(other))
    a = dealt(queries, query_id, "query", "__a", n, m, "__b")
    b = dealt(items, item_id, "item", "__b", m, n, "__a")
    kinds = dict(queries.dtypes)[query_id], dict(items.dtypes)[item_id]

    def compared(asking: pa.Table, there: pa.Table) -> pa.Table:
        out = []
        if len(asking) and len(there):
            names, ids = asking["query"].to_numpy(zero_copy_only=False), there["item"].to_numpy(zero_copy_only=False)
            axes = int(np.median([len(v) for v in there["__v"].to_pylist()[:100] if v is not None] or [0]))
            (p, odd_p), (q, odd_q) = (_matrix(t["__v"], axes) for t in (asking, there))
            by_id = np.argsort(ids, kind="stable")
            ids, q, odd_q = ids[by_id], q[by_id], odd_q[by_id]
            # Where a number is not finite no product bounds a distance, and the pair is worked out.
            plain = np.where(np.isfinite(q), q, 0.0)
            squares, wild = (plain * plain).sum(1), ~np.isfinite(q).all(1)
            step, last = max(_PAIRS // len(ids), 1), min(k - 1 + int(wild.sum()), len(ids) - 1)
            # What rounding can move a square by, in parts of the numbers that it comes from.
            rounding, some = 2e-12 * (axes + 8), max(_PAIRS // max(axes, 1), 1)
            for first in range(0, len(names), step):
                part, odd = p[first : first + step], odd_p[first : first + step, None]
                same = names[first : first + step, None] == ids
                tame = np.where(np.isfinite(part), part, 0.0)
                own = (tame * tame).sum(1)[:, None]
                near = own + squares - 2 * (tame @ plain.T)
                near[:, wild] = -np.inf
                near[:, odd_q] = np.inf
                near[same] = np.inf
                limit = np.partition(near, last, axis=1)[:, last, None] + rounding * (own + squares.max())
                limit[~np.isfinite(part).all(1)] = np.inf
                rows, at = np.nonzero((near <= limit) & ~(same | odd_q | odd))
                for c in range(0, len(rows), some):
                    r, i = rows[c : c + some], at[c : c + some]
                    total = np.zeros(len(r))
                    for x in range(axes):
                        gap = part[r, x] - q[i, x]
                        total += gap * gap
                    out.append((first + r, i, np.sqrt(total), np.zeros(len(r), bool)))
                if odd.any() or odd_q.any():
                    # Of null distances the first k by id are enough.
                    missing = (odd_q | odd) & ~same
                    rows, at = np.nonzero(missing & (np.cumsum(missing, axis=1) <= k))
                    out.append((first + rows, at, np.zeros(len(rows)), np.ones(len(rows), bool)))
        if not out:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
        query, item, d, none = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((item, d, none, query))
        query, item, d, none = query[order], item[order], d[order], none[order]
        good = np.arange(len(query)) - np.searchsorted(query, query) < k
        take = lambda column, at: column.combine_chunks().take(pa.array(at))
        item = by_id[item[good]] if len(query) else item
        return pa.table({"query": take(asking["query"], query[good]), "item": take(there["item"], item), "distance": pa.array(d[good], mask=none[good])})

    local = a.groupBy("__a", "__b").cogroup(b.groupBy("__a", "__b")).applyInArrow(compared, f"query {kinds[0]}, item {kinds[1]}, distance double")
    by = F.row_number().over(Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "item"))
    return local.withColumn("rank", by).where(F.col("rank") <= k).select("query", "item", "distance", "rank")


def _matrix(vectors: pa.ChunkedArray, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """[vectors, axes], and which are null, hold nulls or are of another length; these are zeros."""
    v = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    odd = size != axes
    held = v.filter(pa.array(~odd))
    out = np.zeros((len(v), axes))
    if axes:
        flat = held.flatten()
        out[~odd] = flat.to_numpy(zero_copy_only=False).reshape(-1, axes)
        empty = np.zeros(len(v), bool)
        empty[~odd] = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, axes).any(1)
        odd |= empty
        out[odd] = 0.0
    return out, odd


def overlapping_pairs(df: DataFrame, by: Sequence[str], key: str, low: str, high: str, width: float) -> DataFrame:
    """(by, a, b) of rows whose open intervals meet, a < b; rows are dealt by bins of `width`."""
    binned = df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    x, y = binned.alias("x"), binned.alias("y")
    same = (F.col("x.__bin") == F.col("y.__bin")) & (F.col(f"x.{key}") < F.col(f"y.{key}")) & (F.col(f"x.{low}") < F.col(f"y.{high}")) & (F.col(f"y.{low}") < F.col(f"x.{high}"))
    for c in by:
        same &= F.col(f"x.{c}") == F.col(f"y.{c}")
    first = F.col("x.__bin") == F.floor(F.greatest(f"x.{low}", f"y.{low}") / width)
    return x.join(y, same).where(first).select(*[F.col(f"x.{c}").alias(c) for c in by], F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b"))


def fair_share(df: DataFrame, by: Sequence[str], key: str, demand: str, capacity: int, name: str = "granted") -> DataFrame:
    """Max-min fair grants in whole units of `capacity` to each group's demands (whole, null counts as 0): small demands are met, the others get equal shares, and what is left over goes one each to the first of those by key.

    The level is found among a group's different demands, and places among those that
    are not met are counted by ranges of the key, so no group meets in one task.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with Scratch(df.sparkSession) as scratch:
        rows = scratch.store(df.withColumn("__d", F.greatest(F.coalesce(F.col(demand).cast("long"), F.lit(0)), F.lit(0))))
        values = rows.groupBy(*by, "__d").agg(F.count("*").alias("__n"))
        w = Window.partitionBy(*by).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
        spent, met = F.coalesce(F.sum(F.col("__d") * F.col("__n")).over(w), F.lit(0)), F.coalesce(F.sum("__n").over(w), F.lit(0))
        levels = values.withColumns({"__rest": int(capacity) - spent, "__left": F.sum("__n").over(Window.partitionBy(*by)) - met})
        # Demands are met as long as every one that is no smaller could have as much.
        short = levels.where("__d * __left > __rest").groupBy(*by).agg(F.min_by(F.struct("__rest", "__left"), "__d").alias("__l"), F.min("__d").alias("__from"))
        both = scratch.store(rows.join(short, list(by), "left"))
        open_ = both.where("__d >= __from")
        shared = placed(open_, by, [key], scratch).withColumn(name, F.expr("__l.__rest DIV __l.__left") + (F.col("__place") < F.expr("__l.__rest % __l.__left")).cast("long")).drop("__place")
        rest = both.where("__from IS NULL OR __d < __from").withColumn(name, F.col("__d"))
        return shared.unionByName(rest).drop("__d", "__l", "__from").checkpoint()


def pareto_front(df: DataFrame, by: Sequence[str], smaller: str, larger: Sequence[str], block_points: int = 2048) -> DataFrame:
    """Rows that no row of their group dominates: at most as much of one, at least as much of each other, better in one. Rows with a null there are left out.

    Rows are brought down to different points. Blocks of about block_points points by hash
    drop what their own points dominate, again and again in other blocks as long as that
    drops a tenth of them; only what is then left is held against a whole group.
    """
    axes = [smaller, *larger]

    def undominated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        a, b = rows.alias("a"), rows.alias("b")
        at_least = F.col(f"b.{smaller}") <= F.col(f"a.{smaller}")
        better = F.col(f"b.{smaller}") < F.col(f"a.{smaller}")
        for c in larger:
            at_least &= F.col(f"b.{c}") >= F.col(f"a.{c}")
            better |= F.col(f"b.{c}") > F.col(f"a.{c}")
        return a.join(b, _all([F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]) & at_least & better, "left_anti")

    ensure_checkpoint_dir(df.sparkSession)
    with Scratch(df.sparkSession) as scratch:
        points = scratch.store(df.select(*by, *axes).dropna(subset=axes).distinct())
        left, before, turn = points.count(), None, 0
        while left > block_points and (before is None or left < 0.9 * before):
            block = F.pmod(F.xxhash64(F.lit(turn), *axes), F.lit(-(-left // block_points)))
            points = scratch.store(undominated(points.withColumn("__block", block), [*by, "__block"]).drop("__block"))
            left, before, turn = points.count(), left, turn + 1
        front = scratch.store(undominated(points, by)).withColumnsRenamed({c: f"__{c}" for c in [*by, *axes]})
        return df.join(front, _all([F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, *axes]]), "left_semi").checkpoint()


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out


def box_overlaps(boxes: DataFrame, id_col: str, axes: Sequence[tuple[str, str]], cell: float) -> DataFrame:
    """(a, b), a < b, of boxes that overlap strictly on all axes (low, high).

    A box lies in every cell of the first two axes that it reaches; a pair is taken in
    the cell where the overlap begins, so once. cell is about the extent of a box: the
    rows of a box follow its extent, the pairs looked at the density of a cell.
    """
    edges = [F.floor(F.col(c) / cell).cast("long") for pair in axes[:2] for c in pair]
    cells = boxes.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"{s}{k}") for k, pair in enumerate(axes) for s, c in zip(("l", "h"), pair, strict=True)], F.explode(F.sequence(edges[0], edges[1])).alias("cx"), *([F.sequence(edges[2], edges[3]).alias("ys")] if len(axes) > 1 else []))
    cells = cells.withColumn("cy", F.explode("ys")).drop("ys") if len(axes) > 1 else cells.withColumn("cy", F.lit(0))
    a, b = cells.alias("a"), cells.alias("b")
    over = [F.col("a.cx") == F.col("b.cx"), F.col("a.cy") == F.col("b.cy"), F.col("a.id") < F.col("b.id")]
    for k in range(len(axes)):
        over += [F.col(f"a.l{k}") < F.col(f"b.h{k}"), F.col(f"b.l{k}") < F.col(f"a.h{k}")]
    for k, c in enumerate(("cx", "cy")[: len(axes)]):
        over.append(F.col(f"a.{c}") == F.floor(F.greatest(f"a.l{k}", f"b.l{k}") / cell))
    return a.join(b, _all(over)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def upsert(stored: DataFrame, fresh: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys of both sides with stored values, and fresh ones where there is none or it is null; origin: stored, filled or added."""
    a = stored.select(*on, *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(True).alias("__ina"))
    b = fresh.select(*on, *[F.col(v).alias(f"__b_{v}") for v in values])
    filled = F.lit(False)
    for v in values:
        filled |= F.col(f"__a_{v}").isNull() & F.col(f"__b_{v}").isNotNull()
    origin = F.when(F.col("__ina").isNull(), "added").when(filled, "filled").otherwise("stored")
    return a.join(b, list(on), "full").select(*on, *[F.coalesce(f"__a_{v}", f"__b_{v}").alias(v) for v in values], origin.alias("origin"))


def interpolated(points: DataFrame, grid: DataFrame, key: str, axes: Mapping[str, float | None], value: str, name: str) -> DataFrame:
    """key and the value between the grid's corners around each point, linear on every axis; null where a corner that counts is missing.

    axes maps columns that both sides have to a period, or None where the axis ends and
    points beyond it take its end. Grid values of an axis with a period lie in [0, period);
    every axis has few values. A point makes at most 2^axes rows.
    """
    out = points.select(key, *axes).withColumn("__w", F.lit(1.0))
    for a, period in axes.items():
        both = bracket(grid.select(a), out, a, period)
        ends = F.array(F.struct(F.col("lo").alias("at"), (1 - F.col("w")).alias("part")), F.struct(F.col("hi").alias("at"), F.col("w").alias("part")))
        kept = [c for c in out.columns if c not in (a, "__w")]
        out = both.select(*kept, "__w", F.explode(ends).alias("__e")).where("__e.part > 0").select(*kept, F.col("__e.at").alias(a), (F.col("__w") * F.col("__e.part")).alias("__w"))
    corners = grid.select(*[F.col(a).cast("double").alias(a) for a in axes], F.col(value).alias("__v"))
    rows = out.join(corners, list(axes), "left").groupBy(key)
    return rows.agg(F.when(F.count("__v") == F.count("*"), F.sum(F.col("__w") * F.col("__v"))).alias(name))
