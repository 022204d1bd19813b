"""Exact top-k search by inner product, with multi-resolution segment statistics.

A vector cut into segments has in each a mean and a deviation. The distance of the
vectors of means and deviations of two vectors is a lower bound of their distance (by
Cauchy and Schwarz on what is left of each segment), and as means and deviations keep
the length of a vector, it is an upper bound of their inner product. Bounds of few
segments are cheap and loose, those of many dear and tight: they are taken coarse to
fine, each only where those before leave a chance to reach the query's k-th best score
so far, and the whole numbers are multiplied for what is left.

Queries and candidates are packed into blocks, and each block of queries meets each
block of candidates in one task. A bounded sample gives every query a first k-th best
score before, which can only be too low.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches
from .vectors import kept, packed, unpacked, whole

#: Rows of a block at most, of queries and of candidates.
QUERY_BLOCK, BLOCK = 1 << 15, 1 << 16
#: Rows of a pack, which Python makes of the rows that a task reads.
PACK = 4096
#: Bytes of the sample.
SAMPLE_BYTES = 4 << 20


def resolutions(width: int) -> list[int]:
    """How many segments each level has: 1, 4, 16 and so on, last as many as half the components."""
    out, s = [], 1
    while s < width // 2:
        out.append(s)
        s *= 4
    return [*out, width // 2] if width > 1 else []


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """[rows, 2 segments]: each segment's mean and deviation, both scaled by the square root of its length."""
    cut = np.arange(segments) * rows.shape[1] // segments
    size = np.diff(np.append(cut, rows.shape[1]))
    x = rows.astype(np.float64)
    mean = np.add.reduceat(x, cut, axis=1) / size
    rest = x - np.repeat(mean, size, axis=1)
    return np.hstack([mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, cut, axis=1))])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact; by floating point where every sum fits its 53 bits."""
    top = max(1, a.shape[1]) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, items: np.ndarray, other: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, tile: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, item, score) of each query's k best items, numbers of rows, and how many pairs were multiplied.

    Items stand in order of preference at ties; floor is a score that k items are known
    to reach; other(own, items) says which pairs may meet.
    """
    levels = resolutions(queries.shape[1])
    # Equal vectors are looked at once for the first k + 1 of them, of which one may be a query's own.
    _, which = np.unique(items, axis=0, return_inverse=True)
    by = np.argsort(which, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by)) - np.searchsorted(which[by], which[by])
    wanted = np.flatnonzero(place <= k)
    tiles = [wanted[a : a + tile] for a in range(0, len(wanted), tile)]
    known = [[statistics(items[t], s) for s in levels] for t in tiles]
    reach = [_lengths(items[t]).max() for t in tiles]
    found, multiplied = [], 0
    for b in range(0, len(queries), 256):
        x, mine, low = queries[b : b + 256], own[b : b + 256], floor[b : b + 256].copy()
        stats, length = [statistics(x, s) for s in levels], _lengths(x)
        who, item, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t, bounds, most in zip(tiles, known, reach, strict=True):
            # Bounds are rounded: a pair goes only if it is below by more than any rounding.
            least = low - 1e-9 * length * most - 1e-6
            alive, pairs = np.ones((len(x), len(t)), bool), None
            for q, c in zip(stats, bounds, strict=True):
                if np.count_nonzero(alive) > alive.size // 8 if pairs is None else False:
                    alive &= q @ c.T >= least[:, None]
                    continue
                pairs = np.nonzero(alive) if pairs is None else pairs
                pairs = _chosen(pairs, lambda i, j: np.einsum("ij,ij->i", q[i], c[j]) >= least[i])  # noqa: B023
            if pairs is None and np.count_nonzero(alive) > alive.size // 8:
                pairs = np.nonzero(alive)
                score = products(x, items[t])[pairs]
            else:
                pairs = np.nonzero(alive) if pairs is None else pairs
                score = np.concatenate([np.einsum("ij,ij->i", x[i].astype(np.int64), items[t[j]].astype(np.int64)) for i, j in _cut(pairs)] or [np.zeros(0, np.int64)])
            multiplied += len(score)
            good = (score >= low[pairs[0]]) & other(mine[pairs[0]], t[pairs[1]])
            who, item, best = np.append(who, pairs[0][good]), np.append(item, t[pairs[1][good]]), np.append(best, score[good])
            order = np.lexsort((item, -best, who))
            who, item, best = who[order], item[order], best[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            last = place == k - 1
            low[who[last]] = np.maximum(low[who[last]], best[last])
            who, item, best = who[place < k], item[place < k], best[place < k]
        found.append((who + b, item, best))
    return *(np.concatenate(c) for c in zip(*found, strict=True)), multiplied


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


def _chosen(pairs: tuple[np.ndarray, np.ndarray], test: Callable) -> tuple[np.ndarray, np.ndarray]:
    good = np.concatenate([test(i, j) for i, j in _cut(pairs)] or [np.zeros(0, bool)])
    return pairs[0][good], pairs[1][good]


def _cut(pairs: tuple[np.ndarray, np.ndarray], size: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return ((pairs[0][a : a + size], pairs[1][a : a + size]) for a in range(0, len(pairs[0]), size))


def _packs(batches: Iterator[pa.RecordBatch], width: int, rows: int) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """(ids, whole-number vectors, number of the pack) of at most so many rows; packs of a task are numbered on from the task's number."""
    held, count, number = [], 0, TaskContext.get().partitionId()
    for batch in batches:
        while count + batch.num_rows >= rows:
            held.append(batch.slice(0, rows - count))
            batch = batch.slice(rows - count)
            table = pa.Table.from_batches(held)
            yield table["vec_id"].combine_chunks(), whole(table["vector"], width), number
            held, count, number = [], 0, number + 1
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
    if held:
        table = pa.Table.from_batches(held)
        yield table["vec_id"].combine_chunks(), whole(table["vector"], width), number


def _joined(packs: pa.Table) -> np.ndarray:
    wide = [unpacked(v, n) for v, n in zip(packs["vectors"].to_pylist(), packs["n"].to_pylist(), strict=True)]
    return np.concatenate(wide)


def _flat(packs: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in packs[name].chunks])


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product with each query; ties go to the smaller id, a null one last.

    Queries are the rows whose id `every` divides, candidates all rows but those of the
    query's own id. Components are floor(256 x). A repeated row is a candidate each time;
    a repeated query row is answered each time. Vectors that are null or hold null or
    non-finite components take no part (see vectors.LARGEST); shorter vectors than the
    longest are filled with zeros. Fewer candidates than k are all given; an empty table
    gives no rows. Other columns of df do not matter.
    """
    bounded_batches(df.sparkSession)
    rows = kept(df, id_col, vector)
    asks = F.col("vec_id") % every == 0
    n, n_queries, longest = rows.agg(F.count("*"), F.count_if(asks), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    width = max(1, longest)
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    # Blocks are as large as they may be where there are many, else there are several a task.
    c_blocks = max(1, -(-n // BLOCK), min(-(-n // 1024), -(-4 * wanted // q_blocks)))
    pack = max(64, min(PACK, n // (2 * c_blocks)))
    few = max(k + 1, min(PACK, SAMPLE_BYTES // (4 * width)))
    # Any rows may be the sample: a score that k rows reach is never above the k-th best of all. limit() only bounds what is sent.
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(max(1, n // few))) == 0).limit(2 * few).toArrow()
    sample, sample_ids = whole(drawn["vector"], width), np.asarray(drawn["vec_id"].to_numpy(), np.float64)

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for ids, x, number in _packs(batches, width, PACK):
            ids, none = ids.to_numpy(), np.iinfo(np.int64).min
            floor = np.full(len(x), none)
            for a in range(0, len(x), 256) if len(sample) >= k else ():
                score = products(x[a : a + 256], sample)
                score[ids[a : a + 256, None] == sample_ids[None, :]] = none
                floor[a : a + 256] = np.partition(score, -k, axis=1)[:, -k]
            asked = (task << 40) + (number - task) * PACK + np.arange(len(x))
            yield pa.RecordBatch.from_pydict({"block": pa.array([number % q_blocks], pa.int32()), "n": pa.array([len(x)], pa.int32()), "asked": pa.array([asked]), "ids": pa.array([ids]), "floor": pa.array([floor]), "vectors": pa.array([packed(x)], pa.binary())})

    def pack_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, number in _packs(batches, width, pack):
            yield pa.RecordBatch.from_pydict({"cell": pa.array([number % c_blocks], pa.int32()), "n": pa.array([len(x)], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "vectors": pa.array([packed(x)], pa.binary())})

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("asked", "query_id", "vec_id", "score")})
        own, asked, ids, items = _flat(left, "ids").to_numpy(), _flat(left, "asked").to_numpy(), _flat(right, "ids"), _joined(right)
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        ids = ids.take(pa.array(order))
        plain, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        who, item, score, _ = search(_joined(left), own, _flat(left, "floor").to_numpy(), items[order], lambda mine, j: (plain[j] != mine) | null[j], k)
        return pa.table({"asked": asked[who], "query_id": own[who], "vec_id": ids.take(pa.array(item)), "score": score})

    left = rows.where(asks).mapInArrow(pack_queries, "block int, n int, asked array<long>, ids array<long>, floor array<long>, vectors binary")
    left = left.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    right = rows.mapInArrow(pack_items, "cell int, n int, ids array<long>, vectors binary")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    found = left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInArrow(meet, "asked long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50) -> str:
    """DuckDB SQL for top_k()."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS r FROM pairs) WHERE r <= {k}"""
