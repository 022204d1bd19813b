"""Vector codes: each part of a vector becomes the number of the nearest entry of its codebook.

Nearest entries are found by a vantage-point tree a part position. An inner node holds
one entry and two halves of the others by distance from it, each with the least and the
largest distance; by the triangle inequality a half can be left out where no entry of it
can be as near as the best so far. Such radii are rounded outwards, a half that may tie
is visited, and whole-number distances decide, so the tree never changes a result.

Codebooks are small and go to every task; sums by entry come back from each task once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, ensure_checkpoint_dir
from .vectors import kept, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries below a node of which no further tree is made.
LEAF = 6
#: Share by which radii and distances are rounded outwards; square roots of whole numbers are closer.
SLACK = 1e-12


@dataclass
class Node:
    """Entries of a leaf, or a vantage point with (least, largest distance, node) of its near and its far half."""

    entries: np.ndarray
    halves: tuple[tuple[float, float, Node], ...] = ()


def grow(book: np.ndarray, entries: np.ndarray) -> Node:
    """A tree over these rows of a codebook; its vantage points lie farthest from the middle of theirs, where halves overlap least."""
    if len(entries) <= LEAF:
        return Node(np.sort(entries))
    some = book[entries]
    middle = some.mean(axis=0)
    at = int(((some - middle) ** 2).sum(axis=1).argmax())
    rest = np.delete(entries, at)
    far = ((book[rest] - some[at]) ** 2).sum(axis=1)
    order = np.argsort(far, kind="stable")
    halves = []
    for half in np.array_split(order, 2):
        low, high = np.sqrt(far[half].min()) * (1 - SLACK), np.sqrt(far[half].max()) * (1 + SLACK)
        halves.append((low, high, grow(book, rest[half])))
    return Node(entries[at : at + 1], tuple(halves))


def nearest(book: np.ndarray, tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each point's nearest entry, the one of least number at ties; also how many distances were worked out."""
    code, best = np.full(len(points), len(book)), np.full(len(points), np.iinfo(np.int64).max)
    looked = 0

    def look(entries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        nonlocal looked
        looked += len(entries) * len(rows)
        gap = points[rows, None, :] - book[None, entries, :]
        square = np.einsum("ijk,ijk->ij", gap, gap)
        first = square.argmin(axis=1)
        least, number = square[np.arange(len(rows)), first], entries[first]
        good = (least < best[rows]) | (least == best[rows]) & (number < code[rows])
        best[rows[good]], code[rows[good]] = least[good], number[good]
        return square

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        square = look(node.entries, rows)
        if not node.halves:
            return
        away = np.sqrt(square[:, 0])
        (_, near_high, near), (far_low, _, far) = node.halves
        inside = away <= (near_high + far_low) / 2
        for first in (True, False):
            for mine, (low, high, half) in ((inside, node.halves[0]), (~inside, node.halves[1])):
                part = mine if first else ~mine
                # The least distance that an entry of the half can have; one that may equal the best is not left out.
                bound = np.maximum(away * (1 - SLACK) - high, low - away * (1 + SLACK))
                open_ = part & (bound <= np.sqrt(best[rows]) * (1 + SLACK))
                visit(half, rows[open_])

    visit(tree, np.arange(len(points)))
    return code, best, looked


class Codebooks:
    """[parts, entries, width of a part] of whole numbers, with a tree a part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.trees = [grow(book, np.arange(len(book))) for book in self.entries]

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes [rows, parts], summed squared distance) of whole-number vectors."""
        parts = len(self.entries)
        codes, error = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), np.int64)
        for p, part in enumerate(np.split(rows.astype(np.int64), parts, axis=1)):
            code, square, _ = nearest(self.entries[p], self.trees[p], part)
            codes[:, p] = code
            error += square
        return codes, error

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are the floored means of the parts that are nearest to them; unused entries stay."""
    parts, entries, size = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.entries.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = whole(batch["vector"], books.width)
            codes, _ = books.encode(x)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], x[:, p * size : (p + 1) * size])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.argwhere(count)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(used[:, 0] * entries + used[:, 1], pa.int32()), "n": pa.array(count[tuple(used.T)]), "total": pa.array(list(total[tuple(used.T)]), pa.list_(pa.int64()))})

    found = rows.mapInArrow(sums, "slot int, n long, total array<long>").groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(size)])
    new = books.entries.reshape(-1, size).copy()
    for slot, n, *total in found.collect():  # a row an entry at most
        new[slot] = [t // n for t in total]
    return Codebooks(new.reshape(books.entries.shape))


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from the vectors of the least ids, refined over all rows; None where there is no row. width: a multiple of parts."""
    begun = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).toArrow()
    if not begun.num_rows:
        return None
    books = Codebooks(whole(begun["vector"], width).reshape(begun.num_rows, parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the vectors that take part.

    Components are floor(256 x). Vectors that are null or hold null or non-finite
    components are left out (see vectors.LARGEST). Vectors shorter than the longest, or
    than a multiple of `parts`, are filled with zeros. Of equal ids the lesser vector comes
    first in a codebook, null ids come last; fewer rows than `entries` make smaller
    codebooks, and an empty table gives no rows. Each repeated row has a row. Rows of a
    null label are summed together. Other columns of df do not matter.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    ensure_checkpoint_dir(spark)
    rows = kept(df, id_col, vector, F.col(label).alias("label"))
    longest = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    plain = rows.select("vec_id", "vector")
    books = train(plain, max(1, -(-longest // parts)) * parts, parts, entries, rounds)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = books.encode(whole(batch["vector"], books.width))
            text = ["".join(map("{:02x}".format, c)) for c in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    with Scratch(spark) as scratch:
        coded = scratch.store(rows.mapInArrow(encode, f"vec_id long, label {kind}, code string, error long"))
        by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
        # One row a label: Spark broadcasts it if it turns out small, and else splits the rows of a hot label.
        out = coded.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
        return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")).checkpoint()


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for compress(); every vector is as long as the others and a multiple of parts."""
    out = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, r, p, e[p * (len(e) // {parts}) + 1 : (p + 1) * (len(e) // {parts})] AS x FROM v, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS c, x AS y FROM parts WHERE r <= {entries})"""
    for k in range(rounds + 1):
        out += f""",
near{k} AS MATERIALIZED (SELECT r, p, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, p, c, CAST(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts JOIN book{k} USING (p)) GROUP BY r, p)"""
        if k < rounds:
            out += f""",
mean{k} AS (SELECT p, c, list(CAST(floor(s / n) AS BIGINT) - CASE WHEN floor(s / n) * n > s THEN 1 ELSE 0 END ORDER BY i) AS y FROM (SELECT p, c, i, sum(x[i]) AS s, count(*) AS n FROM near{k} JOIN parts USING (r, p), unnest(range(1, len(x) + 1)) u(i) GROUP BY p, c, i) GROUP BY p, c),
book{k + 1} AS MATERIALIZED (SELECT p, c, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN mean{k} m USING (p, c))"""
    return out + f""",
coded AS (SELECT r, string_agg(printf('%02x', c), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
print AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN v USING (r) CROSS JOIN print"""
