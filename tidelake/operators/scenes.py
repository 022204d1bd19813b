"""Layouts of scenes, camera paths, projection, and the area of projected boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.scalars import transformed

LAYOUTS = ("line", "circle")


def layout(df: DataFrame, by: Sequence[str], order: str, kind: str, spacing: float = 1.0, radii: tuple[float, float] = (3.0, 2.0)) -> DataFrame:
    """df with x, y, z: each scene's objects in order on a line about its middle, or around an ellipse."""
    if kind not in LAYOUTS:
        raise ValueError(f"layout {kind}, not one of {LAYOUTS}")
    scene = Window.partitionBy(*by)
    k, n = F.row_number().over(scene.orderBy(order)) - 1, F.count("*").over(scene)
    turn = 2 * math.pi * k / n
    x = (k - (n - 1) / 2) * spacing if kind == "line" else F.cos(turn) * radii[0]
    z = F.lit(0.0) if kind == "line" else F.sin(turn) * radii[1]
    return df.withColumns({"x": x, "y": F.lit(0.0), "z": z})


def placed(df: DataFrame, scene: str, key: str, low: Sequence[float], high: Sequence[float], apart: float, seed: int, attempts: int = 64, growth: float = 1.5, size: str | None = None, most_growths: int = 64) -> DataFrame:
    """scene, key, x, y, z: objects at random places of a box, none in another's way; repeated keys count once.

    Objects are in each other's way if they are nearer than `apart`; with size, a column of
    half edges, if their boxes, padded by `apart`, overlap on all axes. Each object in order
    of key tries `attempts` places; where none is free, the box grows about its middle by
    `growth` and it tries again, at most `most_growths` times, after which it is an error.
    Places follow (seed, scene) only. One task places one scene, whose objects must be few.
    """
    if apart < 0 or attempts < 1 or growth <= 1:
        raise ValueError("a distance of at least 0, an attempt and a growth above 1 are needed")
    middle, half = (np.asarray(low, float) + high) / 2, (np.asarray(high, float) - low) / 2

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows[scene].iloc[0]
        draw = np.random.default_rng([seed, *str(name).encode()])
        own = rows.sort_values(list(rows.columns)).drop_duplicates(key)
        keys, reach, grown = own[key].to_numpy(), half.copy(), 0
        sizes = own[size].to_numpy(float) if size else np.zeros(len(keys))
        places = np.zeros((len(keys), 3))
        for k in range(len(keys)):
            while True:
                tries = middle + draw.uniform(-1, 1, (attempts, 3)) * reach
                gaps = np.abs(tries[:, None] - places[None, :k])
                free = (gaps.max(axis=2) >= sizes[:k] + sizes[k] + apart).all(1) if size else (np.linalg.norm(gaps, axis=2) >= apart).all(1)
                if free.any():
                    places[k] = tries[np.argmax(free)]
                    break
                if grown == most_growths:
                    raise ValueError(f"scene {name} has no place for {keys[k]} after {grown} growths")
                reach, grown = reach * growth, grown + 1
        return pd.DataFrame({scene: name, key: keys, "x": places[:, 0], "y": places[:, 1], "z": places[:, 2]})

    kinds = dict(df.dtypes)
    return df.select(scene, key, *([size] if size else [])).groupBy(scene).applyInPandas(one, f"{scene} {kinds[scene]}, {key} {kinds[key]}, x double, y double, z double")


def sine_yaw(frame: Column, period: int, amplitude: float) -> Column:
    """Degrees that a camera is turned at a frame: it swings by `amplitude` once a period."""
    return F.sin(2 * math.pi * (frame % period) / period) * amplitude


def yaw_rows(degrees: Column) -> Column:
    """Rows of the rotation about the upright axis."""
    c, s, one, none = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), F.lit(1.0), F.lit(0.0)
    return F.array(F.array(c, none, s), F.array(none, one, none), F.array(-s, none, c))


def moved(point: Column, turn: Column, scale: Column, pivot: Column, by: Column) -> Column:
    """A point turned and scaled about a pivot, then moved."""
    turned = transformed(turn, F.zip_with(point, pivot, lambda a, b: a - b))
    return F.zip_with(F.zip_with(turned, pivot, lambda a, b: a * scale + b), by, lambda a, b: a + b)


def pixel(point: Column, turn: Column, eye: Column, focal: float, width: int, height: int, near: float = 0.01) -> Column:
    """Struct u, v, depth of a point seen by a camera at `eye` that looks along z; null before the near plane."""
    seen = transformed(turn, F.zip_with(point, eye, lambda a, b: a - b))
    depth = seen[2]
    at = F.struct((seen[0] / depth * focal + (width - 1) / 2).alias("u"), (seen[1] / depth * focal + (height - 1) / 2).alias("v"), depth.alias("depth"))
    return F.when(depth > near, at)


def source_local(turn: Column, offset: Column, object_turn: Column, scale: Column, origin: Column) -> Column:
    """Struct turn, offset of a camera (turn * p + offset) as an object of that place, turn and scale sees it; pixels stay as they are."""
    product = F.transform(turn, lambda row: F.array(*[row[0] * object_turn[0][k] + row[1] * object_turn[1][k] + row[2] * object_turn[2][k] for k in range(3)]))
    there = F.zip_with(transformed(turn, origin), offset, lambda a, b: (a + b) / scale)
    return F.struct(product.alias("turn"), there.alias("offset"))


#: Lines nearer than this to each other, on a side that reaches from 0 to 1, are one.
_TOUCH = 1e-9
#: Boxes worked on at once: their arrays stay in the processor's cache.
_AT_ONCE = 2048


def _sides(low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Of each side of boxes: its corner of least other coordinates and the two edges from it, in clip space; whether a turn from the first edge to the second is anticlockwise as seen from outside."""
    step = [rows[:, :, d] * (high - low)[:, d, None] for d in range(3)]
    least = rows[:, :, 0] * low[:, 0, None] + rows[:, :, 1] * low[:, 1, None] + rows[:, :, 2] * low[:, 2, None] + rows[:, :, 3]
    for d in range(3):
        for o, turn in ((least, -1.0), (least + step[d], 1.0)):
            yield o, step[(d + 1) % 3], step[(d + 2) % 3], turn


def _cut_area(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signed area on the screen of what is in view of a side.

    A point of a side is o + u a + v b, and in view where ten linear conditions on (u, v)
    hold: four of the side and six of the view. Each of their lines bounds what is in view
    along one range at most, which the other nine conditions narrow; the ranges, each run
    through with the view on its left, close the outline, whose area is a sum over them.
    """
    one, none = np.ones(len(o)), np.zeros(len(o))
    rules = [(none, one, none), (one, -one, none), (none, none, one), (one, none, -one)]
    rules += [tuple(x[:, 3] + sign * x[:, k] for x in (o, a, b)) for k in range(3) for sign in (1, -1)]
    c, u, v = (np.stack(x) for x in zip(*rules, strict=True))  # [conditions, boxes]
    # Conditions in which (u, v) do not occur hold or not for the whole side.
    n = np.sqrt(u * u + v * v)
    bent = n > 0
    n = np.where(bent, n, 1.0)
    c, u, v = c / n, np.where(bent, u / n, 0.0), np.where(bent, v / n, 0.0)
    out = none.copy()
    for k in range(len(rules)):
        lu, lv = u[k], v[k]
        pu, pv = -c[k] * lu, -c[k] * lv
        off, along = c + u * pu + v * pv, u * lv - v * lu
        same = np.abs(along) <= 1e-12
        # Of lines that are one the first counts; where their conditions are opposite, nothing lies between.
        first = np.arange(len(rules))[:, None] < k
        shut = same & ((off < -_TOUCH) | (off <= _TOUCH) & (first | (u * lu + v * lv < 0)))
        shut[k] = False
        at = -off / np.where(same, 1.0, along)
        low = np.where(~same & (along > 0), at, -np.inf).max(0)
        high = np.where(~same & (along < 0), at, np.inf).min(0)
        good = bent[k] & ~shut.any(0) & (low < high)
        if good.any():
            ends = [(pu + t * lv, pv - t * lu) for t in (low, high)]
            (px, py), (qx, qy) = (((o[:, 0] + s * a[:, 0] + t * b[:, 0]) / w, (o[:, 1] + s * a[:, 1] + t * b[:, 1]) / w) for s, t in ends for w in (o[:, 3] + s * a[:, 3] + t * b[:, 3],))
            out += np.where(good, px * qy - qx * py, 0.0)
    return out / 2


def _whole_area(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signed area on the screen of a side's two halves along the diagonal from its first corner, of which each counts if its corners are in view."""
    seen = lambda p: (p[:, 3] > 0) & (np.abs(p[:, :3]) <= p[:, 3:]).all(1)

    def half(*corners: np.ndarray) -> np.ndarray:
        x, y = ([p[:, k] / p[:, 3] for p in corners] for k in (0, 1))
        return np.where(np.all([seen(p) for p in corners], 0), ((x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])) / 2, 0.0)

    return half(o, o + a, o + a + b) + half(o, o + a + b, o + b)


def projected_area(low: Column, high: Column, rows: Column, width: float, height: float, clip: bool = True) -> Column:
    """Pixels that the sides of a box facing the camera cover, each side by itself.

    rows is a 4 x 4 matrix to clip space, where -w <= x, y, z <= w is in view. With `clip`
    what is in view of a side counts; without, the halves of sides that are in view as a
    whole. A side faces the camera if it shows its outside, as then its outline runs
    anticlockwise. Null where the box has no extent on an axis, or where a number is missing.
    Boxes are worked out an Arrow batch at a time, as arrays over its boxes.
    """

    @F.arrow_udf("double")
    def areas(numbers: pa.Array) -> pa.Array:
        flat = numbers.flatten().to_numpy(zero_copy_only=False).reshape(len(numbers), 22)
        out = np.zeros(len(flat))
        with np.errstate(all="ignore"):
            for k in range(0, len(flat), _AT_ONCE):
                part = flat[k : k + _AT_ONCE]
                for o, a, b, turn in _sides(part[:, :3], part[:, 3:6], part[:, 6:].reshape(-1, 4, 4)):
                    out[k : k + _AT_ONCE] += np.maximum((_cut_area if clip else _whole_area)(o, a, b) * turn, 0.0)
        return pa.array(out * (width * height / 4))

    numbers = [x.cast("double") for x in (*[low[k] for k in range(3)], *[high[k] for k in range(3)], *[rows[i][j] for i in range(4) for j in range(4)])]
    # A missing number goes as NaN, since an array of numbers has none missing.
    area = areas(F.array(*[F.coalesce(x, F.lit(float("nan"))) for x in numbers]))
    solid = F.forall(F.zip_with(low, high, lambda a, b: a < b), lambda b: b)
    return F.when(solid & F.forall(F.array(*numbers), lambda x: x.isNotNull()), area)
