"""Scalar functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_text(seconds: Column) -> Column:
    """Whole seconds as hh:mm:ss; hours may pass 99."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def iso_duration(seconds: Column) -> Column:
    """PTnS with no trailing zeros."""
    return F.concat(F.lit("PT"), F.regexp_replace(seconds.cast("decimal(20,6)").cast("string"), r"\.?0+$", ""), F.lit("S"))


def angle_difference(a: Column, b: Column) -> Column:
    """Shortest signed way from b to a in degrees, in [-180, 180)."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def looped_time(time: Column, duration: float) -> Column:
    """Content time of a looping timeline."""
    return F.pmod(time, F.lit(duration))


def synthetic_weight(key: Column, time: Column, seed: int) -> Column:
    """A weight in [0, 1] that swings with time, with a period and a phase from the key's hash: equal on every machine."""
    h = lambda part: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{part}")).cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (1 + F.sin(2 * F.pi() * (time / (5 + 25 * h("period")) + h("phase")))) / 2


def byte_range(header: Column, size: Column) -> Column:
    """(first, last) of one "bytes=a-b" range against a size; null where it is malformed or out of reach."""
    a, b = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    number = lambda x: F.when(x != "", x.cast("long"))
    first = F.when(a != "", number(a)).otherwise(F.greatest(size - number(b), F.lit(0)))
    last = F.when((a != "") & (b != ""), F.least(number(b), size - 1)).otherwise(size - 1)
    return F.when(header.rlike(r"^bytes=(\d+-\d*|-\d+)$") & (first <= last) & (first < size), F.struct(first.alias("first"), last.alias("last")))


def frame_range(text: Column) -> Column:
    """"a-b,c" or "a:b,c" as the list of whole numbers it names, in order as written; a part that is no number or range, a range that runs down and a number named twice are errors."""
    parts = F.split(F.regexp_replace(text, r"\s", ""), ",")
    ends = lambda p: F.split(p, "[-:]")
    low, high = (lambda p: ends(p)[0].cast("int")), (lambda p: F.element_at(ends(p), -1).cast("int"))
    sound = F.forall(parts, lambda p: p.rlike(r"^\d+([-:]\d+)?$") & (F.try_element_at(ends(p), F.lit(1)).try_cast("int") <= F.try_element_at(ends(p), F.lit(-1)).try_cast("int")))
    numbers = F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p))))
    bad = F.raise_error(F.concat(F.lit("no frame range: "), text)).cast("array<int>")
    return F.when(text.isNull(), F.lit(None)).when(~F.coalesce(sound, F.lit(False)), bad).when(F.size(F.array_distinct(numbers)) < F.size(numbers), bad).otherwise(numbers)


def first_available(*columns: str) -> Column:
    """Struct name, value (as text) of the first of the columns that is not null; null where all are."""
    told = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))) for c in columns]
    return F.coalesce(*told)


def option_value(arguments: Column, *names: str) -> Column:
    """What a flag of one of these names is given, as `--flag value` or `--flag=value`; the first of them that has a value counts, null where none has."""
    flags = F.array(*[F.lit(n) for n in names])

    def given(word: Column, k: Column) -> Column:
        named = F.filter(flags, lambda n: F.startswith(word, F.concat(n, F.lit("="))))
        inline = F.when(F.size(named) > 0, F.substring(word, F.length(named[0]) + 2, F.length(word)))
        return F.when(F.array_contains(flags, word), F.get(arguments, k + 1)).otherwise(inline)

    return F.get(F.filter(F.transform(arguments, given), lambda v: v.isNotNull()), F.lit(0))


def safe_relative_path(path: Column) -> Column:
    """Whether a path stays below its root: relative, no "..", no empty part, no backslash, no percent escapes of these."""
    plain = F.coalesce(F.try_url_decode(path), F.lit("/"))
    plain = F.coalesce(F.try_url_decode(plain), F.lit("/"))
    return (F.length(plain) > 0) & ~plain.rlike(r"(^/)|\\|(^|/)\.{1,2}(/|$)|//|[\x00-\x1f]")


def is_sha256(text: Column) -> Column:
    return text.rlike(r"^[0-9a-f]{64}$")


def quantised(value: Column, low: float, high: float, bits: int) -> Column:
    """The value's code among 2^bits even steps of [low, high]; outside values are clamped."""
    steps = (1 << bits) - 1
    return F.round((F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / (high - low) * steps).cast("int")


def dequantised(code: Column, low: float, high: float, bits: int) -> Column:
    return code / F.lit(float((1 << bits) - 1)) * (high - low) + low


def visibility(visible: Column, solo: Column, epsilon: float = 1e-6) -> Column:
    """Struct of the clamped visible amount, the occluded share (null without solo) and whether it is out of view."""
    kept = F.least(F.greatest(visible, F.lit(0.0)), solo)
    return F.struct(kept.alias("visible"), F.when(solo > epsilon, 1 - kept / solo).alias("occlusion"), (solo <= epsilon).alias("out_of_view"))


def transmittance(alphas: Column) -> Column:
    """What light passes a list of layers from front to back."""
    return F.aggregate(alphas, F.lit(1.0), lambda t, a: t * (1 - a))


def mixed_difference(e00: Column, e10: Column, e01: Column, e11: Column) -> Column:
    return e11 - e10 - e01 + e00


def available(value: Column, digits: int) -> Column:
    """Fixed decimals; "unavailable" for null and "∞" for infinity."""
    return F.when(value.isNull(), "unavailable").when(F.abs(value) == float("inf"), "∞").otherwise(F.format_string(f"%.{digits}f", value))


def shoelace(points: Column) -> Column:
    """Area of a polygon of (x, y) structs, in either turn."""
    n = F.size(points)
    turns = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda s, x: s + x)) / 2


def whole_ticks(seconds: Column, scale: int, tolerance: float = 1e-6) -> Column:
    """A time in ticks of 1 / scale seconds; null where it falls between them."""
    ticks = seconds * scale
    return F.when(F.abs(ticks - F.round(ticks)) < tolerance, F.round(ticks).cast("long"))


def _rotation(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = (F.when(n > 0, c / F.when(n > 0, n)) for c in (w, x, y, z))
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]


def rotation(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Rows of the rotation matrix of a quaternion of any length above zero; null for one of none."""
    return F.array(*[F.array(*r) for r in _rotation(w, x, y, z)])


def rotated(point: Sequence[Column], w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """The three coordinates of a point turned by a quaternion: transformed(rotation(...), point) without arrays, so that a coordinate that is not read costs nothing."""
    return [r[0] * point[0] + r[1] * point[1] + r[2] * point[2] for r in _rotation(w, x, y, z)]


def transformed(matrix: Column, point: Column) -> Column:
    """A matrix, given by rows, times a point."""
    return F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, point, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def array_mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of equal length; null where lengths differ or are zero."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.nullif(F.size(a), F.lit(0)))


def similarity_scale(matrix: Column, tolerance: float = 1e-6) -> Column:
    """How much a 3 x 3 matrix scales, if it only turns and scales: its rows are orthogonal and equally long, and it does not mirror; else null."""
    dot = lambda i, j: F.aggregate(F.zip_with(matrix[i], matrix[j], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    square = dot(0, 0)
    near = lambda x, want: F.abs(x - want) <= tolerance * square
    rigid = near(dot(1, 1), square) & near(dot(2, 2), square) & near(dot(0, 1), F.lit(0.0)) & near(dot(0, 2), F.lit(0.0)) & near(dot(1, 2), F.lit(0.0))
    m = lambda i, j: matrix[i][j]
    det = m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
    return F.when((square > 0) & rigid & (det > 0), F.sqrt(square))
