"""Values that a user's own class provides, called from SQL as table functions.

A Provider names the columns it needs and gives a value, or why there is none, for each
row. register() makes it a table function that checks its input when a query is analysed
and adds `value` and `reason` to every row:

    register(spark, "density_value", Density())
    SELECT * FROM density_value(TABLE(SELECT ...), most => 2.5)

Given the columns of the table beforehand, the function works on Arrow batches instead
of rows, which large tables need: register(spark, "density_value", Density(), rows.schema).

Built-in utilities are column expressions (operators.selection); this is for what those
cannot express.
"""

from __future__ import annotations

import inspect
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import DoubleType, NumericType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Provider:
    """needs: columns, which must be numbers. value(): gets them by name, and the options that the call names, which have defaults there.

    values() does the same for arrays of numbers, by calls of value(); a provider may say it at once instead.
    """

    needs: tuple[str, ...] = ()

    def value(self, *needs: float, **options) -> tuple[float | None, str | None]:
        raise NotImplementedError

    def values(self, *needs: np.ndarray, **options) -> tuple[pa.Array, pa.Array]:
        pairs = [self.value(*row, **options) for row in zip(*[n.tolist() for n in needs], strict=True)]
        return pa.array([v for v, _ in pairs], pa.float64()), pa.array([r for _, r in pairs], pa.string())

    def options(self) -> Mapping[str, object]:
        return {n: p.default for n, p in inspect.signature(self.value).parameters.items() if p.kind is p.KEYWORD_ONLY}


class Density(Provider):
    """Visible share of the pixels times what density is gained over the base, at most `most`."""

    needs = ("weight", "visible", "pixels", "base", "own")

    def value(self, weight, visible, pixels, base, own, *, most: float = float("inf")):
        if pixels <= 0:
            return None, "no pixels"
        if visible <= 0:
            return 0.0, "not visible"
        return min(weight * visible / pixels * (base - own), most), None

    def values(self, weight, visible, pixels, base, own, *, most: float = float("inf")):
        none, unseen = pixels <= 0, visible <= 0
        with np.errstate(all="ignore"):
            x = weight * visible / pixels * (base - own)
        x = np.where(unseen, 0.0, np.where(most < x, most, x))
        return pa.array(x, mask=none), pa.array(np.where(none, "no pixels", np.where(unseen, "not visible", None)), pa.string())


class Quality(Provider):
    """Error that a variant takes off its base, weighted by what of it is seen."""

    needs = ("seen", "base_error", "error")

    def value(self, seen, base_error, error, *, floor: float = float("-inf")):
        if error < 0 or base_error < 0:
            return None, "negative error"
        return max(seen * (base_error - error), floor), None


def _with_value(name: str, needs: Sequence[str], columns: StructType) -> StructType:
    """columns with value and reason; ValueError where a needed column is missing or no number, or one of the two is there."""
    kinds = {f.name: f.dataType for f in columns.fields}
    for n in needs:
        if not isinstance(kinds.get(n), NumericType):
            raise ValueError(f"{name} needs a number column {n}")
    if taken := {"value", "reason"} & set(kinds):
        raise ValueError(f"{name} adds a column {sorted(taken)[0]}, which is there")
    return StructType([*columns.fields, StructField("value", DoubleType()), StructField("reason", StringType())])


def register(spark: SparkSession, name: str, provider: Provider, columns: StructType | None = None) -> None:
    """Makes `name` a table function of a table argument and the provider's options by name; a null in a needed column gives no value and the reason "missing <column>".

    With `columns`, the function takes tables of these columns only, an Arrow batch at a time.
    """
    needs, defaults = tuple(provider.needs), dict(provider.options())

    def given_options(options: Mapping[str, object]) -> dict[str, object]:
        return {n: v if v is None else type(defaults[n])(v) for n, v in options.items()}

    class Function:
        def __init__(self, analyzed: AnalyzeResult):
            names = [f.name for f in analyzed.schema.fields]
            self.width, self.at = len(names) - 2, [names.index(n) for n in needs]

        @staticmethod
        def analyze(rows: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} takes a table")
            out = _with_value(name, needs, rows.dataType)
            if unknown := set(options) - set(defaults):
                raise ValueError(f"{name} has no option {sorted(unknown)[0]}")
            return AnalyzeResult(out)

        def eval(self, row, **options):
            given = [row[k] for k in self.at]
            for n, v in zip(needs, given, strict=True):
                if v is None:
                    yield (*row, None, f"missing {n}")
                    return
            value, reason = provider.value(*[float(v) for v in given], **given_options(options))
            yield (*row, value, reason)

    if columns is None:
        spark.udtf.register(name, udtf(Function))
        return
    names = columns.names

    class Batches:
        def eval(self, rows: pa.RecordBatch, **options: pa.Array):
            if rows.schema.names != names:
                raise ValueError(f"{name} takes the columns {names}")
            if unknown := set(options) - set(defaults):
                raise ValueError(f"{name} has no option {sorted(unknown)[0]}")
            if rows.num_rows:
                value, reason = _valued(provider, [rows.column(names.index(n)) for n in needs], given_options({n: v[0].as_py() for n, v in options.items()}))
                yield pa.table([*rows.columns, value, reason], names=[*names, "value", "reason"])

    spark.udtf.register(name, arrow_udtf(Batches, returnType=_with_value(name, needs, columns)))


def _valued(provider: Provider, given: Sequence[pa.Array], options: Mapping[str, object]) -> tuple[pa.Array, pa.Array]:
    """Values and reasons of a batch; the provider sees rows without nulls only."""
    full = np.ones(len(given[0]), bool)
    missing = np.full(len(full), None)
    for n, c in reversed([*zip(provider.needs, given, strict=True)]):
        there = c.is_valid().to_numpy(zero_copy_only=False)
        missing[~there] = f"missing {n}"
        full &= there
    # Decimals go by their text, as Arrow's own cast does not always round to the nearest.
    texts = [c.cast(pa.string()) if pa.types.is_decimal(c.type) else c for c in given]
    numbers = [c.filter(pa.array(full)).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for c in texts]
    value, reason = provider.values(*numbers, **options)
    if full.all():
        return value, reason
    at = pa.array(np.cumsum(full) - 1, mask=~full)
    return value.take(at), pc.coalesce(reason.take(at), pa.array(missing, pa.string()))
