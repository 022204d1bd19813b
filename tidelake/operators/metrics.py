"""Aggregates over measurements: distributions, pooled quality, coverage, rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.storage import Scratch, ensure_checkpoint_dir


def distribution(value: str) -> list[Column]:
    """count, total, mean, median, low and high; all but the count null without values."""
    v = F.col(value)
    return [F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high")]


def interpolated_percentile(value: str, q: float) -> Column:
    """Linear interpolation at (n - 1) q."""
    return F.percentile(value, q)


def nearest_rank_percentile(value: str, q: float) -> Column:
    """The value of rank ceil(q n)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def counted_values(df: DataFrame, by: Sequence[str], value: str, scratch: Scratch) -> DataFrame:
    """by, value, n, before, all: how often each value of a group is there, how many of the group's values are less, and how many it has; nulls do not count.

    Values are counted first and then dealt by ranges, so that neither a group's rows nor
    its different values meet in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    dealt = scratch.store(counts.repartitionByRange(*by, value).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "__part").agg(F.sum("n").alias("__sum"))
    ahead = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sums.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__part").alias("__of"), F.coalesce(ahead, F.lit(0)).alias("__ahead"), F.sum("__sum").over(Window.partitionBy(*by)).alias("all"))
    same = F.col("__part") == F.col("__of")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{k}"))
    local = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__local", local).join(parts, same).select(*by, value, "n", (F.col("__local") + F.col("__ahead")).alias("before"), "all")


def order_statistics(df: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """by and a column for each of wanted, name: (kind, q).

    "interpolated": between the values at (n - 1) q; "nearest": the value of rank
    ceil(q n); "lower": the value at index floor(n q), at most n - 1 (half: (n - 1) // 2).
    """
    ensure_checkpoint_dir(df.sparkSession)
    with Scratch(df.sparkSession) as scratch:
        counts = counted_values(df, by, value, scratch)
        n, end = F.col("all"), F.col("before") + F.col("n")
        at = lambda place: F.max(F.when((place >= F.col("before")) & (place < end), F.col(value)))
        out = []
        for name, (kind, q) in wanted.items():
            if kind == "interpolated":
                place = (n - 1) * q
                low, high = at(F.floor(place)), at(F.ceil(place))
                out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
            elif kind == "nearest":
                out.append(at(F.greatest(F.ceil(n * q) - 1, F.lit(0))).alias(name))
            elif kind == "lower":
                out.append(at(F.floor((n - 1) / 2) if q == 0.5 else F.least(n - 1, F.floor(n * q))).alias(name))
            else:
                raise ValueError(f"no percentile {kind}")
        return counts.groupBy(*by).agg(*out).checkpoint()


def lower_percentile(df: DataFrame, by: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """The value at index floor(n q), at most n - 1, of the sorted values (half: (n - 1) // 2)."""
    return order_statistics(df, by, value, {name: ("lower", q)})


def medians(df: DataFrame, by: Sequence[str], value: str, facts: Sequence[Column] = (), accuracy: int = 10_000) -> DataFrame:
    """by, the aggregates `facts` and `median`, exact, as F.median() gives it.

    A sketch of each group sets two bounds around its middle; the second reading counts
    what is below them and, value by value, what lies between, some 4 / accuracy of the
    rows. So no group's values meet in one task. A group whose middle is not between its
    bounds, which the sketch rules out, is worked out by order_statistics().
    """
    ensure_checkpoint_dir(df.sparkSession)
    v, margin = F.col(value), min(2 / accuracy, 0.5)
    with Scratch(df.sparkSession) as scratch:
        groups = scratch.store(df.groupBy(*by).agg(*facts, F.count(v).alias("__n"), F.percentile_approx(v, [0.5 - margin, 0.5 + margin], accuracy).alias("__cuts")))

        def matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
            same = F.lit(True)
            for k, c in enumerate(by):
                same &= F.col(c).eqNullSafe(F.col(f"__by{k}"))
            return left.join(right.withColumnsRenamed({c: f"__by{k}" for k, c in enumerate(by)}), same, how)

        near = matched(df.select(*by, value), groups.select(*by, "__n", "__cuts"), "inner").where(v <= F.col("__cuts")[1])
        counts = near.groupBy(*by, "__n", F.when(v >= F.col("__cuts")[0], v).alias("__v")).agg(F.count("*").alias("__c"))
        # What is below both bounds is one null and comes first.
        before = F.coalesce(F.sum("__c").over(Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = lambda place: F.max(F.when((place >= F.col("__before")) & (place < F.col("__before") + F.col("__c")), F.col("__v")))
        place = (F.col("__n") - 1) / 2
        middle = counts.withColumn("__before", before).groupBy(*by).agg(at(F.floor(place)).alias("__low"), at(F.ceil(place)).alias("__high"))
        low, high = F.col("__low"), F.col("__high")
        out = matched(groups, middle, "left").withColumn("median", F.when(low == high, low.cast("double")).otherwise(0.5 * low + 0.5 * high))
        out = out.select(*by, *[c for c in groups.columns if c not in by], "median").checkpoint()
        rest = out.where("__n > 0 AND median IS NULL")
        kept = [c for c in out.columns if c not in ("__n", "__cuts")]
        if rest.isEmpty():
            return out.select(*kept)
        exact = order_statistics(matched(df, rest.select(*by), "left_semi"), by, value, {"__median": ("interpolated", 0.5)})
        return matched(out, exact, "left").withColumn("median", F.coalesce("median", "__median")).select(*kept).checkpoint()


def harmonic_mean(value: str) -> Column:
    """Of the positive values."""
    v = F.when(F.col(value) > 0, F.col(value))
    return F.count(v) / F.nullif(F.sum(1 / v), F.lit(0))


def psnr(mse: Column, data_range: float = 1.0) -> Column:
    """10 log10(range^2 / mse) in decibels; infinite where the error is zero."""
    return F.when(mse == 0, F.lit(float("inf"))).when(mse > 0, 10 * F.log10(F.lit(data_range**2) / F.when(mse > 0, mse)))


def pooled_quality(df: DataFrame, by: Sequence[str], sse: str, count: str, data_range: float = 1.0) -> DataFrame:
    """Pooled error: sums before the logarithm, never a mean of decibels.

    n_rows, n_measured, coverage, mse, psnr_db (null where infinite), is_infinite
    and mean_psnr_db, which is the mean over finite rows, for comparison.
    """
    good = (F.col(count) > 0) & F.col(sse).isNotNull()
    own = F.when(good & (F.col(sse) > 0), psnr(F.col(sse) / F.nullif(F.col(count), F.lit(0)), data_range))
    sums = df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(good).alias("n_measured"), F.sum(F.when(good, F.col(sse))).alias("__s"), F.sum(F.when(good, F.col(count))).alias("__n"), F.avg(own).alias("mean_psnr_db"))
    mse = F.col("__s") / F.nullif(F.col("__n"), F.lit(0))
    return sums.select(*by, "n_rows", "n_measured", (F.col("n_measured") / F.col("n_rows")).alias("coverage"), mse.alias("mse"), F.when(mse > 0, psnr(mse, data_range)).alias("psnr_db"), F.coalesce(mse == 0, F.lit(False)).alias("is_infinite"), "mean_psnr_db")


def aggregate(strategy: str, value: str, weight: str | None = None, higher_is_better: bool = True) -> Column:
    """uniform_mean, weighted_mean, median, p95 or worst; null if any value is null."""
    v = F.col(value)
    columns = {
        "uniform_mean": lambda: F.avg(v),
        "weighted_mean": lambda: F.sum(v * F.col(weight)) / F.nullif(F.sum(F.when(v.isNotNull(), F.col(weight))), F.lit(0)),
        "median": lambda: F.median(v),
        "p95": lambda: F.percentile(v, 0.95),
        "worst": lambda: F.min(v) if higher_is_better else F.max(v),
    }
    if strategy not in columns:
        raise ValueError(f"no strategy {strategy}")
    return F.when(F.count(v) == F.count("*"), columns[strategy]())


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank from 0, ties sharing the mean of their ranks."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2 - 1


def ranks_by_value(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the rank from 0 of each row's value in its group, ties sharing the mean of their ranks; a null value has no rank."""
    ensure_checkpoint_dir(df.sparkSession)
    with Scratch(df.sparkSession) as scratch:
        ranks = counted_values(df, by, value, scratch).select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col(value).alias("__v"), (F.col("before") + (F.col("n") - 1) / 2).alias(name), "all")
        same = F.col(value) == F.col("__v")
        for k, c in enumerate(by):
            same &= F.col(c).eqNullSafe(F.col(f"__by{k}"))
        return df.join(ranks, same, "left").drop("__v", "all", *[f"__by{k}" for k in range(len(by))]).checkpoint()


def top_agreement(df: DataFrame, by: Sequence[str], key: str, predicted: str, actual: str, k: int) -> DataFrame:
    """by, top_hit and recall: is the first by prediction among the best in fact, and which share of the k best in fact, ties included, is among the k best predicted, ties included."""
    w = Window.partitionBy(*by)
    place = lambda c: F.rank().over(w.orderBy(F.col(c).desc()))
    ranked = df.select(*by, place(predicted).alias("__p"), place(actual).alias("__a"), F.row_number().over(w.orderBy(F.col(predicted).desc(), key)).alias("__k"))
    hit = F.max(((F.col("__k") == 1) & (F.col("__a") == 1)).cast("int"))
    return ranked.groupBy(*by).agg(hit.alias("top_hit"), (F.count_if((F.col("__a") <= k) & (F.col("__p") <= k)) / F.count_if(F.col("__a") <= k)).alias("recall"))


def share_of_total(value: str, by: Sequence[str]) -> Column:
    """A row's part of its group's sum; 0 where the sum is 0."""
    return F.coalesce(F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy(*by)), F.lit(0.0)), F.lit(0.0))


def ranking_agreement(df: DataFrame, by: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """mae, rmse, bias and Spearman correlation (average ranks) of two columns, by group."""
    e = F.col(predicted) - F.col(actual)
    ranked = ranks_by_value(ranks_by_value(df, by, predicted, "__p"), by, actual, "__a")
    return ranked.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.corr("__p", "__a").alias("spearman"))


def relative_error(predicted: Column, actual: Column, near_zero: float = 1e-12) -> Column:
    """Signed error over the actual value's size; null where that is near zero."""
    return F.when(F.abs(actual) > near_zero, (predicted - actual) / F.abs(F.nullif(actual, F.lit(0.0))))


def distinct_sum(df: DataFrame, by: Sequence[str], key: str, size: str, name: str) -> DataFrame:
    """Sum of sizes over distinct keys of a group; a key's size is its largest."""
    return df.groupBy(*by, key).agg(F.max(size).alias("__s")).groupBy(*by).agg(F.sum("__s").alias(name))


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """Order-free SHA-256 of rows: hashes of rows are sorted and hashed in buckets by their first hex digits, then the buckets' hashes by three digits less, and so on.

    Repeated rows count. With three digits a bucket is a 4096th of a group; more digits,
    which are part of what is hashed, are for groups of more than some hundred million rows.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
    level = df.select(*by, row.alias("__h")).withColumn("__b", F.substring("__h", 1, digits)).groupBy(*by, "__b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__h")), ""), 256).alias("__p"))
    for k in range(digits - 3, -3, -3):
        level = _joined(level, by, max(k, 0))
    return level.select(*by, F.col("__p").alias("fingerprint"))


def _joined(level: DataFrame, by: Sequence[str], digits: int) -> DataFrame:
    """Buckets of fewer digits: the hash of their own buckets' hashes in order."""
    up = level.withColumn("__u", F.substring("__b", 1, digits))
    parts = up.groupBy(*by, "__u").agg(F.array_sort(F.collect_list(F.struct("__b", "__p"))).alias("__all"))
    return parts.select(*by, F.col("__u").alias("__b"), F.sha2(F.array_join(F.transform("__all", lambda x: x["__p"]), ""), 256).alias("__p"))


def pairwise_accuracy(df: DataFrame, by: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """by, pairs, accuracy: of a group's pairs that differ in fact, the share that prediction puts the same way; pairs that it ties count half. No such pair: null.

    No pair is made. Predictions become numbers in order; two numbers part at one
    binary digit, so at each digit rows that agree above it are counted past each
    other by a running sum over the actual values: n log n rows for n of them.
    """
    counted = df.dropna(subset=[predicted, actual]).groupBy(*by, predicted, actual).agg(F.count("*").cast("double").alias("__n"))
    w = Window.partitionBy(*by)
    place = F.dense_rank().over(w.orderBy(predicted)) - 1
    ranked = counted.withColumn("__p", place).withColumn("__bits", F.length(F.bin(F.max("__p").over(w).cast("long"))))
    digits = ranked.withColumn("__d", F.explode(F.sequence(F.lit(0), F.col("__bits") - 1)))
    digits = digits.withColumns({"__up": F.expr("shiftright(__p, __d + 1)"), "__one": F.expr("shiftright(__p, __d) & 1")})
    parts = digits.groupBy(*by, "__d", "__up", actual).agg(F.sum(F.when(F.col("__one") == 0, F.col("__n")).otherwise(0.0)).alias("__zeros"), F.sum(F.when(F.col("__one") == 1, F.col("__n")).otherwise(0.0)).alias("__ones"))
    same = Window.partitionBy(*by, "__d", "__up")
    below = F.coalesce(F.sum("__zeros").over(same.orderBy(actual).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("__zeros").over(same) - below - F.col("__zeros")
    parted = parts.withColumns({"__right": F.col("__ones") * below, "__wrong": F.col("__ones") * above}).groupBy(*by).agg(F.sum("__right").alias("__right"), F.sum("__wrong").alias("__wrong"))
    ties = counted.groupBy(*by, predicted).agg(F.sum("__n").alias("__s"), F.sum(F.col("__n") * F.col("__n")).alias("__q"))
    ties = ties.groupBy(*by).agg(F.sum((F.col("__s") * F.col("__s") - F.col("__q")) / 2).alias("__tied"))
    pairs = F.col("__right") + F.col("__wrong") + F.col("__tied")
    return parted.join(ties, list(by)).select(*by, pairs.cast("long").alias("pairs"), F.when(pairs > 0, (F.col("__right") + F.col("__tied") / 2) / pairs).alias("accuracy"))


def frame_summary(df: DataFrame, by: Sequence[str], sse: str, count: str, duration: str, data_range: float = 1.0) -> DataFrame:
    """pooled_quality() with the mean of decibels weighted by duration, the measured share of all time, and how many frames are without error."""
    own = F.when((F.col(count) > 0) & (F.col(sse) > 0), psnr(F.col(sse) / F.nullif(F.col(count), F.lit(0)), data_range))
    good = (F.col(count) > 0) & F.col(sse).isNotNull()
    time = df.groupBy(*by).agg(
        (F.sum(own * F.col(duration)) / F.nullif(F.sum(F.when(own.isNotNull(), F.col(duration))), F.lit(0.0))).alias("timed_psnr_db"),
        (F.sum(F.when(good, F.col(duration))) / F.nullif(F.sum(duration), F.lit(0.0))).alias("time_coverage"),
        F.count_if(good & (F.col(sse) == 0)).alias("n_infinite"),
    )
    pooled = pooled_quality(df, by, sse, count, data_range)
    same = F.lit(True)
    for c in by:
        same &= pooled[c].eqNullSafe(time[c])
    return pooled.join(time, same).select(*[pooled[c] for c in pooled.columns], "timed_psnr_db", "time_coverage", "n_infinite")
