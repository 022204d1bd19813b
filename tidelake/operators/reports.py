"""Rollups, audits, generators and validations that reports are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tidelake.operators.metrics import aggregate
from tidelake.operators.storage import global_row_number


def profile_rollup(df: DataFrame, by: Sequence[str], values: Sequence[str], weight: str, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Each value under four strategies, by group: mean, weighted, p95 and worst; null if any value is null."""
    out = []
    for v in values:
        worst = aggregate("worst", v, higher_is_better=v not in lower_is_better)
        out += [aggregate("uniform_mean", v).alias(f"{v}_mean"), aggregate("weighted_mean", v, weight).alias(f"{v}_weighted"), aggregate("p95", v).alias(f"{v}_p95"), worst.alias(f"{v}_worst")]
    return df.groupBy(*by).agg(*out)


def same_population(df: DataFrame, by: Sequence[str], variant: str, member: str) -> DataFrame:
    """by, n_variants, n_members, same: whether every variant of a group has the group's every member; by counts, so no set is gathered."""
    pairs = df.select(*by, variant, member).distinct()
    return pairs.groupBy(*by).agg(F.count_distinct(variant).alias("n_variants"), F.count_distinct(member).alias("n_members"), (F.count("*") == F.count_distinct(variant) * F.count_distinct(member)).alias("same"))


def visibility_aggregate(df: DataFrame, by: Sequence[str], weight: str, solo: str, visible: str) -> DataFrame:
    """Weighted solo and visible amounts and the occluded share, null where nothing is there alone."""
    a, b = F.sum(F.col(weight) * F.col(solo)), F.sum(F.col(weight) * F.col(visible))
    return df.groupBy(*by).agg(a.alias("solo"), b.alias("visible"), F.when(a > 0, 1 - b / F.nullif(a, F.lit(0.0))).alias("occlusion"))


def visibility_in_time(df: DataFrame, by: Sequence[str], time: str, item: str, weight: str, solo: str, visible: str) -> DataFrame:
    """by, item, solo, visible, occlusion as of visibility_aggregate(), and series: (time, solo, visible, occlusion) of the item's samples in order of time. The samples of an item in a group are as many as its times, which must be few."""
    keys = [*by, item]
    at = df.groupBy(*keys, time).agg(F.sum(F.col(weight) * F.col(solo)).alias("__a"), F.sum(F.col(weight) * F.col(visible)).alias("__b"))
    hidden = F.when(F.col("__a") > 0, 1 - F.col("__b") / F.nullif(F.col("__a"), F.lit(0.0)))
    series = F.array_sort(F.collect_list(F.struct(F.col(time).alias("time"), F.col("__a").alias("solo"), F.col("__b").alias("visible"), hidden.alias("occlusion"))))
    a, b = F.sum("__a"), F.sum("__b")
    return at.groupBy(*keys).agg(a.alias("solo"), b.alias("visible"), F.when(a > 0, 1 - b / F.nullif(a, F.lit(0.0))).alias("occlusion"), series.alias("series"))


def flattened(df: DataFrame, between: str = "_") -> DataFrame:
    """df with every nested struct as columns of its own, named by the way to them; arrays and maps as JSON text. Two columns of one name are refused."""

    def leaves(kind: StructType, way: list[str]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = [*way, f.name]
            path = ".".join(f"`{p}`" for p in here)
            if isinstance(f.dataType, StructType):
                out += leaves(f.dataType, here)
            else:
                nested = isinstance(f.dataType, (ArrayType, MapType))
                out.append((F.to_json(F.col(path)) if nested else F.col(path)).alias(between.join(here)))
        return out

    flat = df.select(*leaves(df.schema, []))
    if len(set(flat.columns)) < len(flat.columns):
        raise ValueError(f"columns of one name among {flat.columns}")
    return flat


def uncovered(rows: DataFrame, context: Sequence[str], frame: str, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(context, frame): the frames that a context ought to have, by `wanted` (by, frame), and has not; by names those columns of the context that wanted goes by."""
    contexts = rows.select(*context).distinct()
    due = contexts.join(wanted.select(*by, frame).distinct(), list(by))
    return due.join(rows, [*context, frame], "left_anti").select(*context, frame)


def gain_by_step(df: DataFrame, by: Sequence[str], rank: str, error: str, name: str = "gain") -> DataFrame:
    """Error of the rank below less own error; null for the lowest."""
    return df.withColumn(name, F.lag(error).over(Window.partitionBy(*by).orderBy(rank)) - F.col(error))


def signatures(df: DataFrame, item: str, member: str) -> DataFrame:
    """item, signature, n: items of equal sets of members have equal signatures; sums of member hashes, so no set is gathered."""
    h = lambda salt: F.sum(F.pmod(F.xxhash64(F.lit(salt), F.col(member)), F.lit(1 << 40)))
    return df.select(item, member).distinct().groupBy(item).agg(F.concat_ws(":", F.count("*"), h(1), h(2)).alias("signature"), F.count("*").alias("n"))


def class_masks(df: DataFrame, item: str, member: str) -> DataFrame:
    """item, n_classes, mask: which classes of members an item has, as hex text of bits, the lowest first in each byte, trailing zeros left out.

    Members that the same items have are one class, so that their bytes count together;
    classes are numbered from 0 by their least member. Bits are gathered by Spark's
    bitmaps, in buckets of 32,768 classes; a bucket's text is as long as its last bit needs.
    """
    pairs = df.select(F.col(item).alias("item"), F.col(member).alias("member")).distinct()
    alike = signatures(pairs, "member", "item").select("member", "signature")
    least = alike.groupBy("signature").agg(F.min("member").alias("first"))
    number = global_row_number(least, ["first"], "bit").select("signature", (F.col("bit") - 1).alias("bit"))
    bits = pairs.join(alike, "member").join(number, "signature").select("item", "bit").distinct()
    parts = bits.groupBy("item", F.expr("bit DIV 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
    return parts.groupBy("item").agg(F.sum(F.bitmap_count("bits")).alias("n_classes"), F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("all")).select(
        F.col("item").alias(item), "n_classes", _trimmed(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.element_at("all", -1)["bucket"]), lambda b: F.coalesce(F.hex(F.get(F.filter("all", lambda x: x["bucket"] == b), F.lit(0))["bits"]), F.lit("0" * 8192))), "")).alias("mask")
    )


def _trimmed(hexes: Column) -> Column:
    """Without bytes of zero at the end."""
    return F.regexp_replace(hexes, "(00)+$", "")


def differing_rows(a: DataFrame, b: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose values differ, nulls being equal, or that one side lacks."""
    x = a.select(*on, F.struct(*values).alias("__a"), F.lit(True).alias("__ina"))
    y = b.select(*on, F.struct(*values).alias("__b"), F.lit(True).alias("__inb"))
    both = x.join(y, list(on), "full")
    lacks = F.col("__ina").isNull() | F.col("__inb").isNull()
    return both.where(lacks | ~F.col("__a").eqNullSafe(F.col("__b"))).select(*on)


def sequence_faults(df: DataFrame, by: Sequence[str], order: str, step: int = 1) -> DataFrame:
    """Rows that do not follow the one before by `step`: by, order, kind (repeated, gap, back)."""
    d = F.col(order) - F.lag(order).over(Window.partitionBy(*by).orderBy(order))
    kind = F.when(d == 0, "repeated").when(d != step, "gap")
    return df.withColumn("kind", kind).where("kind is not null").select(*by, order, "kind")


def coverage_faults(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """by, start, kind: intervals that begin after the end before them (gap) or before it (overlap)."""
    prev = F.lag(end).over(Window.partitionBy(*by).orderBy(start, end))
    kind = F.when(F.col(start) > prev, "gap").when(F.col(start) < prev, "overlap")
    return df.withColumn("kind", kind).where("kind is not null").select(*by, start, "kind")


def restricted(df: DataFrame, by: Sequence[str], rank: str, allowed: DataFrame) -> DataFrame:
    """Rows whose rank is allowed, of groups whose base, the least rank, is; allowed has the one column `rank`."""
    least = df.groupBy(*by).agg(F.min(rank).alias(rank)).join(allowed, rank, "left_semi")
    return df.join(allowed, rank, "left_semi").join(least.select(*by), list(by), "left_semi")


def package_faults(members: DataFrame, sources: DataFrame, source: str, place: str) -> DataFrame:
    """rule and key of what an index breaks: keys (source, place) that repeat, members without a source, sources without members, places that are not 1 to n.

    Members and sources are one stream, sorted once by source; all rules are read from it,
    so a task holds no table of keys and joins nothing. A source's members meet in one task.
    """
    rows = members.select(F.col(source).alias("__s"), F.col(place).alias("__p"), F.lit(False).alias("__is_source"))
    rows = rows.unionByName(sources.select(F.col(source).alias("__s"), F.lit(None).cast(members.schema[place].dataType).alias("__p"), F.lit(True).alias("__is_source")))
    w, whole = Window.partitionBy("__s").orderBy("__is_source", "__p"), Window.partitionBy("__s")
    like = lambda k: (F.col("__at") > k) & F.col("__p").eqNullSafe(F.col(f"__p{k}"))
    member = ~F.col("__is_source")
    rows = rows.withColumns({"__at": F.row_number().over(w), "__p1": F.lag("__p", 1).over(w), "__p2": F.lag("__p", 2).over(w)})
    rows = rows.withColumns({"__again": member & like(1), "__second": member & like(1) & ~like(2)})
    rows = rows.withColumns({
        "__lo": F.min("__p").over(whole), "__hi": F.max("__p").over(whole), "__n": F.count_if(member).over(whole),
        "__d": F.count_if(F.col("__p").isNotNull() & ~F.col("__again")).over(whole), "__sources": F.count_if("__is_source").over(whole),
    })
    first, lone = member & (F.col("__at") == 1), F.col("__s").isNull()  # a null is no one's source
    broken = {
        "repeated key": F.col("__second"),
        "no source": first & (lone | (F.col("__sources") == 0)),
        "not covered": F.col("__is_source") & (lone | (F.col("__n") == 0)),
        "places": first & F.expr("__lo != 1 OR __hi != __n OR __d != __n"),
    }
    key = lambda rule: F.concat_ws(":", "__s", "__p") if rule == "repeated key" else F.concat_ws(":", "__s")
    found = F.array(*[F.when(c, F.struct(F.lit(rule).alias("rule"), key(rule).alias("key"))) for rule, c in broken.items()])
    bad = F.lit(False)
    for c in broken.values():
        bad |= F.coalesce(c, F.lit(False))
    return rows.where(bad).select(F.explode(found).alias("f")).where("f IS NOT NULL").select("f.*")


def synthetic_cases(spark: SparkSession, n: int, items: int, seed: int) -> DataFrame:
    """case, item, weight of a generated workload: hashes of (seed, case, item), so that more cases leave the first as they are."""
    unit = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1_000_003)) / 1_000_003.0
    grid = spark.range(n).select(F.col("id").alias("case"), F.explode(F.sequence(F.lit(0), F.lit(items - 1))).alias("item"))
    return grid.withColumn("weight", unit(F.col("case"), F.col("item")))


def clones(df: DataFrame, n: int, owner: str, content: str) -> DataFrame:
    """n copies of each row, of different owners and with content hashes of their own."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return copies.withColumn(owner, F.concat_ws("#", owner, "copy")).withColumn(content, F.sha2(F.concat_ws(":", owner, content).cast("binary"), 256))


def density_utility(weight: Column, visible: Column, pixels: Column, base: Column, own: Column) -> Column:
    """weight * visible / pixels * (base density - own density); null where an input is missing or there are no pixels."""
    return weight * visible / F.nullif(pixels, F.lit(0)) * (base - own)


def missing_bytes(wanted: DataFrame, resident: DataFrame, by: Sequence[str], key: str, size: str) -> DataFrame:
    """Bytes of each group's distinct resources that are not resident."""
    new = wanted.join(resident.select(key).distinct(), key, "left_anti")
    return new.groupBy(*by, key).agg(F.max(size).alias("__s")).groupBy(*by).agg(F.sum("__s").alias("missing_bytes"), F.count("*").alias("n_missing"))


def owned_bytes(wanted: DataFrame, resident: DataFrame, owner: str, choice: str, key: str, size: str) -> DataFrame:
    """owner, choice, missing_bytes, reason: bytes of a choice's distinct resources that are not resident; no bytes and the reason "shared" where a resource is another owner's too, "size differs" where it has two sizes."""
    pairs = wanted.groupBy(owner, choice, key).agg(F.max(size).alias("__s"))
    facts = wanted.groupBy(key).agg((F.count_distinct(owner) > 1).alias("__shared"), (F.count_distinct(size) > 1).alias("__differs"))
    held = resident.select(key).distinct().withColumn("__held", F.lit(True))
    sums = pairs.join(facts, key).join(held, key, "left").groupBy(owner, choice).agg(F.sum(F.when(F.col("__held").isNull(), F.col("__s")).otherwise(0)).alias("missing_bytes"), F.bool_or("__shared").alias("__shared"), F.bool_or("__differs").alias("__differs"))
    reason = F.when(F.col("__shared"), "shared").when(F.col("__differs"), "size differs")
    return sums.select(owner, choice, F.when(reason.isNull(), F.col("missing_bytes")).alias("missing_bytes"), reason.alias("reason"))


def smallest_that_hold(rows: DataFrame, by: Sequence[str], variant: str, prefix: str, mean: str, worst: str, size: str, most_mean: float, most_worst: float, near: float) -> DataFrame:
    """by, variant, size, near_variants: the smallest variant whose mean and worst loss hold for every prefix that its group has, ties by variant; and how many others that hold are within `near` of its size."""
    held = F.bool_and(F.coalesce((F.col(mean) <= most_mean) & (F.col(worst) <= most_worst), F.lit(False)))
    each = rows.groupBy(*by, variant).agg(held.alias("__ok"), F.count_distinct(prefix).alias("__n"), F.max(size).alias(size))
    wanted = rows.groupBy(*by).agg(F.count_distinct(prefix).alias("__all"))
    good = each.join(wanted, list(by)).where("__ok AND __n = __all").select(*by, variant, size)
    least = good.groupBy(*by).agg(F.min(F.struct(size, variant)).alias("__m"))
    both = good.join(least, list(by))
    return both.groupBy(*by).agg(F.first("__m")[variant].alias(variant), F.first("__m")[size].alias(size), (F.count_if(F.col(size) <= F.col("__m")[size] * (1 + near)) - 1).alias("near_variants"))


def conservation_faults(delivered: DataFrame, by: Sequence[str], time: str, tie: str, amount: str, capacity: str, tolerance: float) -> DataFrame:
    """Rows by whose time more has come than could: the sum of amounts so far is above `capacity`, what the link could carry by then, by more than tolerance; by, time, tie, over."""
    so_far = F.sum(amount).over(Window.partitionBy(*by).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0))
    over = so_far - F.col(capacity)
    return delivered.withColumn("over", over).where(F.col("over") > tolerance).select(*by, time, tie, "over")


def catalog_faults(rows: DataFrame, content: str, variant: str, place: str, mapping: str, rate: str, length: str) -> DataFrame:
    """rule and key of what a catalog of variants breaks: "places" (a variant's are not 0 to n - 1), "mapping" (variants of a content map a place differently, or not all have it), "rate" (a variant has several), "whole frames" (a piece is no whole number of frames)."""
    key = lambda *c: F.concat_ws(":", *[F.col(x).cast("string") for x in c]).alias("key")
    row = lambda df, rule, *c: df.select(F.lit(rule).alias("rule"), key(*c)).distinct()
    per = rows.groupBy(content, variant).agg(F.min(place).alias("__lo"), F.max(place).alias("__hi"), F.count_distinct(place).alias("__d"), F.count("*").alias("__n"), F.count_distinct(rate).alias("__rates"))
    out = row(per.where("__lo != 0 OR __hi != __n - 1 OR __d != __n"), "places", content, variant)
    variants = rows.groupBy(content).agg(F.count_distinct(variant).alias("__v"))
    maps = rows.groupBy(content, place).agg(F.count_distinct(mapping).alias("__m"), F.count_distinct(variant).alias("__have")).join(variants, content)
    out = out.unionByName(row(maps.where("__m != 1 OR __have != __v"), "mapping", content, place))
    out = out.unionByName(row(per.where("__rates != 1"), "rate", content, variant))
    frames = F.col(length) * F.col(rate)
    return out.unionByName(row(rows.where(F.abs(frames - F.round(frames)) > 1e-6), "whole frames", content, variant, place))


def window_picks(windows: DataFrame, value: str, spread: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """kind and the row of windows that stands for it: of the kinds low, middle and high by two quantiles of `value`, the window nearest to its kind's medians of value and spread, each in interquartile ranges; ties by start.

    Quantiles come from counts by value over all windows; only five numbers a kind travel.
    """
    cuts = windows.agg(F.percentile(value, low).alias("__l"), F.percentile(value, high).alias("__h"))
    kind = F.when(F.col(value) <= F.col("__l"), "low").when(F.col(value) >= F.col("__h"), "high").otherwise("middle")
    named = windows.join(F.broadcast(cuts)).withColumn("kind", kind).drop("__l", "__h")  # cuts: one row
    q = lambda c, p: F.percentile(c, p)
    facts = named.groupBy("kind").agg(*[f.alias(n) for c, k in ((value, "v"), (spread, "s")) for f, n in ((q(c, 0.5), f"__{k}m"), (q(c, 0.75) - q(c, 0.25), f"__{k}r"))])
    far = F.lit(0.0)
    for c, k in ((value, "v"), (spread, "s")):
        far += F.abs(F.col(c) - F.col(f"__{k}m")) / F.when(F.col(f"__{k}r") > 0, F.col(f"__{k}r")).otherwise(1.0)
    ranked = named.join(F.broadcast(facts), "kind").withColumn("__far", F.round(far, 9))  # three rows
    best = ranked.groupBy("kind").agg(F.min_by(F.struct(*windows.columns), F.struct("__far", "start")).alias("__w"))
    return best.select("kind", "__w.*")


def window_classes(df: DataFrame, time: str, value: str, length: str, slide: str) -> DataFrame:
    """start, n, mean, variance and class of hopping windows: stable, variable or middle by thirds of the variance, low, middle or high by thirds of the mean."""
    w = df.groupBy(F.window(time, length, slide)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    cuts = w.agg(*[F.percentile(c, q).alias(f"{c}{k}") for c in ("mean", "variance") for k, q in ((1, 1 / 3), (2, 2 / 3))])
    label = lambda c, names: F.when(F.col(c) <= F.col(f"{c}1"), names[0]).when(F.col(c) <= F.col(f"{c}2"), names[1]).otherwise(names[2])
    both = F.concat_ws("-", label("mean", ("low", "middle", "high")), label("variance", ("stable", "middle", "variable")))
    return w.join(F.broadcast(cuts)).select(F.col("window.start").alias("start"), "n", "mean", "variance", both.alias("class"))  # cuts: one row


def eta_seconds(df: DataFrame, by: Sequence[str], done: str, seconds: str, remaining: int, last: int = 20) -> DataFrame:
    """by, eta: mean of the last finished tasks times what remains."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(done).desc(), F.col(seconds)))
    return df.withColumn("__k", k).where(F.col("__k") <= last).groupBy(*by).agg((F.avg(seconds) * remaining).alias("eta"))


def profile_faults(df: DataFrame, context: Sequence[str], quality: str, error: str, reference: str, key: Sequence[str]) -> DataFrame:
    """rule and key of what a quality profile breaks: repeated keys, errors that are missing or negative, a reference not equal to itself, contexts without one of the qualities."""
    name = lambda columns: F.concat_ws(":", *columns)
    row = lambda bad, rule: df.where(bad).select(F.lit(rule).alias("rule"), name([*key]).alias("key"))
    repeated = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated key").alias("rule"), name([*key]).alias("key"))
    wanted = df.select(quality).distinct()
    have = df.groupBy(*context).agg(F.count_distinct(quality).alias("n")).join(F.broadcast(wanted.agg(F.count("*").alias("all"))))  # one row
    lacking = have.where("n < all").select(F.lit("missing quality").alias("rule"), name([*context]).alias("key"))
    e = F.col(error)
    return repeated.unionByName(row(e.isNull() | (e < 0), "bad error")).unionByName(row((F.col(quality) == reference) & (e != 0), "reference differs")).unionByName(lacking)


def protocol_faults(references: DataFrame, declared: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """on, field, found, wanted: values of references that are not those declared for their method, nulls being equal; methods that nothing declares have field null."""
    want = declared.select(*on, *[F.col(v).cast("string").alias(f"__{v}") for v in values], F.lit(True).alias("__known"))
    both = references.select(*on, *[F.col(v).cast("string").alias(v) for v in values]).join(want, list(on), "left")
    fields = F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).alias("found"), F.col(f"__{v}").alias("wanted")) for v in values])
    wrong = F.filter(fields, lambda x: ~x["found"].eqNullSafe(x["wanted"]))
    unknown = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("found"), F.lit(None).cast("string").alias("wanted")))
    return both.select(*on, F.explode(F.when(F.col("__known").isNull(), unknown).otherwise(wrong)).alias("x")).select(*on, "x.*")


def first_failed(df: DataFrame, stages: Sequence[tuple[str, Column]], name: str = "failed") -> DataFrame:
    """df with the first stage whose condition does not hold, a null condition included; null where all hold."""
    cases = [F.when(~F.coalesce(ok, F.lit(False)), stage) for stage, ok in stages]
    return df.withColumn(name, F.coalesce(*cases))
