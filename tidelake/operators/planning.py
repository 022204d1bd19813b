"""Plans over choices: joint oracles, policies, labels with pruning, whole plans with locks and fallback, replays.

Cases are dealt over tasks; the items of one case are bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.selection import SELECTED, select_within_budget, solve_exact_bytes, undominated


def allocations(choices: DataFrame, case: str, item: str, choice: str, sums: Sequence[str], most: int) -> DataFrame:
    """case, the sums of every allocation's columns, and its selection in order of items; for cases of at most `most` items, which must be few."""
    w = Window.partitionBy(case)
    numbered = choices.withColumn("__i", F.dense_rank().over(w.orderBy(item))).withColumn("__n", F.max("__i").over(w))
    level = numbered.where("__i = 1").select(case, "__n", *sums, F.array(choice).alias("selection"))
    done = level.where("__n = 1")
    for k in range(2, most + 1):
        step = numbered.where(F.col("__i") == k).select(case, F.col(choice).alias("__k"), *[F.col(c).alias(f"__s_{c}") for c in sums])
        level = level.join(step, case).select(case, "__n", *[(F.col(c) + F.col(f"__s_{c}")).alias(c) for c in sums], F.concat("selection", F.array("__k")).alias("selection"))
        done = done.unionByName(level.where(F.col("__n") == k))
    return done.drop("__n")


def joint_oracle(every: DataFrame, budgets: DataFrame, case: str, cost: str, error: str, count: str) -> DataFrame:
    """case, feasible, cost, pooled, selection: the allocation within the budget of least pooled error, of equals the cheaper, then the smaller choices.

    every as of allocations(), budgets as case and budget. Cases with nothing within the budget have no row.
    """
    fits = every.join(budgets.select(case, "budget"), case).where(F.col(cost) <= F.col("budget"))
    scored = fits.withColumn("pooled", F.col(error) / F.col(count))
    key = F.struct("pooled", F.col(cost).alias("cost"), "selection")
    return scored.groupBy(case).agg(F.count("*").alias("feasible"), F.min(key).alias("__b")).select(case, "feasible", "__b.cost", "__b.pooled", "__b.selection")


def oracle_gap(decided: DataFrame, oracle: DataFrame, on: Sequence[str], error: str, places: int = 9) -> DataFrame:
    """decided with gap, in decimals of so many places, and relative_gap to the oracle's error.

    Errors are compared as decimals, so that what differs below the last place is equal;
    a decision whose error is then below the oracle's is an error. An oracle of zero has
    no relative gap.
    """
    exact = lambda c: F.col(c).cast(f"decimal(38,{places})")
    best = oracle.select(*on, exact(error).alias("__least"))
    rows = decided.join(best, list(on)).withColumn("gap", (exact(error) - F.col("__least")).cast("double"))
    sound = F.assert_true(F.coalesce(F.col("gap") >= 0, F.lit(True)), F.lit("a decision beats the oracle"))
    share = F.col("gap") / F.nullif(F.col("__least").cast("double"), F.lit(0.0))
    return rows.where(sound.isNull()).withColumn("relative_gap", share).drop("__least")


def policy_values(policy: str, quality: str, base: str, own: str, case: str, item: str, choice: str) -> Column:
    """What a sample is worth under a policy: its quality, its own error's reduction, or that of the mean errors over all samples."""
    over = Window.partitionBy(case, item, choice)
    known = {
        "quality_proxy": lambda: F.col(quality).cast("double"),
        "exact_error": lambda: F.col(base) - F.col(own),
        "average_error": lambda: F.avg(base).over(over) - F.avg(own).over(over),
    }
    if policy not in known:
        raise ValueError(f"no policy {policy}")
    return known[policy]()


def policy_utilities(samples: DataFrame, policy: str, case: str, sample: str, weight: str, item: str, choice: str, area: str, quality: str, base: str, own: str) -> DataFrame:
    """case, item, choice, utility: values of samples by the sample's share of weights and the item's share of the sample's area.

    A sample without any area gives nothing. The weight belongs to (case, sample), the area to (case, sample, item).
    """
    seen = samples.groupBy(case, sample, item).agg(F.first(weight).alias("__w"), F.first(area).alias("__a"))
    areas = seen.groupBy(case, sample).agg(F.sum("__a").alias("__areas"), F.first("__w").alias("__w"))
    total = areas.groupBy(case).agg(F.sum("__w").alias("__weights"))
    shares = areas.drop("__w").join(total, case)
    valued = samples.withColumn("__v", policy_values(policy, quality, base, own, case, item, choice)).join(shares, [case, sample])
    share = F.coalesce(F.col(area) / F.nullif(F.col("__areas"), F.lit(0)), F.lit(0.0))
    return valued.groupBy(case, item, choice).agg(F.sum(F.col(weight) / F.col("__weights") * share * F.col("__v")).alias("utility"))


def solve_by_labels(costs: np.ndarray, utilities: np.ndarray, budget: int, max_labels: int) -> tuple[str, float | None, int | None, list[int] | None]:
    """Optimum by labels carried from item to item; a label goes if another dominates it, if nothing within the budget follows, or if the best that can follow is less than what is in hand.

    Status "incomplete" where an item had more than max_labels labels: the result is
    then what is in hand, which keeps the budget but need not be best.
    """
    items = len(costs)
    gains = np.where(np.isfinite(costs), utilities, -np.inf)
    cheap = np.nanargmin(costs, 1) if items else np.zeros(0, int)
    rows = np.arange(items)
    cost_after = np.append(np.cumsum(costs[rows, cheap][::-1])[::-1], 0)
    sure_after = np.append(np.cumsum(utilities[rows, cheap][::-1])[::-1], 0)
    hope_after = np.append(np.cumsum(gains.max(1)[::-1])[::-1], 0) if items else np.zeros(1)
    if cost_after[0] > budget:
        return "infeasible", None, None, None
    in_hand, incomplete = (float(sure_after[0]), int(cost_after[0]), cheap.tolist()), False
    labels = (np.zeros(1, np.int64), np.zeros(1), np.zeros((1, 0), np.int16))
    for k in range(items):
        spent, gain, path = labels
        parts = []
        for c in np.flatnonzero(np.isfinite(costs[k])):
            keep = spent + costs[k, c] + cost_after[k + 1] <= budget
            parts.append((spent[keep] + int(costs[k, c]), gain[keep] + utilities[k, c], np.column_stack([path[keep], np.full(keep.sum(), c, np.int16)])))
        spent, gain, path = undominated(*map(np.concatenate, zip(*parts, strict=True)))
        if not len(gain):
            labels = spent, gain, path
            break
        at = int(np.argmax(gain + sure_after[k + 1]))
        if gain[at] + sure_after[k + 1] > in_hand[0]:
            in_hand = float(gain[at] + sure_after[k + 1]), int(spent[at] + cost_after[k + 1]), path[at].tolist() + cheap[k + 1 :].tolist()
        slack = 1e-9 * max(1.0, abs(in_hand[0]))
        hopeful = np.flatnonzero(gain + hope_after[k + 1] >= in_hand[0] - slack)
        if len(hopeful) > max_labels:
            incomplete, hopeful = True, np.sort(hopeful[np.argsort(-(gain[hopeful] + hope_after[k + 1]), kind="stable")[:max_labels]])
        labels = spent[hopeful], gain[hopeful], path[hopeful]
    spent, gain, path = labels
    if len(gain) and gain[-1] >= in_hand[0]:
        in_hand = float(gain[-1]), int(spent[-1]), path[-1].tolist()
    return "incomplete" if incomplete else "optimal", *in_hand


def select_by_labels(choices: DataFrame, case: str, item: str, choice: str, cost: str, utility: str, budget: str, max_labels: int = 100_000, finish: bool = True) -> DataFrame:
    """case and SELECTED by solve_by_labels(); with `finish`, cases over max_labels are solved by fronts of spendings instead of staying incomplete."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        key, room = rows[case].iloc[0], int(rows[budget].iloc[0])
        wide = rows.pivot_table(index=item, columns=choice, values=[cost, utility], aggfunc="first")
        costs, gains = wide[cost].to_numpy(float), wide[utility].to_numpy(float)
        found = solve_by_labels(costs, gains, room, max_labels)
        status, gain, spent, chosen = solve_exact_bytes(costs, gains, room) if finish and found[0] == "incomplete" else found
        return pd.DataFrame({case: [key], "status": pd.Series([status], dtype=object), "utility": [gain], "cost": pd.array([spent], "Int64"), "selection": [chosen]})

    return choices.select(case, item, choice, cost, utility, budget).groupBy(case).applyInPandas(one, f"{case} {dict(choices.dtypes)[case]}, {SELECTED}")


def plan(targets: DataFrame, case: str, item: str, choice: str, weight: str, quality: str, resources: str, locked: str, budget: str) -> DataFrame:
    """case, item, choice, status: one choice an item within the case's budget, best by weight times quality.

    resources is an array of structs (id, bytes); locked names an item's only choice, or
    is null. What all of an item's choices need is paid first, once a resource. Items
    that are not locked and offer the same choices, qualities and resources are planned
    as one, which costs once. Status: planned; fallback where the budget does not do,
    with every item's cheapest choice, of equals the least.
    """
    open_rows = targets.where(F.col(locked).isNull() | (F.col(locked) == F.col(choice)))
    n_choices = open_rows.groupBy(case, item).agg(F.count("*").alias("__n"))
    needs = open_rows.select(case, item, choice, F.explode(resources).alias("__r")).select(case, item, choice, "__r.id", "__r.bytes")
    common = needs.groupBy(case, item, "id").agg(F.count("*").alias("__k"), F.max("bytes").alias("bytes")).join(n_choices, [case, item]).where("__k = __n")
    paid = common.groupBy(case, "id").agg(F.max("bytes").alias("bytes"))
    fixed = paid.groupBy(case).agg(F.sum("bytes").alias("__fixed"))
    left = needs.join(paid.select(case, "id"), [case, "id"], "left_anti").groupBy(case, item, choice).agg(F.sum("bytes").alias("__cost"), F.array_sort(F.collect_list(F.struct("id", "bytes"))).alias("__needs"))
    priced = open_rows.join(left, [case, item, choice], "left").withColumn("__cost", F.coalesce("__cost", F.lit(0)))
    total = Window.partitionBy(case)
    each = priced.groupBy(case, item).agg(
        F.first(weight).alias("__w"), F.first(locked).alias("__l"), F.first(budget).alias("__budget"),
        F.array_sort(F.collect_list(F.struct(F.col(choice).alias("c"), F.col(quality).alias("q"), F.col("__cost").alias("cost"), F.col("__needs").alias("needs")))).alias("__offer"),
    )
    each = each.withColumn("__w", F.coalesce(F.col("__w") / F.nullif(F.sum("__w").over(total), F.lit(0)), F.lit(0.0)))
    same = F.when(F.col("__l").isNull(), F.sha2(F.to_json("__offer"), 256)).otherwise(F.concat(F.lit("locked-"), F.col(item).cast("string")))
    each = each.withColumn("__group", same)
    groups = each.groupBy(case, "__group").agg(F.sum("__w").alias("__w"), F.first("__offer").alias("__offer"), F.first("__budget").alias("__budget"))
    rows = groups.join(fixed, case, "left").withColumn("__room", F.col("__budget") - F.coalesce("__fixed", F.lit(0)))
    flat = rows.select(case, "__group", "__room", "__w", F.explode("__offer").alias("o")).select(case, "__group", "__room", F.col("o.c").alias("c"), F.col("o.cost").alias("cost"), (F.col("__w") * F.col("o.q")).alias("gain"))
    best = select_within_budget(flat, case, "__group", "c", "cost", "gain", "__room")
    place = flat.select(case, "__group").distinct().withColumn("__i", F.row_number().over(Window.partitionBy(case).orderBy("__group")))
    number = flat.select(case, "c").distinct().withColumn("__c", F.row_number().over(Window.partitionBy(case).orderBy("c")) - 1)
    chosen = best.where("status = 'optimal'").select(case, F.posexplode("selection").alias("__p", "__c")).withColumn("__i", F.col("__p") + 1)
    chosen = chosen.join(place, [case, "__i"]).join(number, [case, "__c"]).select(case, "__group", F.col("c").alias("__best"))
    cheapest = flat.groupBy(case, "__group").agg(F.min(F.struct("cost", "c")).getField("c").alias("__cheap"))
    both = cheapest.join(chosen, [case, "__group"], "left")
    out = each.select(case, item, "__group").join(both, [case, "__group"])
    return out.select(case, item, F.coalesce("__best", "__cheap").alias(choice), F.when(F.col("__best").isNull(), "fallback").otherwise("planned").alias("status"))


def plan_rates(planned: DataFrame, targets: DataFrame, case: str, item: str, choice: str, resources: str, budget: str) -> DataFrame:
    """case, union_bytes, budget, fits of a plan: the bytes of all resources that its choices need, each once a case, whoever shares them."""
    taken = planned.select(case, item, choice).join(targets, [case, item, choice]).select(case, F.col(budget).alias("budget"), F.explode_outer(resources).alias("__r"))
    once = taken.groupBy(case, "budget", "__r.id").agg(F.max("__r.bytes").alias("__b"))
    return once.groupBy(case).agg(F.coalesce(F.sum("__b"), F.lit(0)).alias("union_bytes"), F.max("budget").alias("budget"), F.coalesce(F.coalesce(F.sum("__b"), F.lit(0)) <= F.max("budget"), F.lit(False)).alias("fits"))


def replayed(recorded: DataFrame, again: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """on, verdict of decisions made again: same, changed (nulls being equal), lost (recorded only) or new."""
    a = recorded.select(*on, F.struct(*values).alias("__a"))
    b = again.select(*on, F.struct(*values).alias("__b"))
    verdict = F.when(F.col("__b").isNull(), "lost").when(F.col("__a").isNull(), "new").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    return a.join(b, list(on), "full").select(*on, verdict.alias("verdict"))
