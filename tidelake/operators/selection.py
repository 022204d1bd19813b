"""Utilities, budgets and multiple-choice knapsack selection.

A case is a group of items, each with a few choices of a cost and a utility; one
choice of each item is taken so that costs keep within the budget and utilities are
most. The dynamic programme is sequential over a case's items and parallel over
cases: applyInPandas gets one case at a time, whose items are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SELECTED = "status string, utility double, cost long, selection array<int>"


def weighted_gain(df: DataFrame, by: Sequence[str], rank: str, error: str, weight: Column, name: str = "utility") -> DataFrame:
    """weight * (error of the lowest rank - own error) within each group; signed, never clamped."""
    base = F.first(error).over(Window.partitionBy(*by).orderBy(rank))
    return df.withColumn(name, weight * (base - F.col(error)))


#: Objectives by name: functions of a quality, a visible area, pixels, a base's error and an own error.
UTILITIES: dict[str, Callable[[Column, Column, Column, Column, Column], Column]] = {
    "share_quality": lambda q, a, n, d0, d: a / F.nullif(n, F.lit(0)) * q,
    "visibility_psnr": lambda q, a, n, d0, d: F.when(a > 0, q).otherwise(0.0),
    "visibility_mse": lambda q, a, n, d0, d: a / F.nullif(n, F.lit(0)) * (d0 - d),
    "solo_sse": lambda q, a, n, d0, d: n * (d0 - d),
    "weighted_sse": lambda q, a, n, d0, d: a * (d0 - d),
    "historical_mse": lambda q, a, n, d0, d: F.sqrt(F.greatest(a / F.nullif(n, F.lit(0)), F.lit(0.0))) * (d0 - d),
}


def register_utility(name: str, objective: Callable[[Column, Column, Column, Column, Column], Column]) -> None:
    """Adds an objective of one's own to UTILITIES; a name that is taken is refused."""
    if name in UTILITIES:
        raise ValueError(f"the method {name} is there already")
    UTILITIES[name] = objective


def utility(method: str, quality: str, area: str, pixels: str, base_mse: str, mse: str) -> Column:
    """One of the named objectives over joined columns; 0 where it is null."""
    if method not in UTILITIES:
        raise ValueError(f"no method {method}, only {sorted(UTILITIES)}")
    return F.coalesce(UTILITIES[method](*(F.col(c) for c in (quality, area, pixels, base_mse, mse))), F.lit(0.0))


def discretised(cost: Column, step: int, up: bool = True) -> Column:
    """Bins of a cost: upwards for costs, downwards for budgets, so that no choice costs more than it seems."""
    return (F.ceil(cost / step) if up else F.floor(cost / step)).cast("long")


def budget_bytes(rate_bps: Column, seconds: Column, safety: float) -> Column:
    """Whole bytes that a rate carries in a time, less a safety share, in decimals."""
    exact = rate_bps.cast("decimal(20,4)") * F.lit(safety).cast("decimal(6,4)") * seconds.cast("decimal(10,2)") / F.lit(8)
    return F.floor(exact).cast("long")


def budget_ladder(df: DataFrame, by: Sequence[str], item: str, cost: str, fractions: Sequence[float]) -> DataFrame:
    """by, fraction, budget: least cost of all items plus a share of the way to the greatest."""
    item_bounds = df.groupBy(*by, item).agg(F.min(cost).alias("lo"), F.max(cost).alias("hi"))
    total = item_bounds.groupBy(*by).agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    rows = total.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    return rows.select(*by, "fraction", (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * F.col("fraction"))).cast("long").alias("budget"))


def solve(costs: np.ndarray, utilities: np.ndarray, budget: int, step: int) -> tuple[str, float | None, int | None, list[int] | None]:
    """Exact optimum over rounded costs; costs and utilities are [items, choices], nan where there is no choice.

    Costs are rounded up and the budget down. Of equal utilities the smaller first
    choices win. Status: optimal, infeasible (even unrounded), or rounded_infeasible.
    """
    items = len(costs)
    cheapest = np.nanmin(costs, 1).sum() if items else 0
    if cheapest > budget:
        return "infeasible", None, None, None
    bins, room = np.ceil(costs / step), int(budget // step)
    value = np.full((items + 1, room + 1), -np.inf)
    value[items] = 0
    for k in range(items - 1, -1, -1):
        for c in range(costs.shape[1]):
            if np.isfinite(bins[k, c]) and bins[k, c] <= room:
                b = int(bins[k, c])
                value[k, b:] = np.maximum(value[k, b:], value[k + 1, : room + 1 - b] + utilities[k, c])
    if not np.isfinite(value[0, room]):
        return "rounded_infeasible", None, None, None
    left, chosen = room, []
    for k in range(items):
        for c in range(costs.shape[1]):
            b = bins[k, c]
            if np.isfinite(b) and b <= left and value[k + 1, left - int(b)] + utilities[k, c] == value[k, left]:
                chosen.append(c)
                left -= int(b)
                break
    return "optimal", float(value[0, room]), int(sum(costs[k, c] for k, c in enumerate(chosen))), chosen


def fronts(costs: np.ndarray, utilities: np.ndarray, budget: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the items from each number on: the spendings that no cheaper one beats, rising, and the most utility of each.

    Spendings that leave too little for the cheapest choices of the items before are
    left out. There are no bins, so memory follows the spendings and not the budget.
    """
    before = np.concatenate([[0], np.cumsum(np.nanmin(costs, 1))]) if len(costs) else np.zeros(1)
    out = [(np.zeros(1, np.int64), np.zeros(1))]
    for k in range(len(costs) - 1, -1, -1):
        spent, gain = out[-1]
        can = np.flatnonzero(np.isfinite(costs[k]))
        total = (costs[k, can].astype(np.int64)[:, None] + spent).ravel()
        value = (utilities[k, can][:, None] + gain).ravel()
        order = np.lexsort((-value, total))
        order = order[total[order] <= budget - before[k]]
        top = np.maximum.accumulate(value[order])
        rises = np.diff(top, prepend=-np.inf) > 0
        out.append((total[order][rises], value[order][rises]))
    return out[::-1]


def solve_by_fronts(costs: np.ndarray, utilities: np.ndarray, step: int, budget: int) -> tuple[str, float | None, int | None, list[int] | None]:
    """What solve() gives, by fronts of spendings in bins: for budgets of very many bins."""
    if len(costs) and np.nanmin(costs, 1).sum() > budget:
        return "infeasible", None, None, None
    bins, left = np.ceil(costs / step), int(budget // step)
    suffix = fronts(bins, utilities, left)
    if not len(suffix[0][0]):
        return "rounded_infeasible", None, None, None
    need, chosen = suffix[0][1][-1], []
    for k in range(len(costs)):
        spent, gain = suffix[k + 1]
        for c in range(costs.shape[1]):
            at = np.searchsorted(spent, left - bins[k, c], "right") - 1 if np.isfinite(bins[k, c]) else -1
            if at >= 0 and utilities[k, c] + gain[at] == need:
                need, left = gain[at], left - int(bins[k, c])
                chosen.append(c)
                break
    return "optimal", float(suffix[0][1][-1]), int(sum(costs[k, c] for k, c in enumerate(chosen))), chosen


def solve_exact_bytes(costs: np.ndarray, utilities: np.ndarray, budget: int) -> tuple[str, float | None, int | None, list[int] | None]:
    """Exact optimum over unrounded costs. Of equal utilities the cheaper wins, then the smaller first choices."""
    suffix = fronts(costs, utilities, budget)
    if not len(suffix[0][0]):
        return "infeasible", None, None, None
    left, need, chosen = int(suffix[0][0][-1]), suffix[0][1][-1], []
    spent_in_all, best = left, float(need)
    for k in range(len(costs)):
        spent, gain = suffix[k + 1]
        for c in np.flatnonzero(np.isfinite(costs[k])).tolist():
            at = int(np.searchsorted(spent, left - int(costs[k, c])))
            if at < len(spent) and spent[at] == left - int(costs[k, c]) and utilities[k, c] + gain[at] == need:
                left, need = int(spent[at]), gain[at]
                chosen.append(c)
                break
    return "optimal", best, spent_in_all, chosen


def select_within_budget(choices: DataFrame, case: str, item: str, choice: str, cost: str, utility: str, budget: str, step: int = 1, max_cells: int = 50_000_000) -> DataFrame:
    """case and SELECTED: the best choice (from 0) of each item, items by order.

    Cases of more than max_cells items times bins are solved by fronts of spendings
    instead of a table, with the same result.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        key, room = rows[case].iloc[0], int(rows[budget].iloc[0])
        wide_cost = rows.pivot_table(index=item, columns=choice, values=cost, aggfunc="first")
        wide_gain = rows.pivot_table(index=item, columns=choice, values=utility, aggfunc="first").reindex_like(wide_cost)
        costs, gains = wide_cost.to_numpy(float), wide_gain.to_numpy(float)
        large = len(wide_cost) * (room // step + 1) > max_cells
        status, gain, spent, chosen = solve_by_fronts(costs, gains, step, room) if large else solve(costs, gains, room, step)
        return pd.DataFrame({case: [key], "status": pd.Series([status], dtype=object), "utility": [gain], "cost": pd.array([spent], "Int64"), "selection": [chosen]})

    kind = dict(choices.dtypes)[case]
    return choices.select(case, item, choice, cost, utility, budget).groupBy(case).applyInPandas(one, f"{case} {kind}, {SELECTED}")


BOUNDS = "status string, utility double, cost long, upper double, gap double, selection array<int>"


def _binned(bins: np.ndarray, costs: np.ndarray, utilities: np.ndarray, room: int) -> tuple[float, int, list[int]] | None:
    """(utility, cost, choices) of most utility, and of least cost among those, whose bins fit; one table of (utility, -cost) pairs in lexicographic order."""
    gain, spent = np.full(room + 1, -np.inf), np.zeros(room + 1, np.int64)
    gain[0], picks = 0.0, []
    for k in range(len(bins)):
        best, least, pick = np.full(room + 1, -np.inf), np.zeros(room + 1, np.int64), np.full(room + 1, -1, np.int16)
        for c in np.flatnonzero(np.isfinite(bins[k])).tolist():
            b = int(bins[k, c])
            if b > room:
                continue
            value, total = gain[: room + 1 - b] + utilities[k, c], spent[: room + 1 - b] + int(costs[k, c])
            held, paid = best[b:], least[b:]
            better = (value > held) | (value == held) & (value > -np.inf) & (total < paid)
            held[better], paid[better], pick[b:][better] = value[better], total[better], c
        gain, spent = best, least
        picks.append(pick)
    if not np.isfinite(gain).any():
        return None
    at = int(np.lexsort((spent, -gain))[0])
    out, left = [], at
    for k in range(len(bins) - 1, -1, -1):
        out.append(int(picks[k][left]))
        left -= int(bins[k, out[-1]])
    return float(gain[at]), int(spent[at]), out[::-1]


def bounds_within_budget(choices: DataFrame, case: str, item: str, choice: str, cost: str, utility: str, budget: str, bins: int = 1024) -> DataFrame:
    """case and BOUNDS: the budget in `bins` parts; costs rounded up give a selection that keeps within it, rounded down an upper bound that none exceeds.

    Of equal utilities the cheaper selection wins. status: optimal (of the rounded case),
    cheapest where rounding up leaves nothing but the cheapest choices fit, else infeasible
    with an upper bound of null. gap is upper - utility; the exact optimum lies between.
    A case's items times bins are bounded, whatever the budget.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        key, room = rows[case].iloc[0], int(rows[budget].iloc[0])
        wide = rows.pivot_table(index=item, columns=choice, values=cost, aggfunc="first")
        costs = wide.to_numpy(float)
        gains = rows.pivot_table(index=item, columns=choice, values=utility, aggfunc="first").reindex_like(wide).to_numpy(float)
        status, lower, upper = "infeasible", None, None
        if np.nanmin(costs, 1).sum() <= room:
            parts = bins if room else 0
            # With no budget at all only choices that cost nothing fit.
            scaled = lambda up: np.ceil(costs * bins / room - 1e-9) if up else np.floor(costs * bins / room + 1e-9)
            zero = np.where(costs > 0, 1.0, costs)
            lower, top = _binned(scaled(True) if room else zero, costs, gains, parts), _binned(scaled(False) if room else zero, costs, gains, parts)
            upper, status = top[0], "optimal" if lower else "cheapest"
            if lower is None:
                order = [min(np.flatnonzero(np.isfinite(costs[k])).tolist(), key=lambda c: (costs[k, c], -gains[k, c], c)) for k in range(len(costs))]  # noqa: B023
                lower = sum(gains[k, c] for k, c in enumerate(order)), int(sum(costs[k, c] for k, c in enumerate(order))), order
        gain, spent, chosen = lower or (None, None, None)
        return pd.DataFrame({case: [key], "status": pd.Series([status], dtype=object), "utility": [gain], "cost": pd.array([spent], "Int64"), "upper": [upper], "gap": [None if upper is None else upper - gain], "selection": [chosen]})

    kind = dict(choices.dtypes)[case]
    return choices.select(case, item, choice, cost, utility, budget).groupBy(case).applyInPandas(one, f"{case} {kind}, {BOUNDS}")


Spendings = tuple[np.ndarray, np.ndarray, np.ndarray]


def undominated(spent: np.ndarray, gain: np.ndarray, path: np.ndarray) -> Spendings:
    """The rows that none of at most their spending equals in gain; of equal rows the first in order of path."""
    order = np.lexsort((*path.T[::-1], -gain, spent))
    order = order[np.diff(np.maximum.accumulate(gain[order]), prepend=-np.inf) > 0]
    return spent[order], gain[order], path[order]


def solve_shared(own: np.ndarray, utilities: np.ndarray, wants: list[list[int]], sizes: list[int], budget: int) -> tuple[str, float | None, int | None, list[int] | None]:
    """Exact optimum where choices also want shared resources, each paid for once.

    own: [items, choices] bytes that no other item wants, nan where there is no choice;
    wants: a bit for each shared resource. What later choices cost depends on the past
    only by what is paid already, so spendings are compared among equal sets of paid
    resources. Of equal utilities the cheaper wins, then the smaller first choices.
    """
    items = len(own)
    rest = np.append(np.cumsum(np.nanmin(own, 1)[::-1])[::-1], 0) if items else np.zeros(1)
    paid: dict[int, Spendings] = {0: (np.zeros(1, np.int64), np.zeros(1), np.zeros((1, 0), np.int16))}
    for k in range(items):
        grown: dict[int, list[Spendings]] = {}
        for had, (spent, gain, path) in paid.items():
            for c in np.flatnonzero(np.isfinite(own[k])).tolist():
                more = wants[k][c] & ~had
                total = spent + int(own[k, c]) + sum(size for j, size in enumerate(sizes) if more >> j & 1)
                fits = total <= budget - rest[k + 1]
                if fits.any():
                    grown.setdefault(had | more, []).append((total[fits], gain[fits] + utilities[k, c], np.column_stack([path[fits], np.full(fits.sum(), c, np.int16)])))
        paid = {now: undominated(*map(np.concatenate, zip(*parts, strict=True))) for now, parts in grown.items()}
    ends = [(-float(gain[-1]), int(spent[-1]), path[-1].tolist()) for spent, gain, path in paid.values()]
    if not ends:
        return "infeasible", None, None, None
    loss, spent, chosen = min(ends)
    return "optimal", -loss, spent, chosen


def select_with_shared_resources(choices: DataFrame, case: str, item: str, choice: str, utility: str, resources: str, budget: str) -> DataFrame:
    """case and SELECTED where choices cost the distinct bytes of their resources, and resources may be shared.

    resources is an array of structs (id, bytes). Resources that several items may
    want count as one where the same choices want them; see solve_shared().
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        key, room = rows[case].iloc[0], int(rows[budget].iloc[0])
        place = {i: k for k, i in enumerate(sorted(rows[item].unique()))}
        each = [(place[i], int(c), float(u), {r["id"]: int(r["bytes"]) for r in own}) for i, c, u, own in zip(rows[item], rows[choice], rows[utility], rows[resources], strict=True)]
        wanted: dict[str, set] = {}
        for i, c, _, own in each:
            for r in own:
                wanted.setdefault(r, set()).add((i, c))
        alike: dict[frozenset, int] = {}
        for r, size in {r: n for *_, own in each for r, n in own.items()}.items():
            if len({i for i, _ in wanted[r]}) > 1:
                alike[frozenset(wanted[r])] = alike.get(frozenset(wanted[r]), 0) + size
        width = max(c for _, c, *_ in each) + 1
        gain, private = np.full((len(place), width), np.nan), np.full((len(place), width), np.nan)
        bits = [[0] * width for _ in place]
        for i, c, u, own in each:
            gain[i, c], private[i, c] = u, sum(n for r, n in own.items() if len({x for x, _ in wanted[r]}) == 1)
            bits[i][c] = sum(1 << k for k, w in enumerate(alike) if (i, c) in w)
        status, best, spent, chosen = solve_shared(private, gain, bits, list(alike.values()), room)
        return pd.DataFrame({case: [key], "status": pd.Series([status], dtype=object), "utility": [best], "cost": pd.array([spent], "Int64"), "selection": [chosen]})

    kind = dict(choices.dtypes)[case]
    return choices.select(case, item, choice, utility, resources, budget).groupBy(case).applyInPandas(one, f"{case} {kind}, {SELECTED}")


def enumerate_allocations(choices: DataFrame, case: str, item: str, choice: str, cost: str, utility: str, budget: str, most: int) -> DataFrame:
    """case, utility, cost, selection of the best allocation by enumeration, for cases of at most `most` few items: the oracle of small cases."""
    w = Window.partitionBy(case)
    numbered = choices.withColumn("__i", F.dense_rank().over(w.orderBy(item))).withColumn("__n", F.max("__i").over(w))
    row = [F.col(cost).alias("__c"), F.col(utility).alias("__u")]
    level = numbered.where("__i = 1").select(case, budget, "__n", *row, F.array(choice).alias("selection"))
    done = level.where("__n = 1")
    for k in range(2, most + 1):
        nxt = numbered.where(F.col("__i") == k).select(case, F.col(cost).alias("__c2"), F.col(utility).alias("__u2"), F.col(choice).alias("__k2"))
        level = level.join(nxt, case).select(case, budget, "__n", (F.col("__c") + F.col("__c2")).alias("__c"), (F.col("__u") + F.col("__u2")).alias("__u"), F.concat("selection", F.array("__k2")).alias("selection"))
        done = done.unionByName(level.where(F.col("__n") == k))
    best = F.row_number().over(w.orderBy(F.col("__u").desc(), "selection"))
    return done.where(F.col("__c") <= F.col(budget)).withColumn("__k", best).where("__k = 1").select(case, F.col("__u").alias("utility"), F.col("__c").alias("cost"), "selection")
