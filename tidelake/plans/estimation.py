"""Bandwidth-style estimates over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import temporal as t
from tidelake.plans.sequences import events
from tidelake.registry import query

_RECENT = """(SELECT event_id, user_id, t, list(CASE WHEN value > 0 THEN {'t': t, 'v': value} END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w FROM (SELECT *, epoch_us(ts) / 1000000.0 AS t FROM events))"""


@query(f"""SELECT event_id, user_id, round(len(f) / list_sum(list_transform(f, lambda x: 1 / x.v)), 6) AS estimate, CAST(len(f) AS INTEGER) AS n_used,
CASE WHEN len(w) = 0 THEN 'bootstrap' WHEN len(f) = 0 THEN 'stale' WHEN len(f) < 5 THEN 'warming_up' ELSE 'ready' END AS estimate_status
FROM (SELECT *, list_filter(w, lambda x: t - x.t <= 604800) AS f FROM (SELECT * REPLACE (list_filter(w, lambda x: x IS NOT NULL) AS w) FROM {_RECENT}))""")
def bandwidth_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonic mean of each user's last five values of the last seven days, with its status."""
    out = t.harmonic_estimate(events(spark, sf_dir), ["user_id"], "t", "value", 5, 604800.0, "event_id")
    return out.select("event_id", "user_id", F.round("estimate", 6).alias("estimate"), "n_used", "estimate_status")
