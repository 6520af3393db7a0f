"""When what is known about a node grows stale: a time to live after its newest claim.

Claims of a node that follow each other within the time to live are one period of freshness; it ends that long after
its last claim, and then a refresh is due. On a stream this is a session window: late claims prolong or join periods until
the watermark passes their end, which is when a period is emitted, and its state goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fresh_periods(claims: DataFrame, ttl: str, lateness: str | None = None) -> DataFrame:
    """(canonical_id, since, last_claim, due_at, claims) of claims (canonical_id, ts TIMESTAMP), from a table or, with `lateness`, a stream."""
    rows = claims if lateness is None else claims.withWatermark("ts", lateness)
    periods = rows.groupBy("canonical_id", F.session_window("ts", ttl).alias("p")).agg(F.count(F.lit(1)).alias("claims"), F.max("ts").alias("last_claim"))
    return periods.select("canonical_id", F.col("p.start").alias("since"), "last_claim", F.col("p.end").alias("due_at"), "claims")


def due(periods: DataFrame, now: str) -> DataFrame:
    """(canonical_id, due_at): nodes whose last period has ended by `now`."""
    last = periods.groupBy("canonical_id").agg(F.max("due_at").alias("due_at"))
    return last.where(F.col("due_at") <= F.lit(now).cast("timestamp"))
