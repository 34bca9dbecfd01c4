"""Event-time aggregates and joins. Rows later than the watermark are dropped and counted by Spark
(``numRowsDroppedByWatermark``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.operators.agents import alert_rows, metric_counters, metric_rates


def _window(ts: str, size: str, slide: str | None) -> Column:
    return F.window(ts, size, slide) if slide else F.window(ts, size)


def _bounds(df: DataFrame) -> DataFrame:
    return (df.withColumn("window_start", F.col("window.start"))
            .withColumn("window_end", F.col("window.end")).drop("window"))


def stream_usage(usage: DataFrame, window: str = "1 hour", slide: str | None = None,
                 watermark: str = "10 minutes") -> DataFrame:
    """Usage per tenant, model and interface in tumbling (or sliding) windows."""
    return _bounds(usage.withWatermark("created_at", watermark)
                   .groupBy(_window("created_at", window, slide), "tenant_id", "model",
                            "interface_name")
                   .agg(F.count(F.lit(1)).alias("calls"),
                        F.sum("total_tokens").cast("long").alias("total_tokens"),
                        F.sum("cached_tokens").cast("long").alias("cached_tokens"),
                        F.sum("estimated_cost").cast("double").alias("estimated_cost")))


def stream_alerts(events: DataFrame, window: str = "1 hour", slide: str | None = None,
                  watermark: str = "10 minutes", **limits) -> DataFrame:
    """Alerts that fired in each window; ``limits`` are those of ``alert_rows``."""
    counted = _bounds(events.withWatermark("ts", watermark)
                      .groupBy(_window("ts", window, slide)).agg(*metric_counters()))
    return alert_rows(counted.select("*", *metric_rates()), **limits)


def stream_rate_limit(calls: DataFrame, max_per_minute: int = C.CALLS_PER_MINUTE,
                      watermark: str = "1 minute") -> DataFrame:
    """Calls per (user, interface) and minute, with those over the limit."""
    counted = _bounds(calls.withWatermark("ts", watermark)
                      .groupBy(F.window("ts", "1 minute"), "user_id", "interface_name")
                      .agg(F.count(F.lit(1)).alias("calls")))
    return counted.withColumn("overflow", F.greatest(
        F.lit(0).cast("long"), F.col("calls") - max_per_minute))


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str, watermark: str) -> DataFrame:
    """Each key once within the watermark."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def stream_sessions(events: DataFrame, gap: str = "30 minutes",
                    watermark: str = "10 minutes") -> DataFrame:
    """Activity sessions per user, closed by a gap."""
    return (events.withWatermark("ts", watermark)
            .groupBy(F.session_window("ts", gap).alias("window"), "user_id")
            .agg(F.count(F.lit(1)).alias("events"))
            .withColumn("session_start", F.col("window.start"))
            .withColumn("session_end", F.col("window.end")).drop("window"))


def stream_confirmations(created: DataFrame, confirmed: DataFrame,
                         ttl_seconds: int = C.CONFIRMATION_TTL_SECONDS,
                         watermark: str = "10 minutes") -> DataFrame:
    """One outcome per request, once the watermark is past its lifetime: EXECUTED when the owner
    answered in time, however often, else USER_MISMATCH when only others did, else EXPIRED.

    ``created``: confirmation_id, user_id, created_at; ``confirmed``: confirmation_id, user_id,
    confirmed_at. Later answers change nothing. ``confirmations`` says the same of finished logs.
    """
    asked = created.select("confirmation_id", F.col("user_id").alias("owner_id"),
                           "created_at").withWatermark("created_at", watermark)
    answers = confirmed.select(F.col("confirmation_id").alias("answered_id"),
                               F.col("user_id").alias("answered_by"),
                               "confirmed_at").withWatermark("confirmed_at", watermark)
    same = ((F.col("confirmation_id") == F.col("answered_id"))
            & (F.col("confirmed_at") >= F.col("created_at"))
            & (F.col("confirmed_at") <= F.col("created_at")
               + F.expr(f"INTERVAL {ttl_seconds} SECONDS")))
    own = F.coalesce(F.col("answered_by") == F.col("owner_id"), F.lit(False))
    asked_at = ["confirmation_id", "owner_id", "created_at"]
    decided = (asked.join(answers, same, "leftOuter")
               .select(*asked_at, own.alias("own"), F.col("answered_by").isNotNull().alias("answered"))
               .groupBy(*asked_at).agg(F.bool_or("own").alias("own"),
                                       F.bool_or("answered").alias("answered")))
    outcome = (F.when(F.col("own"), F.lit("EXECUTED"))
               .when(F.col("answered"), F.lit("USER_MISMATCH")).otherwise(F.lit("EXPIRED")))
    return decided.select(*asked_at, outcome.alias("outcome"))
