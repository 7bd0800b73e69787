"""Analytics over streams (or tables) of documents: running totals, event-time windows, sessions.

All take a frame with a navigable VARIANT column ``v``; event time comes from an
instant member. On a stream, ``late`` bounds how long state is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.register import call


def event_time(df: DataFrame, member: str, name: str = "event_time") -> DataFrame:
    """The instant at ``member`` as a timestamp (microseconds)."""
    ns = F.try_variant_get(call("field", F.col("v"), member), '$["$i"]', "bigint")
    return df.withColumn(name, F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))))  # "/" would go through doubles


def totals(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Count and sum per key: use output mode update or complete."""
    k, a = call("text", call("field", F.col("v"), key)).alias("key"), call("numeric", call("field", F.col("v"), amount))
    return df.groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("total"))


def enrich(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def windows(df: DataFrame, member: str, size: str, slide: str | None = None, late: str = "10 minutes", *keys: Column) -> DataFrame:
    """Count per tumbling or sliding window, and per key."""
    at = event_time(df, member).withWatermark("event_time", late)
    return at.groupBy(F.window("event_time", size, slide) if slide else F.window("event_time", size), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(df: DataFrame, member: str, gap: str, late: str = "10 minutes", *keys: Column) -> DataFrame:
    """Count per session of events no further apart than ``gap``, and per key; Spark wants a key on streams."""
    at = event_time(df, member).withWatermark("event_time", late)
    return at.groupBy(F.session_window("event_time", gap), *keys).agg(F.count(F.lit(1)).alias("n"))
