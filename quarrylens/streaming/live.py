"""Structured Streaming forms of the stateless rules and of the anchored logon windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import attempts
from ..plans import sigma


def match_stream(events: DataFrame, rules: list[sigma.Rule]) -> DataFrame:
    """Rule matches of a stream of events: the same plan as in a batch, without state."""
    return sigma.match(events, rules)


def failures_ahead(events: DataFrame, width_us: int, delay: str) -> DataFrame:
    """(user, source, anchor_ts, failures, hit_success) of each failure's closed window ahead.

    A stream-stream self-join within the window, both sides watermarked, so state is bounded by
    the width and the delay; then a count per anchor, which is final once the watermark passes.
    """
    seconds = width_us / 1_000_000
    rows = attempts(events).withWatermark("ts", delay)
    anchors = rows.filter(~F.col("success")).select(F.col("user").alias("a_user"), F.col("source").alias("a_source"), F.col("ts").alias("anchor_ts"), F.col("_ord").alias("anchor"))
    near = (F.col("user") == F.col("a_user")) & (F.col("source") == F.col("a_source")) & F.expr(f"ts between anchor_ts and anchor_ts + interval {seconds} seconds")
    joined = anchors.join(rows, near)
    out = joined.groupBy("a_user", "a_source", "anchor_ts", "anchor").agg(F.count_if(~F.col("success")).alias("failures"), F.max("success").alias("hit_success"))
    return out.select(F.col("a_user").alias("user"), F.col("a_source").alias("source"), "anchor_ts", "failures", "hit_success")
