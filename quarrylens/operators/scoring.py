"""Weighted signals and gate hits, as expressions over one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signal:
    """A condition that adds weight, a reason and a technique.  A null condition doesn't fire."""

    fires: Column
    weight: int
    reason: Column
    tag: str | None = None


def scored(rows: DataFrame, signals: list[Signal]) -> DataFrame:
    """rows with weight, reasons (in the signals' order) and mitre (first occurrences)."""
    return told(weighed(rows, signals), signals)


def weighed(rows: DataFrame, signals: list[Signal]) -> DataFrame:
    """rows with the signals that fire, as bits of _fired, and their weight."""
    # The signals that fire are bits of one number, so that each is computed once, whatever asks for it.
    bits = sum((F.when(F.coalesce(s.fires, F.lit(False)), F.lit(1 << i)).otherwise(0) for i, s in enumerate(signals)), F.lit(0))
    # A filter on the weight would be pushed below and repeat all signals for each bit it asks for; an
    # expression that counts as non-deterministic, and is always 0, keeps it above.
    rows = rows.withColumn("_fired", bits + F.shiftright(F.monotonically_increasing_id(), 63).cast("int"))
    return rows.withColumn("weight", sum((F.when(f, s.weight).otherwise(0) for f, s in zip(_bits(signals), signals, strict=True)), F.lit(0)))


def _bits(signals: list[Signal]) -> list[Column]:
    return [F.col("_fired").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(signals))]


def told(rows: DataFrame, signals: list[Signal]) -> DataFrame:
    """rows of weighed() with reasons and mitre instead of the bits; needs the columns that reasons name, not those that signals ask."""
    fired = _bits(signals)
    reasons = F.array_compact(F.array(*(F.when(f, s.reason) for f, s in zip(fired, signals, strict=True))))
    tags = F.array_distinct(F.array_compact(F.array(*(F.when(f, F.lit(s.tag).cast("string")) for f, s in zip(fired, signals, strict=True)))))
    return rows.withColumns({"reasons": reasons, "mitre": tags}).drop("_fired")


@dataclass(frozen=True)
class Hit:
    """A dispositive signal: a severity rank of its own (null: no hit)."""

    rank: Column
    label: str | Column
    reason: Column
    tag: str


def gated(rows: DataFrame, hits: list[Hit]) -> DataFrame:
    """rows with hits: the array of those that hold, in order, each with its index."""
    made = [
        F.when(h.rank.isNotNull(), F.struct(h.rank.cast("int").alias("rank"), F.lit(i).alias("idx"), (F.lit(h.label) if isinstance(h.label, str) else h.label).alias("label"), h.reason.alias("reason"), F.lit(h.tag).alias("tag")))
        for i, h in enumerate(hits)
    ]
    return rows.withColumn("hits", F.array_compact(F.array(*made)))


def top_hit(hits: Column) -> Column:
    """The last of the hits with the highest rank."""
    return F.array_max(hits)
