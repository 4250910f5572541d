"""Small aggregates over findings and records: counts, panels, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..functions.values import public_hint
from ..plans.pipeline import report_order
from ..schema import rank

USN_ROWS = 200


def by_severity(findings: DataFrame) -> DataFrame:
    """(severity, n, verdict): verdict marks the severities that make a host count as compromised."""
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.max(rank(F.col("severity")) >= 3).alias("verdict"))


def top_hosts(findings: DataFrame, n: int = 10) -> DataFrame:
    return findings.groupBy("host").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "host").limit(n)


def repeated_names(findings: DataFrame) -> DataFrame:
    """(name, n): base names in the evidence of two findings or more."""
    names = F.array_distinct(F.transform(F.filter("evidence", lambda e: e["path"].isNotNull()), lambda e: base_name(e["path"])))
    return findings.select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").orderBy(F.col("n").desc(), "name")


def process_counts(processes: DataFrame) -> DataFrame:
    return processes.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("signed")).alias("unsigned"), F.count_distinct("image").alias("images"))


def process_panel(processes: DataFrame) -> DataFrame:
    """Unsigned first, then unknown, then signed; by pid."""
    return processes.orderBy(F.when(~F.col("signed"), 0).when(F.col("signed").isNull(), 1).otherwise(2), "pid")


def net_panel(connections: DataFrame) -> DataFrame:
    """Open and listening connections, public remotes first."""
    kept = connections.filter(F.lower(F.coalesce("state", F.lit(""))).isin("", "established", "listen", "listening"))
    return kept.withColumn("public", public_hint(F.col("raddr"))).orderBy(F.col("public").desc(), F.col("raddr").asc_nulls_first())


def net_counts(connections: DataFrame) -> DataFrame:
    return net_panel(connections).agg(F.count(F.lit(1)).alias("n"), F.count_if("public").alias("public"))


def execution_panel(executions: DataFrame) -> DataFrame:
    return executions.orderBy(F.col("last_run").desc_nulls_last(), "_ord")


def usn_panel(changes: DataFrame, n: int = USN_ROWS) -> DataFrame:
    """The newest creations and renames (a top-k report)."""
    return changes.filter(F.contains("reason", F.lit("create")) | F.contains("reason", F.lit("rename"))).orderBy(F.col("ts").desc(), "_ord").limit(n)


def logon_panel(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(~F.contains("logon_type", F.lit("Remote")), "user")


def downloads_panel(files: DataFrame) -> DataFrame:
    """Files that carry a mark of the web."""
    return files.filter("zone_identifier is not null").orderBy("path")


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, n): how many records there are of each kind."""
    parts = [df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def by_category(observations: DataFrame) -> DataFrame:
    return observations.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy("category")


def top_alerts(findings: DataFrame, n: int = 5) -> DataFrame:
    """The first of the critical and high findings, in the order of the report (a top-k report)."""
    worst = report_order(findings.filter(F.col("severity").isin("critical", "high")))
    return worst.limit(n).select(F.upper("severity").alias("label"), "title", "ts")
