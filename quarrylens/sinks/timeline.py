"""Timeline, JSON lines, body file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..schema import rank

# The timeline's columns.
COLUMNS = ("Timestamp", "Host", "Channel", "EventID", "Severity", "RecordID", "RuleTitle", "RuleAuthor", "MITRE", "Details", "Reason", "Entity", "DetailsClient")


#: JSON writers cut times to milliseconds unless told otherwise.
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def entity_summary() -> Column:
    """One line about what a finding is about: process, else registry, else connection, else file."""
    p, r, n, f = (F.col(f"entity.{k}") for k in ("process", "registry", "netconn", "file"))
    signed = F.when(p["signed"], " [signed]").when(~p["signed"], " [unsigned]").otherwise("")
    cmd = F.when(F.coalesce(p["cmdline"], F.lit("")) != "", F.concat(F.lit(" cmd="), F.substring(p["cmdline"], 1, 60))).otherwise("")
    process = F.concat(base_name(p["image"]), F.lit(" (pid="), p["pid"].cast("string"), F.lit(")"), signed, cmd)
    registry = F.concat(base_name(r["key"]), F.lit(" -> "), F.btrim(r["data"], F.lit('"')))
    conn = F.concat(F.coalesce(F.concat(F.lit("pid="), n["pid"].cast("string")), F.lit("unknown program")), F.lit(" -> "), F.coalesce(n["raddr"], F.lit("-")), F.lit(":"), F.coalesce(n["rport"].cast("string"), F.lit("-")))
    return F.when(p.isNotNull(), process).when(r.isNotNull(), registry).when(n.isNotNull(), conn).when(f.isNotNull(), f["path"]).otherwise("")


def client_text(severity: Column) -> Column:
    """A plain sentence for findings of medium severity or above."""
    host, p, r, n, f = F.col("host"), *(F.col(f"entity.{k}") for k in ("process", "registry", "netconn", "file"))
    name = F.coalesce(base_name(p["image"]), base_name(f["path"]), base_name(r["key"]), F.lit("an unknown program"))
    target = F.coalesce(F.concat(n["raddr"], F.lit(":"), F.coalesce(n["rport"].cast("string"), F.lit("-"))), F.lit("an unknown target"))
    on = lambda *parts: F.concat(F.lit("On host "), host, F.lit(": "), *parts)
    text = (
        F.when((F.col("source") == "sigma") & (rank(severity) >= 3), on(F.lit("activity that matches \""), F.col("title"), F.lit("\" carries a high risk; please investigate soon.")))
        .when(F.col("source") == "sigma", on(F.lit("activity that matches \""), F.col("title"), F.lit("\"; please check that it is authorised.")))
        .when(F.col("artifact") == "process", on(name, F.lit(" was started by an unexpected parent; please check that this is normal.")))
        .when(F.col("artifact") == "no_execution_artifact", on(name, F.lit(" runs but no execution record mentions it; records have gaps, so please check where it comes from.")))
        .when(F.col("artifact") == "persistence", on(name, F.lit(" is set to start by itself; please check that it is known and authorised.")))
        .when(F.col("artifact") == "netconn", on(name, F.lit(" connects to "), target, F.lit("; please check that this is normal.")))
        .when(F.col("artifact") == "file_meta", on(name, F.lit(" seems to have changed times; please check when it was really made.")))
        .otherwise(on(F.lit("possibly unusual behaviour was seen; please have an analyst check it.")))
    )
    return F.when(rank(severity) >= 2, text)


def with_client_text(findings: DataFrame) -> DataFrame:
    return findings.withColumn("details_client", client_text(F.col("severity")))


def timeline_rows(findings: DataFrame) -> DataFrame:
    """Findings as rows of the timeline, all text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return findings.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("Timestamp"), text("host").alias("Host"), F.regexp_replace("artifact", "^evtx:", "").alias("Channel"), text("event_id").alias("EventID"),
        F.col("severity").alias("Severity"), text("evidence_ref").alias("RecordID"), F.col("title").alias("RuleTitle"), text("rule_author").alias("RuleAuthor"), F.array_join("mitre", ";").alias("MITRE"),
        text("details").alias("Details"), text("reason").alias("Reason"), entity_summary().alias("Entity"), text("details_client").alias("DetailsClient"),
    )


def sorted_timeline(rows: DataFrame) -> DataFrame:
    """Ordered by time and record as text, without equal rows.

    Dropping every equal row and dropping adjacent ones is the same once all columns are sorted by.
    """
    return rows.dropDuplicates().orderBy("Timestamp", "RecordID", *(c for c in COLUMNS if c not in ("Timestamp", "RecordID")))


def drop_adjacent(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows in an order over all their columns, of equal neighbours the first alone."""
    w = Window.partitionBy(*order).orderBy(F.lit(0))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n") if set(order) != set(rows.columns) else rows.dropDuplicates()


def bodyfile(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(line): mactime body lines of file and change records; missing times are 0."""
    at = lambda c: F.coalesce(F.unix_seconds(c), F.lit(0)).cast("string")
    bar = F.lit("|")
    one = files.select(F.concat(F.lit("0|"), F.col("path"), F.lit("|0|0|0|0|"), F.col("size").cast("string"), bar, at("si_mtime"), bar, at("si_mtime"), bar, at("fn_mtime"), bar, at("si_btime")).alias("line"))
    two = changes.select(F.concat(F.lit("0|"), F.col("path"), F.lit("|0|0|0|0|0|0|"), at("ts"), F.lit("|0|0")).alias("line"))
    return one.unionAll(two)


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): one JSON object a row, without null fields at the top."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true", **_MICROS}).alias("value"))


def tagged_records(tables: dict[str, DataFrame]) -> DataFrame:
    """(value): every record of every kind as a JSON object with its kind, nulls kept."""
    parts = [df.orderBy("_ord").select(F.to_json(F.struct(F.lit(kind).alias("kind"), *(c for c in df.columns if c != "_ord")), {"ignoreNullFields": "false", **_MICROS}).alias("value")) for kind, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
