"""Record and output schemas, severities and empty tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Namespace of the ``schema`` column of outputs.
FINDING_SCHEMA, OBSERVATION_SCHEMA, MANIFEST_SCHEMA = "quarrylens.finding/1", "quarrylens.observation/1", "quarrylens.manifest/1"

SEVERITIES = ("info", "low", "medium", "high", "critical")

#: Every record table also carries ``_ord``, the ingest ordinal that ties are broken by.
RECORDS = {
    "event": "ts TIMESTAMP, channel STRING, event_id BIGINT, provider STRING, computer STRING, record_id BIGINT, data MAP<STRING,STRING>",
    "process": "pid BIGINT, ppid BIGINT, image STRING, cmdline STRING, signed BOOLEAN, signer STRING, binary_sha256 STRING, integrity STRING, user STRING, start_time TIMESTAMP",
    "net_conn": "proto STRING, laddr STRING, lport INT, raddr STRING, rport INT, state STRING, pid BIGINT",
    "persistence": "mechanism STRING, location STRING, value STRING, command STRING, binary_path STRING, binary_sha256 STRING, signed BOOLEAN, signer STRING, last_write TIMESTAMP",
    "file_meta": "path STRING, size BIGINT, sha256 STRING, si_btime TIMESTAMP, si_mtime TIMESTAMP, fn_btime TIMESTAMP, fn_mtime TIMESTAMP, zone_identifier STRING, path_complete BOOLEAN",
    "usn_event": "ts TIMESTAMP, path STRING, reason STRING, mft_ref BIGINT",
    "reg_value": "hive STRING, key STRING, value STRING, data STRING, last_write TIMESTAMP",
    "execution": "source STRING, path STRING, first_run TIMESTAMP, last_run TIMESTAMP, run_count BIGINT, sha1 STRING, user_sid STRING, execution_confirmed BOOLEAN",
    "logon_session": "user STRING, logon_type STRING, logon_time TIMESTAMP, source STRING, session_id BIGINT, state_active BOOLEAN",
}

_PROCESS = "STRUCT<pid: BIGINT, ppid: BIGINT, image: STRING, cmdline: STRING, signed: BOOLEAN, integrity: STRING>"
_FILE = "STRUCT<path: STRING, sha256: STRING, mtime: TIMESTAMP, si_btime: TIMESTAMP, fn_btime: TIMESTAMP, si_mtime: TIMESTAMP, fn_mtime: TIMESTAMP, path_complete: BOOLEAN>"
_NETCONN = "STRUCT<laddr: STRING, lport: INT, raddr: STRING, rport: INT, pid: BIGINT>"
_REGISTRY = "STRUCT<hive: STRING, key: STRING, value: STRING, data: STRING, last_write: TIMESTAMP>"
ENTITY = {"process": _PROCESS, "file": _FILE, "netconn": _NETCONN, "registry": _REGISTRY}
EVIDENCE = "ARRAY<STRUCT<artifact: STRING, path: STRING, ts: TIMESTAMP, detail: STRING>>"

FINDING = (
    "schema STRING, id STRING, ts TIMESTAMP, detected_at TIMESTAMP, severity STRING, title STRING, source STRING, rule_id STRING, rule_author STRING, "
    f"mitre ARRAY<STRING>, host STRING, user STRING, artifact STRING, event_id BIGINT, entity STRUCT<process: {_PROCESS}, file: {_FILE}, netconn: {_NETCONN}, registry: {_REGISTRY}>, "
    f"evidence_ref STRING, details STRING, details_client STRING, reason STRING, evidence {EVIDENCE}, analyzer STRING"
)
#: Lists of evidence that many findings have in common: a finding names them by key, with their sizes.
SHARED = "ARRAY<STRUCT<key: STRING, n: BIGINT>>"
MOST_SHARED = 2
OBSERVATION = "schema STRING, ts TIMESTAMP, host STRING, category STRING, title STRING, path STRING, details STRING, source_artifact STRING"


def empty(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], f"{RECORDS[kind]}, _ord BIGINT")


def rank(severity: Column) -> Column:
    """0 (info) to 4 (critical); severities never sort by name."""
    out = F.lit(0)
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def severity_of(rank_: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), rank_.cast("int") + 1)


def evidence(artifact: Column, path: Column, ts: Column, detail: Column) -> Column:
    return F.struct(artifact.alias("artifact"), path.cast("string").alias("path"), ts.cast("timestamp").alias("ts"), detail.alias("detail"))


def entity(**parts: Column) -> Column:
    """The finding's entity with the parts given and the rest null."""
    return F.struct(*((parts[k] if k in parts else F.lit(None)).cast(kind).alias(k) for k, kind in ENTITY.items()))


def process_entity(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + c) for c in ("pid", "ppid", "image", "cmdline", "signed", "integrity")))


def findings(rows: DataFrame, analyzer: str, as_of: Column, **columns: Column | str) -> DataFrame:
    """Project rows to the finding schema; columns not given are null, constants or empty."""
    given = {k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}
    base = {
        "schema": F.lit(FINDING_SCHEMA), "detected_at": as_of, "source": F.lit("heuristic"), "analyzer": F.lit(analyzer), "host": F.lit(""), "mitre": F.array().cast("array<string>"),
        "entity": entity(), "details": F.lit(""), "evidence": F.array().cast(EVIDENCE), "ts": as_of,
    } | given
    if "id" not in base:  # the same content always has the same id
        base["id"] = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(analyzer), base["title"], base["ts"].cast("string"), base["details"], F.to_json(base["entity"])), 256), 1, 32)
    fields = [x.split(" ", 1) for x in _top(FINDING)] + ([("shared", SHARED)] if "shared" in base else [])
    return rows.select(*((base[n] if n in base else F.lit(None)).cast(t).alias(n) for n, t in fields))


@dataclass(frozen=True)
class Found:
    """Findings that don't repeat what they share: their rows with `shared`, and the lists (key, items) it names.

    A thousand findings on one program's thousand runs are a thousand rows and one list.
    """

    rows: DataFrame
    lists: DataFrame | None = None
    folders: tuple[str, ...] = ()

    @classmethod
    def of(cls, rows: DataFrame) -> Found:
        return cls(rows.withColumn("shared", F.array().cast(SHARED)))

    def and_more(self, more: Found) -> Found:
        lists = [x for x in (self.lists, more.lists) if x is not None]
        return Found(self.rows.unionByName(more.rows), lists[0].unionByName(lists[1]) if len(lists) > 1 else lists[0] if lists else None, self.folders + more.folders)

    def whole(self) -> DataFrame:
        """The findings, each with all its evidence: its own, then its lists in order."""
        rows = self.rows
        for i in range(MOST_SHARED if self.lists is not None else 0):
            items = self.lists.select(F.col("key").alias("_key"), F.col("items").cast(EVIDENCE).alias("_items"))
            rows = rows.withColumn("_at", F.get("shared", F.lit(i))["key"]).join(items, F.col("_at") == F.col("_key"), "left")
            rows = rows.withColumn("evidence", F.concat("evidence", F.coalesce("_items", F.array().cast(EVIDENCE)))).drop("_at", "_key", "_items")
        return rows.drop("shared")


def evidence_size() -> Column:
    """How many pieces of evidence a finding has, lists included."""
    return F.size("evidence") + F.aggregate("shared", F.lit(0).cast("bigint"), lambda n, x: n + x["n"])


def _top(ddl: str) -> list[str]:
    """Split a DDL string at its outermost commas."""
    out, depth, cur = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()]
