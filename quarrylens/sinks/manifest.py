"""Hash manifest and its verification; directory and zip outputs."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import zipfile
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MANIFEST_SCHEMA
from . import panels, timeline


def compare_hashes(listed: DataFrame, there: DataFrame) -> DataFrame:
    """(path, status): ok, mismatch or missing for every listed (path, sha256)."""
    found = there.select("path", F.col("sha256").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.lower("found") == F.lower("sha256"), "ok").otherwise("mismatch")
    return listed.join(found, "path", "left").select("path", status.alias("status"))


def verify(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """(path, status) of a manifest's outputs against the files of a folder, hashed in parallel."""
    outputs = spark.read.json(manifest, multiLine=True).select(F.explode("outputs").alias("o")).select("o.path", "o.sha256")
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]*$", 0).alias("path"), F.sha2("content", 256).alias("sha256"))
    # Spark's file reader passes over empty files; the folder's listing has them.
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listing = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    nothing = [(x.getPath().getName(), hashlib.sha256(b"").hexdigest()) for x in listing if x.isFile() and x.getLen() == 0]
    return compare_hashes(outputs, files.unionByName(spark.createDataFrame(nothing, "path string, sha256 string")))


def ruleset_digest(folder: str | Path) -> str:
    """SHA-256 over the sorted relative paths and hashes of a folder's files."""
    root = Path(folder)
    lines = sorted(f"{p.relative_to(root).as_posix()}\n{hashlib.sha256(p.read_bytes()).hexdigest()}\n" for p in root.rglob("*") if p.is_file())
    return hashlib.sha256("".join(lines).encode()).hexdigest()


def file_digest(path: Path) -> str:
    """SHA-256 of a local file, read piece by piece."""
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _place(folder: Path, name: str) -> Path:
    path = folder / name
    if path.is_symlink():
        raise ValueError(f"{path} is a symbolic link")
    return path


def write_directory(findings: DataFrame, observations: DataFrame, folder: str, records: dict[str, DataFrame] | None = None, **about: str) -> dict:
    """Write timeline.csv, findings.jsonl, observations.jsonl, records.jsonl and manifest.json; return the manifest.

    These are files for people on the machine that asks for them; rows stream through
    toLocalIterator, a partition at a time.  For tables that stay on the cluster use Spark's writers.
    """
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    findings = timeline.with_client_text(findings)
    with _place(out, "timeline.csv").open("w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f, lineterminator="\r\n")
        w.writerow(timeline.COLUMNS)
        w.writerows(timeline.sorted_timeline(timeline.timeline_rows(findings)).toLocalIterator())
    streams = {"findings.jsonl": timeline.json_lines(findings), "observations.jsonl": timeline.json_lines(observations)}
    if records:
        streams["records.jsonl"] = timeline.tagged_records(records)
    for name, rows in streams.items():
        with _place(out, name).open("w", encoding="utf-8") as f:
            f.writelines(r[0] + "\n" for r in rows.toLocalIterator())
    names = ["timeline.csv", *streams]
    listed = [{"path": n, "sha256": file_digest(out / n), "size": os.path.getsize(out / n)} for n in names]
    counts = {r[0]: r[1] for r in findings.groupBy("severity").count().collect()}
    totals = {r[0]: r[1] for r in panels.totals(records).collect()} if records else {}
    manifest = {"schema": MANIFEST_SCHEMA, "created": datetime.now(UTC).isoformat(), **about, "outputs": listed, "findings_by_sev": dict(sorted(counts.items())), "observations": observations.count(), "records": totals}
    _place(out, "manifest.json").write_text(json.dumps(manifest, indent=2) + "\n", encoding="utf-8")
    return manifest


def write_zip(folder: str, target: str, leave_out: tuple[str, ...] = ("report.html", "records.jsonl")) -> list[str]:
    """Pack a written folder's files; returns their names."""
    names = sorted(p.name for p in Path(folder).iterdir() if p.is_file() and not p.is_symlink() and p.name not in leave_out)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(Path(folder) / n, n)
    return names
