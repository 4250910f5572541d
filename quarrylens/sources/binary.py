"""Parsers of binary artifacts and the readers that run them over files in parallel.

Inside one blob records follow one another, so a file is one task's work; files are spread over
the cluster.  Every parser is total: damaged input ends it, and keeps what came before.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import FILETIME_EPOCH, USN_REASONS, filetime
from ..storage import python_ready
from .readers import file_of, file_ranks

#: Larger blobs are skipped; skipped_files() lists them.
MAX_BLOB = 512 << 20
MAX_PREFETCH = 64 << 20
_REFERENCE = (1 << 48) - 1


def _uint(b: bytes, at: int, size: int) -> int | None:
    part = b[at : at + size]
    return int.from_bytes(part, "little") if at >= 0 and len(part) == size else None


def reason_names(mask: int) -> str:
    return "|".join(name for bit, name in USN_REASONS if mask & bit)


def usn_records(b: bytes, cap: int | None = None) -> tuple[list[tuple[int, str, str, int]], bool]:
    """(filetime, path, reason, file reference) of a change journal, and whether the cap cut it.

    Runs of zeros are stepped over by eight bytes, unknown versions by their length; a damaged
    record ends the scan.
    """
    out: list[tuple[int, str, str, int]] = []
    at = 0
    while at < len(b):
        length = _uint(b, at, 4)
        if not length:
            at = (at // 8 + 1) * 8
            continue
        version = _uint(b, at + 4, 2)
        if version is None or at + length > len(b):
            break
        if version in (2, 3):
            header, time_at, reason_at, name_at = (60, 32, 40, 56) if version == 2 else (76, 48, 56, 72)
            if length < header:
                break
            size, offset = _uint(b, at + name_at, 2) or 0, _uint(b, at + name_at + 2, 2) or 0
            if offset < header or offset + size > length:
                break
            if cap is not None and len(out) >= cap:
                return out, True
            name = b[at + offset : at + offset + size // 2 * 2].decode("utf-16-le", "replace")
            out.append((_uint(b, at + time_at, 8) or 0, name, reason_names(_uint(b, at + reason_at, 4) or 0), (_uint(b, at + 8, 8) or 0) & _REFERENCE))
        at += (length + 7) // 8 * 8
    return out, False


def shimcache_entries(b: bytes) -> list[tuple[str, bool]]:
    """(path, executed) of an AppCompatCache value; another header than the known one gives nothing."""
    out: list[tuple[str, bool]] = []
    at = _uint(b, 0, 4)
    if at != 0x34:
        return out
    while b[at : at + 4] == b"10ts":
        size = _uint(b, at + 12, 2)
        if size is None or at + 14 + size > len(b):
            break
        data_at = at + 14 + size + 8
        data = _uint(b, data_at, 4)
        if data is None or data_at + 4 + data > len(b):
            break
        out.append((b[at + 14 : at + 14 + size // 2 * 2].decode("utf-16-le", "replace"), b[data_at + 4 : data_at + 4 + data] == b"\x01\0\0\0"))
        at = data_at + 4 + data
    return out


def prefetch_info(b: bytes) -> tuple[str, int, list[int]] | None:
    """(name, run count, run times as FILETIMEs) of a prefetch body of version 30 or 31."""
    count_at = {30: 0xD0, 31: 0xC8}.get(_uint(b, 0, 4) or 0)
    count = _uint(b, count_at, 4) if count_at else None
    if count is None:
        return None
    name = b[16:76][: len(b[16:76]) // 2 * 2].decode("utf-16-le", "replace").split("\0")[0]
    times = [x for i in range(8) if (x := _uint(b, 0x80 + 8 * i, 8)) and x >= FILETIME_EPOCH]
    return name, count, times


def xpress_huffman(b: bytes, size: int) -> bytes:
    """Decompress the LZ77+Huffman format of Microsoft's published XCA specification.

    Each chunk of 64 KiB of output begins with 512 code lengths of four bits; symbols below 256
    are bytes, others matches of a length and a number of distance bits.
    """
    out = bytearray()
    at = 0
    while len(out) < size:
        lengths = [x for c in b[at : at + 256] for x in (c & 15, c >> 4)]
        if len(lengths) < 512:
            raise ValueError("the data ends within a table")
        at += 256
        symbols = sorted((n, s) for s, n in enumerate(lengths) if n)
        table: dict[tuple[int, int], int] = {}
        code = last = 0
        for n, s in symbols:
            code <<= n - last
            last = n
            table[n, code] = s
            code += 1
        bits = int.from_bytes(b[at : at + 2], "little") << 16 | int.from_bytes(b[at + 2 : at + 4], "little")
        at += 4
        left = 16
        end = min(size, len(out) + 65536)

        def drop(n: int) -> None:
            nonlocal bits, left, at
            bits = bits << n & 0xFFFFFFFF
            left -= n
            if left < 0:
                bits |= int.from_bytes(b[at : at + 2], "little") << -left
                at += 2
                left += 16

        while len(out) < end:
            for n in range(1, 16):
                s = table.get((n, bits >> (32 - n)))
                if s is not None:
                    break
            else:
                raise ValueError("no such code")
            drop(n)
            if s < 256:
                out.append(s)
                continue
            length, far = (s - 256) & 15, (s - 256) >> 4
            if length == 15:
                length += b[at]
                at += 1
                if length == 270:
                    length = int.from_bytes(b[at : at + 2], "little")
                    at += 2
                    if not length:
                        length = int.from_bytes(b[at : at + 4], "little")
                        at += 4
            length += 3
            distance = 1 << far | (bits >> (32 - far) if far else 0)
            drop(far)
            if distance > len(out):
                raise ValueError("a match reaches before the start")
            for _ in range(length):
                out.append(out[-distance])
    return bytes(out[:size])


def prefetch_body(b: bytes) -> bytes | None:
    """The body of a prefetch file, decompressed if it is; null if it is damaged or too large."""
    if b[:3] != b"MAM":
        return b
    size = _uint(b, 4, 4)
    if b[3:4] != b"\x04" or size is None or size > MAX_PREFETCH:
        return None
    try:
        return xpress_huffman(b[8:], size)
    except (ValueError, IndexError):
        return None


def _rows(spark: SparkSession, path: str, f: Callable[[str, bytes], list[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """f over every file below a path, a file a row; _ord: by path, then in the order of the file's records.

    Files above MAX_BLOB are left out; skipped_files() lists them.
    """
    python_ready(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= MAX_BLOB)
    files = files.select("path", "content", file_of().alias("_file")).join(F.broadcast(file_ranks(files)), F.col("_file") == F.col("file"))
    schema, types = f"{schema}, _ord long", [*types, pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = [(*r, (rank << 32) + i) for i, r in enumerate(f(p, content))]
                for at in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)

    return files.select("path", "content", "rank").mapInArrow(run, schema)


def read_usn(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Change-journal records of every file; an unset time is the epoch."""

    def parse(p: str, b: bytes) -> list[tuple]:
        return usn_records(b, cap)[0]

    raw = _rows(spark, path, parse, "ft long, path string, reason string, mft_ref long", [pa.int64(), pa.string(), pa.string(), pa.int64()])
    ts = F.coalesce(filetime(F.col("ft")), F.timestamp_seconds(F.lit(0)))
    return raw.select(ts.alias("ts"), "path", "reason", "mft_ref", "_ord")


def usn_sources(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """(file, records, note) of every change journal that was read: how many records, and a note if the cap cut it."""

    def parse(p: str, b: bytes) -> list[tuple]:
        found, cut = usn_records(b, cap)
        return [(p, len(found), f"truncated at {cap} records" if cut else None)]

    return _rows(spark, path, parse, "file string, records long, note string", [pa.string(), pa.int64(), pa.string()]).drop("_ord")


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, note) of the files that are too large to be read; contents aren't touched."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > MAX_BLOB)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.lit(f"skipped: larger than {MAX_BLOB} bytes").alias("note"))


def read_shimcache(spark: SparkSession, path: str) -> DataFrame:
    """AppCompatCache entries of every blob; only an entry marked as executed counts as confirmed."""
    raw = _rows(spark, path, lambda p, b: shimcache_entries(b), "path string, executed boolean", [pa.string(), pa.bool_()])
    none = F.lit(None)
    return raw.select(
        F.lit("shimcache").alias("source"), "path", none.cast("timestamp").alias("first_run"), none.cast("timestamp").alias("last_run"), none.cast("bigint").alias("run_count"), none.cast("string").alias("sha1"),
        none.cast("string").alias("user_sid"), F.col("executed").alias("execution_confirmed"), "_ord",
    )


def read_prefetch(spark: SparkSession, path: str) -> DataFrame:
    """Prefetch files as executions: first and last of the run times."""

    def parse(p: str, b: bytes) -> list[tuple]:
        body = prefetch_body(b)
        info = prefetch_info(body) if body else None
        return [] if info is None else [(p, info[0], info[1], min(info[2], default=0), max(info[2], default=0))]

    raw = _rows(spark, path, parse, "file string, name string, n long, first long, last long", [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()])
    none = F.lit(None).cast("string")
    return raw.select(
        F.lit("prefetch").alias("source"), F.col("name").alias("path"), filetime(F.col("first")).alias("first_run"), filetime(F.col("last")).alias("last_run"), F.col("n").alias("run_count"), none.alias("sha1"),
        none.alias("user_sid"), F.lit(True).alias("execution_confirmed"), "_ord",
    )


def mft_entries(b: bytes, record: int = 1024) -> list[tuple]:
    """(rec, name, parent, size, four times) of the records of a master file table.

    The record's standard times and its file name of the Win32 kind; damaged records are skipped.
    """
    out = []
    for rec in range(len(b) // record):
        r = bytearray(b[rec * record : (rec + 1) * record])
        if r[:4] != b"FILE":
            continue
        fix_at, fix_n = struct.unpack_from("<HH", r, 4)
        for k in range(1, fix_n):  # the last two bytes of each sector are kept aside
            end = 512 * k
            if end <= len(r) and fix_at + 2 * k + 2 <= len(r):
                r[end - 2 : end] = r[fix_at + 2 * k : fix_at + 2 * k + 2]
        at = _uint(r, 20, 2) or 0
        times: list[int] = [0, 0]
        best: tuple | None = None
        while at + 24 <= len(r):
            kind, length = _uint(r, at, 4), _uint(r, at + 4, 4)
            if kind in (None, 0xFFFFFFFF) or not length or at + length > len(r):
                break
            if r[at + 8] == 0:
                body = at + (_uint(r, at + 20, 2) or 0)
                if kind == 0x10 and body + 16 <= len(r):
                    times = [_uint(r, body, 8) or 0, _uint(r, body + 8, 8) or 0]
                elif kind == 0x30 and body + 66 <= len(r):
                    n, space = r[body + 64], r[body + 65]
                    name = bytes(r[body + 66 : body + 66 + 2 * n]).decode("utf-16-le", "replace")
                    parent = (_uint(r, body, 8) or 0) & _REFERENCE
                    found = (name, parent, _uint(r, body + 48, 8) or 0, _uint(r, body + 8, 8) or 0, _uint(r, body + 16, 8) or 0)
                    if best is None or space != 2:
                        best = found
            at += length
        if best is not None:
            out.append((rec, best[0], best[1], best[2], *times, best[3], best[4]))
    return out


def read_mft(spark: SparkSession, path: str, resolve: bool = True) -> DataFrame:
    """File records of master file tables, with whole paths unless resolve is off."""
    from ..operators.joins import mft_paths

    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
    raw = _rows(spark, path, lambda p, b: mft_entries(b), "rec long, name string, parent long, size long, sb long, sm long, fb long, fm long", kinds)
    # A table's file is a volume: its number goes above the record numbers, so that volumes don't mix.
    volume = F.shiftleft(F.shiftright("_ord", 32), 48)
    raw = raw.withColumn("parent", volume + F.col("parent")).withColumn("rec", volume + F.col("rec"))
    if resolve:
        named = raw.join(mft_paths(raw.select("rec", "name", "parent", "_ord")), "rec", "left")
        where, complete = F.coalesce("path", "name"), F.col("complete")
    else:
        named, where, complete = raw, F.col("name"), F.lit(None).cast("boolean")
    none = F.lit(None).cast("string")
    return named.select(
        where.alias("path"), "size", none.alias("sha256"), *(filetime(F.col(c)).alias(n) for c, n in (("sb", "si_btime"), ("sm", "si_mtime"), ("fb", "fn_btime"), ("fm", "fn_mtime"))),
        none.alias("zone_identifier"), complete.alias("path_complete"), "_ord",
    )


def file_hashes(spark: SparkSession, path: str, cap: int = 256 << 20) -> DataFrame:
    """(path, sha256, size, note) of every file, hashed where it is read; larger ones have no hash and a note."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = files.filter(F.col("length") <= cap).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.lit(None).cast("string").alias("note"))
    large = files.filter(F.col("length") > cap)
    return read.unionByName(large.select("path", F.lit(None).cast("string").alias("sha256"), F.col("length").alias("size"), F.lit(f"not hashed: larger than {cap} bytes").alias("note")))
