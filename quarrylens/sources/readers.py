"""Readers of JSON, text and table exports."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import values as v
from ..operators.joins import last_by_key
from ..schema import FINDING, RECORDS
from ..storage import checkpointed, shared_folder


#: Bytes of a file at most, and so the ordinals that it may use.
FILE_SPAN = 1 << 40


def file_of() -> Column:
    """The file that a row is read from; a scheme is followed by one slash, as Spark writes it with one or three."""
    return F.regexp_replace("_metadata.file_path", r"^([\w+.-]+):/+", "$1:/")


def file_ranks(rows: DataFrame) -> DataFrame:
    """(file, rank): the files that rows are read from, in path order; as many narrow rows as files are listed."""
    files = sorted(re.sub(r"^([\w+.-]+):/+", r"\1:/", f) for f in rows.inputFiles())
    return rows.sparkSession.createDataFrame([(f, k) for k, f in enumerate(files)], "file string, rank bigint")


def with_ordinal(rows: DataFrame) -> DataFrame:
    """rows, as read from files, with _ord: file by file in path order, row by row within one.

    Spark deals files to tasks by size, so a row's place in its task tells nothing.  A row's ordinal
    is its file's rank, the place where its split begins and its number in the task, which is
    smaller than the bytes of the splits before the next one.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    own = [F.col(f"`{c}`") for c in rows.columns]
    placed = rows.select(*own, file_of().alias("_file"), (F.col("_metadata.file_block_start") + within).alias("_at"))
    ranks = F.broadcast(file_ranks(rows))  # the list of files is Spark's own, held by the driver
    return placed.join(ranks, F.col("_file") == F.col("file")).select(*own, (F.col("rank") * FILE_SPAN + F.col("_at")).alias("_ord"))


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of one kind from tagged JSON lines; keys that older files lack are null (or their default)."""
    return _records(with_ordinal(spark.read.text(path)).withColumn("kind", F.get_json_object("value", "$.kind")), kind)


def _records(lines: DataFrame, kind: str) -> DataFrame:
    """Records of one kind from (value, kind, _ord)."""
    ddl = RECORDS[kind].replace("data MAP<STRING,STRING>", "data STRING") if kind == "event" else RECORDS[kind]
    rows = lines.filter(F.col("kind") == kind)
    rows = rows.select(F.from_json("value", ddl, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX]"}).alias("r"), "_ord").select("r.*", "_ord")
    if kind == "event":
        rows = rows.withColumn("data", string_values(F.col("data")))
    if kind == "logon_session":
        rows = rows.withColumn("state_active", F.coalesce("state_active", F.lit(False)))
    return rows


def string_values(json: Column) -> Column:
    """The string, number and boolean members of a JSON object as a map of text."""
    return F.map_filter(F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, x: x.isNotNull())


def read_all(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The records of every kind.  The lines are read once and kept by kind in the shared folder; a kind reads its own part alone."""
    parts = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    with_ordinal(spark.read.text(path)).withColumn("kind", F.get_json_object("value", "$.kind")).filter(F.col("kind").isin(*RECORDS)).write.partitionBy("kind").parquet(parts)
    lines = spark.read.schema("value STRING, _ord BIGINT, kind STRING").parquet(parts)
    return {kind: _records(lines, kind) for kind in RECORDS}


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A record table kept as Parquet; columns that an older writer lacked are null."""
    rows = spark.read.parquet(path)
    fields = [x.strip().split(" ", 1) for x in RECORDS[kind].split(", ")]
    rows = rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in fields), *(["_ord"] if "_ord" in rows.columns else []))
    return rows if "_ord" in rows.columns else with_ordinal(rows)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINDING).json(path)


def since(events: DataFrame, ts: Column) -> DataFrame:
    """Events at or after a time: a filter that reaches a Parquet scan."""
    return events.filter(F.col("ts") >= ts)


def read_events(spark: SparkSession, path: str, channels: list[str] | None = None, start: Column | None = None) -> DataFrame:
    """Event records kept as Parquet, best partitioned by channel: only the channels asked for are read."""
    rows = spark.read.parquet(path)
    rows = rows.filter(F.col("channel").isin(channels)) if channels is not None else rows
    rows = since(rows, start) if start is not None else rows
    return rows if "_ord" in rows.columns else with_ordinal(rows)


# ---- event logs exported as JSON ------------------------------------------------------------


def event_id(raw: Column) -> Column:
    """EventID as a number, a string or {"#text": ...}; anything else is 0."""
    inner = F.get_json_object(raw, "$.#text")
    return F.coalesce(raw.try_cast("bigint"), inner.try_cast("bigint"), F.get_json_object(raw, "$['#text']").try_cast("bigint"), F.lit(0))


def read_event_json(spark: SparkSession, path: str) -> DataFrame:
    """Events from one JSON document a line, {"Event": {"System": ..., "EventData"|"UserData": ...}}.

    System, EventData and UserData are flattened one level, later keys replacing earlier ones;
    attributes below System become Name_Attribute.  Lines that are no events are dropped.
    """
    raw = with_ordinal(spark.read.text(path)).select(F.get_json_object("value", "$.Event").alias("e"), "_ord").filter("e is not null")
    get = lambda p: F.get_json_object("e", p)
    part = lambda p: F.coalesce(F.from_json(get(p), "map<string,string>"), F.create_map().cast("map<string,string>"))
    attributes = F.create_map(F.lit("Provider_Name"), get("$.System.Provider.#attributes.Name"), F.lit("Provider_Guid"), get("$.System.Provider.#attributes.Guid"))
    entries = F.concat(*(F.map_entries(m) for m in (attributes, part("$.System"), part("$.EventData"), part("$.UserData"))))
    entries = F.filter(entries, lambda x: x["value"].isNotNull())
    # The last of equal keys counts.
    keys = F.transform(entries, lambda x: x["key"])
    data = F.map_from_entries(F.filter(entries, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"])))
    when = F.coalesce(get("$.System.TimeCreated.#attributes.SystemTime"), get("$.System.TimeCreated.SystemTime"))
    return raw.select(
        F.try_to_timestamp(when).alias("ts"), F.coalesce(get("$.System.Channel"), F.lit("")).alias("channel"), event_id(get("$.System.EventID")).alias("event_id"),
        F.coalesce(get("$.System.Provider.#attributes.Name"), F.lit("")).alias("provider"), F.coalesce(get("$.System.Computer"), F.lit("")).alias("computer"),
        F.coalesce(get("$.System.EventRecordID").try_cast("bigint"), F.lit(0)).alias("record_id"), data.alias("data"), "_ord",
    ).filter("ts is not null")


# ---- snapshots ------------------------------------------------------------------------------


def process_rows(raw: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Process records from (pid, ppid, image, cmdline, integrity_rid, user, start_time); signatures: (path, signed, signer).

    Only absolute images take a signature.
    """
    rows = raw.select(
        "pid", "ppid", "image", F.coalesce("cmdline", F.lit("")).alias("cmdline"), F.lit(None).cast("string").alias("binary_sha256"), v.integrity_label(F.col("integrity_rid")).alias("integrity"), "user", "start_time", "_ord",
    )
    if signatures is None:
        return rows.withColumns({"signed": F.lit(None).cast("boolean"), "signer": F.lit(None).cast("string")})
    known = signatures.select(t.ascii_lower(F.col("path")).alias("_p"), "signed", "signer", F.monotonically_increasing_id().alias("_ord"))
    return rows.join(last_by_key(known, "_p").drop("_ord"), (t.ascii_lower(F.col("image")) == F.col("_p")) & t.absolute_path(F.col("image")), "left").drop("_p")


def connection_rows(tcp: DataFrame, udp: DataFrame) -> DataFrame:
    """Connections from both tables; UDP has no remote end and no state."""
    tcp = tcp.select(F.lit("tcp").alias("proto"), "laddr", "lport", "raddr", "rport", v.tcp_state(F.col("state_code")).alias("state"), "pid", "_ord")
    udp = udp.select(F.lit("udp").alias("proto"), "laddr", "lport", "pid", "_ord")
    return tcp.unionByName(udp, allowMissingColumns=True)


def session_rows(raw: DataFrame) -> DataFrame:
    """Logon sessions with a user; the type follows from the station's name."""
    rows = raw.filter(F.coalesce("user", F.lit("")) != "")
    return rows.select("user", t.logon_type(F.coalesce("station", F.lit(""))).alias("logon_type"), "logon_time", F.lit(None).cast("string").alias("source"), "session_id", F.coalesce("state_active", F.lit(False)).alias("state_active"), "_ord")


# ---- registry exports -----------------------------------------------------------------------
# One flat table: hive STRING, key STRING, name STRING, data STRING, raw BINARY, last_write TIMESTAMP, _ord BIGINT


def _entry(rows: DataFrame, mechanism: str, location: Column, value: Column, command: Column, binary_path: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(mechanism).alias("mechanism"), location.alias("location"), value.alias("value"), command.alias("command"), binary_path.alias("binary_path"), none.alias("binary_sha256"),
        F.lit(None).cast("boolean").alias("signed"), none.alias("signer"), "last_write", "_ord",
    )


def full_key() -> Column:
    return F.concat(F.col("hive"), F.lit("\\"), F.col("key"))


def run_keys(registry: DataFrame, env: dict[str, str]) -> DataFrame:
    rows = registry.filter(F.rlike(t.ascii_lower(F.col("key")), F.lit(r"\\microsoft\\windows\\currentversion\\run(once)?$")))
    path = F.get(t.path_candidates(t.expand_env(F.col("data"), env)), F.lit(0))
    return _entry(rows, "run_key", full_key(), F.col("name"), F.col("data"), path)


def services(registry: DataFrame, windir: str = "C:\\Windows") -> DataFrame:
    """Services that start by themselves (Start at most 2) and have an image."""
    rows = registry.filter(F.rlike(t.ascii_lower(F.col("key")), F.lit(r"\\services\\[^\\]+$")))
    one = rows.groupBy("hive", "key").agg(
        F.max_by(F.when(F.lower("name") == "start", F.col("data")), F.when(F.lower("name") == "start", F.col("_ord"))).alias("start"),
        F.max_by(F.when(F.lower("name") == "imagepath", F.col("data")), F.when(F.lower("name") == "imagepath", F.col("_ord"))).alias("image"),
        F.max("last_write").alias("last_write"), F.min("_ord").alias("_ord"),
    ).filter((F.col("start").try_cast("int") <= 2) & (F.coalesce("image", F.lit("")) != ""))
    first = F.get(t.path_candidates(F.col("image")), F.lit(0))
    return _entry(one, "service", full_key(), t.base_name(F.col("key")), F.col("image"), t.service_path(first, windir))


def winlogon(registry: DataFrame) -> DataFrame:
    rows = registry.filter(F.rlike(t.ascii_lower(F.col("key")), F.lit(r"\\windows nt\\currentversion\\winlogon$")) & F.col("name").isin("Shell", "Userinit"))
    return _entry(rows, "winlogon", full_key(), F.col("name"), F.col("data"), F.get(t.path_candidates(F.regexp_replace("data", ",$", "")), F.lit(0)))


def ifeo(registry: DataFrame) -> DataFrame:
    rows = registry.filter(F.contains(t.ascii_lower(F.col("key")), F.lit("\\image file execution options\\")) & (F.lower("name") == "debugger"))
    return _entry(rows, "ifeo", full_key(), F.col("name"), F.col("data"), F.get(t.path_candidates(F.col("data")), F.lit(0)))


def startup_folders(files: DataFrame) -> DataFrame:
    """Entries of startup folders from a listing (path, modificationTime, _ord)."""
    rows = files.filter(F.lower(t.base_name(F.col("path"))) != "desktop.ini").withColumn("last_write", F.col("modificationTime"))
    folder = F.regexp_replace("path", r"[\\/][^\\/]*$", "")
    return _entry(rows, "startup", folder, t.base_name(F.col("path")), F.col("path"), F.col("path"))


def wmi_subscriptions(bindings: DataFrame, filters: DataFrame, consumers: DataFrame) -> DataFrame:
    """Bindings (filter, consumer) with both ends known; consumers: (path, kind, command, _ord)."""
    rows = bindings.select("filter", "consumer").join(filters.select(F.col("path").alias("filter"), "query"), "filter")
    rows = rows.join(consumers.select(F.col("path").alias("consumer"), "kind", "command", "_ord"), "consumer")
    rows = rows.withColumn("last_write", F.lit(None).cast("timestamp"))
    binary = F.when(F.col("kind") == "CommandLineEventConsumer", F.get(F.split(F.trim("command"), r"\s+"), F.lit(0)))
    return _entry(rows, "wmi_subscription", F.col("consumer"), F.col("query"), F.col("command"), binary)


def _element(xml: str, tag: str) -> Column:
    """The trimmed text of the first element of a local name, empty if there is none.

    Parsing a document for each element is most of a task file's cost.  Where no such element has attributes
    or children and nothing is commented, quoted or referred to by number, its text is what lies between its
    tags; any other document is parsed.
    """
    c, name = F.col(xml), rf"<(?:[^\s<>/:!?]+:)?{tag}"
    inner = F.regexp_extract(c, name + r">([^<]*)</", 1)
    named = ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")
    other = F.contains(c, F.lit("<!")) | F.contains(F.substring(c, 3, 1 << 30), F.lit("<?")) | F.rlike(c, F.lit(name + r"(?:[\s/]|>[^<]*(?:$|<[^/]))")) | F.rlike(inner, F.lit(rf"&(?!(?:{'|'.join(n for n, _ in named)});)|\r"))
    text = inner
    for n, sign in named:  # the ampersand last, so that what it makes isn't read again
        text = F.replace(text, F.lit(f"&{n};"), F.lit(sign))
    return F.trim(F.when(other, F.expr(f"xpath_string({xml}, 'string(//*[local-name()=\"{tag}\"])')")).otherwise(text))


def scheduled_tasks(files: DataFrame, known_files: DataFrame | None = None, env: dict[str, str] | None = None) -> DataFrame:
    """One row an Exec action of task XML files (path, xml, modificationTime, _ord); known_files: (path), to pick binaries by."""
    blocks = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?Exec(?:\s[^>]*)?>(.*?)</(?:\w+:)?Exec>"), F.lit(1))
    rows = files.select("*", F.posexplode(blocks).alias("i", "block")).withColumn("block", F.concat(F.lit("<e>"), F.col("block"), F.lit("</e>")))
    rows = rows.withColumns({"command0": _element("block", "Command"), "arguments": _element("block", "Arguments"), "uri": _element("xml", "URI")})
    rows = rows.filter("command0 <> ''").withColumn("command", F.when(F.col("arguments") == "", F.col("command0")).otherwise(F.concat_ws(" ", "command0", "arguments")))
    rows = rows.withColumn("candidates", t.path_candidates(t.expand_env(F.col("command"), env or {}))).withColumn("last_write", F.col("modificationTime"))
    # Read once: both sides of the join below, and each filter that is pushed down, would read the files again.
    rows = checkpointed(rows.select("_ord", "i", "path", "last_write", "command", "uri", "candidates"))
    stem = F.regexp_replace(t.base_name(F.col("path")), r"\.xml$", "")
    if known_files is not None:  # only the candidates that exist are looked up, not the whole list
        seen = rows.select("_ord", "i", F.explode("candidates").alias("path")).join(known_files.select("path").distinct(), "path", "left_semi")
        rows = rows.join(seen.groupBy("_ord", "i").agg(F.collect_set("path").alias("known")), ["_ord", "i"], "left")
    else:
        rows = rows.withColumn("known", F.array().cast("array<string>"))
    location = F.when(F.col("uri") != "", F.col("uri")).otherwise(stem)
    leaf = F.nullif(t.base_name(F.col("uri")), F.lit(""))
    rows = rows.withColumn("_ord", F.col("_ord") * 4096 + F.col("i"))  # each action is an entry of its own
    return _entry(rows, "scheduled_task", location, F.coalesce(leaf, stem), F.col("command"), t.pick_path(F.col("candidates"), F.coalesce("known", F.array().cast("array<string>"))))


# ---- execution artifacts --------------------------------------------------------------------


def _execution(rows: DataFrame, source: str, path: Column, **columns: Column) -> DataFrame:
    fields = {"first_run": "timestamp", "last_run": "timestamp", "run_count": "bigint", "sha1": "string", "user_sid": "string", "execution_confirmed": "boolean"}
    return rows.select(F.lit(source).alias("source"), path.alias("path"), *(columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields.items()), "_ord")


def amcache(registry: DataFrame, source: str = "amcache", path_names: tuple[str, ...] = ("LowerCaseLongPath", "DriverName"), hash_name: str = "FileId") -> DataFrame:
    """Inventory entries: a key's values side by side; the first path that isn't empty, SHA-1 from the file id."""
    # The last of values of one name counts; values without a name, which exports have, are none of these.
    last = [F.max_by(F.when(F.col("name") == n, F.col("data")), F.when(F.col("name") == n, F.col("_ord"))).alias(f"v{i}") for i, n in enumerate((*path_names, hash_name))]
    one = registry.groupBy("hive", "key").agg(*last, F.max("last_write").alias("last_write"), F.min("_ord").alias("_ord"))
    path = t.first_non_empty(*(F.col(f"v{i}") for i in range(len(path_names))))
    return _execution(one.filter(path.isNotNull()), source, path, first_run=F.col("last_write"), sha1=t.sha1_from_file_id(F.col(f"v{len(path_names)}")))


def bam(registry: DataFrame) -> DataFrame:
    """Values of BAM's per-user keys: the time is the first eight bytes; shorter values are skipped."""
    rows = registry.filter(F.rlike("key", F.lit(r"(?i)\\bam\\(state\\)?usersettings\\s-1-"))).filter(F.octet_length("raw") >= 8)
    return _execution(rows, "bam", F.col("name"), last_run=v.filetime(filetime_at(F.col("raw"), 0)), user_sid=t.base_name(F.col("key")), execution_confirmed=F.lit(True))


def userassist(registry: DataFrame, profiles: DataFrame) -> DataFrame:
    """UserAssist values with their user's SID; profiles: (folder, sid, _ord), the last of a folder counts."""
    rows = registry.filter(F.rlike("key", F.lit(r"(?i)\\userassist\\.*\\count$"))).filter(F.octet_length("raw") >= 8)
    known = last_by_key(profiles.select(t.ascii_lower(F.col("folder")).alias("_folder"), "sid", "_ord"), "_folder").drop("_ord")
    rows = rows.join(known, t.ascii_lower(F.col("hive")) == F.col("_folder"), "left")
    return _execution(rows, "userassist", t.rot13(F.col("name")), run_count=v.le_uint(F.col("raw"), 4, 4), last_run=v.filetime(filetime_at(F.col("raw"), 60)), user_sid=F.col("sid"), execution_confirmed=F.lit(True))


def filetime_at(raw: Column, offset: int) -> Column:
    """The FILETIME at an offset, from its two halves (64 unsigned bits don't fit a signed number)."""
    low, high = v.le_uint(raw, offset, 4), v.le_uint(raw, offset + 4, 4)
    return F.when(high < (1 << 31), high * F.lit(1 << 32).cast("bigint") + low)


def srum(apps: DataFrame, network: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of both usage tables (app_id, ts, _ord) with the program's name; ids: (app_id, name, _ord)."""
    names = last_by_key(ids.select("app_id", "name", "_ord"), "app_id").drop("_ord")
    parts = []
    for source, rows in (("srum_app", apps), ("srum_net", network)):
        rows = rows.join(names, "app_id", "left")
        parts.append(_execution(rows, source, F.coalesce("name", F.concat(F.lit("id:"), F.col("app_id").cast("string"))), last_run=F.col("ts")))
    return parts[0].unionByName(parts[1])


def driver_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(sha1) of a list: comments after #, lower case, 40 hex digits, each once."""
    line = F.lower(F.trim(F.element_at(F.split("value", "#"), 1)))
    return spark.read.text(path).select(line.alias("sha1")).filter(F.rlike("sha1", F.lit("^[0-9a-f]{40}$"))).distinct()


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of tab-separated lines; blank lines and comments are skipped."""
    rows = spark.read.text(path).filter(~F.rlike("value", F.lit(r"^\s*(#|$)")))
    return rows.select(F.trim(F.split("value", "\t")[0]).alias("key"), F.trim(F.get(F.split("value", "\t"), F.lit(1))).alias("value"))


def truncation_notes(sources: DataFrame) -> DataFrame:
    """(artifact, cap) harvested from the sources' notes."""
    return sources.select("artifact", F.explode("errors").alias("note")).select("artifact", t.parse_cap(F.col("note")).alias("cap")).filter("cap is not null")


def capped(rows: DataFrame, cap: int) -> tuple[DataFrame, bool]:
    """At most cap rows in ingest order, and whether there were more (a stated cap of a run)."""
    more = rows.limit(cap + 1).count() > cap
    return (rows.orderBy("_ord").limit(cap) if more else rows), more
