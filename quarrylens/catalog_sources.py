"""Registered queries of the sources, record conversions, functions and outputs, each a call of what ships.

The tables they read are made from the driver's by SQL that runs in both engines; readers of files
read files written from those tables into the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters
from .catalog import _ATT, _SEV, NOW, PARAMS, PARENTCHILD, PERSIST, _base, query
from .functions import text as t
from .functions import values as v
from .plans import analyzers as a
from .plans import pipeline, sigma
from .sinks import panels, timeline
from .sources import readers
from .storage import shared_folder


def _text(literal: str) -> str:
    """A SQL expression of a text with backslashes that both engines read alike."""
    return "concat('" + "', chr(92), '".join(literal.split("\\")) + "')" if "\\" in literal else f"'{literal}'"


_K = "cast(c_custkey as varchar(20))"
_AT = "timestamp '2024-01-01 00:00:00' + interval '1' minute * c_custkey"
_SERVICE = f"case c_custkey % 4 when 0 then concat({_text(chr(92) + 'SystemRoot' + chr(92) + 'd')}, {_K}, '.sys') when 1 then concat({_text('C:' + chr(92) + 'Svc' + chr(92) + 's')}, {_K}, '.exe') when 2 then '' else concat({_text('System32' + chr(92) + 't')}, {_K}, '.exe') end"


def _registry(hive: str, key: str, name: str, data: str, ord_: int, where: str = "true") -> str:
    return f"select {hive} as hive, {key} as key, {name} as name, {data} as data, {_AT} as last_write, c_custkey * 16 + {ord_} as _ord from {{customer}} where {where}"


adapters.SQL["registry"] = "\nunion all\n".join((
    _registry("'HKLM'", f"concat({_text(chr(92).join(('SOFTWARE', 'Microsoft', 'Windows', 'CurrentVersion', 'Run')))}, case when c_custkey % 3 = 0 then 'Once' else '' end)", f"concat('r', {_K})",
              f"case when c_custkey % 2 = 0 then concat('\"C:', chr(92), 'P F', chr(92), 'app', {_K}, '.exe\" -run') else concat('%TOOLS%', chr(92), 'tool', {_K}, '.exe') end", 0),
    _registry("'HKLM'", f"concat({_text(chr(92).join(('SYSTEM', 'ControlSet001', 'Services', 'svc')))}, {_K})", "'Start'", "cast(c_custkey % 5 as varchar(20))", 1),
    _registry("'HKLM'", f"concat({_text(chr(92).join(('SYSTEM', 'ControlSet001', 'Services', 'svc')))}, {_K})", "'ImagePath'", _SERVICE, 2),
    _registry("'HKLM'", _text(chr(92).join(("SOFTWARE", "Microsoft", "Windows NT", "CurrentVersion", "Winlogon"))), "case c_custkey % 3 when 0 then 'Shell' when 1 then 'Userinit' else 'Other' end", f"concat({_text('C:' + chr(92) + 'w')}, {_K}, '.exe,')", 3),
    _registry("'HKLM'", f"concat({_text(chr(92).join(('SOFTWARE', 'Microsoft', 'Windows NT', 'CurrentVersion', 'Image File Execution Options', 'p')))}, {_K})", "case when c_custkey % 2 = 0 then 'Debugger' else 'GlobalFlag' end", f"concat('dbg', {_K}, '.exe')", 4),
    _registry("'inventory'", f"concat('k', {_K})", "'LowerCaseLongPath'", f"case when c_custkey % 4 = 0 then '' else concat({_text('c:' + chr(92) + 'i' + chr(92))}, {_K}, '.exe') end", 5),
    _registry("'inventory'", f"concat('k', {_K})", "'DriverName'", f"concat('drv', {_K}, '.sys')", 6, "c_custkey % 8 <> 0"),
    _registry("'inventory'", f"concat('k', {_K})", "'FileId'", f"case when c_custkey % 5 = 0 then 'none' else concat('0000', lpad({_K}, 40, 'A')) end", 7),
    _registry("'inventory'", f"concat('k', {_K})", "cast(null as varchar(20))", "'no name'", 8),
    _registry("'inventory'", f"concat('k', {_K})", "cast(null as varchar(20))", "'nor here'", 9),
))
adapters._USED["registry"] = ["customer"]


def _registry_table(s: SparkSession, d: str) -> DataFrame:
    return adapters.view(s, d, "registry").withColumn("raw", F.lit(None).cast("binary"))


def _entry(df: DataFrame) -> DataFrame:
    return df.select("location", "value", "command", "binary_path")


# ---- registry, tasks, WMI -------------------------------------------------------------------


@query("source_run_keys", "registry", r"""SELECT hive || '\' || key AS location, name AS value, data AS command, CASE WHEN starts_with(data, '"') THEN regexp_extract(data, '^"([^"]*)', 1) ELSE replace(data, '%TOOLS%', 'C:\T') END AS binary_path
FROM registry WHERE regexp_matches(lower(key), '\\run(once)?$')""")
def _(s, d):
    return _entry(readers.run_keys(_registry_table(s, d), {"tools": "C:\\T"}))


@query("source_services", "registry", r"""WITH x AS (SELECT hive, key, max(data) FILTER (WHERE name = 'Start') AS start, max(data) FILTER (WHERE name = 'ImagePath') AS image FROM registry WHERE contains(key, '\Services\') GROUP BY 1, 2)
SELECT hive || '\' || key AS location, regexp_extract(key, '[^\\]*$') AS value, image AS command, CASE WHEN starts_with(image, '\SystemRoot') THEN 'C:\Windows' || substr(image, 12) WHEN starts_with(image, 'C:') THEN image ELSE 'C:\Windows\' || image END AS binary_path
FROM x WHERE CAST(start AS INT) <= 2 AND image <> ''""")
def _(s, d):
    return _entry(readers.services(_registry_table(s, d)))


@query("source_winlogon", "registry", r"SELECT hive || '\' || key AS location, name AS value, data AS command, regexp_replace(data, ',$', '') AS binary_path FROM registry WHERE ends_with(key, '\Winlogon') AND name IN ('Shell', 'Userinit')")
def _(s, d):
    return _entry(readers.winlogon(_registry_table(s, d)))


@query("source_ifeo", "registry", r"SELECT hive || '\' || key AS location, name AS value, data AS command, data AS binary_path FROM registry WHERE contains(key, 'Image File Execution Options') AND name = 'Debugger'")
def _(s, d):
    return _entry(readers.ifeo(_registry_table(s, d)))


@query("source_startup", "", r"SELECT '/startup/' || (c_custkey % 7) AS location, CASE WHEN c_custkey % 9 = 0 THEN 'Desktop.ini' ELSE 'item' || c_custkey || '.lnk' END AS value, '/startup/' || (c_custkey % 7) || '/item' || c_custkey || '.lnk' AS command, '/startup/' || (c_custkey % 7) || '/item' || c_custkey || '.lnk' AS binary_path FROM customer WHERE c_custkey % 9 <> 0")
def _(s, d):
    rows = s.read.parquet(f"{d}/customer.parquet")
    name = F.when(F.col("c_custkey") % 9 == 0, "Desktop.ini").otherwise(F.concat(F.lit("item"), F.col("c_custkey"), F.lit(".lnk")))
    path = F.concat(F.lit("/startup/"), F.col("c_custkey") % 7, F.lit("/"), name)
    return _entry(readers.startup_folders(rows.select(path.alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.col("c_custkey").alias("_ord"))))


@query("source_tasks", "", r"""SELECT '\Jobs\J' || p_partkey AS location, 'J' || p_partkey AS value, CASE WHEN i = 0 THEN 'C:\j\a' || p_partkey || '.exe -x & y' ELSE 'D:\b.exe' END AS command, CASE WHEN i = 0 THEN 'C:\j\a' || p_partkey || '.exe' ELSE 'D:\b.exe' END AS binary_path
FROM part, (SELECT unnest([0, 1]) AS i) WHERE i = 0 OR p_partkey % 2 = 0""")
def _(s, d):
    rows = s.read.parquet(f"{d}/part.parquet")
    action = lambda *parts: F.concat(F.lit("<Exec><Command>"), *parts, F.lit("</Exec>"))
    one = action(F.lit("C:\\j\\a"), F.col("p_partkey"), F.lit(".exe</Command><Arguments>-x &amp; y</Arguments>"))
    two = F.when(F.col("p_partkey") % 2 == 0, F.lit("<Exec><Command>D:\\b.exe</Command></Exec>")).otherwise("")
    xml = F.concat(F.lit('<Task xmlns="urn:t"><RegistrationInfo><URI>\\Jobs\\J'), F.col("p_partkey"), F.lit("</URI></RegistrationInfo><Actions>"), one, two, F.lit("</Actions></Task>"))
    files = rows.select(F.concat(F.lit("/t/"), F.col("p_partkey")).alias("path"), xml.alias("xml"), F.lit(None).cast("timestamp").alias("modificationTime"), F.col("p_partkey").alias("_ord"))
    known = rows.select(F.concat(F.lit("C:\\j\\a"), F.col("p_partkey"), F.lit(".exe")).alias("path"))
    return _entry(readers.scheduled_tasks(files, known))


@query("source_wmi", "", "SELECT 'c' || s_suppkey AS location, 'query ' || (s_suppkey % 5) AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'run' || s_suppkey || '.exe -q' ELSE 'Eval(x)' END AS command, CASE WHEN s_suppkey % 2 = 0 THEN 'run' || s_suppkey || '.exe' END AS binary_path FROM supplier WHERE s_suppkey % 5 <> 4")
def _(s, d):
    rows = s.read.parquet(f"{d}/supplier.parquet")
    key, even = F.col("s_suppkey"), F.col("s_suppkey") % 2 == 0
    consumer = F.concat(F.lit("c"), key).alias("path")
    command = F.when(even, F.concat(F.lit("run"), key, F.lit(".exe -q"))).otherwise("Eval(x)")
    consumers = rows.select(consumer, F.when(even, "CommandLineEventConsumer").otherwise("ActiveScriptEventConsumer").alias("kind"), command.alias("command"), key.alias("_ord"))
    filters = s.range(4).select(F.concat(F.lit("f"), F.col("id")).alias("path"), F.concat(F.lit("query "), F.col("id")).alias("query"))
    bindings = rows.select(F.concat(F.lit("f"), key % 5).alias("filter"), F.concat(F.lit("c"), key).alias("consumer"))
    return _entry(readers.wmi_subscriptions(bindings, filters, consumers))


# ---- execution artifacts --------------------------------------------------------------------


@query("source_amcache", "registry", r"""WITH x AS (SELECT key, max(data) FILTER (WHERE name = 'LowerCaseLongPath') AS p, max(data) FILTER (WHERE name = 'DriverName') AS n, max(data) FILTER (WHERE name = 'FileId') AS f FROM registry WHERE hive = 'inventory' GROUP BY 1)
SELECT coalesce(nullif(p, ''), n) AS path, CASE WHEN starts_with(f, '0000') THEN lower(substr(f, 5)) END AS sha1 FROM x WHERE coalesce(nullif(p, ''), n) IS NOT NULL""")
def _(s, d):
    return readers.amcache(_registry_table(s, d).filter("hive = 'inventory'")).select("path", "sha1")


def _le(n: F.Column, size: int) -> F.Column:
    """A number as the hexadecimal text of its little-endian bytes."""
    digits = F.lpad(F.hex(n), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)))


_FT = "133500000000000000 + o_orderkey * 10000000"


@query("source_userassist", "", r"SELECT 'C:\Apps\p' || o_orderkey || '.exe' AS path, o_orderkey % 200 AS run_count, c_name AS user_sid, (133500000000000000 + o_orderkey * 10000000 - 116444736000000000) // 10 AS us FROM orders LEFT JOIN customer ON o_custkey * 2 = c_custkey")
def _(s, d):
    profiles = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("C:\\USERS\\"), F.col("c_custkey")).alias("folder"), F.col("c_name").alias("sid"), F.col("c_custkey").alias("_ord"))
    rows = s.read.parquet(f"{d}/orders.parquet")
    raw = F.unhex(F.concat(F.lit("00" * 4), _le(F.col("o_orderkey") % 200, 4), F.lit("00" * 52), _le(F.expr(_FT).cast("bigint"), 8), F.lit("00" * 4)))
    registry = rows.select(
        F.concat(F.lit("c:\\users\\"), F.col("o_custkey") * 2).alias("hive"), F.lit("Software\\Explorer\\UserAssist\\{1}\\Count").alias("key"), t.rot13(F.concat(F.lit("C:\\Apps\\p"), F.col("o_orderkey"), F.lit(".exe"))).alias("name"),
        F.lit(None).cast("string").alias("data"), raw.alias("raw"), F.lit(None).cast("timestamp").alias("last_write"), F.col("o_orderkey").alias("_ord"),
    )
    return readers.userassist(registry, profiles).select("path", "run_count", "user_sid", F.unix_micros("last_run").alias("us"))


@query("source_bam", "", r"SELECT '\Device\x' || o_orderkey AS path, 'S-1-5-' || (o_custkey % 10) AS user_sid, (133500000000000000 + o_orderkey * 10000000 - 116444736000000000) // 10 AS us FROM orders WHERE o_orderkey % 6 <> 0")
def _(s, d):
    rows = s.read.parquet(f"{d}/orders.parquet")
    raw = F.when(F.col("o_orderkey") % 6 != 0, F.unhex(F.concat(_le(F.expr(_FT).cast("bigint"), 8), F.lit("00" * 16)))).otherwise(F.unhex(F.lit("0011")))
    key = F.concat(F.lit("SYSTEM\\ControlSet001\\Services\\bam\\State\\UserSettings\\S-1-5-"), F.col("o_custkey") % 10)
    registry = rows.select(F.lit("HKLM").alias("hive"), key.alias("key"), F.concat(F.lit("\\Device\\x"), F.col("o_orderkey")).alias("name"), raw.alias("raw"), F.col("o_orderkey").alias("_ord"))
    return readers.bam(registry).select("path", "user_sid", F.unix_micros("last_run").alias("us"))


@query("source_srum", "", "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'srum_app' ELSE 'srum_net' END AS source, coalesce(s_name, 'id:' || CAST(l_suppkey + l_linenumber AS VARCHAR)) AS path, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey + l_linenumber GROUP BY 1, 2")
def _(s, d):
    ids = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("app_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("_ord"))
    rows = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") + F.col("l_linenumber")).alias("app_id"), F.lit(None).cast("timestamp").alias("ts"), F.col("l_orderkey").alias("_ord"), "l_linenumber")
    even = F.col("l_linenumber") % 2 == 0
    return readers.srum(rows.filter(even), rows.filter(~even), ids).groupBy("source", "path").agg(F.count(F.lit(1)).alias("n"))


# ---- snapshots ------------------------------------------------------------------------------


@query("source_processes", "process", r"""SELECT pid, _ord AS ord, CASE pid % 5 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' WHEN 2 THEN 'system' WHEN 3 THEN 'low' ELSE '' END AS integrity,
  CASE WHEN regexp_matches(image, '^[A-Za-z]:\\') AND contains(lower(image), 'app') AND contains(lower(image), 'program') THEN true END AS signed FROM process""")
def _(s, d):
    rows = adapters.view(s, d, "process").withColumnRenamed("user_name", "user")
    rid = F.element_at(F.array(*map(F.lit, (0x2000, 0x3000, 0x4000, 0x1000, 5))), (F.col("pid") % 5 + 1).cast("int"))
    known = rows.filter(F.contains(F.lower("image"), F.lit("app")) & F.contains(F.lower("image"), F.lit("program"))).select(F.upper("image").alias("path"), F.lit(True).alias("signed"), F.lit("S").alias("signer")).distinct()
    return readers.process_rows(rows.withColumn("integrity_rid", rid), known).select("pid", F.col("_ord").alias("ord"), "integrity", "signed")


@query("source_connections", "net_conn", f"SELECT 'tcp' AS proto, CASE lport // 500 % 14 {' '.join(f'WHEN {k} THEN {name!r}' for k, name in enumerate(v.TCP_STATES, 1))} ELSE CAST(lport // 500 % 14 AS VARCHAR) END AS state, count(*) AS n, count(raddr) AS remote FROM net_conn GROUP BY 1, 2 UNION ALL SELECT 'udp', NULL, count(*), 0 FROM net_conn WHERE lport > 2000")
def _(s, d):
    rows = adapters.view(s, d, "net_conn").drop("proto", "state").withColumn("state_code", F.expr("lport div 500 % 14"))
    return readers.connection_rows(rows, rows.filter("lport > 2000")).groupBy("proto", "state").agg(F.count(F.lit(1)).alias("n"), F.count("raddr").alias("remote"))


@query("source_sessions", "", "SELECT c_custkey AS session_id, c_name AS user, CASE WHEN c_custkey % 3 = 0 THEN 'RemoteInteractive' ELSE 'Interactive' END AS logon_type, c_custkey % 2 = 0 AS state_active FROM customer WHERE c_custkey % 11 <> 0")
def _(s, d):
    key = F.col("c_custkey")
    rows = s.read.parquet(f"{d}/customer.parquet").select(
        F.when(key % 11 != 0, F.col("c_name")).alias("user"), F.when(key % 3 == 0, "RDP-Tcp#4").when(key % 3 == 1, "Console").alias("station"), F.lit(None).cast("timestamp").alias("logon_time"),
        key.alias("session_id"), F.when(key % 2 == 0, F.lit(True)).alias("state_active"), key.alias("_ord"),
    )
    return readers.session_rows(rows).select("session_id", "user", "logon_type", "state_active")


# ---- files ----------------------------------------------------------------------------------


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@query("source_event_json", "event_flat", "SELECT record_id, event_id, channel, provider, computer, epoch_us(ts) AS us, target_user, CAST(event_id AS VARCHAR) AS event_id_text FROM event_flat")
def _(s, d):
    rows = adapters.view(s, d, "event_flat")
    attribute = lambda **x: F.struct(F.struct(*(c.alias(n) for n, c in x.items())).alias("#attributes"))
    system = F.struct(
        attribute(Name=F.col("provider")).alias("Provider"), F.col("event_id").cast("string").alias("EventID"), F.col("channel").alias("Channel"), F.col("computer").alias("Computer"), F.col("record_id").alias("EventRecordID"),
        attribute(SystemTime=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("TimeCreated"),
    )
    path = _folder(s, "event-json")
    rows.select(F.to_json(F.struct(F.struct(system.alias("System"), F.struct(F.col("target_user").alias("TargetUserName")).alias("EventData")).alias("Event"))).alias("value")).write.text(path)
    got = readers.read_event_json(s, path)
    return got.select("record_id", "event_id", "channel", "provider", "computer", F.unix_micros("ts").alias("us"), F.element_at("data", "TargetUserName").alias("target_user"), F.element_at("data", "EventID").alias("event_id_text"))


@query("source_event_scan", "event_flat", "SELECT channel, event_id, count(*) AS n, min(record_id) AS first_record FROM event_flat WHERE channel = 'System' AND ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2")
def _(s, d):
    path = _folder(s, "events")
    adapters.event(s, d).drop("_ord").write.partitionBy("channel").parquet(path)
    got = readers.read_events(s, path, ["System"], F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return got.groupBy("channel", "event_id").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_record"))


@query("source_records", "process usn_event", "SELECT pid, image, epoch_us(start_time) AS us, signed, 'process' AS kind FROM process UNION ALL SELECT mft_ref, path, epoch_us(ts), NULL, 'usn_event' FROM usn_event")
def _(s, d):
    tb = adapters.tables(s, d)
    path = _folder(s, "records")
    timeline.tagged_records({k: tb[k] for k in ("process", "usn_event")}).write.text(path)
    got = readers.read_all(s, path)
    one = got["process"].select("pid", "image", F.unix_micros("start_time").alias("us"), "signed", F.lit("process").alias("kind"))
    return one.unionAll(got["usn_event"].select("mft_ref", "path", F.unix_micros("ts"), F.lit(None).cast("boolean"), F.lit("usn_event")))


@query("source_findings", "process", f"WITH {PARENTCHILD} SELECT pid, {_SEV.format(r='CASE WHEN weight >= 70 THEN 4 WHEN weight >= 50 THEN 3 WHEN weight >= 30 THEN 2 ELSE 1 END')} AS severity, tags FROM pc WHERE weight >= 15")
def _(s, d):
    path = _folder(s, "findings")
    timeline.json_lines(a.parentchild(adapters.tables(s, d), None, PARAMS, s)).write.text(path)
    return readers.read_findings(s, path).select("entity.process.pid", "severity", F.array_join("mitre", ",").alias("tags"))


@query("source_hash_list", "", "SELECT DISTINCT lpad(CAST(c_custkey % 50 AS VARCHAR), 40, 'a') AS sha1 FROM customer")
def _(s, d):
    path, key = _folder(s, "hashes"), F.col("c_custkey")
    s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lpad((key % 50).cast("string"), 40, "A"), F.when(key % 2 == 0, " # note").otherwise("  ")).alias("value")).write.text(path)
    return readers.driver_hashes(s, path)


# ---- order, totals, sinks -------------------------------------------------------------------


@query("since_filter", "event_flat", "SELECT event_id, count(*) AS n FROM event_flat WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def _(s, d):
    return readers.since(adapters.event(s, d), F.lit("2024-01-15 12:00:00").cast("timestamp")).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("record_totals", "process net_conn persistence usn_event", "SELECT 'process' AS kind, count(*) AS n FROM process UNION ALL SELECT 'net_conn', count(*) FROM net_conn UNION ALL SELECT 'persistence', count(*) FROM persistence UNION ALL SELECT 'usn_event', count(*) FROM usn_event")
def _(s, d):
    tb = adapters.tables(s, d)
    return panels.totals({k: tb[k] for k in ("process", "net_conn", "persistence", "usn_event")})


@query("inventory_by_category", "persistence", f"WITH {PERSIST} SELECT CASE mechanism WHEN 'winlogon' THEN 'winlogon_default' ELSE mechanism END AS category, count(*) AS n FROM hits WHERE n = 0 GROUP BY 1")
def _(s, d):
    return panels.by_category(a.persist_observations(adapters.tables(s, d), PARAMS, s))


@query("hash_targets", "process", f"WITH {PARENTCHILD} SELECT DISTINCT image AS path FROM process WHERE pid IN (SELECT pid FROM pc WHERE weight >= 15) AND image <> ''")
def _(s, d):
    tb = adapters.tables(s, d)
    return pipeline.hash_targets(tb, a.parentchild(tb, None, PARAMS, s))


@query("entity_summaries", "process", f"""WITH {PARENTCHILD} SELECT pid, {_base('image')} || ' (pid=' || pid || ')' || CASE WHEN signed THEN ' [signed]' WHEN NOT signed THEN ' [unsigned]' ELSE '' END || CASE WHEN cmdline <> '' THEN ' cmd=' || substr(cmdline, 1, 60) ELSE '' END AS entity,
  CASE WHEN weight >= 30 THEN 'On host : ' || {_base('image')} || ' was started by an unexpected parent; please check that this is normal.' ELSE '' END AS client FROM pc WHERE weight >= 15""")
def _(s, d):
    found = timeline.with_client_text(a.parentchild(adapters.tables(s, d), None, PARAMS, s))
    pid = F.regexp_extract("Details", r"\(pid=(\d+),", 1).cast("bigint")
    return timeline.timeline_rows(found).select(pid.alias("pid"), F.col("Entity").alias("entity"), F.col("DetailsClient").alias("client"))


@query("logon_evidence", "event_flat", f"""WITH {_ATT}, w AS (SELECT x._ord, x.u, x.src, count(*) FILTER (WHERE NOT y.ok) AS f, bool_or(y.ok) AS hit FROM a x JOIN a y ON x.u = y.u AND x.src = y.src AND y.us BETWEEN x.us AND x.us + 72 * 3600000000 WHERE NOT x.ok GROUP BY 1, 2, 3),
b AS (SELECT u, src, max(f) AS f FROM w GROUP BY 1, 2), bh AS (SELECT b.u, b.src, b.f, bool_or(w.hit) AS hit FROM b JOIN w ON w.u = b.u AND w.src = b.src AND w.f = b.f WHERE b.f >= 3 GROUP BY 1, 2, 3),
p AS (SELECT x._ord, x.src, x.us, count(DISTINCT y.u) AS n, bool_or(y.ok) AS hit FROM a x JOIN a y ON x.src = y.src AND y.us BETWEEN x.us AND x.us + 12 * 3600000000 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, _ord) AS k FROM p)
SELECT CASE WHEN hit THEN 'high' ELSE 'medium' END AS severity, 'Brute-force logon: ' || u || ' from ' || src AS title, (SELECT count(*) FROM a WHERE a.u = bh.u AND a.src = bh.src) AS n_evidence FROM bh
UNION ALL SELECT CASE WHEN hit THEN 'high' ELSE 'medium' END, 'Password spraying: ' || src, (SELECT count(*) FROM a WHERE a.src = r.src AND a.us BETWEEN r.us AND r.us + 12 * 3600000000) FROM r WHERE k = 1 AND n >= 2""")
def _(s, d):
    found = a.logon_bruteforce({"event": adapters.event(s, d)}, None, PARAMS, s)
    return found.select("severity", "title", F.size("evidence").cast("bigint").alias("n_evidence"))


@query("ipv6_networks", "", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN p_partkey % 512 < 256 WHEN 2 THEN false ELSE p_partkey % 3 = 0 END AS inside FROM part")
def _(s, d):
    key = F.col("p_partkey")
    low = F.lower(F.hex(key % 512))
    address = F.when(key % 4 == 0, F.concat(F.lit("fd12::"), low)).when(key % 4 == 1, F.concat(F.lit("2001:DB8:0:0:0:0:"), F.lower(F.hex(F.expr("p_partkey % 512 div 256"))), F.lit(":"), low)).when(key % 4 == 2, F.concat(F.lit("fe00::"), low))
    address = address.otherwise(F.when(key % 3 == 0, "::ffff:10.1.2.3").otherwise("::ffff:11.1.2.3"))
    rule = sigma.parse_rule({"id": "r", "detection": {"s": {"Ip|cidr": ["fc00::/7", "2001:db8::/112", "::ffff:10.0.0.0/104"]}, "condition": "s"}})
    rows = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.create_map(F.lit("Ip"), address).alias("data"))
    return rows.select("p_partkey", sigma.compile_tree(rule.tree, F.col("data")).alias("inside"))


# ---- functions ------------------------------------------------------------------------------


@query("humanized_times", "", f"SELECT o_orderkey, CASE WHEN h >= 24 THEN (h // 24) || 'd' ELSE h || 'h' END AS age, CASE WHEN o_orderkey % 7 = 0 THEN 'time unknown' WHEN h // 24 * 24 = h AND h <= 720 OR h < 720 THEN 'added ' || (h // 24) || ' days ago' ELSE 'added long ago' END AS hint FROM (SELECT o_orderkey, o_orderkey % 2000 AS h, {NOW} AS z FROM orders)")
def _(s, d):
    hours = F.col("o_orderkey") % 2000
    written = F.when(F.col("o_orderkey") % 7 != 0, PARAMS.now - F.make_dt_interval(hours=hours))
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", v.humanized(hours * 3_600_000_000).alias("age"), v.timing_hint(written, PARAMS.now).alias("hint"))


@query("byte_readers", "", "SELECT o_orderkey, o_orderkey % 65536 AS two, o_orderkey * 7 AS four, NULL::BIGINT AS past FROM orders")
def _(s, d):
    raw = F.unhex(F.concat(F.lit("ff"), _le(F.col("o_orderkey") % 65536, 2), _le(F.col("o_orderkey") * 7, 4)))
    rows = s.read.parquet(f"{d}/orders.parquet").withColumn("raw", raw)
    return rows.select("o_orderkey", v.le_uint(F.col("raw"), 1, 2).alias("two"), v.le_uint(F.col("raw"), 3, 4).alias("four"), v.le_uint(F.col("raw"), 5, 4).alias("past"))


@query("picked_paths", "", r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'C:\a b.exe' WHEN 1 THEN 'C:\a' ELSE 'C:\a' END AS picked, CASE WHEN p_partkey % 2 = 0 THEN 'D:\x\t' || p_partkey ELSE '%OTHER%\t' END AS expanded FROM part""")
def _(s, d):
    rows, key = s.read.parquet(f"{d}/part.parquet"), F.col("p_partkey")
    known = F.when(key % 3 == 0, F.array(F.lit("C:\\a b.exe"))).when(key % 3 == 1, F.array(F.lit("C:\\a"))).otherwise(F.array(F.lit("C:\\z")))
    line = F.when(key % 2 == 0, F.concat(F.lit("%Data%\\t"), key)).otherwise("%OTHER%\\t")
    return rows.select("p_partkey", t.pick_path(t.path_candidates(F.lit("C:\\a b.exe -c")), known).alias("picked"), t.expand_env(line, {"DATA": "D:\\x"}).alias("expanded"))


@query("text_forms", "registry", r"""SELECT _ord AS ord, CASE WHEN starts_with(data, '0000') THEN lower(substr(data, 5)) END AS sha1, CASE WHEN starts_with(hive, 'HK') THEN hive ELSE '' END AS prefix, coalesce(nullif(data, ''), key) AS filled,
  replace(replace(key, '\', '/'), '/', '%4') || '.evtx' AS file, replace(key, '\', '/') AS channel, _ord % 100 AS cap, printf('ControlSet%03d', CAST(_ord % 20 AS INT)) AS controlset FROM registry WHERE data IS NOT NULL""")
def _(s, d):
    rows = _registry_table(s, d).filter("data is not null")
    channel = F.replace("key", F.lit("\\"), F.lit("/"))
    note = F.concat(F.lit("stopped (cap="), F.col("_ord") % 100, F.lit(")"))
    return rows.select(
        F.col("_ord").alias("ord"), t.sha1_from_file_id(F.col("data")).alias("sha1"), t.hive_prefix(readers.full_key()).alias("prefix"), t.first_non_empty(F.col("data"), F.col("key")).alias("filled"),
        t.channel_file(channel).alias("file"), t.file_channel(t.channel_file(channel)).alias("channel"), t.parse_cap(note).alias("cap"), t.controlset_name(F.col("_ord") % 20).alias("controlset"),
    )


@query("path_tests", "persistence", rf"""SELECT _ord AS ord, contains(lower(coalesce(binary_path, '')), '{t.TRUSTED_APPDATA}') AS trusted, regexp_matches(coalesce(binary_path, ''), '^[A-Za-z]:') AS absolute,
  contains(lower(coalesce(binary_path, '')), ':\windows\system32\') AS inbox FROM persistence""")
def _(s, d):
    path = F.coalesce("binary_path", F.lit(""))
    return adapters.view(s, d, "persistence").select(F.col("_ord").alias("ord"), t.trusted_appdata(path).alias("trusted"), F.coalesce(t.absolute_path(path), F.lit(False)).alias("absolute"), t.inbox_service(path).alias("inbox"))


@query("finding_ids", "process", f"WITH {PARENTCHILD} SELECT count(*) AS n, count(DISTINCT _ord) AS ids, 'quarrylens.finding/1' AS schema, min(32) AS length FROM pc WHERE weight >= 15")
def _(s, d):
    found = a.parentchild(adapters.tables(s, d), None, PARAMS, s)
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("schema").alias("schema"), F.min(F.length("id")).alias("length"))
