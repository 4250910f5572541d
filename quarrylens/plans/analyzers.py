"""The ten analyzers: each a function of the record tables and of earlier findings.

``Tables`` maps record kinds to DataFrames with ``_ord``; every analyzer returns findings.  One
``as_of`` stands for the clock everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import values as v
from ..operators import joins, windows
from ..operators.scoring import Hit, Signal, gated, scored, told, top_hit, weighed
from ..schema import EVIDENCE, OBSERVATION_SCHEMA, Found, empty, entity, evidence, findings, process_entity, rank, severity_of
from ..storage import checkpointed, stored

Tables = dict[str, DataFrame]

# Names that the rules compare with.
OFFICE_PARENTS = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe")
SCRIPT_PARENTS = ("wscript.exe", "cscript.exe", "mshta.exe")
SHELL_CHILDREN = ("cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe")
REAL_SHELLS = ("cmd.exe", "powershell.exe", "pwsh.exe")
LOLBAS = ("rundll32.exe", "regsvr32.exe", "mshta.exe", "certutil.exe", "bitsadmin.exe", "cscript.exe", "wscript.exe")
INTERPRETERS = ("powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "cmd.exe", "powershell", "pwsh", "wscript", "cscript", "mshta", "cmd")
SCRIPT_EXTENSIONS = (".vbs", ".vbe", ".js", ".jse", ".bat", ".ps1", ".hta")
WMI_MARKS = ("Chr(", "Eval(", "ExecuteGlobal", "XMLHTTP", "WinHttp.WinHttpRequest")
ACCOUNT_EVENTS = {4720: ("created", "T1136.001"), 4726: ("deleted", "T1531"), 4732: ("added to group", "T1098.001"), 4728: ("added to group", "T1098.001")}
PERSIST_MARKER = "source: heur_persist"
WEB = ("http://", "https://")


def bundled_drivers() -> tuple[str, ...]:
    """The hashes of the list that comes with the package."""
    lines = Path(__file__).with_name("known_drivers.txt").read_text(encoding="utf-8").splitlines()
    return tuple(x.split("#")[0].strip() for x in lines if x.split("#")[0].strip())


@dataclass
class Params:
    """What a run is configured by; times in microseconds."""

    as_of: datetime = field(default_factory=lambda: datetime(2024, 2, 1))
    exclude_pids: tuple[int, ...] = ()
    timestomp_us: int = v.DAY_US
    bruteforce_us: int = 300_000_000
    bruteforce_failures: int = 5
    spraying_us: int = 60_000_000
    spraying_accounts: int = 10
    temporal_us: int = 300_000_000
    temporal_evidence: int = 200
    recent_persist_days: int = 7
    recent_first_run_days: int = 30
    recent_account_days: int = 90
    driver_hashes: tuple[str, ...] = field(default_factory=bundled_drivers)
    host: str = ""

    @property
    def now(self) -> Column:
        return F.lit(self.as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def records(tables: Tables, kind: str, spark: SparkSession) -> DataFrame:
    return tables[kind] if kind in tables else empty(spark, kind)


# ---- parent and child -----------------------------------------------------------------------


def parentchild_scores(processes: DataFrame, exclude_pids: tuple[int, ...] = ()) -> DataFrame:
    """Every process with its parent's name, weight, reasons and mitre."""
    parents = joins.prefixed(joins.last_by_key(processes, "pid").select("pid", "image"), "parent_")
    rows = processes.filter(~F.col("pid").isin(*exclude_pids)) if exclude_pids else processes
    rows = rows.join(parents, F.col("ppid") == F.col("parent_pid"), "left")
    rows = rows.withColumn("name", t.ascii_lower(t.base_name(F.col("image")))).withColumn("parent_name", t.ascii_lower(t.base_name(F.col("parent_image"))))
    name, parent, cmd = F.col("name"), F.col("parent_name"), F.coalesce("cmdline", F.lit(""))
    masked = t.masquerade(F.col("image"))
    office = parent.isin(*OFFICE_PARENTS) & name.isin(*SHELL_CHILDREN)
    script = parent.isin(*SCRIPT_PARENTS) & name.isin(*REAL_SHELLS)
    encoded = t.encoded_powershell(name, cmd)
    lolbas = name.isin(*LOLBAS) & t.lolbas_arguments(cmd)
    combo = F.coalesce(masked, F.lit(False)) | F.coalesce(office, F.lit(False)) | F.coalesce(script, F.lit(False)) | encoded | lolbas
    unsigned = combo & (F.col("signed") == False)  # noqa: E712  null is not false
    return scored(rows, [
        Signal(masked, 60, F.concat(F.lit("bears the name of a system program but lies elsewhere: "), F.col("image")), "T1036.005"),
        Signal(office, 50, F.concat(F.lit("Office program "), parent, F.lit(" started "), name), "T1059"),
        Signal(script, 30, F.concat(F.lit("script host "), parent, F.lit(" started "), name), "T1059"),
        Signal(encoded, 40, F.lit("encoded PowerShell command"), "T1059.001"),
        Signal(lolbas, 30, F.concat(name, F.lit(" with suspicious arguments")), "T1218"),
        Signal(combo & t.suspicious_path(F.col("image")), 25, F.concat(F.lit("runs from a suspicious path: "), F.col("image")), "T1036"),
        Signal(unsigned, 20, F.lit("binary is unsigned")),
        Signal(unsigned & F.col("integrity").isin("high", "system"), 15, F.lit("unsigned binary at high integrity"), "T1068"),
    ])


def parentchild(tables: Tables, prior: DataFrame | None, p: Params, spark: SparkSession) -> DataFrame:
    rows = parentchild_scores(records(tables, "process", spark), p.exclude_pids)
    rows = checkpointed(rows.withColumn("rank", v.severity_rank(F.col("weight"))).filter("rank is not null"))  # texts are built for these alone
    name = t.base_name(F.col("image"))
    command = F.when(F.coalesce("cmdline", F.lit("")) != "", F.concat(F.lit(", cmd="), F.col("cmdline"))).otherwise("")
    return findings(
        rows, "heur_parentchild", p.now, severity=severity_of(F.col("rank")), title=F.concat(F.lit("Unusual start of "), name), artifact="process",
        ts=F.coalesce("start_time", p.now), mitre=F.col("mitre"), reason=F.array_join("reasons", "; "), entity=entity(process=process_entity()),
        details=F.concat(name, F.lit(" (pid="), F.col("pid"), F.lit(", parent="), F.col("ppid"), command, F.lit(")")),
    )


# ---- persistence ----------------------------------------------------------------------------


def invoked_name(binary_path: Column, command: Column) -> Column:
    """The base name of what a persistence entry runs."""
    first = F.element_at(F.split(F.trim(F.btrim(F.trim(command), F.lit('"'))), r"\s+"), 1)
    return t.ascii_lower(t.short_name(F.coalesce(binary_path, first)))


def persist_hits(entries: DataFrame, p: Params) -> DataFrame:
    """Every entry with its hits: the array of dispositive signals that hold."""
    mech, cmd, path = F.col("mechanism"), F.col("command"), F.coalesce("binary_path", F.lit(""))
    low, content = t.ascii_lower(cmd), F.coalesce("command", F.lit(""))
    unsigned = F.coalesce(F.col("signed") == False, F.lit(False))  # noqa: E712
    untrusted = unsigned | t.user_writable(path)
    script = t.contains_any(content, WMI_MARKS) | t.contains_any(t.ascii_lower(content), WEB)
    placed = mech != "startup"
    fresh = F.coalesce(v.within_days(F.col("last_write"), p.now, p.recent_persist_days), F.lit(False))
    invoked = invoked_name(F.col("binary_path"), cmd)
    loud = t.contains_any(low, (" -enc", " -encodedcommand", "frombase64string", *WEB))
    runs_script = cmd.isNotNull() & invoked.isin(*INTERPRETERS)
    shown = F.coalesce("command", F.lit("-"))
    return gated(entries, [
        Hit(F.when((mech == "winlogon") & ~t.winlogon_default(F.col("value"), cmd), 3), "Winlogon value changed", F.concat(F.lit("Winlogon "), F.coalesce("value", F.lit("?")), F.lit(" is not the stock value: "), shown), "T1547.004"),
        Hit(F.when(mech == "ifeo", F.when(untrusted, 3).otherwise(2)), "IFEO debugger", F.concat(F.lit("IFEO debugger set ("), F.col("location"), F.lit(")"), F.when(untrusted, "; unsigned or in a user-writable path").otherwise("; signed, system or vendor path")), "T1546.012"),
        Hit(F.when((mech == "wmi_subscription") & F.col("binary_path").isNull(), F.when(script, 3).otherwise(2)), "WMI event script", F.concat(F.lit("WMI event subscription runs an inline script"), F.when(script, " with dynamic or remote content").otherwise(""), F.lit(": "), content), "T1546.003"),
        Hit(F.when(placed & unsigned & t.user_writable(path), 3), "Unsigned binary in a user-writable path", F.concat(F.lit("unsigned binary in a user-writable path: "), path), "T1036"),
        Hit(F.when(placed & t.masquerade(path), 3), "System name elsewhere", F.concat(F.lit("bears the name of a system program but lies elsewhere: "), path), "T1036.005"),
        Hit(F.when(placed & F.col("signed").isNull() & (path != "") & ~t.system_or_program_files(path) & fresh, 2), "New and unverifiable", F.concat(F.lit("written within "), F.lit(p.recent_persist_days), F.lit(" days, signature unverifiable, outside system paths: "), path), "T1547"),
        Hit(F.when(runs_script, F.when(loud, 3).when(t.contains_any(low, SCRIPT_EXTENSIONS), 1)), F.when(loud, "Interpreter with encoded or remote content").otherwise("Script file"), F.concat(F.lit("runs "), invoked, F.lit(": "), shown), "T1059"),
    ])


def persist_details() -> Column:
    where = F.coalesce(F.nullif("binary_path", F.lit("")), F.col("location"))
    signed = F.when(F.col("signed"), F.concat(F.lit("signed"), F.coalesce(F.concat(F.lit(" ("), F.col("signer"), F.lit(")")), F.lit("")))).when(~F.col("signed"), "unsigned").otherwise("signature unverifiable")
    value = F.coalesce(F.concat(F.lit(" -> "), F.col("value")), F.lit(""))
    return F.concat(where, F.lit(" | "), F.col("mechanism"), F.lit(": "), F.col("location"), value, F.lit(" | "), signed, F.lit(" | last_write="), F.coalesce(F.date_format("last_write", "yyyy-MM-dd"), F.lit("unknown")))


def persist_ranked(tables: Tables, p: Params, spark: SparkSession) -> DataFrame:
    """Entries with hits, how many executions and processes corroborate them and under which key, and the final rank.

    Programs of one name have one list of runs, so entries hold its key and size: entries times runs would
    grow with the square of the tables.
    """
    # The few entries with a hit are kept before texts are built and both joins look at them: one plan of
    # all that is too large to be compiled, and would compute the signals several times.
    entries = checkpointed(persist_hits(records(tables, "persistence", spark), p).filter(F.size("hits") > 0))
    key = F.coalesce("binary_path", "command", F.lit(""))
    runs = records(tables, "execution", spark)
    processes = records(tables, "process", spark)
    proc = F.struct("pid", "ppid", "image", "cmdline", "signed", "integrity", "start_time")
    n = F.count(F.lit(1))
    entries = entries.join(joins.two_tier_join(entries, "_ord", key, runs, "path", matched="runs_key", runs=n).withColumnRenamed("degraded", "runs_degraded"), "_ord", "left")
    matches = joins.two_tier_join(entries, "_ord", key, processes, "image", matched="procs_key", procs=n, first_proc=F.min(F.struct(F.col("_ord").alias("o"), proc.alias("p")))["p"])
    entries = checkpointed(entries.join(matches.withColumnRenamed("degraded", "procs_degraded"), "_ord", "left"))
    found = F.col("runs").isNotNull() | F.col("procs").isNotNull()
    degraded = F.coalesce("runs_degraded", F.lit(False)) | F.coalesce("procs_degraded", F.lit(False))
    base = F.array_max(F.transform("hits", lambda h: h["rank"]))
    several = F.size("hits") >= 2
    final = F.when(several, v.escalated(base)).otherwise(base)
    return entries.withColumns({"corroborated": found, "degraded": degraded, "rank": F.when(found, v.escalated(final)).otherwise(final)})


def persist_entity() -> Column:
    mech = F.col("mechanism")
    file = F.struct(F.coalesce("binary_path", "location").alias("path"), F.col("binary_sha256"), F.col("last_write").alias("mtime"), *(F.lit(None).cast("timestamp") for _ in range(4)), F.lit(None).cast("boolean"))
    hive = F.when(mech == "wmi_subscription", "WMI").otherwise(t.hive_prefix(F.col("location")))
    registry = F.struct(hive.alias("hive"), F.col("location").alias("key"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("command", F.lit("")).alias("data"), "last_write")
    first = F.col("first_proc")
    process = F.when(F.col("procs").isNotNull(), F.struct(*(first[c].alias(c) for c in ("pid", "ppid", "image", "cmdline", "signed", "integrity"))))
    return entity(process=process, file=F.when(mech == "startup", file), registry=F.when(mech != "startup", registry))


def persist(tables: Tables, prior: DataFrame | None, p: Params, spark: SparkSession) -> DataFrame:
    return persist_found(tables, None, p, spark).whole()


def persist_found(tables: Tables, prior: Found | None, p: Params, spark: SparkSession) -> Found:
    rows = persist_ranked(tables, p, spark)
    own = F.array(evidence(F.col("mechanism"), F.col("binary_path"), F.col("last_write"), F.concat(F.col("location"), F.lit(": "), F.coalesce("value", F.lit("-")), F.lit(" = "), F.coalesce("command", F.lit("-")))))
    run = evidence(F.col("source"), F.col("path"), F.coalesce("last_run", "first_run"), F.concat(F.col("source"), F.lit(": run_count="), F.coalesce(F.col("run_count").cast("string"), F.lit("?")), F.lit(" last_run="), F.coalesce(v.rfc3339(F.col("last_run")), F.lit("unknown"))))
    proc = evidence(F.lit("process"), F.col("image"), F.col("start_time"), F.concat(F.lit("running pid="), F.col("pid").cast("string"), F.lit(" image="), F.col("image")))
    runs = joins.lists_by_key(records(tables, "execution", spark), "path", rows.select("runs_key").filter("runs_key is not null"), run)
    procs = joins.lists_by_key(records(tables, "process", spark), "image", rows.select("procs_key").filter("procs_key is not null"), proc)
    tagged = lambda kind, key: F.concat(F.lit(kind + "/"), F.col(key))
    lists = runs.withColumn("key", tagged("run", "key")).unionByName(procs.withColumn("key", tagged("process", "key")))
    named = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(tagged(kind, c + "_key").alias("key"), F.col(c).alias("n")))
    reasons = F.array_compact(F.flatten(F.array(F.transform("hits", lambda h: h["reason"]), F.array(
        F.when(F.size("hits") >= 2, F.concat(F.size("hits").cast("string"), F.lit(" independent signals: escalated"))),
        F.when(F.col("corroborated"), F.concat(F.lit("corroborated by execution or a running process: escalated"), F.when(F.col("degraded"), " (by file name only)").otherwise(""))),
        F.lit(PERSIST_MARKER),
    ))))
    shown = t.short_name(F.coalesce("binary_path", "command", "location"))
    found = findings(
        rows, "heur_persist", p.now, severity=severity_of(F.col("rank")), title=F.concat(top_hit(F.col("hits"))["label"], F.lit(": "), shown), artifact="persistence",
        ts=F.coalesce("last_write", p.now), mitre=F.array_distinct(F.transform("hits", lambda h: h["tag"])), reason=F.array_join(reasons, "; "), details=persist_details(),
        entity=persist_entity(), evidence=own.cast(EVIDENCE), shared=F.array_compact(F.array(named("run", "runs"), named("process", "procs"))),
    )
    return Found(found, lists)


def persist_observations(tables: Tables, p: Params, spark: SparkSession) -> DataFrame:
    """Entries without a hit: the inventory."""
    rows = persist_hits(records(tables, "persistence", spark), p).filter(F.size("hits") == 0)
    shown = t.short_name(F.coalesce("binary_path", "command", "location"))
    return rows.select(
        F.lit(OBSERVATION_SCHEMA).alias("schema"), F.coalesce("last_write", p.now).alias("ts"), F.lit(p.host).alias("host"),
        F.when(F.col("mechanism") == "winlogon", "winlogon_default").otherwise(F.col("mechanism")).alias("category"),
        F.concat(F.col("mechanism"), F.lit(": "), shown).alias("title"), F.col("binary_path").alias("path"), persist_details().alias("details"), F.lit("persistence").alias("source_artifact"),
    )


# ---- network connections --------------------------------------------------------------------


def evidence_names(prior: DataFrame | Found) -> DataFrame:
    """(base): the base names in the evidence of persistence findings, each once.  One is enough: an equal path implies it."""
    found = prior if isinstance(prior, Found) else Found.of(prior)
    marked = found.rows.filter(F.contains("reason", F.lit(PERSIST_MARKER)))
    seen = marked.select(F.explode("evidence.path").alias("path"))
    if found.lists is not None:  # a list counts once, however many findings name it
        keys = marked.select(F.explode("shared.key").alias("key")).distinct()
        seen = seen.unionAll(found.lists.join(keys, "key", "left_semi").select(F.explode("items.path").alias("path")))
    seen = seen.filter("path is not null")
    return checkpointed(seen.select(t.ascii_lower(t.short_name(F.col("path"))).alias("base")).filter("base <> ''").distinct())


def netconn_scores(connections: DataFrame, processes: DataFrame, prior: DataFrame | Found | None, exclude_pids: tuple[int, ...] = ()) -> DataFrame:
    """Every connection with its owner, weight, reasons and mitre; prior: findings of the persistence analyzer."""
    rows, signals = netconn_weighed(connections, processes, prior, exclude_pids)
    return told(rows, signals)


def netconn_weighed(connections: DataFrame, processes: DataFrame, prior: DataFrame | Found | None, exclude_pids: tuple[int, ...] = ()) -> tuple[DataFrame, list[Signal]]:
    """Every connection with its owner, the signals that fire (as bits) and its weight; and the signals."""
    rows = connections.filter(F.col("pid").isNull() | ~F.col("pid").isin(*exclude_pids)) if exclude_pids else connections
    owners = joins.prefixed(joins.last_by_key(processes, "pid").select("pid", "ppid", "image", "cmdline", "signed", "integrity"), "o_").withColumn("base", t.ascii_lower(t.base_name(F.col("o_image"))))
    # Looked up once an owner: connections are many more and are shuffled once.
    owners = owners.withColumn("corroborated", F.lit(False)) if prior is None else joins.exists_flag(owners, evidence_names(prior), "base", "corroborated")
    rows = rows.join(owners, F.col("pid") == F.col("o_pid"), "left").withColumn("corroborated", F.coalesce("corroborated", F.lit(False)))
    rare = F.coalesce((F.col("rport") != 0) & v.rare_port(F.col("rport")), F.lit(False))
    public = v.public_ipv4(F.col("raddr")) & rare
    placed, unsigned = t.suspicious_path(F.col("o_image")), F.col("o_signed") == False  # noqa: E712
    placed, unsigned = F.coalesce(placed, F.lit(False)), F.coalesce(unsigned, F.lit(False))
    signals = [
        Signal(public, 25, F.concat(F.lit("public address "), F.col("raddr"), F.lit(" on an uncommon port"))),
        Signal(rare, 20, F.concat(F.lit("uncommon remote port "), F.col("rport"))),
        Signal(placed & unsigned, 50, F.concat(F.lit("owner is unsigned and runs from a suspicious path: "), F.col("o_image")), "T1036"),
        Signal(placed & ~unsigned, 30, F.concat(F.lit("owner runs from a suspicious path: "), F.col("o_image"))),
        Signal(~placed & unsigned & rare, 20, F.lit("owner is unsigned")),
        Signal((F.col("state") == "listen") & (F.col("lport") > 1024) & unsigned & placed, 25, F.concat(F.lit("unsigned program listens on port "), F.col("lport"))),
        Signal(F.col("corroborated") & F.col("o_pid").isNotNull(), 30, F.lit("owner is also a persistence finding"), "T1547"),
    ]
    return weighed(rows, signals), signals


def netconn(tables: Tables, prior: DataFrame | None, p: Params, spark: SparkSession) -> DataFrame:
    return netconn_found(tables, None if prior is None else Found.of(prior), p, spark).whole()


def netconn_found(tables: Tables, prior: Found | None, p: Params, spark: SparkSession) -> Found:
    """Rows are kept with the bits of their signals, and texts are made from them when they are asked for."""
    rows, signals = netconn_weighed(records(tables, "net_conn", spark), records(tables, "process", spark), prior, p.exclude_pids)
    kept = ("laddr", "lport", "raddr", "rport", "pid", "o_pid", "o_ppid", "o_image", "o_cmdline", "o_signed", "o_integrity", "_fired", "weight")
    rows, folder = stored(rows.filter("weight >= 50").select(*kept))
    rows = told(rows, signals).withColumn("rank", v.severity_rank(F.col("weight")))
    target = F.concat(F.coalesce("raddr", F.lit("-")), F.lit(":"), F.coalesce(F.col("rport").cast("string"), F.lit("-")))
    owner = F.when(F.col("o_pid").isNotNull(), process_entity("o_"))
    conn = F.struct("laddr", "lport", "raddr", "rport", "pid")
    found = findings(
        rows, "heur_netconn", p.now, severity=severity_of(F.col("rank")), title=F.concat(F.lit("Suspicious connection: "), t.base_name(F.col("o_image"))), artifact="netconn",
        mitre=F.col("mitre"), reason=F.array_join("reasons", "; "), entity=entity(process=owner, netconn=conn), details=F.concat(t.base_name(F.col("o_image")), F.lit(" -> "), target),
    )
    return replace(Found.of(found), folders=(folder,))


# ---- time-window correlation ----------------------------------------------------------------


def temporal(tables: Tables, prior: DataFrame | None, p: Params, spark: SparkSession) -> DataFrame:
    return temporal_found(tables, None if prior is None else Found.of(prior), p, spark).whole()


def temporal_found(tables: Tables, prior: Found | None, p: Params, spark: SparkSession) -> Found:
    """Earlier findings on a process that started shortly before file changes, or that has connections.

    Findings on one process have its file changes and connections in common, as two lists.
    """
    if prior is None:
        return Found.of(findings(empty(spark, "process"), "heur_temporal", p.now, severity="info", title=""))
    prior = prior.rows
    started = joins.last_by_key(records(tables, "process", spark), "pid").select(F.col("pid").alias("_pid"), F.col("start_time").alias("_start")).filter("_start is not null")
    rows = prior.filter("entity.process is not null").join(started, F.col("entity.process.pid") == F.col("_pid"))
    usn = records(tables, "usn_event", spark).select(F.col("ts").alias("_uts"), F.col("path").alias("_upath"), "reason", F.col("_ord").alias("_uord")).withColumnRenamed("reason", "_ureason")
    # Findings of one process share its window, so the range join runs once a process.
    pids = rows.select("_pid", "_start").distinct()
    near = joins.range_join(pids, "_start", usn, "_uts", p.temporal_us)
    w = Window.partitionBy("_pid")
    newest = near.withColumn("_n", F.row_number().over(w.orderBy(F.col("_uts").desc(), "_uord"))).filter(F.col("_n") <= p.temporal_evidence)
    counts = near.groupBy("_pid").agg(F.count(F.lit(1)).alias("_total"))
    item = evidence(F.lit("usn_temporal"), F.col("_upath"), F.col("_uts"), F.concat(F.lit("file change in the window, no proof of cause: "), F.col("_ureason"), F.lit(" "), F.col("_upath")))
    changes = newest.groupBy("_pid").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", item.alias("e")))), lambda x: x["e"]).alias("_changes")).join(counts, "_pid")
    more = F.when(F.col("_total") > p.temporal_evidence, F.array(evidence(F.lit("usn_temporal_summary"), F.lit(None), F.lit(None), F.concat(F.col("_total").cast("string"), F.lit(" file changes in the window, the newest "), F.lit(str(p.temporal_evidence)), F.lit(" attached"))))).otherwise(F.array().cast(EVIDENCE))
    tagged = lambda kind: F.concat(F.lit(kind + "/"), F.col("_pid").cast("string"))
    changes = changes.select(tagged("change").alias("key"), F.concat(F.col("_changes").cast(EVIDENCE), more.cast(EVIDENCE)).alias("items"))
    conns = records(tables, "net_conn", spark).filter("pid is not null")
    link = evidence(F.lit("netconn_temporal"), F.lit(None), F.lit(None), F.concat(F.lit("has a connection now: "), F.coalesce("raddr", F.lit("")), F.lit(":"), F.coalesce(F.col("rport").cast("string"), F.lit("")), F.lit(" state="), F.coalesce("state", F.lit(""))))
    links = conns.join(pids.select(F.col("_pid").alias("pid")), "pid", "left_semi").groupBy(F.col("pid").alias("_pid"))
    open_now = links.agg(F.count(F.lit(1)).alias("_open"))
    links = links.agg(F.transform(F.sort_array(F.collect_list(F.struct("_ord", link.alias("e")))), lambda x: x["e"]).alias("_links")).select(tagged("connection").alias("key"), F.col("_links").cast(EVIDENCE).alias("items"))
    rows = rows.join(counts.join(open_now, "_pid", "full"), "_pid")
    listed = F.least("_total", F.lit(p.temporal_evidence)) + F.when(F.col("_total") > p.temporal_evidence, 1).otherwise(0)
    named = lambda kind, c, n: F.when(F.col(c).isNotNull(), F.struct(tagged(kind).alias("key"), n.cast("bigint").alias("n")))
    found = findings(
        rows, "heur_temporal", p.now, severity=severity_of(v.escalated(rank(F.col("severity")))), title=F.concat(F.lit("Time-window correlation: "), F.col("entity.process.image")), artifact="temporal_window",
        ts=F.col("_start"), mitre=F.col("mitre"), entity=entity(process=F.col("entity.process")), reason=F.concat(F.lit("corroborated within the time window: escalated (source finding: "), F.col("title"), F.lit(")")),
        shared=F.array_compact(F.array(named("change", "_total", listed), named("connection", "_open", F.col("_open")))), details=F.col("id"),
    )
    return Found(found, changes.unionByName(links))


# ---- running programs against execution artifacts ------------------------------------------


def live_exec_signals(processes: DataFrame, executions: DataFrame, p: Params) -> DataFrame:
    """Every process with signal 'a' (no artifact), 'b' (unsigned and first seen lately) or null, and its first run."""
    known = F.when(F.col("first_run").isNotNull(), F.col("source"))
    found = joins.two_tier_join(processes, "_ord", F.col("image"), executions, "path", first_run=F.min("first_run"), first_source=F.min_by(known, F.when(known.isNotNull(), F.struct("first_run", "_ord"))))
    rows = processes.join(found, "_ord", "left")
    fresh = v.within_days(F.col("first_run"), p.now, p.recent_first_run_days) & (F.col("signed") == False)  # noqa: E712
    return rows.withColumn("signal", F.when(F.col("degraded").isNull(), "a").when(fresh, "b"))


def live_exec(tables: Tables, prior: DataFrame | None, p: Params, spark: SparkSession) -> DataFrame:
    rows = live_exec_signals(records(tables, "process", spark), records(tables, "execution", spark), p).filter("signal is not null")
    absent = F.col("signal") == "a"
    name = t.base_name(F.col("image"))
    return findings(
        rows, "heur_live_exec", p.now, severity="high", artifact=F.when(absent, "no_execution_artifact").otherwise(F.col("first_source")), ts=F.coalesce("start_time", p.now),
        title=F.concat(F.when(absent, "Running without an execution artifact: ").otherwise("Running unsigned and first seen lately: "), name), entity=entity(process=process_entity()),
        mitre=F.when(absent, F.array().cast("array<string>")).otherwise(F.array(F.lit("T1036"))), details=F.concat(F.lit("pid="), F.col("pid"), F.lit(" image="), F.col("image")),
        reason=F.when(absent, F.concat(F.col("image"), F.lit(" runs but no artifact records it; artifacts have gaps, so this proves nothing by itself"))).otherwise(F.concat(F.col("image"), F.lit(" is unsigned and first seen "), v.rfc3339(F.col("first_run")))),
    )


# ---- file times -----------------------------------------------------------------------------


def timestomp_deltas(files: DataFrame, threshold_us: int) -> DataFrame:
    """Files whose $FILE_NAME times lie more than the threshold after their standard ones."""
    gap = lambda a, b: F.unix_micros(a) - F.unix_micros(b)
    birth, change = gap("fn_btime", "si_btime"), gap("fn_mtime", "si_mtime")
    rows = files.withColumn("birth_us", F.when(birth > threshold_us, birth)).withColumn("change_us", F.when(change > threshold_us, change))
    return rows.withColumn("delta_us", F.greatest("birth_us", "change_us")).filter("delta_us is not null").withColumn("rank", v.timestomp_rank(F.col("delta_us")))


def timestomp(tables: Tables, prior: DataFrame | None, p: Params, spark: SparkSession) -> DataFrame:
    rows = timestomp_deltas(records(tables, "file_meta", spark), p.timestomp_us)
    axes = F.array_join(F.array_compact(F.array(
        F.when(F.col("birth_us").isNotNull(), F.concat(F.lit("birth +"), v.humanized(F.col("birth_us")))), F.when(F.col("change_us").isNotNull(), F.concat(F.lit("change +"), v.humanized(F.col("change_us")))),
    )), ", ")
    ts = F.coalesce("fn_btime", "fn_mtime")
    file = F.struct("path", "sha256", F.col("si_mtime").alias("mtime"), "si_btime", "fn_btime", "si_mtime", "fn_mtime", "path_complete")
    return findings(
        rows, "heur_timestomp", p.now, severity=severity_of(F.col("rank")), title="File times set back against $FILE_NAME", artifact="file_meta", ts=ts, mitre=F.array(F.lit("T1070.006")),
        entity=entity(file=file), details=F.concat(F.lit("path="), F.col("path"), F.lit(" "), axes), reason=F.concat(F.lit("$FILE_NAME is later than the standard times: "), axes),
        evidence=F.array(evidence(F.lit("mft"), F.col("path"), ts, axes)).cast(EVIDENCE),
    )


# ---- accounts and logons --------------------------------------------------------------------


def account_events(events: DataFrame, p: Params) -> DataFrame:
    """Account changes with their subject, target, group and whether they are recent."""
    rows = events.filter((F.col("channel") == "Security") & F.col("event_id").isin(*ACCOUNT_EVENTS))
    grouped = F.col("event_id").isin(4732, 4728)
    member, target = t.data_or_dash(F.col("data"), "MemberName"), t.data_or_dash(F.col("data"), "TargetUserName")
    kind, tag = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, technique) in ACCOUNT_EVENTS.items():
        kind, tag = F.when(F.col("event_id") == k, name).otherwise(kind), F.when(F.col("event_id") == k, technique).otherwise(tag)
    return rows.withColumns({
        "kind": kind, "tag": tag, "target": F.when(grouped, member).otherwise(target), "group": F.when(grouped, target), "subject": t.data_or_dash(F.col("data"), "SubjectUserName"),
        "recent": F.coalesce(v.within_days(F.col("ts"), p.now, p.recent_account_days), F.lit(False)),
    })


def account(tables: Tables, prior: DataFrame | None, p: Params, spark: SparkSession) -> DataFrame:
    rows = account_events(records(tables, "event", spark), p)
    to = F.coalesce(F.concat(F.lit(" to "), F.col("group")), F.lit(""))
    text = F.concat(F.col("target"), F.lit(" "), F.col("kind"), to, F.lit(" by "), F.col("subject"), F.lit(" at "), v.rfc3339(F.col("ts")))
    return findings(
        rows, "heur_account", p.now, severity=F.when(F.col("recent"), "high").otherwise("medium"), title=F.concat(F.lit("Account "), F.col("kind"), F.lit(": "), F.col("target"), to), artifact="account", ts=F.col("ts"),
        mitre=F.array("tag"), details=text, reason=F.concat(F.lit("account change "), v.age_days(F.col("ts"), p.now).cast("string"), F.lit(" days ago")), event_id=F.col("event_id"),
        evidence=F.array(evidence(F.lit("evtx:Security"), F.lit(None), F.col("ts"), F.concat(F.lit("EID "), F.col("event_id"), F.lit(": target="), F.col("target"), F.lit(" subject="), F.col("subject")))).cast(EVIDENCE),
    )


def _attempt_evidence() -> Column:
    return evidence(F.lit("evtx:Security"), F.lit(None), F.col("ts"), F.concat(F.when(F.col("success"), "4624 success").otherwise("4625 failure"), F.lit(": target="), F.col("user"), F.lit(" source="), F.col("source")))


def logon_bruteforce(tables: Tables, prior: DataFrame | None, p: Params, spark: SparkSession) -> DataFrame:
    rows = windows.attempts(records(tables, "event", spark))
    item = F.struct("ts", "_ord", _attempt_evidence().alias("e"))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["e"])
    brute = windows.bruteforce_windows(rows, p.bruteforce_us, p.bruteforce_failures)
    own = rows.join(brute.select("user", "source"), ["user", "source"], "left_semi").groupBy("user", "source").agg(listed(item).alias("seen"))
    brute = brute.join(own, ["user", "source"])
    first = findings(
        brute, "heur_logon_bruteforce", p.now, severity=F.when(F.col("hit_success"), "high").otherwise("medium"), title=F.concat(F.lit("Brute-force logon: "), F.col("user"), F.lit(" from "), F.col("source")), artifact="logon_bruteforce",
        ts=F.col("last_ts"), mitre=F.array(F.lit("T1110.001")), user=F.col("user"), details=F.concat(F.col("failures").cast("string"), F.lit(" failures for "), F.col("user"), F.lit(" from "), F.col("source")),
        reason=F.concat(F.col("failures").cast("string"), F.lit(" failures in a window"), F.when(F.col("hit_success"), ", with a success").otherwise(", without a success")), evidence=F.col("seen").cast(EVIDENCE),
    )
    spray = windows.spraying_windows(rows, p.spraying_us, p.spraying_accounts)
    inside = rows.join(spray.select("source", "best_us"), "source").filter(F.col("us").between(F.col("best_us"), F.col("best_us") + p.spraying_us))
    spray = spray.join(inside.groupBy("source").agg(listed(item).alias("seen")), "source")
    second = findings(
        spray, "heur_logon_bruteforce", p.now, severity=F.when(F.col("hit_success"), "high").otherwise("medium"), title=F.concat(F.lit("Password spraying: "), F.col("source")), artifact="logon_bruteforce",
        ts=F.col("last_ts"), mitre=F.array(F.lit("T1110.003")), details=F.concat(F.col("accounts").cast("string"), F.lit(" accounts tried from "), F.col("source")),
        reason=F.concat(F.col("accounts").cast("string"), F.lit(" distinct accounts in a window"), F.when(F.col("hit_success"), ", with a success").otherwise(", without a success")), evidence=F.col("seen").cast(EVIDENCE),
    )
    return first.unionByName(second)


# ---- vulnerable drivers ---------------------------------------------------------------------


def byovd_matches(executions: DataFrame, hashes: DataFrame) -> DataFrame:
    """Driver inventory rows whose hash is listed; a null hash never matches."""
    return executions.filter(F.col("source") == "amcache_driver").join(hashes.select("sha1").distinct(), "sha1", "left_semi")


def byovd(tables: Tables, prior: DataFrame | None, p: Params, spark: SparkSession) -> DataFrame:
    hashes = spark.createDataFrame([(h,) for h in p.driver_hashes], "sha1 STRING")
    rows = byovd_matches(records(tables, "execution", spark), hashes)
    ts = F.coalesce("last_run", "first_run", p.now)
    return findings(
        rows, "heur_byovd", p.now, severity="high", title=F.concat(F.lit("Known vulnerable driver: "), t.base_name(F.col("path"))), artifact="amcache_driver", ts=ts, mitre=F.array(F.lit("T1068"), F.lit("T1211")),
        details=F.concat(F.col("path"), F.lit(" sha1="), F.col("sha1")), reason=F.lit("the driver's SHA-1 is on the list of known vulnerable drivers"),
        entity=entity(file=F.struct("path", F.lit(None).cast("string"), *(F.lit(None).cast("timestamp") for _ in range(5)), F.lit(None).cast("boolean"))),
        evidence=F.array(evidence(F.lit("amcache_driver"), F.col("path"), ts, F.concat(F.lit("sha1="), F.col("sha1")))).cast(EVIDENCE),
    )
