"""The registered queries of the triage engine and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import adapters
from .functions import text as t
from .functions import values as v
from .operators import joins, windows
from .plans import analyzers as a
from .plans import pipeline, sigma
from .schema import rank, severity_of
from .sinks import panels, timeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PARAMS = a.Params(as_of=datetime(2024, 2, 1), bruteforce_us=72 * 3_600_000_000, bruteforce_failures=3, spraying_us=12 * 3_600_000_000, spraying_accounts=2, recent_persist_days=7, driver_hashes=tuple(f"{i:040d}" for i in range(0, 100, 3)))
NOW = "timestamp '2024-02-01 00:00:00'"


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its SQL sees the adapter views named."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ctes = ", ".join(f"{k} AS ({adapters.oracle(k)})" for k in views.split())
            body = sql.strip()
            start = next((k for k in ("WITH RECURSIVE ", "WITH ") if body.startswith(k)), "")
            SQL[name] = f"{start or 'WITH '}{ctes}{', ' * bool(start) or ' '}{body[len(start):]}" if ctes else body
        return f

    return add


# SQL of shared predicates.
def _base(x: str) -> str:
    return rf"regexp_extract({x}, '[^\\/]*$')"


def _has(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _in(x: str, words: tuple) -> str:
    return f"{x} IN (" + ", ".join(f"'{w}'" if isinstance(w, str) else str(w) for w in words) + ")"


def _susp(x: str) -> str:
    return _has(f"lower({x})", t.SUSPICIOUS_DIRS)


def _masq(x: str) -> str:
    return rf"(substr({x}, 2, 2) = ':\' AND substr(lower({x}), 2, 10) <> ':\windows\' AND {_in(f'lower({_base(x)})', t.PROTECTED_NAMES)})"


def _join_key(x: str) -> str:
    n = f"lower(trim(trim({x}), '\"'))"
    return rf"CASE WHEN contains({n}, '\') OR contains({n}, '/') THEN 'p:' || {n} ELSE 'n:' || regexp_replace({n}, '\.exe$', '') END"


def _degraded(x: str) -> str:
    return rf"'n:' || regexp_replace(regexp_extract(lower(trim(trim({x}), '\"')), '[^\\/]*$'), '\.exe$', '')"


_SEV = "CASE {r} WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END"
_B64 = "regexp_matches({x}, '[A-Za-z0-9+/=]{{16}}')"


# ---- Sigma ----------------------------------------------------------------------------------


def _rule(detection: dict, **source: str) -> sigma.Rule:
    return sigma.parse_rule({"id": "r", "title": "r", "level": "high", "logsource": source, "detection": detection})


def _sigma(spark: SparkSession, d: str, *rules: sigma.Rule) -> DataFrame:
    return sigma.match(adapters.event(spark, d), list(rules)).select("record_id", "event_id", F.col("rule.id").alias("rule_id"))


@query("sigma_contains_all", "event_flat", "SELECT record_id, event_id, 'r' AS rule_id FROM event_flat WHERE channel = 'Security' AND contains(lower(cmdline), '-p3') AND contains(lower(cmdline), ' -run ')")
def _(s, d):
    return _sigma(s, d, _rule({"selection": {"CommandLine|contains|all": ["-P3", " -run "]}, "condition": "selection"}, service="security"))


@query("sigma_one_of_not_filter", "event_flat", r"SELECT record_id, event_id, 'r' AS rule_id FROM event_flat WHERE channel IN ('Security', 'System') AND (ends_with(lower(image), '\view.exe') OR event_id = 7045) AND NOT (starts_with(lower(target_user), 'u1') OR ip = '-')")
def _(s, d):
    rule = {"selection_a": {"Image|endswith": "\\view.exe"}, "selection_b": {"CommandLine|startswith": "click"}, "filter_a": {"TargetUserName": "U1*"}, "filter_b": {"IpAddress": "-"}, "condition": "1 of selection_* and not 1 of filter_*"}
    return _sigma(s, d, _rule(rule, product="linux"))


@query("sigma_keywords", "event_flat", "SELECT record_id, event_id, 'r' AS rule_id FROM event_flat WHERE channel = 'Security' AND (contains(lower(cmdline), 'error.exe -p1') OR contains(target_user, 'u77') OR contains(lower(cmdline), 'signup.exe -p2') OR contains(lower(image), 'u77'))")
def _(s, d):
    return _sigma(s, d, _rule({"keywords": ["ERROR.exe -p1", "u77", "signup.exe -p2"], "condition": "keywords"}, service="security"))


@query("sigma_gate_failopen", "event_flat", "SELECT channel, count(*) AS n FROM event_flat WHERE regexp_full_match(lower(cmdline), '.*-p[0-4].*quiet.*') GROUP BY 1")
def _(s, d):
    rule = _rule({"selection": {"CommandLine|re": "-p[0-4].*quiet"}, "condition": "selection"}, service="unheard-of")
    return sigma.match(adapters.event(s, d), [rule]).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("sigma_wildcard_numeric", "event_flat", "SELECT record_id, event_id, 'r' AS rule_id FROM event_flat WHERE channel = 'Security' AND regexp_full_match(lower(cmdline), 'v.ew.*-p[0-9] .*') AND regexp_matches(ip, '^10[.]0[.]0[.][4-7]$')")
def _(s, d):
    return _sigma(s, d, _rule({"selection": {"CommandLine": "v?ew*-p? *", "IpAddress|cidr": "10.0.0.4/30"}, "condition": "selection"}, service="security"))


_THREE = "SELECT record_id, 'a' AS rule_id FROM event_flat WHERE channel = 'Security' AND event_id = 4625 UNION ALL SELECT record_id, 'b' FROM event_flat WHERE channel = 'System' AND contains(lower(cmdline), ' -run ') UNION ALL SELECT record_id, 'c' FROM event_flat WHERE channel = 'Security' AND target_user IN ('u1', 'u2', 'u3')"


@query("sigma_fused_counts", "event_flat", f"WITH m AS ({_THREE}) SELECT rule_id, count(*) AS n, min(record_id) AS first_record FROM m GROUP BY 1")
def _(s, d):
    def rule(i: str, service: str, body: dict) -> sigma.Rule:
        return sigma.parse_rule({"id": i, "title": i, "logsource": {"service": service}, "detection": {"selection": body, "condition": "selection"}})

    rules = [rule("a", "security", {"Image|endswith": "error.exe"}), rule("b", "system", {"CommandLine|contains": " -run "}), rule("c", "security", {"TargetUserName": ["u1", "u2", "U3"]})]
    return sigma.match(adapters.event(s, d), rules).groupBy(F.col("rule.id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_record"))


@query("sigma_bundled_rules", "event_flat", """SELECT 'Account created' AS title, count(*) AS n FROM event_flat WHERE channel = 'Security' AND event_id = 4720 HAVING count(*) > 0
UNION ALL SELECT 'Member added to a group', count(*) FROM event_flat WHERE channel = 'Security' AND event_id = 4732 HAVING count(*) > 0
UNION ALL SELECT 'Failed logon that names no station', count(*) FROM event_flat WHERE channel = 'Security' AND event_id = 4625 AND station = '-' HAVING count(*) > 0
UNION ALL SELECT 'Service with a program in a user-writable folder', count(*) FROM event_flat WHERE channel = 'System' AND event_id = 7045 HAVING count(*) > 0
UNION ALL SELECT 'Tool run quietly from a folder of tools', count(*) FROM event_flat WHERE contains(cmdline, '-p7') AND contains(cmdline, '/quiet') HAVING count(*) > 0""")
def _(s, d):
    return sigma.match(adapters.event(s, d), sigma.load_rules()).groupBy(F.col("rule.title").alias("title")).agg(F.count(F.lit(1)).alias("n"))


# ---- parent and child -----------------------------------------------------------------------

_NAME = f"lower({_base('p.image')})"
_PARENT = f"lower({_base('q.image')})"
PARENTCHILD = f"""
last AS (SELECT pid, max_by(image, _ord) AS image FROM process GROUP BY 1),
s0 AS (SELECT p.*, {_masq('p.image')} AS c1, coalesce({_in(_PARENT, a.OFFICE_PARENTS)} AND {_in(_NAME, a.SHELL_CHILDREN)}, false) AS c2,
  coalesce({_in(_PARENT, a.SCRIPT_PARENTS)} AND {_in(_NAME, a.REAL_SHELLS)}, false) AS c3,
  (contains(lower(p.cmdline), '-enc') OR contains(lower(p.cmdline), '-e ') AND {_in(_NAME, t.POWERSHELLS)}) AND {_B64.format(x='p.cmdline')} AS c4,
  {_in(_NAME, a.LOLBAS)} AND ({_has('lower(p.cmdline)', ('http', 'scrobj', '/i:'))} OR {_B64.format(x='p.cmdline')}) AS c5, {_susp('p.image')} AS c6
  FROM process p LEFT JOIN last q ON p.ppid = q.pid),
s1 AS (SELECT *, (c1 OR c2 OR c3 OR c4 OR c5) AS combo, coalesce(signed = false, false) AS uns FROM s0),
pc AS (SELECT *, 60 * c1::INT + 50 * c2::INT + 30 * c3::INT + 40 * c4::INT + 30 * c5::INT + 25 * (combo AND c6)::INT + 20 * (combo AND uns)::INT + 15 * coalesce(combo AND uns AND integrity IN ('high', 'system'), false)::INT AS weight,
  concat_ws(',', CASE WHEN c1 THEN 'T1036.005' END, CASE WHEN c2 OR c3 THEN 'T1059' END, CASE WHEN c4 THEN 'T1059.001' END, CASE WHEN c5 THEN 'T1218' END, CASE WHEN combo AND c6 THEN 'T1036' END,
    CASE WHEN coalesce(combo AND uns AND integrity IN ('high', 'system'), false) THEN 'T1068' END) AS tags FROM s1)"""


@query("parentchild_scores", "process", f"WITH {PARENTCHILD} SELECT _ord AS ord, pid, weight, tags FROM pc")
def _(s, d):
    rows = a.parentchild_scores(adapters.tables(s, d)["process"])
    return rows.select(F.col("_ord").alias("ord"), "pid", "weight", F.array_join("mitre", ",").alias("tags"))


@query("parentchild_severities", "process", f"WITH {PARENTCHILD} SELECT CASE WHEN weight >= 70 THEN 'critical' WHEN weight >= 50 THEN 'high' WHEN weight >= 30 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM pc WHERE weight >= 15 GROUP BY 1")
def _(s, d):
    return a.parentchild(adapters.tables(s, d), None, PARAMS, s).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("last_pid_wins", "process", "SELECT pid, max_by(image, _ord) AS image, max(_ord) AS ord FROM process GROUP BY 1")
def _(s, d):
    return joins.last_by_key(adapters.tables(s, d)["process"], "pid").select("pid", "image", F.col("_ord").alias("ord"))


# ---- persistence ----------------------------------------------------------------------------

_P = "coalesce(binary_path, '')"
_FIRST = r"""regexp_extract(trim(trim(trim(command)), '"'), '^\S+')"""
_INV = f"lower({_base(f"""trim(coalesce(binary_path, {_FIRST}), '"')""")})"
_NORM = r"regexp_replace(regexp_replace(lower(trim(command)), ',$', ''), '^%(systemroot|windir)%', 'c:\\windows')"
_WRITABLE = _has(f"lower({_P})", t.USER_WRITABLE_DIRS)
_SYSTEM = rf"(starts_with(substr(lower({_P}), 2), ':\windows\') OR starts_with(substr(lower({_P}), 2), ':\program files'))"
_LOUD = _has("lower(command)", (" -enc", " -encodedcommand", "frombase64string", "http://", "https://"))
PERSIST = f"""
h0 AS (SELECT *, coalesce(signed = false, false) AS uns,
  coalesce(CASE value WHEN 'Shell' THEN {_NORM} = 'explorer.exe' WHEN 'Userinit' THEN {_in(_NORM, t.WINLOGON_USERINIT)} END, false) AS stock,
  {_has("coalesce(command, '')", a.WMI_MARKS)} OR {_has("lower(coalesce(command, ''))", a.WEB)} AS scripted FROM persistence),
h1 AS (SELECT *, CASE WHEN mechanism = 'winlogon' AND NOT stock THEN 3 END AS r0, CASE WHEN mechanism = 'ifeo' THEN CASE WHEN uns OR {_WRITABLE} THEN 3 ELSE 2 END END AS r1,
  CASE WHEN mechanism = 'wmi_subscription' AND binary_path IS NULL THEN CASE WHEN scripted THEN 3 ELSE 2 END END AS r2,
  CASE WHEN mechanism <> 'startup' AND uns AND {_WRITABLE} THEN 3 END AS r3, CASE WHEN mechanism <> 'startup' AND {_masq(_P)} THEN 3 END AS r4,
  CASE WHEN mechanism <> 'startup' AND signed IS NULL AND {_P} <> '' AND NOT {_SYSTEM} AND epoch_us({NOW}) - epoch_us(last_write) BETWEEN 0 AND 7 * 86400000000 THEN 2 END AS r5,
  CASE WHEN command IS NOT NULL AND {_in(_INV, a.INTERPRETERS)} THEN CASE WHEN {_LOUD} THEN 3 WHEN {_has('lower(command)', a.SCRIPT_EXTENSIONS)} THEN 1 END END AS r6 FROM h0),
hits AS (SELECT *, (r0 IS NOT NULL)::INT + (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT + (r4 IS NOT NULL)::INT + (r5 IS NOT NULL)::INT + (r6 IS NOT NULL)::INT AS n,
  greatest(coalesce(r0, -1), coalesce(r1, -1), coalesce(r2, -1), coalesce(r3, -1), coalesce(r4, -1), coalesce(r5, -1), coalesce(r6, -1)) AS top FROM h1)"""
_LAST = "CASE top WHEN r6 THEN 6 WHEN r5 THEN 5 WHEN r4 THEN 4 WHEN r3 THEN 3 WHEN r2 THEN 2 WHEN r1 THEN 1 WHEN r0 THEN 0 END"
EXEC_KEYS = f"ek AS (SELECT {_join_key('path')} AS k, * FROM execution WHERE regexp_replace(regexp_extract(lower(trim(trim(path), '\"')), '[^\\\\/]*$'), '\\.exe$', '') <> '')"
PROC_KEYS = f"pk AS (SELECT {_join_key('image')} AS k, * FROM process WHERE regexp_replace(regexp_extract(lower(trim(trim(image), '\"')), '[^\\\\/]*$'), '\\.exe$', '') <> '')"


@query("persist_gate_hits", "persistence", f"WITH {PERSIST} SELECT _ord AS ord, n AS hits, top, {_LAST} AS top_signal FROM hits WHERE n > 0")
def _(s, d):
    rows = a.persist_hits(adapters.tables(s, d)["persistence"], PARAMS).filter(F.size("hits") > 0)
    top = F.array_max("hits")
    return rows.select(F.col("_ord").alias("ord"), F.size("hits").alias("hits"), top["rank"].alias("top"), top["idx"].alias("top_signal"))


_KEY = "coalesce(binary_path, command, '')"


@query("persist_escalated", "persistence execution process", f"""WITH {PERSIST}, {EXEC_KEYS}, {PROC_KEYS}, e AS (SELECT k, count(*) AS c FROM ek GROUP BY 1), p AS (SELECT k, count(*) AS c FROM pk GROUP BY 1),
j AS (SELECT h._ord, n, top, coalesce(e1.c, e2.c, 0) AS runs, coalesce(p1.c, p2.c, 0) AS procs, (e1.c IS NULL AND e2.c IS NOT NULL) OR (p1.c IS NULL AND p2.c IS NOT NULL) AS degraded FROM hits h
  LEFT JOIN e e1 ON e1.k = {_join_key(_KEY)} LEFT JOIN e e2 ON e2.k = {_degraded(_KEY)} LEFT JOIN p p1 ON p1.k = {_join_key(_KEY)} LEFT JOIN p p2 ON p2.k = {_degraded(_KEY)} WHERE n > 0)
SELECT _ord AS ord, runs, procs, degraded, least(4, least(4, top + (n >= 2)::INT) + (runs > 0 OR procs > 0)::INT) AS rank FROM j""")
def _(s, d):
    rows = a.persist_ranked(adapters.tables(s, d), PARAMS, s)
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.select(F.col("_ord").alias("ord"), n("runs").alias("runs"), n("procs").alias("procs"), "degraded", "rank")


@query("persist_observations", "persistence", f"WITH {PERSIST} SELECT CASE mechanism WHEN 'winlogon' THEN 'winlogon_default' ELSE mechanism END AS category, mechanism || ': ' || {_base('''trim(coalesce(binary_path, command, location), '\"')''')} AS title, binary_path AS path FROM hits WHERE n = 0")
def _(s, d):
    return a.persist_observations(adapters.tables(s, d), PARAMS, s).select("category", "title", "path")


@query("two_tier_join", "persistence execution", f"""WITH {EXEC_KEYS}, k AS (SELECT _ord, {_join_key(_KEY)} AS k1, {_degraded(_KEY)} AS k2 FROM persistence),
x AS (SELECT k._ord, count(*) AS c, min(ek._ord) AS f FROM k JOIN ek ON ek.k = k1 GROUP BY 1), y AS (SELECT k._ord, count(*) AS c, min(ek._ord) AS f FROM k JOIN ek ON ek.k = k2 GROUP BY 1)
SELECT k._ord AS ord, coalesce(x.c, y.c) AS n, coalesce(x.f, y.f) AS first_match, x.c IS NULL AS degraded FROM k LEFT JOIN x USING (_ord) LEFT JOIN y USING (_ord) WHERE coalesce(x.c, y.c) IS NOT NULL""")
def _(s, d):
    tb = adapters.tables(s, d)
    out = joins.two_tier_matches(tb["persistence"], "_ord", F.coalesce("binary_path", "command", F.lit("")), tb["execution"].withColumn("o", F.col("_ord")), "path", F.col("o"))
    return out.select(F.col("_ord").alias("ord"), F.size("matches").cast("bigint").alias("n"), F.col("matches")[0].alias("first_match"), "degraded")


# ---- network --------------------------------------------------------------------------------

_OCT = [f"CAST(split_part(x.raddr, '.', {i}) AS INT)" for i in range(1, 5)]
_PUBLIC = f"""coalesce(NOT ({_OCT[0]} IN (10, 127) OR {_OCT[0]} >= 224 OR x.raddr = '0.0.0.0' OR ({_OCT[0]} = 172 AND {_OCT[1]} BETWEEN 16 AND 31) OR ({_OCT[0]} = 192 AND {_OCT[1]} = 168) OR ({_OCT[0]} = 169 AND {_OCT[1]} = 254)
  OR ({_OCT[0]} = 100 AND {_OCT[1]} BETWEEN 64 AND 127) OR ({_OCT[0]} = 192 AND {_OCT[1]} = 0 AND {_OCT[2]} IN (0, 2)) OR ({_OCT[0]} = 198 AND {_OCT[1]} IN (18, 19)) OR ({_OCT[0]} = 198 AND {_OCT[1]} = 51 AND {_OCT[2]} = 100) OR ({_OCT[0]} = 203 AND {_OCT[1]} = 0 AND {_OCT[2]} = 113)), false)"""
_RARE = f"coalesce(x.rport <> 0 AND NOT {_in('x.rport', v.COMMON_PORTS)}, false)"


def _netconn_sql(corroborated: str) -> str:
    return f"""own AS (SELECT pid, max_by(image, _ord) AS image, max_by(coalesce(signed::INT, 2), _ord) AS signed FROM process GROUP BY 1),
n0 AS (SELECT x._ord, x.state, x.lport, {_RARE} AS rare, {_PUBLIC} AND {_RARE} AS pub, coalesce({_susp('o.image')}, false) AS placed, coalesce(o.signed = 0, false) AS uns, coalesce({corroborated}, false) AS corr FROM net_conn x LEFT JOIN own o ON x.pid = o.pid),
nc AS (SELECT _ord, 25 * pub::INT + 20 * rare::INT + CASE WHEN placed AND uns THEN 50 WHEN placed THEN 30 WHEN uns AND rare THEN 20 ELSE 0 END + 25 * coalesce(state = 'listen' AND lport > 1024 AND uns AND placed, false)::INT + 30 * corr::INT AS weight FROM n0)"""


@query("netconn_scores", "net_conn process", f"WITH {_netconn_sql('false')} SELECT _ord AS ord, weight FROM nc WHERE weight > 0")
def _(s, d):
    tb = adapters.tables(s, d)
    return a.netconn_scores(tb["net_conn"], tb["process"], None).filter("weight > 0").select(F.col("_ord").alias("ord"), "weight")


_NETC = _netconn_sql(f"lower({_base('o.image')}) IN (SELECT b FROM ev WHERE b <> '')")


@query("netconn_corroborated", "net_conn process persistence execution", f"""WITH {PERSIST}, {EXEC_KEYS}, {PROC_KEYS}, g AS (SELECT {_join_key(_KEY)} AS k1, {_degraded(_KEY)} AS k2, binary_path FROM hits WHERE n > 0),
ex AS (SELECT DISTINCT k, path FROM ek), px AS (SELECT DISTINCT k, image AS path FROM pk), ev AS (SELECT DISTINCT lower({_base("trim(path, '\"')")}) AS b FROM (SELECT binary_path AS path FROM g UNION ALL SELECT ex.path FROM g JOIN ex ON ex.k = g.k1
  UNION ALL SELECT ex.path FROM g JOIN ex ON ex.k = g.k2 WHERE g.k1 NOT IN (SELECT k FROM ek) UNION ALL SELECT px.path FROM g JOIN px ON px.k = g.k1 UNION ALL SELECT px.path FROM g JOIN px ON px.k = g.k2 WHERE g.k1 NOT IN (SELECT k FROM pk)) WHERE path IS NOT NULL),
{_NETC} SELECT weight, count(*) AS n FROM nc WHERE weight >= 50 GROUP BY 1""")
def _(s, d):
    tb = adapters.tables(s, d)
    rows, _ = a.netconn_weighed(tb["net_conn"], tb["process"], a.persist_found(tb, None, PARAMS, s))
    return rows.filter("weight >= 50").groupBy("weight").agg(F.count(F.lit(1)).alias("n"))


@query("public_ipv4", "net_conn", f"SELECT raddr, {_PUBLIC} AS public FROM net_conn x WHERE raddr IS NOT NULL GROUP BY 1")
def _(s, d):
    return adapters.tables(s, d)["net_conn"].filter("raddr is not null").select("raddr").distinct().select("raddr", v.public_ipv4(F.col("raddr")).alias("public"))


# ---- time windows ---------------------------------------------------------------------------

_STARTS = "st AS (SELECT pid, max_by(start_time, _ord) AS s FROM process GROUP BY 1)"
_NEAR = f"{_STARTS}, nr AS (SELECT pid, u._ord AS o, u.ts FROM st JOIN usn_event u ON u.ts BETWEEN st.s AND st.s + INTERVAL 5 MINUTE)"


def _near(s: SparkSession, d: str) -> DataFrame:
    tb = adapters.tables(s, d)
    starts = joins.last_by_key(tb["process"], "pid").select("pid", "start_time")
    return joins.range_join(starts, "start_time", tb["usn_event"].select("ts", F.col("_ord").alias("o")), "ts", 300_000_000)


@query("temporal_range_join", "process usn_event", f"WITH {_NEAR} SELECT pid, count(*) AS n, min(o) AS first_event FROM nr GROUP BY 1")
def _(s, d):
    return _near(s, d).groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first_event"))


@query("temporal_topk", "process usn_event", f"""WITH {PARENTCHILD}, {_STARTS}, nr AS (SELECT pid, u._ord AS o, u.ts, u.path FROM st JOIN usn_event u ON u.ts BETWEEN st.s AND st.s + INTERVAL 5 MINUTE),
k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ts DESC, o) AS rn FROM nr) SELECT pid, epoch_us(ts) AS us, path, count(*) AS n FROM pc JOIN k USING (pid) WHERE weight >= 15 AND rn <= 2 GROUP BY 1, 2, 3""")
def _(s, d):
    tb = {k: x for k, x in adapters.tables(s, d).items() if k != "net_conn"}
    p = a.Params(as_of=PARAMS.as_of, temporal_evidence=2)
    found = a.temporal(tb, a.parentchild(tb, None, p, s), p, s).select("entity.process.pid", F.explode("evidence").alias("e")).filter("e.artifact = 'usn_temporal'")
    return found.groupBy("pid", F.unix_micros("e.ts").alias("us"), F.col("e.path").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("temporal_findings", "process usn_event net_conn", f"WITH {PARENTCHILD}, {_NEAR}, r AS (SELECT pid, CASE WHEN weight >= 70 THEN 4 WHEN weight >= 50 THEN 3 WHEN weight >= 30 THEN 2 ELSE 1 END AS k FROM pc WHERE weight >= 15) SELECT {_SEV.format(r='least(4, k + 1)')} AS severity, count(*) AS n FROM r WHERE pid IN (SELECT pid FROM nr) OR pid IN (SELECT pid FROM net_conn) GROUP BY 1")
def _(s, d):
    tb = adapters.tables(s, d)
    return a.temporal(tb, a.parentchild(tb, None, PARAMS, s), PARAMS, s).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


_LIVE = f"""WITH {EXEC_KEYS}, k AS (SELECT _ord, signed, {_join_key('image')} AS k1, {_degraded('image')} AS k2 FROM process), e AS (SELECT k, min(first_run) AS f FROM ek GROUP BY 1),
m AS (SELECT k._ord, signed, e1.k IS NULL AND e2.k IS NULL AS absent, CASE WHEN e1.k IS NOT NULL THEN e1.f ELSE e2.f END AS f FROM k LEFT JOIN e e1 ON e1.k = k1 LEFT JOIN e e2 ON e2.k = k2)"""


@query("live_exec_signal_a", "process execution", f"{_LIVE} SELECT _ord AS ord FROM m WHERE absent")
def _(s, d):
    tb = adapters.tables(s, d)
    return a.live_exec_signals(tb["process"], tb["execution"], PARAMS).filter("signal = 'a'").select(F.col("_ord").alias("ord"))


@query("live_exec_signal_b", "process execution", f"{_LIVE} SELECT _ord AS ord, epoch_us(f) AS first_us FROM m WHERE NOT absent AND signed = false AND epoch_us({NOW}) - epoch_us(f) BETWEEN 0 AND 30 * 86400000000")
def _(s, d):
    tb = adapters.tables(s, d)
    return a.live_exec_signals(tb["process"], tb["execution"], PARAMS).filter("signal = 'b'").select(F.col("_ord").alias("ord"), F.unix_micros("first_run").alias("first_us"))


@query("timestomp_bands", "file_meta", """WITH x AS (SELECT _ord, CASE WHEN epoch_us(fn_btime) - epoch_us(si_btime) > 86400000000 THEN epoch_us(fn_btime) - epoch_us(si_btime) END AS b, CASE WHEN epoch_us(fn_mtime) - epoch_us(si_mtime) > 86400000000 THEN epoch_us(fn_mtime) - epoch_us(si_mtime) END AS m FROM file_meta)
SELECT CASE WHEN greatest(coalesce(b, 0), coalesce(m, 0)) > 365 * 86400000000 THEN 4 WHEN greatest(coalesce(b, 0), coalesce(m, 0)) > 30 * 86400000000 THEN 3 ELSE 2 END AS rank, count(*) AS n, max(greatest(coalesce(b, 0), coalesce(m, 0))) AS longest FROM x WHERE b IS NOT NULL OR m IS NOT NULL GROUP BY 1""")
def _(s, d):
    rows = a.timestomp_deltas(adapters.tables(s, d)["file_meta"], PARAMS.timestomp_us)
    return rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.max("delta_us").alias("longest"))


@query("account_events", "event_flat", f"SELECT record_id, CASE event_id WHEN 4720 THEN 'created' ELSE 'added to group' END AS kind, CASE event_id WHEN 4720 THEN target_user ELSE member END AS target, epoch_us({NOW}) - epoch_us(ts) BETWEEN 0 AND 20 * 86400000000 AS recent FROM event_flat WHERE channel = 'Security' AND event_id IN (4720, 4732)")
def _(s, d):
    p = a.Params(as_of=PARAMS.as_of, recent_account_days=20)
    return a.account_events(adapters.event(s, d), p).select("record_id", "kind", "target", "recent")


_ATT = "a AS (SELECT ts, epoch_us(ts) AS us, target_user AS u, CASE WHEN ip <> '-' THEN ip ELSE station END AS src, event_id = 4624 AS ok, _ord FROM event_flat WHERE channel = 'Security' AND event_id IN (4624, 4625) AND NOT (ip = '-' AND station = '-'))"


@query("bruteforce_windows", "event_flat", f"""WITH {_ATT}, w AS (SELECT x._ord, x.u, x.src, count(*) FILTER (WHERE NOT y.ok) AS f, bool_or(y.ok) AS hit FROM a x JOIN a y ON x.u = y.u AND x.src = y.src AND y.us BETWEEN x.us AND x.us + 72 * 3600000000 WHERE NOT x.ok GROUP BY 1, 2, 3),
b AS (SELECT u, src, max(f) AS f FROM w GROUP BY 1, 2) SELECT b.u AS target_user, b.src AS source, b.f AS failures, bool_or(w.hit) AS hit_success FROM b JOIN w ON w.u = b.u AND w.src = b.src AND w.f = b.f WHERE b.f >= 3 GROUP BY 1, 2, 3""")
def _(s, d):
    rows = windows.bruteforce_windows(windows.attempts(adapters.event(s, d)), PARAMS.bruteforce_us, PARAMS.bruteforce_failures)
    return rows.select(F.col("user").alias("target_user"), "source", "failures", "hit_success")


@query("spraying_windows", "event_flat", f"""WITH {_ATT}, w AS (SELECT x._ord, x.src, x.us, count(DISTINCT y.u) AS n, bool_or(y.ok) AS hit FROM a x JOIN a y ON x.src = y.src AND y.us BETWEEN x.us AND x.us + 12 * 3600000000 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, _ord) AS k FROM w) SELECT src AS source, n AS accounts, hit AS hit_success, us AS best_us FROM r WHERE k = 1 AND n >= 2""")
def _(s, d):
    rows = windows.spraying_windows(windows.attempts(adapters.event(s, d)), PARAMS.spraying_us, PARAMS.spraying_accounts)
    return rows.select("source", F.col("accounts").cast("bigint").alias("accounts"), "hit_success", "best_us")


@query("byovd_semi", "execution", f"SELECT _ord AS ord, sha1 FROM execution WHERE source = 'amcache_driver' AND {_in('sha1', PARAMS.driver_hashes)}")
def _(s, d):
    hashes = s.createDataFrame([(h,) for h in PARAMS.driver_hashes], "sha1 string")
    return a.byovd_matches(adapters.tables(s, d)["execution"], hashes).select(F.col("_ord").alias("ord"), "sha1")


# ---- scalars --------------------------------------------------------------------------------

_BITS = ", ".join(f"CASE WHEN (m & {bit}) <> 0 THEN '{name}' END" for bit, name in v.USN_REASONS)


@query("usn_reason_bits", "", f"WITH x AS (SELECT o_orderkey AS k, (o_orderkey * 2654435 + 12345) % 4294967296 AS m FROM orders) SELECT k, concat_ws('|', {_BITS}) AS reason FROM x")
def _(s, d):
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") * 2654435 + 12345) % 4294967296).alias("m"))
    return rows.select("k", v.usn_reason(F.col("m")).alias("reason"))


@query("rot13_names", "", "SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS name FROM part")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", t.rot13(F.col("p_name")).alias("name"))


@query("filetime_convert", "", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch_us(o_orderdate) END AS us FROM orders WHERE epoch_us(o_orderdate) >= 0")
def _(s, d):
    s.conf.set("spark.sql.session.timeZone", "UTC")
    rows = s.read.parquet(f"{d}/orders.parquet").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp"))).filter("us >= 0")
    ft = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("us") * 10 + v.FILETIME_EPOCH + F.col("o_orderkey") % 10)
    return rows.select("o_orderkey", F.unix_micros(v.filetime(ft)).alias("us"))


@query("join_key_forms", "execution", f"SELECT path, {_join_key('path')} AS k, substr({_degraded('path')}, 3) AS degraded FROM execution GROUP BY 1")
def _(s, d):
    rows = adapters.view(s, d, "execution").select("path").distinct().withColumn("k", t.join_key(F.col("path")))
    return rows.select("path", F.concat(F.when(F.col("k.full"), "p:").otherwise("n:"), F.col("k.key")).alias("k"), t.degraded_key(F.col("k")).alias("degraded"))


@query("winlogon_default", "persistence", f"WITH {PERSIST} SELECT _ord AS ord, stock FROM hits WHERE mechanism = 'winlogon'")
def _(s, d):
    rows = adapters.view(s, d, "persistence").filter("mechanism = 'winlogon'")
    return rows.select(F.col("_ord").alias("ord"), t.winlogon_default(F.col("value"), F.col("command")).alias("stock"))


_SVC = r"CASE o_orderkey % 6 WHEN 0 THEN '\??\C:\d\a.sys' WHEN 1 THEN '\SystemRoot\System32\b.sys' WHEN 2 THEN '%systemroot%\c.exe' WHEN 3 THEN 'System32\drivers\d.sys' WHEN 4 THEN 'D:\e.exe' ELSE '\\srv\s\f.exe' END"


@query("service_path_norm", "", rf"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'C:\d\a.sys' WHEN 1 THEN 'C:\Windows\System32\b.sys' WHEN 2 THEN 'C:\Windows\c.exe' WHEN 3 THEN 'C:\Windows\System32\drivers\d.sys' WHEN 4 THEN 'D:\e.exe' ELSE '\\srv\s\f.exe' END AS path FROM orders")
def _(s, d):
    rows = s.read.parquet(f"{d}/orders.parquet")
    raw = F.lit("\\\\srv\\s\\f.exe")
    for i, p in enumerate(("\\??\\C:\\d\\a.sys", "\\SystemRoot\\System32\\b.sys", "%systemroot%\\c.exe", "System32\\drivers\\d.sys", "D:\\e.exe")):
        raw = F.when(F.col("o_orderkey") % 6 == i, p).otherwise(raw)
    return rows.select("o_orderkey", t.service_path(raw).alias("path"))


@query("binary_path_candidates", "", "WITH x AS (SELECT p_partkey, string_split(trim(p_name), ' ') AS w, p_partkey % 4 = 0 AS q, p_name FROM part) SELECT p_partkey, CASE WHEN q THEN p_name ELSE array_to_string(list_transform(range(len(w), 0, -1), lambda n: array_to_string(w[1:n], ' ')), '|') END AS candidates FROM x")
def _(s, d):
    rows = s.read.parquet(f"{d}/part.parquet")
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('"'), F.col("p_name"), F.lit('" -run'))).otherwise(F.col("p_name"))
    return rows.select("p_partkey", F.array_join(t.path_candidates(line), "|").alias("candidates"))


@query("mft_paths_recursive", "mft", r"""WITH RECURSIVE r AS (SELECT rec, name AS path, parent AS goes, [rec] AS seen, 1 AS n FROM mft WHERE rec <> 5 UNION ALL SELECT r.rec, m.name || '\' || r.path, m.parent, list_append(seen, m.rec), n + 1 FROM r JOIN mft m ON m.rec = r.goes WHERE r.goes <> 5 AND NOT list_contains(seen, m.rec) AND n < 255)
SELECT rec, 'C:\' || max_by(path, n) AS path, bool_or(goes = 5) AS complete FROM r GROUP BY rec""")
def _(s, d):
    return joins.mft_paths(adapters.view(s, d, "mft"))


# ---- outputs --------------------------------------------------------------------------------


@query("timeline_rows", "event_flat", f"SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS \"Timestamp\", CASE WHEN epoch_us({NOW}) - epoch_us(ts) BETWEEN 0 AND 90 * 86400000000 THEN 'high' ELSE 'medium' END AS \"Severity\", CASE event_id WHEN 4720 THEN 'T1136.001' ELSE 'T1098.001' END AS \"MITRE\", CAST(event_id AS VARCHAR) AS \"EventID\" FROM event_flat WHERE channel = 'Security' AND event_id IN (4720, 4732)")
def _(s, d):
    return timeline.timeline_rows(a.account({"event": adapters.event(s, d)}, None, PARAMS, s)).select("Timestamp", "Severity", "MITRE", "EventID")


@query("timeline_dedup", "event_flat", "SELECT CAST(event_id AS VARCHAR) AS \"EventID\", count(DISTINCT strftime(ts, '%Y-%m-%dT%H:%M:%S') || '|' || target_user || '|' || CASE WHEN event_id = 4732 THEN member ELSE '' END) AS n FROM event_flat WHERE channel = 'Security' AND event_id IN (4720, 4732) GROUP BY 1")
def _(s, d):
    rows = timeline.timeline_rows(a.account({"event": adapters.event(s, d)}, None, PARAMS, s))
    return timeline.sorted_timeline(rows.unionAll(rows)).groupBy("EventID").agg(F.count(F.lit(1)).alias("n"))


@query("bodyfile_lines", "file_meta usn_event", "SELECT '0|' || path || '|0|0|0|0|' || size || '|' || coalesce(CAST(floor(epoch(si_mtime)) AS BIGINT), 0) || '|' || coalesce(CAST(floor(epoch(si_mtime)) AS BIGINT), 0) || '|' || coalesce(CAST(floor(epoch(fn_mtime)) AS BIGINT), 0) || '|' || coalesce(CAST(floor(epoch(si_btime)) AS BIGINT), 0) AS line FROM file_meta UNION ALL SELECT '0|' || path || '|0|0|0|0|0|0|' || CAST(floor(epoch(ts)) AS BIGINT) || '|0|0' FROM usn_event")
def _(s, d):
    tb = adapters.tables(s, d)
    return timeline.bodyfile(tb["file_meta"], tb["usn_event"])


@query("summary_by_severity", "process", f"WITH {PARENTCHILD} SELECT CASE WHEN weight >= 70 THEN 'critical' WHEN weight >= 50 THEN 'high' WHEN weight >= 30 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n, max(weight >= 50) AS verdict FROM pc WHERE weight >= 15 GROUP BY 1")
def _(s, d):
    return panels.by_severity(a.parentchild(adapters.tables(s, d), None, PARAMS, s))


@query("repeat_basenames", "file_meta", f"WITH x AS (SELECT path, {_base('path')} AS b FROM file_meta WHERE epoch_us(fn_btime) - epoch_us(si_btime) > 86400000000 OR epoch_us(fn_mtime) - epoch_us(si_mtime) > 86400000000) SELECT b AS name, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 2")
def _(s, d):
    return panels.repeated_names(a.timestomp(adapters.tables(s, d), None, PARAMS, s))


@query("panel_processes", "process", "SELECT count(*) AS n, count(*) FILTER (WHERE signed = false) AS unsigned, count(DISTINCT image) AS images FROM process")
def _(s, d):
    return panels.process_counts(adapters.tables(s, d)["process"])


@query("panel_net", "net_conn", f"WITH x AS (SELECT * FROM net_conn WHERE coalesce(lower(state), '') IN ('', 'established', 'listen', 'listening')) SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(NOT ({_OCT[0]} IN (10, 127) OR x.raddr = '0.0.0.0' OR ({_OCT[0]} = 172 AND {_OCT[1]} BETWEEN 16 AND 31) OR ({_OCT[0]} = 192 AND {_OCT[1]} = 168) OR ({_OCT[0]} = 169 AND {_OCT[1]} = 254)), false)) AS public FROM x")
def _(s, d):
    return panels.net_counts(adapters.tables(s, d)["net_conn"])


@query("panel_usn_cap", "usn_event", "SELECT epoch_us(ts) AS us, path, reason FROM usn_event WHERE contains(reason, 'create') OR contains(reason, 'rename') ORDER BY ts DESC, _ord LIMIT 200")
def _(s, d):
    return panels.usn_panel(adapters.tables(s, d)["usn_event"]).select(F.unix_micros("ts").alias("us"), "path", "reason")


@query("panel_executions", "execution", "SELECT source, path, run_count, epoch_us(first_run) AS us FROM execution")
def _(s, d):
    return panels.execution_panel(adapters.view(s, d, "execution")).select("source", "path", "run_count", F.unix_micros("first_run").alias("us"))


@query("top_rules", "event_flat", f"WITH m AS ({_THREE}), x AS (SELECT m.rule_id, e.computer FROM m JOIN event_flat e USING (record_id)) SELECT rule_id, computer AS host, count(*) AS n FROM x GROUP BY 1, 2")
def _(s, d):
    def rule(i: str, service: str, body: dict) -> sigma.Rule:
        return sigma.parse_rule({"id": i, "title": i, "logsource": {"service": service}, "detection": {"selection": body, "condition": "selection"}})

    rules = [rule("a", "security", {"Image|endswith": "error.exe"}), rule("b", "system", {"CommandLine|contains": " -run "}), rule("c", "security", {"TargetUserName": ["u1", "u2", "U3"]})]
    found = sigma.analyzer(rules)({"event": adapters.event(s, d)}, None, PARAMS, s)
    return found.groupBy("rule_id", "host").agg(F.count(F.lit(1)).alias("n"))


@query("manifest_verify", "", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents WHERE text IS NOT NULL")
def _(s, d):
    from .sinks.manifest import compare_hashes

    docs = s.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    listed = docs.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    there = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return compare_hashes(listed, there).select(F.col("path").cast("bigint").alias("doc_id"), "status")


@query("topk_alerts", "process", f"WITH {PARENTCHILD} SELECT CASE WHEN weight >= 70 THEN 'CRITICAL' ELSE 'HIGH' END AS label, 'Unusual start of ' || {_base('image')} AS title, epoch_us(start_time) AS us FROM pc WHERE weight >= 50 ORDER BY weight >= 70 DESC, start_time, title, pid LIMIT 5")
def _(s, d):
    return panels.top_alerts(a.parentchild(adapters.tables(s, d), None, PARAMS, s)).select("label", "title", F.unix_micros("ts").alias("us"))


@query("module_selection", "", "SELECT * FROM (VALUES ('minimal', 'net', true), ('minimal', 'proc', true), ('standard', 'mft', true), ('standard', 'proc', true), ('standard', 'bogus', false)) AS x(profile, module, selected)")
def _(s, d):
    rows = []
    for profile, only in (("minimal", ["process", "net", "mft"]), ("standard", ["Process", "mft", "bogus", "BOGUS"])):
        chosen, unknown = pipeline.select_modules(profile, only, ["proc", "net", "mft"])
        rows += [(profile, m, True) for m in chosen] + [(profile, m, False) for m in unknown]
    return s.createDataFrame(rows, "profile string, module string, selected boolean")


@query("escalation_ranks", "", f"SELECT p_partkey, {_SEV.format(r='least(4, p_size % 5 + 1)')} AS severity FROM part")
def _(s, d):
    rows = s.read.parquet(f"{d}/part.parquet").withColumn("sev", severity_of(F.col("p_size") % 5))
    return rows.select("p_partkey", severity_of(v.escalated(rank(F.col("sev")))).alias("severity"))


@query("full_triage")
def _(s, d):
    rules = sigma.load_rules()
    counts, errors = pipeline.summary(s, adapters.tables(s, d), PARAMS, extra=(pipeline.Analyzer("sigma", sigma.analyzer(rules)),))
    if errors:
        raise RuntimeError("; ".join(errors))
    return counts


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brute-force and spraying findings as a timeline."""
    return timeline.timeline_rows(a.logon_bruteforce({"event": adapters.event(spark, sf_dir)}, None, PARAMS, spark))


from . import catalog_sources  # noqa: E402, F401  registers its queries, with this module's helpers
