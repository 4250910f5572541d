from datetime import datetime

import pytest
from pyspark.sql import functions as F
from util import at, rows

from quarrylens.operators import joins
from quarrylens.plans import analyzers as a
from quarrylens.plans import pipeline
from quarrylens.schema import evidence_size

P = a.Params(as_of=datetime(2024, 2, 1), driver_hashes=("a" * 40,))


def proc(pid, image, ppid=0, cmdline="", signed=None, integrity=None, start=None):
    return {"pid": pid, "ppid": ppid, "image": image, "cmdline": cmdline, "signed": signed, "integrity": integrity, "start_time": start}


def score(spark, *procs, pid=2):
    df = a.parentchild_scores(rows(spark, "process", *procs))
    return df.filter(F.col("pid") == pid).select("weight", "mitre").first()


def test_parentchild(spark):
    word = proc(1, "C:\\Office\\WINWORD.EXE")
    assert score(spark, word, proc(2, "C:\\Windows\\System32\\cmd.exe", 1)) == (50, ["T1059"])
    assert score(spark, word, proc(2, "C:\\Temp\\cmd.exe", 1, signed=False, integrity="high"))[0] == 50 + 25 + 20 + 15
    assert score(spark, proc(2, "C:\\Temp\\app.exe", 1, signed=False)) == (0, [])
    assert score(spark, proc(2, "C:\\Users\\x\\svchost.exe", signed=None)) == (60, ["T1036.005"])
    assert score(spark, proc(2, "C:\\w\\powershell.exe", cmdline="-e QUJDREVGR0hJSktMTU5PUA=="))[0] == 40
    assert score(spark, proc(2, "C:\\w\\tar.exe", cmdline="-e QUJDREVGR0hJSktMTU5PUA=="))[0] == 0
    assert score(spark, proc(2, "C:\\w\\certutil.exe", cmdline="-urlcache http://x")) == (30, ["T1218"])
    # of two rows with the parent's pid the last counts
    assert score(spark, word, proc(1, "C:\\a\\explorer.exe"), proc(2, "C:\\Windows\\cmd.exe", 1))[0] == 0


def entry(mechanism="run_key", **k):
    return {"mechanism": mechanism, "location": "HKLM\\Run", "value": "v", "last_write": at(30)} | k


def persisted(spark, e, **tables):
    tb = {"persistence": rows(spark, "persistence", e)} | tables
    f = a.persist(tb, None, P, spark).collect()
    o = a.persist_observations(tb, P, spark).collect()
    assert (len(f), len(o)) in ((1, 0), (0, 1))
    return f[0] if f else None


@pytest.mark.parametrize(("e", "severity"), [
    (entry("winlogon", value="Shell", command="explorer.exe"), None), (entry("winlogon", value="Shell", command="x.exe"), "high"), (entry("winlogon", value=None, command=None), "high"),
    (entry("ifeo", signed=True, binary_path="C:\\Windows\\x.exe"), "medium"), (entry("ifeo", signed=False, binary_path="C:\\Windows\\x.exe"), "high"),
    (entry("wmi_subscription", command="Eval(1)"), "high"), (entry("wmi_subscription", command="x"), "medium"), (entry("wmi_subscription", command="eval(1)"), "medium"),
    (entry(binary_path="C:\\Users\\Public\\a.exe", signed=False), "high"), (entry("startup", binary_path="C:\\Users\\Public\\a.exe", signed=False), None), (entry(binary_path="C:\\x\\lsass.exe", signed=True), "high"),
    (entry(binary_path="C:\\x\\a.exe"), "medium"), (entry(binary_path="C:\\x\\a.exe", last_write=datetime(2024, 1, 20)), None), (entry(binary_path="C:\\x\\a.exe", last_write=datetime(2024, 2, 2)), None), (entry(binary_path="C:\\Program Files\\a.exe"), None),
    (entry(command="powershell.exe -enc AAAA", signed=True), "high"), (entry(command="cmd.exe /c a.bat", signed=True), "low"), (entry(command="cmd.exe /c dir", signed=True), None), (entry(command='"C:\\PowerShell Studio\\a.exe" x.bat', binary_path="C:\\PowerShell Studio\\a.exe", signed=True), None),
    (entry(binary_path="C:\\Users\\Public\\lsass.exe", signed=False), "critical"),
])
def test_persistence_gate(spark, e, severity):
    f = persisted(spark, e)
    assert (f.severity if f else None) == severity
    if f:
        assert f.reason.endswith(a.PERSIST_MARKER)


def test_persistence_corroboration(spark):
    e = entry(binary_path="C:\\x\\a.exe")
    run = lambda path: rows(spark, "execution", {"source": "prefetch", "path": path})
    assert persisted(spark, e, execution=run("c:\\X\\A.EXE")).severity == "high"
    assert persisted(spark, e, execution=run("A.exe")).severity == "high"
    assert persisted(spark, e, execution=run("D:\\y\\a.exe")).severity == "medium"
    f = persisted(spark, e, process=rows(spark, "process", proc(7, "C:\\x\\a.exe")))
    assert (f.severity, f.entity.process.pid, f.evidence[-1].artifact) == ("high", 7, "process")


def test_entries_share_their_evidence(spark):
    """Twelve entries on a program that ran nine times and runs five times: one list of each, not twelve."""
    tb = {
        "persistence": rows(spark, "persistence", *(entry(value=f"v{i}", binary_path="C:\\x\\a.exe") for i in range(12)), entry(binary_path="C:\\x\\b.exe")),
        "execution": rows(spark, "execution", *({"source": "bam", "path": "C:\\X\\a.exe", "run_count": i} for i in range(9)), {"source": "bam", "path": "other"}),
        "process": rows(spark, "process", *(proc(i, "C:\\x\\A.exe") for i in range(5))),
    }
    ranked = a.persist_ranked(tb, P, spark)
    assert [k for k, kind in ranked.dtypes if kind.startswith("array") and k != "hits"] == []
    assert sorted((r.runs or 0, r.procs or 0, r.corroborated) for r in ranked.collect()) == [(0, 0, False)] + [(9, 5, True)] * 12
    found = a.persist_found(tb, None, P, spark)
    assert sorted(len(r["items"]) for r in found.lists.collect()) == [5, 9]
    whole = found.whole().collect()
    assert sorted(len(r.evidence) for r in whole) == [1] + [15] * 12 == sorted(r.n for r in found.rows.select(evidence_size().alias("n")).collect())
    one = next(r for r in whole if len(r.evidence) == 15)
    assert [e.artifact for e in one.evidence] == ["run_key"] + ["bam"] * 9 + ["process"] * 5
    assert [e.detail.split()[1] for e in one.evidence[1:10]] == [f"run_count={i}" for i in range(9)] and one.entity.process.pid == 0


def test_two_tiers(spark):
    probe = rows(spark, "execution", {"path": "C:\\a\\x.exe"}, {"path": "x.exe"}, {"path": "C:\\b\\y.exe"}, {"path": ""})
    build = rows(spark, "execution", {"path": "C:\\A\\X.exe"}, {"path": "x"}, {"path": "y"}, {"path": "C:\\c\\y.exe"}, {"path": ""})
    got = {r[0]: (r[1], r[2]) for r in joins.two_tier_matches(probe, "_ord", F.col("path"), build, "path", F.col("path")).collect()}
    assert got == {0: (["C:\\A\\X.exe"], False), 1: (["x"], False), 2: (["y"], True)}


def conn(**k):
    return {"proto": "tcp", "laddr": "10.0.0.1", "lport": 5000, "raddr": "8.8.8.8", "rport": 4444, "state": "established", "pid": 2} | k


def conn_weight(spark, c, p=None, prior=None):
    df = a.netconn_scores(rows(spark, "net_conn", c), rows(spark, "process", *([p] if p else [])), prior)
    return df.first().weight


def test_netconn(spark):
    shady = proc(2, "C:\\Temp\\a.exe", signed=False)
    assert conn_weight(spark, conn()) == 45
    assert conn_weight(spark, conn(rport=443)) == 0
    assert conn_weight(spark, conn(rport=0)) == 0
    assert conn_weight(spark, conn(raddr="10.0.0.9")) == 20
    assert conn_weight(spark, conn(rport=443), shady) == 50
    assert conn_weight(spark, conn(rport=443), proc(2, "C:\\Temp\\a.exe", signed=None)) == 30
    assert conn_weight(spark, conn(), proc(2, "C:\\x\\a.exe", signed=False)) == 65
    assert conn_weight(spark, conn(rport=None, raddr=None, state="listen"), shady) == 75
    assert conn_weight(spark, conn(rport=None, raddr=None, state="LISTEN"), shady) == 50
    prior = a.persist({"persistence": rows(spark, "persistence", entry(binary_path="C:\\other\\A.exe"))}, None, P, spark)
    assert conn_weight(spark, conn(rport=443), shady, prior) == 80


def test_netconn_looks_names_up_once_an_owner(spark):
    """Findings that share a list of evidence mark the same owners as findings that hold it, without being expanded."""
    e = rows(spark, "persistence", *(entry(value=f"v{i}", command="tool x.bat", binary_path="D:\\Tool.exe") for i in range(6)))
    tb = {"persistence": e, "execution": rows(spark, "execution", *({"source": "bam", "path": "tool"} for _ in range(4)))}
    found = a.persist_found(tb, None, P, spark)
    assert found.lists.count() == 1 and {len(r.evidence) for r in found.rows.collect()} == {1}
    assert sorted(r.base for r in a.evidence_names(found).collect()) == sorted(r.base for r in a.evidence_names(found.whole()).collect()) == ["tool", "tool.exe"]
    net, owners = rows(spark, "net_conn", conn(rport=443), conn(rport=443, pid=3), conn(pid=None)), rows(spark, "process", proc(2, "C:\\a\\TOOL.exe"), proc(3, "C:\\a\\x.exe"))
    for prior in (found, found.whole()):
        got = a.netconn_scores(net, owners, prior).orderBy("_ord").collect()
        assert [(r.weight, r.mitre, r.corroborated) for r in got] == [(30, ["T1547"], True), (0, [], False), (45, [], False)]


def logon(ts, user="u", ip="1.2.3.4", ok=False, station="-"):
    return {"ts": ts, "channel": "Security", "event_id": 4624 if ok else 4625, "data": {"TargetUserName": user, "IpAddress": ip, "WorkstationName": station}}


def test_bruteforce(spark):
    found = lambda *e: [(f.severity, f.mitre[0], len(f.evidence)) for f in a.logon_bruteforce({"event": rows(spark, "event", *e)}, None, P, spark).collect()]
    fails = [logon(at(1, 0, i)) for i in range(5)]
    assert found(*fails[:4]) == []
    assert found(*fails) == [("medium", "T1110.001", 5)]
    assert found(*fails, logon(at(1, 0, 5), ok=True)) == [("high", "T1110.001", 6)]
    assert found(*fails, logon(at(1, 0, 6), ok=True)) == [("medium", "T1110.001", 6)]
    assert found(*(logon(at(1, 0, 2 * i)) for i in range(5))) == []
    assert found(*(logon(at(1, 0, i), ip="-") for i in range(5))) == []
    assert found(*(logon(at(1, 0, i), ip="-", station="WS") for i in range(5))) == [("medium", "T1110.001", 5)]
    users = [logon(at(1, 0, 0, i), user=f"u{i}") for i in range(10)]
    assert found(*users[:9]) == []
    assert found(*users) == [("medium", "T1110.003", 10)]
    assert found(*users[:9], logon(at(1, 0, 1), user="u9", ok=True)) == [("high", "T1110.003", 10)]


def test_account(spark):
    e = lambda eid, ts: {"ts": ts, "channel": "Security", "event_id": eid, "data": {"TargetUserName": "t", "MemberName": "m"}}
    got = a.account({"event": rows(spark, "event", e(4720, at(20)), e(4726, datetime(2023, 1, 1)), e(4732, at(20)), e(4728, datetime(2025, 1, 1)), e(4624, at(1)))}, None, P, spark)
    assert sorted((r.event_id, r.severity, r.mitre[0]) for r in got.collect()) == [(4720, "high", "T1136.001"), (4726, "medium", "T1531"), (4728, "medium", "T1098.001"), (4732, "high", "T1098.001")]


def test_timestomp(spark):
    f = lambda si, fn: {"path": "p", "si_btime": si, "fn_btime": fn}
    sev = lambda *x: [r.severity for r in a.timestomp({"file_meta": rows(spark, "file_meta", f(*x))}, None, P, spark).collect()]
    assert sev(at(1), at(2)) == []
    assert sev(at(1), at(2, 0, 0, 1)) == ["medium"]
    assert sev(datetime(2023, 12, 1), at(10)) == ["high"]
    assert sev(datetime(2022, 1, 1), at(10)) == ["critical"]
    assert sev(at(10), at(1)) == []
    assert sev(None, at(1)) == []


def test_live_exec(spark):
    p = rows(spark, "process", proc(1, "C:\\a\\x.exe", signed=False), proc(2, "C:\\a\\y.exe", signed=False), proc(3, "C:\\a\\z.exe", signed=True), proc(4, "C:\\a\\w.exe", signed=False))
    e = rows(spark, "execution", {"source": "amcache", "path": "C:\\a\\y.exe", "first_run": at(20)}, {"source": "bam", "path": "z", "first_run": at(20)}, {"source": "bam", "path": "w", "first_run": datetime(2023, 1, 1)}, {"source": "bam", "path": "w", "first_run": at(20)})
    got = {r.entity.process.pid: (r.severity, r.artifact, r.mitre) for r in a.live_exec({"process": p, "execution": e}, None, P, spark).collect()}
    assert got == {1: ("high", "no_execution_artifact", []), 2: ("high", "amcache", ["T1036"])}


def test_byovd(spark):
    e = rows(spark, "execution", {"source": "amcache_driver", "path": "C:\\d\\x.sys", "sha1": "a" * 40}, {"source": "amcache", "path": "y", "sha1": "a" * 40}, {"source": "amcache_driver", "path": "z"})
    assert [(r.severity, r.mitre) for r in a.byovd({"execution": e}, None, P, spark).collect()] == [("high", ["T1068", "T1211"])]


def test_temporal(spark):
    start = at(5, 12)
    p = rows(spark, "process", proc(2, "C:\\Users\\x\\svchost.exe", start=start))
    usn = rows(spark, "usn_event", *({"ts": at(5, 12, m), "path": f"f{m}", "reason": "create"} for m in (0, 5, 6)))
    tb = {"process": p, "usn_event": usn, "net_conn": rows(spark, "net_conn", conn())}
    prior = a.parentchild(tb, None, P, spark)
    f = a.temporal(tb, prior, P, spark).collect()
    assert [(x.severity, [e.artifact for e in x.evidence], x.evidence[0].path) for x in f] == [("critical", ["usn_temporal", "usn_temporal", "netconn_temporal"], "f5")]
    assert a.temporal({"process": p}, prior, P, spark).count() == 0
    many = rows(spark, "usn_event", *({"ts": at(5, 12, 1), "path": f"f{i}", "reason": "create"} for i in range(205)))
    e = a.temporal({"process": p, "usn_event": many}, prior, P, spark).first().evidence
    assert len(e) == 201 and e[-1].artifact == "usn_temporal_summary"


def test_order_and_selection():
    names = [x.name for x in pipeline.ordered((*pipeline.ANALYZERS, pipeline.Analyzer("sigma", None)))]
    assert names == ["heur_parentchild", "heur_persist", "heur_netconn", "heur_temporal", "heur_live_exec", "heur_timestomp", "heur_account", "heur_logon_bruteforce", "heur_byovd", "sigma"]
    x = lambda n, *d: pipeline.Analyzer(n, None, d)
    assert [y.name for y in pipeline.ordered((x("a", "c"), x("b", "nobody"), x("c")))] == ["b", "c", "a"]
    with pytest.raises(ValueError, match="circle"):
        pipeline.ordered((x("a", "b"), x("b", "a")))
    assert pipeline.select_modules("standard", ["Process", "bogus", "BOGUS"], ["proc", "net"]) == (["proc"], ["bogus"])
    assert pipeline.select_modules("minimal", ["mft", "net"], ["proc", "net", "mft"]) == (["net"], [])


def test_run_skips_what_fails(spark):
    def broken(*_):
        raise RuntimeError("no")

    tb = {"process": rows(spark, "process", proc(2, "C:\\x\\svchost.exe"))}
    result = pipeline.run(spark, tb, a.Params(host="h1"), extra=(pipeline.Analyzer("broken", broken),))
    assert result.errors == ["broken: no"]
    assert {r.host for r in result.findings.collect()} == {"h1"}


def test_summary_counts_what_run_finds(spark):
    shady = {"persistence": rows(spark, "persistence", *(entry(value=f"v{i}", binary_path="C:\\x\\svchost.exe") for i in range(3))), "process": rows(spark, "process", *(proc(i, "C:\\x\\svchost.exe", start=at(5, 12)) for i in range(4)))}
    tb = shady | {"net_conn": rows(spark, "net_conn", conn(), conn(pid=1))}
    only = tuple(x for x in pipeline.ANALYZERS if x.name in ("heur_parentchild", "heur_persist", "heur_netconn", "heur_temporal"))
    want = pipeline.run(spark, tb, P, only).findings.groupBy("analyzer", "severity").agg(F.count(F.lit(1)), F.sum(F.size("evidence"))).collect()
    got, errors = pipeline.summary(spark, tb, P, only, (pipeline.Analyzer("broken", None),))
    assert errors and errors[0].startswith("broken: ")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and {r[0] for r in want} == {x.name for x in only}


def test_row_order_does_not_matter(spark):
    tb = {"event": rows(spark, "event", *(logon(at(1, 0, i % 7), user=f"u{i % 3}", ok=i % 5 == 0) for i in range(60)))}
    p = a.Params(bruteforce_failures=2, spraying_accounts=2)
    once = sorted(map(str, a.logon_bruteforce(tb, None, p, spark).collect()))
    again = sorted(map(str, a.logon_bruteforce({"event": tb["event"].orderBy(F.rand(3)).repartition(5)}, None, p, spark).collect()))
    assert once == again


def test_mft_paths(spark):
    e = [(5, ".", 5), (10, "a", 5), (11, "b", 10), (12, "c", 11), (20, "o", 99), (30, "x", 31), (31, "y", 30), (40, "z", 31), (12, "c2", 11)]
    e += [(1000 + i, f"d{i}", 1000 + i - 1 if i else 5) for i in range(260)]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(e)], "rec bigint, name string, parent bigint, _ord bigint")
    got = {r.rec: (r.path, r.complete) for r in joins.mft_paths(df).collect()}
    assert got[12] == ("C:\\a\\b\\c2", True)
    assert got[20] == ("C:\\o", False)
    assert got[30] == ("C:\\y\\x", False)
    assert got[40] == ("C:\\x\\y\\z", False)
    assert got[1253][1] is True and got[1254][1] is False and got[1253][0].count("\\") == 254
    assert 5 not in got


def test_hash_targets(spark):
    tb = {"process": rows(spark, "process", proc(2, "C:\\x\\svchost.exe"), proc(3, "C:\\y.exe")), "persistence": rows(spark, "persistence", entry(binary_path="C:\\Users\\Public\\a.exe", signed=False), entry(value="other", binary_path="C:\\Program Files\\b.exe"))}
    found = a.parentchild(tb, None, P, spark).unionByName(a.persist(tb, None, P, spark))
    targets = pipeline.hash_targets(tb, found)
    assert sorted(r.path for r in targets.collect()) == ["C:\\Users\\Public\\a.exe", "C:\\x\\svchost.exe"]
    hashes = spark.createDataFrame([("c:\\X\\SVCHOST.exe", "h")], "path string, sha256 string")
    assert {r.path: r.sha256 for r in pipeline.with_hashes(targets, hashes).collect()}["C:\\x\\svchost.exe"] == "h"
