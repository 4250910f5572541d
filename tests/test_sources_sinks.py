import json
import struct

import pytest
from pyspark.sql import functions as F
from util import at, rows

from quarrylens.functions.values import FILETIME_EPOCH
from quarrylens.operators import joins
from quarrylens.plans import analyzers as a
from quarrylens.plans import pipeline, sigma
from quarrylens.sinks import manifest, panels, report, timeline
from quarrylens.sources import binary, readers
from quarrylens.streaming.live import failures_ahead, match_stream

FT = 130018833000000000


def usn(name, version=2, reason=0x100, ft=FT, ref=7):
    n = name.encode("utf-16-le")
    head, t, r, s = (60, 32, 40, 56) if version == 2 else (76, 48, 56, 72)
    b = bytearray((head + len(n) + 7) // 8 * 8)
    struct.pack_into("<IH", b, 0, len(b), version)
    struct.pack_into("<Q", b, 8, ref | 9 << 48)
    struct.pack_into("<q", b, t, ft)
    struct.pack_into("<I", b, r, reason)
    struct.pack_into("<HH", b, s, len(n), head)
    b[head : head + len(n)] = n
    return bytes(b)


def test_usn(spark, tmp_path):
    blob = bytes(24) + usn("a.txt") + bytes(16) + usn("ü", 3) + struct.pack("<IHH", 16, 9, 0) + bytes(8) + usn("z", ft=0)
    got, cut = binary.usn_records(blob)
    assert [(x[1], x[2], x[3]) for x in got] == [("a.txt", "create", 7), ("ü", "create", 7), ("z", "create", 7)] and not cut
    assert binary.usn_records(blob, 2)[1] is True
    assert len(binary.usn_records(usn("a") + b"\xff\xff\xff\x7f\x02\0" + usn("b"))[0]) == 1
    for k in range(0, len(blob), 3):  # no cut may raise
        binary.usn_records(blob[:k])
    (tmp_path / "j").write_bytes(blob)
    df = binary.read_usn(spark, str(tmp_path))
    assert [str(r.ts) for r in df.orderBy("_ord").collect()] == ["2013-01-05 18:15:00", "2013-01-05 18:15:00", "1970-01-01 00:00:00"]


def test_shimcache(spark, tmp_path):
    def entry(path, data):
        p = path.encode("utf-16-le")
        return b"10ts" + bytes(8) + struct.pack("<H", len(p)) + p + struct.pack("<QI", FT, len(data)) + data

    blob = struct.pack("<I", 0x34) + bytes(0x30) + entry("C:\\a.exe", b"\x01\0\0\0") + entry("C:\\b.exe", b"\x02\0\0\0")
    assert binary.shimcache_entries(blob) == [("C:\\a.exe", True), ("C:\\b.exe", False)]
    assert binary.shimcache_entries(b"\x30" + blob[1:]) == []
    assert len(binary.shimcache_entries(blob[:-1])) == 1
    (tmp_path / "s").write_bytes(blob)
    assert [(r.path, r.execution_confirmed, r.first_run) for r in binary.read_shimcache(spark, str(tmp_path)).collect()] == [("C:\\a.exe", True, None), ("C:\\b.exe", False, None)]


def test_prefetch(spark, tmp_path):
    b = bytearray(0x100)
    struct.pack_into("<I", b, 0, 31)
    b[16:36] = "CMD.EXE".encode("utf-16-le").ljust(20, b"\0")
    struct.pack_into("<QQ", b, 0x80, FT, FT + 10_000_000)
    struct.pack_into("<I", b, 0xC8, 5)
    assert binary.prefetch_info(bytes(b)) == ("CMD.EXE", 5, [FT, FT + 10_000_000])
    assert binary.prefetch_info(b"\x11" + bytes(b[1:])) is None
    (tmp_path / "x.pf").write_bytes(bytes(b))
    r = binary.read_prefetch(spark, str(tmp_path)).first()
    assert (r.path, r.run_count, str(r.first_run), str(r.last_run)) == ("CMD.EXE", 5, "2013-01-05 18:15:00", "2013-01-05 18:15:01")


def test_xpress_huffman():
    # A table that gives the symbols of "ab" and of a match (length 3 + n, distance 2) one to two bits.
    lengths = [0] * 512
    lengths[ord("a")], lengths[ord("b")], lengths[256 + (1 << 4 | 5)] = 1, 2, 2
    table = bytes(lengths[i] | lengths[i + 1] << 4 for i in range(0, 512, 2))
    bits = "0" + "10" + "11" + "0"  # a, b, match (one distance bit: 0)
    word = int(bits.ljust(16, "0"), 2)
    data = table + struct.pack("<HH", word, 0)
    assert binary.xpress_huffman(data, 10) == b"ababababab"
    assert binary.prefetch_body(b"MAM\x04" + struct.pack("<I", 10) + data) == b"ababababab"
    assert binary.prefetch_body(b"MAM\x04" + struct.pack("<I", 10) + data[:100]) is None


def test_registry_sources(spark):
    reg = spark.createDataFrame([
        ("HKLM", "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run", "A", '"C:\\a b\\c.exe" -x', None, at(1), 0), ("HKLM", "SYSTEM\\CurrentControlSet\\Services\\Svc", "Start", "2", None, at(1), 1),
        ("HKLM", "SYSTEM\\CurrentControlSet\\Services\\Svc", "ImagePath", "\\SystemRoot\\s.exe", None, at(1), 2), ("HKLM", "SYSTEM\\CurrentControlSet\\Services\\Off", "Start", "4", None, at(1), 3),
        ("HKLM", "SYSTEM\\CurrentControlSet\\Services\\Off", "ImagePath", "x.exe", None, at(1), 4), ("HKLM", "SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon", "Shell", "explorer.exe", None, at(1), 5),
        ("HKLM", "SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Image File Execution Options\\x.exe", "Debugger", "d.exe", None, at(1), 6),
        ("c:\\users\\Bob", "Software\\Explorer\\UserAssist\\{1}\\Count", "P:\\Jvaqbjf\\k.rkr", None, bytes(4) + struct.pack("<I", 3) + bytes(52) + struct.pack("<Q", FT) + bytes(4), at(1), 7),
        ("HKLM", "SYSTEM\\ControlSet001\\Services\\bam\\State\\UserSettings\\S-1-5-21", "\\Device\\x.exe", None, struct.pack("<QQ", FT, 0), at(1), 8), ("HKLM", "SYSTEM\\ControlSet001\\Services\\bam\\State\\UserSettings\\S-1-5-21", "short", None, b"\1\2", at(1), 9),
    ], "hive string, key string, name string, data string, raw binary, last_write timestamp, _ord bigint")
    assert [(r.value, r.binary_path) for r in readers.run_keys(reg, {}).collect()] == [("A", "C:\\a b\\c.exe")]
    assert [(r.value, r.binary_path) for r in readers.services(reg).collect()] == [("Svc", "C:\\Windows\\s.exe")]
    assert [(r.value, r.command) for r in readers.winlogon(reg).collect()] == [("Shell", "explorer.exe")]
    assert [r.command for r in readers.ifeo(reg).collect()] == ["d.exe"]
    profiles = spark.createDataFrame([("C:\\Users\\BOB", "S-1", 0), ("C:\\Users\\bob", "S-2", 1)], "folder string, sid string, _ord bigint")
    assert [(r.path, r.run_count, str(r.last_run), r.user_sid) for r in readers.userassist(reg, profiles).collect()] == [("C:\\Windows\\x.exe", 3, "2013-01-05 18:15:00", "S-2")]
    assert [(r.path, r.user_sid, str(r.last_run)) for r in readers.bam(reg).collect()] == [("\\Device\\x.exe", "S-1-5-21", "2013-01-05 18:15:00")]
    inv = spark.createDataFrame([("h", "k1", "LowerCaseLongPath", "", None, at(1), 0), ("h", "k1", "DriverName", "d.sys", None, at(1), 1), ("h", "k1", "FileId", "0000" + "ab" * 20, None, at(1), 2)], reg.schema)
    assert [(r.path, r.sha1) for r in readers.amcache(inv, "amcache_driver").collect()] == [("d.sys", "ab" * 20)]


def test_tasks_and_wmi(spark):
    xml = '<Task xmlns="urn:x"><RegistrationInfo><URI>\\A\\Job</URI></RegistrationInfo><Actions><Exec><Command>C:\\p q\\r.exe</Command><Arguments>-a &amp; b</Arguments></Exec><ComHandler/><Exec><Command>%W%\\s.exe</Command></Exec></Actions></Task>'
    files = spark.createDataFrame([("/t/Job.xml", xml, at(2), 0), ("/t/None.xml", "<Task/>", at(2), 1)], "path string, xml string, modificationTime timestamp, _ord bigint")
    known = spark.createDataFrame([("C:\\p q\\r.exe",)], "path string")
    got = [(r.location, r.value, r.command, r.binary_path) for r in readers.scheduled_tasks(files, known, {"W": "C:\\Win"}).orderBy("command").collect()]
    assert got == [("\\A\\Job", "Job", "%W%\\s.exe", "C:\\Win\\s.exe"), ("\\A\\Job", "Job", "C:\\p q\\r.exe -a & b", "C:\\p q\\r.exe")]
    b = spark.createDataFrame([("f1", "c1"), ("f1", "c2"), ("gone", "c1")], "filter string, consumer string")
    f = spark.createDataFrame([("f1", "select *")], "path string, query string")
    c = spark.createDataFrame([("c1", "CommandLineEventConsumer", "a.exe -x", 0), ("c2", "ActiveScriptEventConsumer", "Eval(1)", 1)], "path string, kind string, command string, _ord bigint")
    assert sorted((r.command, r.binary_path) for r in readers.wmi_subscriptions(b, f, c).collect()) == [("Eval(1)", None), ("a.exe -x", "a.exe")]


def test_snapshots_and_json(spark, tmp_path):
    raw = spark.createDataFrame([(1, 0, "C:\\a.exe", None, 0x3000, "u", at(1), 0), (2, 0, "b.exe", "x", 5, "u", at(1), 1)], "pid bigint, ppid bigint, image string, cmdline string, integrity_rid int, user string, start_time timestamp, _ord bigint")
    sig = spark.createDataFrame([("c:\\A.exe", True, "S"), ("b.exe", True, "S")], "path string, signed boolean, signer string")
    assert sorted((r.pid, r.cmdline, r.integrity, r.signed) for r in readers.process_rows(raw, sig).collect()) == [(1, "", "high", True), (2, "x", "", None)]
    tcp = spark.createDataFrame([("a", 1, "b", 2, 5, 9, 0)], "laddr string, lport int, raddr string, rport int, state_code int, pid bigint, _ord bigint")
    assert [(r.proto, r.state, r.raddr) for r in readers.connection_rows(tcp, tcp).collect()] == [("tcp", "established", "b"), ("udp", None, None)]
    lines = [
        {"Event": {"System": {"Provider": {"#attributes": {"Name": "P"}}, "EventID": {"#text": "7045"}, "Channel": "System", "Computer": "h", "EventRecordID": 5, "TimeCreated": {"#attributes": {"SystemTime": "2024-01-01T00:00:00Z"}}}, "EventData": {"A": "1", "Channel": "later"}}},
        {"Event": {"System": {"EventID": 4624, "Channel": "Security", "TimeCreated": {"SystemTime": "2024-01-01T00:00:00Z"}}}}, {"nothing": 1},
    ]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, lines)))
    got = readers.read_event_json(spark, str(tmp_path / "e.json")).orderBy("_ord").collect()
    assert [(r.event_id, r.channel, r.provider) for r in got] == [(7045, "System", "P"), (4624, "Security", "")]
    assert got[0].data["A"] == "1" and got[0].data["Channel"] == "later" and got[0].data["Provider_Name"] == "P"
    (tmp_path / "r.jsonl").write_text('{"kind":"process","pid":4,"image":"a"}\n{"kind":"logon_session","user":"u"}\n{"kind":"event","event_id":1,"data":{"a":1,"b":"x"}}\n')
    assert readers.read_records(spark, str(tmp_path / "r.jsonl"), "process").first().signed is None
    assert readers.read_records(spark, str(tmp_path / "r.jsonl"), "logon_session").first().state_active is False
    assert readers.read_records(spark, str(tmp_path / "r.jsonl"), "event").first().data == {"a": "1", "b": "x"}
    (tmp_path / "d.txt").write_text("# c\n" + "AB" * 20 + " # x\nshort\n" + "ab" * 20 + "\n")
    assert [r.sha1 for r in readers.driver_hashes(spark, str(tmp_path / "d.txt")).collect()] == ["ab" * 20]


def test_mft_entries(spark, tmp_path):
    def attribute(kind, body):
        size = (24 + len(body) + 7) // 8 * 8
        b = bytearray(size)
        struct.pack_into("<IIB", b, 0, kind, size, 0)
        struct.pack_into("<IH", b, 16, len(body), 24)
        b[24 : 24 + len(body)] = body
        return bytes(b)

    def record(name, parent):
        n = name.encode("utf-16-le")
        fn = struct.pack("<QQQ", parent, FT, FT) + bytes(24) + struct.pack("<Q", 9) + bytes(8) + bytes([len(name), 1]) + n
        attrs = attribute(0x10, struct.pack("<QQ", FT, FT) + bytes(32)) + attribute(0x30, fn) + struct.pack("<I", 0xFFFFFFFF)
        b = bytearray(1024)
        b[:4] = b"FILE"
        struct.pack_into("<HH", b, 4, 48, 0)
        struct.pack_into("<H", b, 20, 56)
        b[56 : 56 + len(attrs)] = attrs
        return bytes(b)

    blob = bytes(1024) * 5 + record(".", 5) + record("dir", 5) + record("f.txt", 6)
    (tmp_path / "mft").write_bytes(blob)
    got = {r.path: r for r in binary.read_mft(spark, str(tmp_path)).collect()}
    assert got["C:\\dir\\f.txt"].path_complete and got["C:\\dir\\f.txt"].size == 9 and str(got["C:\\dir\\f.txt"].fn_btime) == "2013-01-05 18:15:00"
    assert {r.path for r in binary.read_mft(spark, str(tmp_path), resolve=False).collect()} == {".", "dir", "f.txt"}


def test_outputs(spark, tmp_path):
    tb = {
        "process": rows(spark, "process", {"pid": 2, "ppid": 1, "image": "C:\\x\\svchost.exe", "cmdline": "ä" * 100, "signed": False, "start_time": at(3)}),
        "persistence": rows(spark, "persistence", {"mechanism": "run_key", "location": "HKLM\\Run", "command": "a.exe", "signed": True}),
        "file_meta": rows(spark, "file_meta", {"path": "C:\\f", "size": 3, "si_btime": at(1), "fn_btime": at(9)}), "usn_event": rows(spark, "usn_event", {"ts": at(1), "path": "u", "reason": "create"}),
    }
    got = pipeline.run(spark, tb, a.Params(host="h"))
    out = tmp_path / "run"
    m = manifest.write_directory(got.findings, got.observations, str(out), tb, host="h")
    head = (out / "timeline.csv").read_bytes()
    assert head.startswith(b"\xef\xbb\xbf" + ",".join(timeline.COLUMNS).encode() + b"\r\n")
    assert sum(m["findings_by_sev"].values()) == got.findings.count() > 0
    kinds = {json.loads(x)["kind"] for x in (out / "records.jsonl").read_text().splitlines()}
    assert kinds == set(tb)
    first = json.loads((out / "findings.jsonl").read_text().splitlines()[0])
    assert "rule_id" not in first and first["host"] == "h"
    assert {r.status for r in manifest.verify(spark, str(out / "manifest.json"), str(out)).collect()} == {"ok"}
    (out / "findings.jsonl").write_text("changed")
    (out / "observations.jsonl").unlink()
    assert {r.path: r.status for r in manifest.verify(spark, str(out / "manifest.json"), str(out)).collect()} == {"timeline.csv": "ok", "findings.jsonl": "mismatch", "observations.jsonl": "missing", "records.jsonl": "ok"}
    assert "records.jsonl" not in manifest.write_zip(str(out), str(tmp_path / "x.zip"))
    page = report.render(got.findings, got.observations, tb, "A <b>")
    assert "A &lt;b&gt;" in page and "svchost.exe" in page
    (out / "timeline.csv").unlink()
    (out / "timeline.csv").symlink_to(tmp_path / "x")
    with pytest.raises(ValueError, match="symbolic"):
        manifest.write_directory(got.findings, got.observations, str(out))
    lines = {r.line for r in timeline.bodyfile(tb["file_meta"], tb["usn_event"]).collect()}
    assert lines == {"0|C:\\f|0|0|0|0|3|0|0|0|1704067200", "0|u|0|0|0|0|0|0|1704067200|0|0"}
    assert len(manifest.ruleset_digest(tmp_path)) == 64


def test_streams(spark, tmp_path):
    e = rows(spark, "event", *({"ts": at(1, 0, i), "channel": "Security", "event_id": 4625, "record_id": i, "data": {"TargetUserName": "u", "IpAddress": "1.1.1.1"}} for i in range(6)), {"ts": at(3), "channel": "Security", "event_id": 4625, "record_id": 9, "data": {"TargetUserName": "u", "IpAddress": "1.1.1.1"}}, {"ts": at(9), "channel": "Security", "event_id": 4625, "record_id": 10, "data": {"TargetUserName": "z", "IpAddress": "1.1.1.1"}})
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    rule = sigma.parse_rule({"id": "r", "logsource": {"service": "security"}, "detection": {"s": {"TargetUserName": "u"}, "condition": "s"}})
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("hits", match_stream(stream, [rule]).select("record_id"), "append"), ("windows", failures_ahead(stream, 300_000_000, "1 minute"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("hits").count() == 7
    best = {r.anchor_ts: r.failures for r in spark.table("windows").collect()}
    assert best[at(1, 0, 0)] == 6 and best[at(1, 0, 5)] == 1


def test_ordinals_follow_paths_and_lines(spark, tmp_path):
    """Spark deals large files first; the last record by path and line counts all the same."""
    (tmp_path / "in").mkdir()
    for name, n in (("a", 1), ("b", 50), ("c d%", 3), ("e", 400)):
        (tmp_path / "in" / f"{name}.jsonl").write_text("".join(json.dumps({"kind": "process", "pid": 7, "ppid": i, "image": name}) + "\n" for i in range(n)))
    for got in (readers.read_records(spark, str(tmp_path / "in"), "process"), readers.read_all(spark, str(tmp_path / "in"))["process"]):
        ordered = [(r.image, r.ppid) for r in got.orderBy("_ord").collect()]
        assert ordered == [(name, i) for name, n in (("a", 1), ("b", 50), ("c d%", 3), ("e", 400)) for i in range(n)]
        assert [(r.image, r.ppid) for r in joins.last_by_key(got, "pid").collect()] == [("e", 399)]


def test_amcache_of_odd_value_names(spark):
    rows_ = [("h", "k", None, "x", None, 0), ("h", "k", None, "y", None, 1), ("h", "k", "LowerCaseLongPath", "old", None, 2), ("h", "k", "LowerCaseLongPath", "new", None, 3), ("h", "e", None, None, None, 4)]
    reg = spark.createDataFrame(rows_, "hive string, key string, name string, data string, last_write timestamp, _ord bigint")
    assert [(r.path, r.sha1) for r in readers.amcache(reg).collect()] == [("new", None)]


def test_volumes_stay_apart_and_notes(spark, tmp_path, monkeypatch):
    entries = [(v << 48 | rec, name, v << 48 | parent, n) for v, names in enumerate((("one", "f"), ("two", "g"))) for n, (rec, name, parent) in enumerate(((5, ".", 5), (6, names[0], 5), (7, names[1], 6)))]
    df = spark.createDataFrame(entries, "rec long, name string, parent long, _ord long")
    got = {r.rec: r.path for r in joins.mft_paths(df).filter("complete").collect()}
    assert got[7] == "C:\\one\\f" and got[1 << 48 | 7] == "C:\\two\\g"
    (tmp_path / "small").write_bytes(b"ab")
    (tmp_path / "zlarge").write_bytes(b"x" * 100)
    hashes = {r.path.rsplit("/", 1)[1]: (r.sha256, r.size, r.note) for r in binary.file_hashes(spark, str(tmp_path), 50).collect()}
    assert hashes["small"][0] and hashes["small"][2] is None and hashes["zlarge"] == (None, 100, "not hashed: larger than 50 bytes")
    monkeypatch.setattr(binary, "MAX_BLOB", 50)
    assert [(r.size, r.note) for r in binary.skipped_files(spark, str(tmp_path)).collect()] == [(100, "skipped: larger than 50 bytes")]


def test_lists_that_are_cut_say_so(spark, monkeypatch):
    monkeypatch.setattr(report, "LISTED", 2)
    tb = {"process": rows(spark, "process", *({"pid": i, "ppid": 1, "image": "C:\\x\\svchost.exe", "cmdline": "", "signed": False, "start_time": at(3)} for i in range(5)))}
    got = pipeline.run(spark, tb, a.Params())
    page = report.render(got.findings, got.observations, tb, "t")
    assert f"2 of {got.findings.count()} shown, all are in findings.jsonl" in page and "Processes: 2 of 5 shown, all are in records.jsonl" in page
    top = panels.top_alerts(got.findings, 3)
    assert top.count() == 3 and [r.label for r in top.collect()] == sorted(r.label for r in top.collect())


assert FT > FILETIME_EPOCH


def test_task_elements_are_read_as_xpath_reads_them(spark):
    inner = ["<Command>a b</Command>", "<t:Command> x &amp;lt; &lt;y </t:Command>", "<Command/>", '<Command a="1">q</Command>', "<!-- <Command>no</Command> --><Command>yes</Command>", "<Command><![CDATA[c&d]]></Command>"]
    inner += ["<Command>a<b>c</b>d</Command>", "<Command>&#65;b</Command>", "", "<Commands>z</Commands><Command>w</Command><Command>v</Command>", "<?p <Command>n</Command>?><Command>k</Command>", "<Command>a\r\nb</Command>", "<Command></Command><Command>2</Command>", "<Command >s</Command>"]
    df = spark.createDataFrame([(f"<e>{x}</e>",) for x in inner], "block string")
    parsed = F.trim(F.expr("""xpath_string(block, 'string(//*[local-name()="Command"])')"""))
    assert [r for r in df.select("block", readers._element("block", "Command").alias("got"), parsed.alias("want")).collect() if r.got != r.want] == []
    loose = spark.createDataFrame([("<e><br><Command>a</Command></e>",)], "block string")  # no parser reads this: it isn't parsed
    assert loose.select(readers._element("block", "Command").alias("c")).first().c == "a"
