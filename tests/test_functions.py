import pytest
from pyspark.sql import functions as F

from quarrylens.functions import text as t
from quarrylens.functions import values as v


def col(spark, kind, value, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("weight", "rank"), [(14, None), (15, 1), (29, 1), (30, 2), (49, 2), (50, 3), (69, 3), (70, 4), (500, 4)])
def test_severity_bands(spark, weight, rank):
    assert col(spark, "int", weight, v.severity_rank) == rank


@pytest.mark.parametrize(("addr", "public"), [
    ("8.8.8.8", True), ("10.1.2.3", False), ("172.16.0.1", False), ("172.32.0.1", True), ("192.168.1.1", False), ("127.0.0.1", False), ("169.254.1.1", False), ("100.64.0.1", False), ("100.63.0.1", True),
    ("198.18.0.1", False), ("192.0.2.1", False), ("203.0.113.9", False), ("224.0.0.1", False), ("240.0.0.1", False), ("255.255.255.255", False), ("0.0.0.0", False), ("1.2.3", False), ("01.2.3.4", False), ("::1", False), ("evil", False), (None, False),
])
def test_public_ipv4(spark, addr, public):
    assert col(spark, "string", addr, v.public_ipv4) is public


def test_filetime(spark):
    assert str(col(spark, "bigint", 130018833000000000, v.filetime)) == "2013-01-05 18:15:00"
    assert col(spark, "bigint", 0, v.filetime) is None
    assert col(spark, "bigint", 1, v.filetime) is None
    assert str(col(spark, "bigint", v.FILETIME_EPOCH, v.filetime)) == "1970-01-01 00:00:00"


@pytest.mark.parametrize(("path", "yes"), [("D:\\x\\svchost.exe", True), ("C:\\Windows\\svchost.exe", False), ("E:\\WINDOWS\\System32\\lsass.exe", False), ("svchost.exe", False), ("C:\\x\\app.exe", False)])
def test_masquerade(spark, path, yes):
    assert col(spark, "string", path, t.masquerade) is yes


@pytest.mark.parametrize(("value", "command", "stock"), [
    ("Shell", " Explorer.EXE ", True), ("Shell", "explorer.exe, evil.exe", False), ("Userinit", "C:\\Windows\\system32\\userinit.exe,", True), ("Userinit", "%SystemRoot%\\system32\\userinit.exe", True),
    ("Userinit", "userinit.exe", True), ("Userinit", "D:\\Windows\\system32\\userinit.exe", False), ("Other", "explorer.exe", False), (None, "explorer.exe", False), ("Shell", None, False),
])
def test_winlogon(spark, value, command, stock):
    df = spark.createDataFrame([(value, command)], "v string, c string")
    assert df.select(t.winlogon_default(F.col("v"), F.col("c"))).first()[0] is stock


@pytest.mark.parametrize(("command", "yes"), [
    ("%SystemRoot%\\System32\\svchost.exe -k x", True), ("C:\\Windows\\SysWOW64\\a.exe", True), ("system32\\drivers\\a.sys", True), ('"system32\\a.exe"', True), ("C:\\Windows\\System32\\DriverStore\\x.sys", False), ("C:\\x\\a.exe", False), ("", False), (None, False),
])
def test_inbox_service(spark, command, yes):
    assert col(spark, "string", command, t.inbox_service) is yes


@pytest.mark.parametrize(("raw", "full", "key", "bare"), [
    (' "C:\\A\\B.EXE" ', True, "c:\\a\\b.exe", "b"), ("App.exe", False, "app", "app"), ("id:42", False, "id:42", "id:42"), ("a/b.exe.exe", True, "a/b.exe.exe", "b.exe"), ("", False, "", ""),
])
def test_join_keys(spark, raw, full, key, bare):
    df = spark.createDataFrame([(raw,)], "x string").withColumn("k", t.join_key(F.col("x")))
    assert tuple(df.select("k.full", "k.key", t.degraded_key(F.col("k"))).first()) == (full, key, bare)


def test_service_paths(spark):
    for raw, out in (("\\??\\C:\\a.sys", "C:\\a.sys"), ("\\systemroot\\x\\b.sys", "C:\\Windows\\x\\b.sys"), ("%SystemRoot%\\c", "C:\\Windows\\c"), ("System32\\d.sys", "C:\\Windows\\System32\\d.sys"), ("D:\\e", "D:\\e"), ("\\\\srv\\f", "\\\\srv\\f")):
        assert col(spark, "string", raw, t.service_path) == out


def test_candidates(spark):
    assert col(spark, "string", '"C:\\a b\\c.exe" -x', t.path_candidates) == ["C:\\a b\\c.exe"]
    assert col(spark, "string", "C:\\a b\\c.exe -x", t.path_candidates) == ["C:\\a b\\c.exe -x", "C:\\a b\\c.exe", "C:\\a"]
    assert col(spark, "string", "  ", t.path_candidates) == []
    assert col(spark, "string", "%windir%\\x.exe", lambda c: t.expand_env(c, {"WINDIR": "C:\\W$1"})) == "C:\\W$1\\x.exe"


def test_small_scalars(spark):
    assert col(spark, "bigint", 0x80000100, v.usn_reason) == "create|close"
    assert col(spark, "bigint", 0, v.usn_reason) == ""
    assert col(spark, "string", "Uryyb.rkr", t.rot13) == "Hello.exe"
    assert col(spark, "string", "0000" + "AB" * 20, t.sha1_from_file_id) == "ab" * 20
    assert col(spark, "string", "0001" + "AB" * 20, t.sha1_from_file_id) is None
    assert col(spark, "int", 1, t.controlset_name) == "ControlSet001"
    assert col(spark, "string", "A/B", t.channel_file) == "A%4B.evtx"
    assert col(spark, "string", "A%4B.evtx", t.file_channel) == "A/B"
    assert col(spark, "string", "stopped (cap=250)", t.parse_cap) == 250
    assert col(spark, "string", "none", t.parse_cap) is None
    assert col(spark, "string", "HKLM\\x", t.hive_prefix) == "HKLM"
    assert col(spark, "int", 2, v.tcp_state) == "listen"
    assert col(spark, "int", 99, v.tcp_state) == "99"
    assert col(spark, "int", 0x3000, v.integrity_label) == "high"
    assert col(spark, "int", 7, v.integrity_label) == ""
    assert col(spark, "binary", b"\x01\x02\x00\xff", lambda c: v.le_uint(c, 0, 4)) == 0xFF000201
    assert col(spark, "binary", b"\x01\x02", lambda c: v.le_uint(c, 1, 4)) is None
    assert col(spark, "bigint", 3 * v.DAY_US + 5, v.humanized) == "3d"
    assert col(spark, "bigint", v.DAY_US - 1, v.humanized) == "23h"
