import json

from quarrylens.__main__ import main


def test_run_and_verify(spark, tmp_path):
    lines = [
        {"kind": "process", "pid": 2, "ppid": 1, "image": "C:\\x\\svchost.exe", "cmdline": "", "start_time": "2024-01-01T00:00:00Z"},
        {"kind": "event", "ts": "2024-01-01T00:00:00Z", "channel": "Security", "event_id": 4720, "computer": "h", "record_id": 5, "data": {"EventID": 4720, "TargetUserName": "anna"}},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    out = tmp_path / "out"
    assert main(["run", str(tmp_path / "r.jsonl"), str(out), "--host", "h1", "--zip", str(tmp_path / "o.zip")]) == 0
    found = [json.loads(x) for x in (out / "findings.jsonl").read_text().splitlines()]
    assert {"heur_parentchild", "heur_account", "sigma"} <= {f["analyzer"] for f in found} and (out / "report.html").exists() and (tmp_path / "o.zip").exists()
    assert main(["verify", str(out)]) == 0
    (out / "timeline.csv").write_text("x")
    assert main(["verify", str(out)]) == 1
