"""Views of the driver's tables as record tables.

The SQL is made of casts, CASE, integer arithmetic and string functions alone, so the same text
runs in Spark and in the oracle's engine.  chr(92) is the backslash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.analyzers import Tables

_DIRS = "case {k} % 5 when 0 then concat('C:', chr(92), 'Windows', chr(92), 'System32') when 1 then concat('C:', chr(92), 'Users', chr(92), 'bob', chr(92), 'AppData', chr(92), 'Local', chr(92), 'Temp') when 2 then concat('C:', chr(92), 'ProgramData') when 3 then concat('C:', chr(92), 'Program Files', chr(92), 'App') else concat('D:', chr(92), 'Temp') end"
_NAMES = "case {n} % 9 when 0 then 'cmd.exe' when 1 then 'powershell.exe' when 2 then 'WINWORD.EXE' when 3 then 'wscript.exe' when 4 then 'svchost.exe' when 5 then 'rundll32.exe' when 6 then 'excel.exe' when 7 then 'mshta.exe' else concat('app', cast({k} as varchar(20)), '.exe') end"


def _path(k: str, n: str) -> str:
    return f"concat({_DIRS.format(k=k)}, chr(92), {_NAMES.format(n=n, k=k)})"


SQL = {
    "event_flat": """
select cast(ts as timestamp) as ts, case when event_type = 'click' then 'System' else 'Security' end as channel,
  cast(case event_type when 'error' then 4625 when 'signup' then 4624 when 'purchase' then 4720 when 'view' then 4732 else 7045 end as bigint) as event_id,
  'auth' as provider, concat('host', cast(user_id % 3 as varchar(20))) as computer, event_id as record_id, event_id as _ord,
  concat('u', cast(user_id as varchar(20))) as target_user, case when user_id % 10 = 9 then '-' else concat('10.0.0.', cast(user_id % 10 as varchar(20))) end as ip,
  case when user_id % 20 = 9 then '-' else concat('WS', cast(user_id % 4 as varchar(20))) end as station, concat('m', cast(event_id % 17 as varchar(20))) as member,
  concat('C:', chr(92), 'Tools', chr(92), event_type, '.exe') as image, concat(event_type, '.exe -p', cast(user_id % 10 as varchar(20)), case when event_id % 2 = 0 then ' -Run ' else ' /quiet ' end, 'x') as cmdline
from {events}""",
    "process": f"""
select p_partkey as pid, p_partkey % 97 + 1 as ppid, {_path('p_partkey', 'p_size')} as image,
  case p_partkey % 7 when 0 then 'x -enc QUJDREVGR0hJSktMTU5PUFFSU1RVVg==' when 1 then 'x http://e.example' when 2 then '' when 3 then 'x /i:scrobj.dll' else 'x -k run' end as cmdline,
  case p_size % 3 when 0 then true when 1 then false end as signed, cast(null as varchar(20)) as signer, cast(null as varchar(20)) as binary_sha256,
  case p_partkey % 4 when 0 then 'high' when 1 then 'system' when 2 then 'medium' end as integrity, 'bob' as user_name,
  timestamp '2024-01-01 00:00:00' + interval '1' minute * p_partkey as start_time, p_partkey as _ord
from {{part}}
union all
select p_partkey, p_partkey % 97 + 1, concat('C:', chr(92), 'Temp', chr(92), 'late.exe'), '', false, cast(null as varchar(20)), cast(null as varchar(20)), 'high', 'eve',
  timestamp '2024-01-02 00:00:00' + interval '1' minute * p_partkey, p_partkey + 1000000000
from {{part}} where p_partkey % 50 = 0""",
    "net_conn": """
select 'tcp' as proto, '10.0.0.1' as laddr, cast(l_linenumber * 500 as int) as lport,
  case when l_orderkey % 11 = 0 then null else concat(cast(l_suppkey % 250 + 1 as varchar(20)), '.', cast(l_partkey % 256 as varchar(20)), '.', cast(l_orderkey % 256 as varchar(20)), '.', cast(l_linenumber as varchar(20))) end as raddr,
  cast(case l_orderkey % 5 when 0 then 443 when 1 then 4444 when 2 then 0 when 3 then 8081 end as int) as rport,
  case l_linenumber % 3 when 0 then 'listen' when 1 then 'established' end as state, l_partkey as pid, l_orderkey * 8 + l_linenumber as _ord
from {lineitem}""",
    "persistence": f"""
select case c_custkey % 7 when 0 then 'winlogon' when 1 then 'ifeo' when 2 then 'wmi_subscription' when 3 then 'startup' when 4 then 'run_key' when 5 then 'service' else 'scheduled_task' end as mechanism,
  concat('HKLM', chr(92), 'Software', chr(92), 'K', cast(c_custkey as varchar(20))) as location,
  case c_custkey % 3 when 0 then 'Shell' when 1 then 'Userinit' end as value,
  case when c_custkey % 7 = 0 then case c_nationkey % 4 when 0 then 'Explorer.exe' when 1 then concat('%SystemRoot%', chr(92), 'System32', chr(92), 'userinit.exe,') when 2 then 'evil.exe' end
    else case c_custkey % 6 when 0 then 'powershell.exe -enc AAAA' when 1 then 'cmd.exe /c run.bat' when 2 then 'Eval(x)' when 3 then 'mshta http://e.example' when 4 then 'app.exe -q' end end as command,
  case c_nationkey % 6 when 1 then concat('C:', chr(92), 'Windows', chr(92), 'System32', chr(92), 'svchost.exe') when 2 then concat('C:', chr(92), 'Users', chr(92), 'bob', chr(92), 'AppData', chr(92), 'Roaming', chr(92), 'svchost.exe')
    when 3 then concat('C:', chr(92), 'Users', chr(92), 'Public', chr(92), 'pub', cast(c_custkey as varchar(20)), '.exe') when 4 then {_path('c_custkey', '8')} when 5 then concat('D:', chr(92), 'Tools', chr(92), 'app', cast(c_custkey as varchar(20)), '.exe') end as binary_path,
  cast(null as varchar(20)) as binary_sha256, case c_custkey % 5 when 0 then true when 1 then false when 2 then false end as signed, cast(null as varchar(20)) as signer,
  timestamp '2024-02-02 00:00:00' - interval '1' hour * (c_custkey % 400) as last_write, c_custkey as _ord
from {{customer}}""",
    "execution": f"""
select case o_orderkey % 8 when 0 then 'prefetch' when 1 then 'amcache' when 2 then 'shimcache' when 3 then 'bam' when 4 then 'userassist' when 5 then 'srum_app' when 6 then 'srum_net' else 'amcache_driver' end as source,
  case when o_orderkey % 40 = 7 then {_path('o_orderkey', 'o_custkey')} when o_orderkey % 3 = 0 then concat('D:', chr(92), 'Tools', chr(92), 'APP', cast(o_custkey as varchar(20)), '.exe')
    when o_orderkey % 3 = 1 then concat('app', cast(o_custkey as varchar(20)), '.exe') else concat('C:', chr(92), 'x', chr(92), 'pub', cast(o_custkey as varchar(20)), '.exe') end as path,
  case when o_orderkey % 9 = 0 then null else timestamp '2024-02-02 00:00:00' - interval '1' hour * (case when o_orderkey % 40 = 7 then o_orderkey % 300 else o_orderkey % 2000 end) end as first_run, cast(null as timestamp) as last_run, cast(o_orderkey % 50 as bigint) as run_count,
  case when o_orderkey % 6 = 0 then null else lpad(cast(o_custkey % 100 as varchar(20)), 40, '0') end as sha1, cast(null as varchar(20)) as user_sid, true as execution_confirmed, o_orderkey as _ord
from {{orders}}""",
    "file_meta": """
select concat('C:', chr(92), 'f', cast(l_orderkey as varchar(20)), chr(92), cast(l_linenumber as varchar(20))) as path, l_partkey as size, cast(null as varchar(20)) as sha256,
  cast(o_orderdate as timestamp) as si_btime, case when l_linenumber % 2 = 0 then cast(o_orderdate as timestamp) end as si_mtime, cast(l_shipdate as timestamp) as fn_btime,
  cast(o_orderdate as timestamp) + interval '1' day as fn_mtime, cast(null as varchar(20)) as zone_identifier, true as path_complete, l_orderkey * 8 + l_linenumber as _ord
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "usn_event": """
select cast(ts as timestamp) as ts, concat('C:', chr(92), 'u', cast(user_id as varchar(20)), chr(92), 'f.txt') as path,
  case event_type when 'view' then 'create' when 'click' then 'rename_new_name' else 'close' end as reason, event_id as mft_ref, event_id as _ord
from {events}""",
    "mft": "select p_partkey + 4 as rec, case when p_partkey = 1 then '.' else concat('n', cast(p_partkey as varchar(20))) end as name, case when p_partkey = 1 then 5 when p_partkey % 41 = 0 then 900000000 when p_partkey = 60 then p_partkey + 4 + 60 else cast(floor(p_partkey / 2) as bigint) + 4 end as parent, p_partkey as _ord from {part}",
}
_USED = {k: sorted(set(re.findall(r"\{(\w+)\}", s))) for k, s in SQL.items()}


def view(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.sql(SQL[kind], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _USED[kind]})


def oracle(kind: str) -> str:
    return SQL[kind].format(**{t: t for t in _USED[kind]})


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event records, with their data map."""
    flat = view(spark, sf_dir, "event_flat")
    fields = {"TargetUserName": "target_user", "IpAddress": "ip", "WorkstationName": "station", "MemberName": "member", "Image": "image", "CommandLine": "cmdline"}
    pairs = [x for k, c in fields.items() for x in (F.lit(k), F.col(c))] + [F.lit("EventID"), F.col("event_id").cast("string"), F.lit("ImagePath"), F.col("image")]
    return flat.select("ts", "channel", "event_id", "provider", "computer", "record_id", F.create_map(*pairs).alias("data"), "_ord")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All record tables."""
    process = view(spark, sf_dir, "process").withColumnRenamed("user_name", "user")
    return {"event": event(spark, sf_dir), "process": process} | {k: view(spark, sf_dir, k) for k in ("net_conn", "persistence", "execution", "file_meta", "usn_event")}
