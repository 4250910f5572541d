"""Column functions over numbers, times, addresses and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports of ordinary traffic, labels of codes and flags.
COMMON_PORTS = (80, 443, 53, 22, 3389, 445, 135, 139, 21, 25, 587, 993, 143, 110)
INTEGRITY_LABELS = {0x0000: "untrusted", 0x1000: "low", 0x2000: "medium", 0x3000: "high", 0x4000: "system"}
TCP_STATES = ("closed", "listen", "syn_sent", "syn_rcvd", "established", "fin_wait1", "fin_wait2", "close_wait", "closing", "last_ack", "time_wait", "delete_tcb")
USN_REASONS = (
    (0x00000001, "data_overwrite"), (0x00000002, "data_extend"), (0x00000004, "data_truncation"), (0x00000010, "named_data_overwrite"), (0x00000020, "named_data_extend"),
    (0x00000040, "named_data_truncation"), (0x00000100, "create"), (0x00000200, "delete"), (0x00000400, "ea_change"), (0x00000800, "security_change"), (0x00001000, "rename_old_name"),
    (0x00002000, "rename_new_name"), (0x00004000, "indexable_change"), (0x00008000, "basic_info_change"), (0x00010000, "hard_link_change"), (0x00020000, "compression_change"),
    (0x00040000, "encryption_change"), (0x00080000, "object_id_change"), (0x00100000, "reparse_point_change"), (0x00200000, "stream_change"), (0x00400000, "integrity_change"), (0x80000000, "close"),
)
FILETIME_EPOCH = 116_444_736_000_000_000
DAY_US = 86_400_000_000


def filetime(ft: Column) -> Column:
    """A Windows FILETIME as a timestamp; zero and times before 1970 are null."""
    ticks = ft.cast("bigint") - F.lit(FILETIME_EPOCH)
    return F.when(ticks >= 0, F.timestamp_micros(F.call_function("div", ticks, F.lit(10).cast("bigint"))))


def rare_port(port: Column) -> Column:
    return ~port.isin(*COMMON_PORTS)


def _octets(addr: Column) -> list[Column]:
    return [F.split(addr, r"\.")[i].try_cast("int") for i in range(4)]


def is_ipv4(addr: Column) -> Column:
    """A strict dotted quad: no leading zeros, nothing above 255."""
    part = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.rlike(addr, F.lit(rf"^{part}(\.{part}){{3}}$"))


def public_ipv4(addr: Column) -> Column:
    """A routable public IPv4 address; false for anything else, null included."""
    a, b, c, _ = _octets(addr)
    reserved = (
        (a == 10) | (a == 127) | (a == 0) & (b == 0) & (c == 0) & (F.split(addr, r"\.")[3] == "0") | (a >= 224)
        | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.coalesce(F.when(is_ipv4(addr), ~reserved), F.lit(False))


def public_hint(addr: Column) -> Column:
    """The looser test that panels sort by."""
    a, b, _, _ = _octets(addr)
    near = (a == 10) | (a == 127) | (addr == "0.0.0.0") | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    return F.coalesce(F.when(is_ipv4(addr), ~near), F.lit(False))


def integrity_label(rid: Column) -> Column:
    out = F.lit("")
    for k, v in INTEGRITY_LABELS.items():
        out = F.when(rid == k, v).otherwise(out)
    return out


def tcp_state(code: Column) -> Column:
    out = code.cast("string")
    for k, v in enumerate(TCP_STATES, 1):
        out = F.when(code == k, v).otherwise(out)
    return out


def usn_reason(mask: Column) -> Column:
    """Names of the set bits in their fixed order, joined by a bar."""
    names = (F.when(mask.bitwiseAND(F.lit(bit).cast("bigint")) != 0, F.lit(name)) for bit, name in USN_REASONS)
    return F.array_join(F.array_compact(F.array(*names)), "|")


def le_uint(data: Column, offset: Column | int, size: int) -> Column:
    """An unsigned little-endian number of up to 7 bytes; null past the end."""
    part = F.substring(data, F.lit(offset) + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(_reversed_hex(part, size), 16, 10).cast("bigint"))


def _reversed_hex(part: Column, size: int) -> Column:
    return F.concat(*(F.hex(F.substring(part, i, 1)) for i in range(size, 0, -1)))


def within_days(ts: Column, as_of: Column, days: int) -> Column:
    """0 <= age <= days: the future doesn't count; null for a null time."""
    return (F.unix_micros(as_of) - F.unix_micros(ts)).between(0, days * DAY_US)


def age_days(ts: Column, as_of: Column) -> Column:
    return ((F.unix_micros(as_of) - F.unix_micros(ts)) / DAY_US).cast("bigint")


def severity_rank(weight: Column) -> Column:
    """Severity rank of a score; null below the floor of 15."""
    return F.when(weight >= 70, 4).when(weight >= 50, 3).when(weight >= 30, 2).when(weight >= 15, 1)


def escalated(rank: Column) -> Column:
    return F.least(rank + 1, F.lit(4))


def timestomp_rank(delta_us: Column) -> Column:
    return F.when(delta_us > 365 * DAY_US, 4).when(delta_us > 30 * DAY_US, 3).otherwise(2)


def humanized(delta_us: Column) -> Column:
    """Whole days if there is one, else whole hours."""
    days, hours = (F.floor(delta_us / n).cast("bigint").cast("string") for n in (DAY_US, DAY_US // 24))
    return F.when(delta_us >= DAY_US, F.concat(days, F.lit("d"))).otherwise(F.concat(hours, F.lit("h")))


def timing_hint(last_write: Column, as_of: Column) -> Column:
    """A phrase for how long ago an entry was added."""
    recent = F.concat(F.lit("added "), age_days(last_write, as_of).cast("string"), F.lit(" days ago"))
    return F.when(last_write.isNull(), "time unknown").when(within_days(last_write, as_of, 30), recent).otherwise("added long ago")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
