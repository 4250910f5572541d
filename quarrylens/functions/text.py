"""Column functions over paths, commands and other text.  All of them are built-in expressions."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories, names and words that the rules look for.
SUSPICIOUS_DIRS = ("\\temp\\", "\\appdata\\", "\\programdata\\", "\\downloads\\", "\\public\\")
USER_WRITABLE_DIRS = ("\\temp\\", "\\appdata\\roaming\\", "\\appdata\\local\\temp\\", "\\downloads\\", "\\public\\", "\\programdata\\")
TRUSTED_APPDATA = "\\appdata\\local\\programs\\"
PROTECTED_NAMES = ("svchost.exe", "lsass.exe", "csrss.exe", "winlogon.exe", "services.exe", "smss.exe", "wininit.exe", "explorer.exe", "rundll32.exe", "dllhost.exe", "taskhostw.exe")
WINLOGON_SHELL = "explorer.exe"
WINLOGON_USERINIT = ("c:\\windows\\system32\\userinit.exe", "userinit.exe")
POWERSHELLS = ("powershell.exe", "pwsh.exe")


def ascii_lower(c: Column) -> Column:
    """Lower case for A to Z alone: other letters keep their case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def base_name(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_extract(path, r"[^\\/]*$", 0)


def short_name(path: Column) -> Column:
    return base_name(F.btrim(path, F.lit('"')))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def suspicious_path(path: Column) -> Column:
    return contains_any(ascii_lower(path), SUSPICIOUS_DIRS)


def user_writable(path: Column) -> Column:
    return contains_any(ascii_lower(path), USER_WRITABLE_DIRS)


def trusted_appdata(path: Column) -> Column:
    return F.contains(ascii_lower(path), F.lit(TRUSTED_APPDATA))


def _after_drive(path: Column) -> Column:
    return F.substring(ascii_lower(path), F.lit(2), F.char_length(path))


def under_windows(path: Column) -> Column:
    """An absolute path in the Windows tree of any drive."""
    return F.startswith(_after_drive(path), F.lit(":\\windows\\"))


def system_or_program_files(path: Column) -> Column:
    return under_windows(path) | F.startswith(_after_drive(path), F.lit(":\\program files"))


def drive_absolute(path: Column) -> Column:
    return F.startswith(F.substring(path, F.lit(2), F.char_length(path)), F.lit(":\\"))


def masquerade(path: Column) -> Column:
    """A protected system name at an absolute path outside the Windows tree."""
    return drive_absolute(path) & ~under_windows(path) & ascii_lower(base_name(path)).isin(*PROTECTED_NAMES)


def absolute_path(path: Column) -> Column:
    """A drive letter, colon and separator, or a UNC prefix."""
    return F.rlike(path, F.lit(r"^[A-Za-z]:[\\/]")) | F.startswith(path, F.lit("\\\\"))


def winlogon_default(value: Column, command: Column) -> Column:
    """Whether a Winlogon value is stock; null inputs are not."""
    norm = F.regexp_replace(ascii_lower(F.trim(command)), ",$", "")
    norm = F.regexp_replace(norm, r"^%(systemroot|windir)%", r"c:\\windows")
    stock = F.when(value == "Shell", norm == WINLOGON_SHELL).when(value == "Userinit", norm.isin(*WINLOGON_USERINIT))
    return F.coalesce(stock, F.lit(False))


def inbox_service(command: Column) -> Column:
    """A service binary that Windows ships (System32 or SysWOW64, not DriverStore)."""
    low = ascii_lower(F.trim(command))
    norm = F.regexp_replace(low, r"^(%systemroot%\\|%windir%\\|\\systemroot\\|[a-z]:\\windows\\)", r"<win>\\")
    inside = F.rlike(norm, F.lit(r'^(<win>\\|"?)(system32|syswow64)\\'))
    return F.coalesce(inside & ~F.contains(norm, F.lit("\\driverstore\\")), F.lit(False))


def has_base64_run(text: Column) -> Column:
    return F.rlike(text, F.lit("[A-Za-z0-9+/=]{16}"))


def encoded_powershell(name: Column, cmdline: Column) -> Column:
    low = ascii_lower(cmdline)
    flag = F.contains(low, F.lit("-enc")) | (F.contains(low, F.lit("-e ")) & name.isin(*POWERSHELLS))
    return flag & has_base64_run(cmdline)


def lolbas_arguments(cmdline: Column) -> Column:
    return contains_any(ascii_lower(cmdline), ("http", "scrobj", "/i:")) | has_base64_run(cmdline)


def normalized_path(raw: Column) -> Column:
    return ascii_lower(F.btrim(F.trim(raw), F.lit('"')))


def join_key(raw: Column) -> Column:
    """struct(full, key): the whole normalized path, or a bare name without .exe."""
    return join_key_of(normalized_path(raw))


def join_key_of(norm: Column) -> Column:
    """join_key of a path that is normalized already; best a column, as it is looked at several times."""
    full = F.contains(norm, F.lit("\\")) | F.contains(norm, F.lit("/"))
    return F.struct(full.alias("full"), F.when(full, norm).otherwise(strip_exe(norm)).alias("key"))


def strip_exe(name: Column) -> Column:
    return F.regexp_replace(name, r"\.exe$", "")


def degraded_key(key: Column) -> Column:
    """The bare name that a join key falls back to."""
    return F.when(key["full"], strip_exe(base_name(key["key"]))).otherwise(key["key"])


def rot13(text: Column) -> Column:
    up, low = string.ascii_uppercase, string.ascii_lowercase
    return F.translate(text, up + low, up[13:] + up[:13] + low[13:] + low[:13])


def service_path(path: Column, windir: str = "C:\\Windows") -> Column:
    """A service's ImagePath as an absolute path."""
    root = windir.rstrip("\\/") + "\\"
    plain = F.regexp_replace(path, r"^\\\?\?\\", "")
    rooted = F.regexp_extract(path, r"(?is)^(?:\\systemroot\\|%systemroot%\\)(.*)$", 1)
    is_rooted = F.rlike(path, F.lit(r"(?i)^(\\systemroot\\|%systemroot%\\)"))
    return (
        F.when(F.startswith(path, F.lit("\\??\\")), plain)
        .when(is_rooted, F.concat(F.lit(root), rooted))
        .when(F.rlike(path, F.lit(r"^.:")) | F.startswith(path, F.lit("\\\\")), path)
        .otherwise(F.concat(F.lit(root), F.regexp_replace(path, r"^[\\/]+", "")))
    )


def expand_env(text: Column, variables: dict[str, str]) -> Column:
    """%NAME% replaced for the names given, whatever their case; others stay."""
    for name, value in variables.items():
        text = F.regexp_replace(text, f"(?i)%{name}%", value.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def path_candidates(command: Column) -> Column:
    """Candidate binaries of a command line, longest first: the quoted part, or each prefix before a space."""
    line = F.trim(command)
    quoted = F.regexp_extract(line, r'^"([^"]*)', 1)
    words = F.split(line, " ")
    prefixes = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    found = F.when(F.startswith(line, F.lit('"')), F.array(quoted)).when(F.size(words) > 1, prefixes).otherwise(F.array(line))
    found = F.array_distinct(F.filter(found, lambda x: x != ""))
    return F.coalesce(found, F.array().cast("array<string>"))


def pick_path(candidates: Column, exists: Column) -> Column:
    """The first candidate in an array of known files, else the last candidate."""
    known = F.filter(candidates, lambda c: F.array_contains(exists, c))
    return F.when(F.size(known) > 0, F.get(known, F.lit(0))).when(F.size(candidates) > 0, F.element_at(candidates, -1))


def sha1_from_file_id(file_id: Column) -> Column:
    return F.when(F.rlike(file_id, F.lit("^0000[0-9A-Fa-f]{40}$")), F.lower(F.substring(file_id, 5, 40)))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def controlset_name(n: Column) -> Column:
    return F.format_string("ControlSet%03d", n.cast("int"))


def channel_file(channel: Column) -> Column:
    return F.concat(F.replace(channel, F.lit("/"), F.lit("%4")), F.lit(".evtx"))


def file_channel(name: Column) -> Column:
    return F.replace(F.regexp_replace(name, r"\.evtx$", ""), F.lit("%4"), F.lit("/"))


def parse_cap(note: Column) -> Column:
    return F.nullif(F.regexp_extract(note, r"\(cap=(\d+)\)", 1), F.lit("")).try_cast("bigint")


def hive_prefix(location: Column) -> Column:
    return F.when(F.startswith(location, F.lit("HK")), F.split(location, r"[\\/]")[0]).otherwise(F.lit(""))


def logon_type(station: Column) -> Column:
    return F.when(F.startswith(ascii_lower(station), F.lit("rdp-tcp")), "RemoteInteractive").otherwise("Interactive")


def data_or_dash(data: Column, key: str) -> Column:
    """A field of an event's data, or a dash."""
    return F.coalesce(F.element_at(data, key), F.lit("-"))
