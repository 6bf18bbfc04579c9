"""Column functions: decoding and cleaning of artifact fields. All are Spark expressions, none a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible code points, as a character class of Java's regular expressions.
INVISIBLE = r"\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}\x{e0001}-\x{e007f}\x{e0100}-\x{e01ef}"
DIRTY = rf"[<>\x00-\x1f{INVISIBLE}]"
# Account classes by SID and by the last number of a SID.
SYSTEM_SIDS = ("S-1-5-18", "S-1-5-19", "S-1-5-20")
RID_STATUS = {500: "builtin_admin", 501: "builtin_guest", 503: "builtin_default", 504: "builtin_wdag", 1001: "orphan_oobe"}
# Hash labels and their hex lengths.
HASHES = {"SHA1": 40, "MD5": 32, "SHA256": 64, "IMPHASH": 32}
EPOCH_1601_US = 11_644_473_600_000_000
SIZE_LIMIT = 1 << 40


def filetime_to_ts(value: Column) -> Column:
    """100 ns units since 1601 (decimal or long) -> timestamp; null for 0, less, the 1601 second itself and years over 9999."""
    ft = value.cast("decimal(20,0)")
    ok = (ft >= 10_000_000) & (ft < 2_650_467_744_000_000_000)
    return F.when(ok, F.timestamp_micros(F.floor(ft / 10).cast("long") - EPOCH_1601_US))


def to_bytes(value: Column) -> Column:
    """Hex text -> binary; null if it isn't hex."""
    return F.when(value.rlike(r"\A([0-9a-fA-F]{2})*\z"), F.unhex(value))


def little_endian(hex_text: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian number of ``size`` bytes at a byte offset of hex text, as decimal(20,0); null if too short."""
    parts = [F.substring(hex_text, 2 * (offset + k) + 1, 2) for k in reversed(range(size))]
    return F.when(F.length(hex_text) >= 2 * (offset + size), F.conv(F.concat(*parts), 16, 10).cast("decimal(20,0)"))


def rot13(value: Column) -> Column:
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(value, lower + upper, lower[13:] + lower[:13] + upper[13:] + upper[:13])


def coerce_size(value: Column) -> Column:
    """Decimal or 0x text -> long in 0 .. 2**40, else 0."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"\A0[xX][0-9a-fA-F]{1,15}\z"), F.conv(F.substring(text, 3, 20), 16, 10)).when(text.rlike(r"\A[0-9]{1,18}\z"), text).cast("long")
    return F.when(number.between(0, SIZE_LIMIT), number).otherwise(F.lit(0).cast("long"))


def coerce_uint32(value: Column) -> Column:
    return F.when(value.between(0, (1 << 32) - 1), value.cast("long")).otherwise(F.lit(0).cast("long"))


def strip_file_id(value: Column) -> Column:
    """0000 and 40 hex digits -> the digits in lower case, else 40 zeros."""
    return F.when(value.rlike(r"\A0000[0-9a-fA-F]{40}\z"), F.lower(F.substring(value, 5, 40))).otherwise(F.lit("0" * 40))


def extract_rid(sid: Column) -> Column:
    return F.substring_index(sid, "-", -1).try_cast("int")


def classify_sid(sid: Column) -> Column:
    out = F.when(sid.isin(*SYSTEM_SIDS), F.lit("system_account"))
    for rid, status in RID_STATUS.items():
        out = out.when(sid.startswith("S-1-5-21-") & (extract_rid(sid) == rid), F.lit(status))
    return out.otherwise(F.lit("user_unverified"))


def parse_hashes(text: Column) -> dict[str, Column]:
    """One column for each label: the last valid value of a comma-separated K=V list, in lower case; else null."""
    parts = F.split(text, ",")
    out = {}
    for label, size in HASHES.items():
        fits = F.filter(parts, lambda p: F.trim(p).rlike(rf"\A(?i:{label})=[0-9a-fA-F]{{{size}}}\z"))
        out[label] = F.lower(F.substring_index(F.trim(F.try_element_at(fits, F.lit(-1))), "=", -1))
    return out


def is_dirty(value: Column) -> Column:
    return value.rlike(DIRTY)


def clean(value: Column, longest: int) -> Column:
    """The value, or null if it is dirty or too long."""
    return F.when(~is_dirty(value) & (F.length(value) <= longest), value)


def clean_command_line(value: Column, longest: int = 4096) -> Column:
    """Empty if dirty; cut and marked if too long."""
    return F.when(is_dirty(value), F.lit("")).when(F.length(value) > longest, F.concat(F.substring(value, 1, longest), F.lit("..."))).otherwise(value)


def clean_prefetch_hash(value: Column) -> Column:
    return F.when(value.rlike(r"\A[0-9a-fA-F]{1,16}\z"), F.lower(value)).otherwise(F.lit(""))


def nt_basename(path: Column) -> Column:
    return F.substring_index(path, "\\", -1)


def safe_field(value: Column, longest: int) -> Column:
    """Dirty characters as ``?``; cut to ``longest`` and marked."""
    plain = F.regexp_replace(value, DIRTY, "?")
    return F.when(F.length(plain) > longest, F.concat(F.substring(plain, 1, longest), F.lit("..."))).otherwise(plain)


def token_usage(usage: Column) -> tuple[Column, Column]:
    """(tokens in, tokens out) of a struct input, cache_read, cache_write, output; missing counts are 0."""
    part = lambda name: F.coalesce(usage[name], F.lit(0))
    return part("input") + part("cache_read") + part("cache_write"), part("output")


def between_tags(text: Column) -> Column:
    """The last <answer> tag's content, else the whole text; trimmed."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1))
    return F.trim(F.coalesce(F.try_element_at(found, F.lit(-1)), text))
