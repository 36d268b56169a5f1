"""Exact conversions between sample indexes and UTC at a rational rate num/den Hz, as integer column expressions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

PICO = 10**12


def div(a: Column, b: Column | int) -> Column:
    """Integer division that stays in BIGINT."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b).cast("long")


def floor_div(a: Column, b: int) -> Column:
    """Integer division that rounds down, in BIGINT."""
    return div(a - F.pmod(a, F.lit(b)), b)


def sample_seconds(idx: Column, num: int, den: int) -> tuple[Column, Column]:
    """TIME-01: whole seconds and picoseconds of a sample, floored; quotient and remainder keep products small."""
    rest = (idx % num) * den
    part = rest % num
    return div(idx, num) * den + div(rest, num), part * (PICO // num) + div(part * (PICO % num), num)


def sample_timestamp(idx: Column, num: int, den: int) -> Column:
    """TIME-03: the microsecond timestamp of a sample."""
    sec, ps = sample_seconds(idx, num, den)
    return F.timestamp_micros(sec * 1_000_000 + div(ps, 1_000_000))


def micros_to_sample(us: Column, num: int, den: int, up: bool = False) -> Column:
    """TIME-05, and TIME-02 with up: the sample at or before, or at or after, a time in microseconds; split so that nothing overflows."""
    one = 1_000_000 * den
    whole, rest = div(us, one), us % one
    return whole * num + div(rest * num + (one - 1 if up else 0), one)


def file_millis(idx: Column, num: int, den: int, cadence_ms: int) -> Column:
    """The time in ms of the file that holds a sample."""
    sec, ps = sample_seconds(idx, num, den)
    return div(sec * 1000 + div(ps, 1_000_000_000), cadence_ms) * cadence_ms


def file_path(ms: Column, subdir_s: int) -> tuple[Column, Column]:
    """TIME-10: folder and file name for a file time."""
    folder = F.timestamp_seconds(div(ms, 1000 * subdir_s) * subdir_s)
    return F.date_format(folder, "yyyy-MM-dd'T'HH-mm-ss"), F.format_string("rf@%d.%03d.h5", div(ms, 1000), (ms % 1000).cast("int"))


#: File name patterns by kind (data, metadata, their properties); names in progress start with tmp.
NAMES = {"data": r"^(?!tmp\.)([^@/]+)@(\d+)\.(\d{3})\.h5$", "metadata": r"^(?!tmp\.)([^@/]+)@(\d+)\.h5$", "properties": r"^(drf|dmd)_properties\.h5$"}


def file_kind(name: Column) -> Column:
    """STR-01: the kind of a file by its name, null for others."""
    out = None
    for kind, pattern in NAMES.items():
        out = F.when(name.rlike(pattern), kind) if out is None else out.when(name.rlike(pattern), kind)
    return out


def file_key(name: Column) -> Column:
    """TIME-11: the time in ms that a file's name tells."""
    sec, ms = F.regexp_extract(name, r"@(\d+)", 1), F.regexp_extract(name, r"@\d+\.(\d{3})\.h5$", 1)
    return F.when(sec != "", sec.cast("long") * 1000 + F.when(ms != "", ms.cast("long")).otherwise(0))


def parse_channel(text: str) -> tuple[str, int | None]:
    """STR-02: name or name:subchannel."""
    name, colon, sub = text.strip().rpartition(":")
    if not colon:
        return text.strip(), None
    if not name or not re.fullmatch(r"\d+", sub):
        raise ValueError(f"no channel: {text}")
    return name, int(sub)


def parse_channels(text: str) -> list[tuple[str, int | None]]:
    """STR-02: a comma list of channels; none twice."""
    out = [parse_channel(x) for x in text.split(",") if x.strip()]
    if len(set(out)) < len(out):
        raise ValueError("a channel stands twice")
    return out


def parse_range(text: str, num: int, den: int, ref: int | None = None) -> tuple[int | None, int | None]:
    """STR-02: a:b, either side an identifier of parse_sample or empty."""
    a, colon, b = text.partition(":")
    if not colon or ":" in b:
        raise ValueError(f"no range: {text}")
    lo = parse_sample(a, num, den, ref)
    hi = parse_sample(b, num, den, lo if lo is not None else ref)
    if lo is not None and hi is not None and hi < lo:
        raise ValueError("the range ends before it starts")
    return lo, hi


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _to_sample(t: datetime, num: int, den: int) -> int:
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return (t - EPOCH) // timedelta(microseconds=1) * num // (den * 1_000_000)


def parse_sample(text: str | int | float | None, num: int, den: int, ref: int | None = None, now: datetime | None = None) -> int | None:
    """TIME-08: None or '' no index; int an index; float UTC seconds; +int and +float relative to ref; ISO-8601; now, nowish (next whole second)."""
    if text is None or text == "":
        return None
    s = str(text).strip()
    if s in ("now", "nowish"):
        t = now or datetime.now(timezone.utc)
        return _to_sample(t.replace(microsecond=0) + timedelta(seconds=1) if s == "nowish" else t, num, den)
    if re.fullmatch(r"\+\d+", s) or re.fullmatch(r"\+\d*\.\d*", s):
        if ref is None:
            raise ValueError("a relative index needs a reference")
        return ref + (int(s) if "." not in s else int(round(float(s) * 10**9)) * num // (den * 10**9))
    if re.fullmatch(r"-?\d+", s):
        return int(s)
    if re.fullmatch(r"-?\d*\.\d*", s):
        return int(round(float(s) * 10**6)) * num // (den * 10**6)
    return _to_sample(datetime.fromisoformat(s.replace("Z", "+00:00")), num, den)


def parse_time(text: str | int | float | None, num: int | None = None, den: int = 1, now: datetime | None = None) -> datetime | None:
    """TIME-09: as parse_sample, to a time; an integer is an index only if a rate is given, else seconds."""
    if text is None or text == "":
        return None
    s = str(text).strip()
    if re.fullmatch(r"-?\d+", s) and num is None:
        return EPOCH + timedelta(seconds=int(s))
    if re.fullmatch(r"-?\d*\.\d+", s):
        return EPOCH + timedelta(microseconds=round(float(s) * 10**6))
    rate = (num, den) if num else (10**6, 1)
    idx = parse_sample(s, *rate, now=now)
    return EPOCH + timedelta(microseconds=idx * rate[1] * 10**6 // rate[0])
