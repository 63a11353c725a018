"""Scalar expressions."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """What stands between white space, as an array; it may have an empty string at either end."""
    return F.split(text, "\\s+")


def truncate(text: Column, most: int) -> Column:
    """The first characters."""
    return F.substring(text, 1, most)


def flatten_lists(nested: Column, depth: int = 1) -> Column:
    """Lists of lists as one list, so many levels down."""
    for _ in range(depth):
        nested = F.flatten(nested)
    return nested


def path_get(value: Column, *path: str | int) -> Column:
    """What lies at a path of field names, map keys and positions; null where there is nothing."""
    for step in path:
        value = F.get(value, F.lit(step)) if isinstance(step, int) else value.getItem(step)
    return value


def path_set(value: Column, new: Column, *path: str) -> Column:
    """The struct with the field at a path of names set."""
    return value.withField(".".join(path), new)


def key_token(*parts: Column) -> Column:
    """A name for what is computed from the parts: equal parts, nulls included, have equal tokens."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def format_bytes(n: Column) -> Column:
    """A number of bytes in the largest unit of which there is at least nine tenths."""
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("kiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(n >= 0.9 * 1024**k, F.concat(F.format_string("%.2f", n / float(1024**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def in_zone(ts: Column, zone: str) -> Column:
    """Wall-clock time in a zone, of a time in UTC without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def floor_to(ts: Column, seconds: int) -> Column:
    """The start of the bucket of so many seconds since 1970 that holds the time."""
    at = F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), ts).cast("timestamp"))
    return F.timestamp_seconds(F.floor(at / seconds) * seconds).cast("timestamp_ntz")


def shorten(text: Column, most: int = 15) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def key_group(key: Column) -> Column:
    """The name of a task's group: its key without trailing hex digest, number or tuple index."""
    head = F.regexp_extract(key, r"^[('\"]*([^,'\"()]+)", 1)
    return F.regexp_replace(F.regexp_replace(head, r"-[0-9a-f]{8,}(-[0-9a-f]+)*$", ""), r"-\d+$", "")


def log2_level(ratio: Column, shift: int = 6, top: int = 14) -> Column:
    """Bucket of a ratio by powers of two, halves to even, between 0 and ``top``."""
    return F.when(ratio > 0, F.least(F.greatest(F.bround(F.log2(ratio) + shift), F.lit(0)), F.lit(top))).otherwise(0).cast("int")


_UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "sec": 1.0, "second": 1.0, "m": 60.0, "min": 60.0, "minute": 60.0, "h": 3600.0, "hr": 3600.0, "hour": 3600.0, "d": 86400.0, "day": 86400.0}


def duration(text: str | float) -> timedelta:
    """"5s", "1.5 hours", "100ms" or a number of seconds."""
    if not isinstance(text, str):
        return timedelta(seconds=text)
    m = re.fullmatch(r"\s*([\d.]*(?:e[+-]?\d+)?)\s*([a-z]*)\s*", text.lower())
    unit = m[2] if m and m[2] in _UNITS else m[2].removesuffix("s") if m else None
    if not m or (m[2] and unit not in _UNITS):
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(seconds=float(m[1] or 1) * _UNITS.get(unit or "s", 1.0))
