"""Text functions as expressions: normalisation, globs, timestamps, counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: str | Column) -> Column:
    """Lower case, white space collapsed, trailing punctuation cut."""
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"[.!?,;: ]+$", "")))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``**`` any path, ``*`` within one part of it, ``?`` one character of a part."""
    out = ""
    for part in glob.replace("**", "\0"):
        out += {"\0": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, "\\" + part if part in ".+()[]{}^$|\\" else part)
    return f"^{out}$"


def from_millis(ms: str | Column) -> Column:
    """A timestamp of milliseconds since the epoch."""
    return F.timestamp_millis(F.col(ms) if isinstance(ms, str) else ms)


def to_iso(ts: str | Column) -> Column:
    """A timestamp as ISO 8601 in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def counters(name: str | Column, count: str | Column) -> Column:
    """An aggregate: a map of counts by name, in the order of the names."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, count))))
