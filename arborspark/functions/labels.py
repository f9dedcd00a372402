"""Labels and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_label(x: Column) -> Column:
    """A number with at most four decimals and no trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", "")


def file_name(name: Column) -> Column:
    """A name in which only letters, digits, space, - and _ stay."""
    return F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_")


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a duration below a day."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)
