"""Column functions of paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def clean_path(path: Column) -> Column:
    """Without white space, and with one slash where there are several."""
    return F.regexp_replace(F.regexp_replace(path, r"\s+", ""), "/+", "/")


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^[a-z]+:/+", "")


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(False))


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def token(seed: int, *key: Column, width: int = 8) -> Column:
    """A reproducible string of hexadecimal digits for each key, in the place of a random one."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in key]), 256), 1, width)


def digit_count(number: Column) -> Column:
    """Decimal digits of a whole number."""
    return F.length(F.abs(number).cast("string"))


def grid_corner(name: Column, width: float) -> list[Column]:
    """xmin, xmax, ymin, ymax of a file named ``prefix_<x>_<y>_...``, whose numbers are the upper left corner in kilometres of a square of ``width`` metres."""
    x, y = (F.regexp_extract(name, r"^[^_]*(?:_[^_]*?)*?_(\d{4})_(\d{4})_", k).cast("double") * 1000 for k in (1, 2))
    return [x.alias("xmin"), (x + width).alias("xmax"), (y - width).alias("ymin"), y.alias("ymax")]
