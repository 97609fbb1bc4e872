"""Names and numbers as they are shown in tables and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metric_slug(name: Column, slashes: bool = True) -> Column:
    """Lower case with underscores for spaces and, if asked, slashes."""
    slug = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    return F.replace(slug, F.lit("/"), F.lit("_")) if slashes else slug


def file_slug(name: Column) -> Column:
    slug = F.replace(F.replace(name, F.lit(" "), F.lit("_")), F.lit("+"), F.lit(""))
    return F.replace(slug, F.lit("__"), F.lit("_"))


def sibling_band(path: Column, band: str) -> Column:
    """Path of another band's file beside the red band's."""
    return F.replace(path, F.lit("_B04_"), F.lit(f"_{band}_"))


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals as C's printf writes it; NULL stays NULL.

    It is rounded by its exact binary value, ties to even. Java's formatter, and so
    format_string, rounds the shortest decimal that reads back as the number, ties up:
    it makes 0.02 of 0.015, which is a little less than 15 / 1000, and 3 of 2.5.
    """
    x = value.cast("double")
    text = F.call_function("format_number", x, F.lit(f"0.{'0' * digits}" if digits else "0"))
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == -float("inf"), "-inf").otherwise(text)


def percent(value: Column) -> Column:
    return F.concat(fixed(value, 2), F.lit("%"))


def signed(value: Column, digits: int = 4) -> Column:
    text = fixed(value, digits)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))
