"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def literal_map(values: dict) -> Column:
    """A constant map column; lookups fold into the projection, no join needed."""
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(values), key)


def language_code(code: Column, default: str) -> Column:
    """Any known alias to the five-language code; unknown, empty or null to ``default``."""
    return F.coalesce(lookup(fixed.LANGUAGE_ALIASES, F.lower(code)), F.lit(default))


def unit_interval(value: Column) -> Column:
    """Clamp to [0, 1]; null and NaN count as 0."""
    value = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence > 0.9, "success")
        .when(confidence > 0.7, "primary")
        .when(confidence > 0.5, "warning")
        .otherwise("danger")
    )


def tag_key(tags: Column) -> Column:
    """Order-free text key of a tag map, usable in joins and windows."""
    entries = F.array_sort(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))))
    return F.to_json(F.map_from_entries(entries))


def epoch_text(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_seconds(seconds), pattern)
