"""Queries of the library's own operators and their SQL, by name."""

from __future__ import annotations

from .plans import assembly, entities, fields, layout, merging, metrics, streams, texts

AREAS = [merging, texts, entities, assembly, fields, layout, metrics, streams]


def queries() -> dict:
    return {name: query for area in AREAS for name, (query, _) in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, (_, sql) in area.QUERIES.items() if sql}
