"""Typed reads from semi-structured (VARIANT) columns.

Telemetry attributes are strings on the wire, so every typed read is lenient: text that does
not parse as the wanted type is NULL instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(*keys: str) -> str:
    return "$" + "".join(f'["{key}"]' for key in keys)


def text(column: str, *keys: str) -> Column:
    return F.try_variant_get(F.col(column), _path(*keys), "string")


def integer(column: str, *keys: str) -> Column:
    return F.try_variant_get(F.col(column), _path(*keys), "int")


def double(column: str, *keys: str) -> Column:
    return F.try_variant_get(F.col(column), _path(*keys), "double")


def json_text(column: str) -> Column:
    return F.to_json(F.col(column))
