"""Display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playlens.vocabulary import DEFAULT_PREFIX, KEY_NAMES


def event_label(column="event_type", prefix: str = DEFAULT_PREFIX) -> Column:
    """``game.level_start`` as ``Level Start``."""
    name = F.replace(F.col(column) if isinstance(column, str) else column, F.lit(prefix), F.lit(""))
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def key_name(column: str) -> Column:
    """Name of a key code; NULL for a code that is not tracked."""
    pairs = [F.lit(value) for item in KEY_NAMES.items() for value in item]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def label_of(name: str) -> str:
    """The label of an event by its bare name."""
    return " ".join(word.capitalize() for word in name.split("_"))
