"""Reports from a template of the caller; `1 degrees` and the like become singular."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def singular(text: Column, units: Sequence[str]) -> Column:
    """`1 unit` for `1 units`, and `-1 unit`."""
    for unit in units:
        text = F.regexp_replace(text, rf"(?<![0-9.])(-?1 {unit})s\b", "$1")
    return text


def reports(table: DataFrame, template: str, key: str = "city", units: Sequence[str] = ("degree", "kilometer")) -> DataFrame:
    """key and report for each row; a slot [NAME] takes the column of that name."""
    text = F.lit(template)
    for c in table.columns:
        text = F.replace(text, F.lit(f"[{c.upper()}]"), F.col(c).cast("string"))
    return table.select(key, singular(text, units).alias("report"))
