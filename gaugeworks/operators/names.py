"""Names for helper columns that no caller's column has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def prefix(*tables: DataFrame) -> str:
    """A prefix that no column of the tables begins with."""
    out = "_gw_"
    while any(c.startswith(out) for t in tables for c in t.columns):
        out = "_" + out
    return out
