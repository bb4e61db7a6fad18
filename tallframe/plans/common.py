"""What the plans share: samples in both languages, and rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: Events as samples, in SQL; the same as ``sources.tables.samples``.
SAMPLES = "s AS (SELECT user_id AS stim, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS n, epoch_us(ts) AS us, event_id, event_type AS label, value AS x FROM events)"


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def values(rows: list[tuple], columns: str) -> str:
    """A VALUES list as a SQL table."""
    body = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({columns})"
