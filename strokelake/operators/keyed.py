"""Joins to tables that are expected to be small, with their size checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strokelake.session import cut

#: A table is broadcast up to this many bytes of its rows as text.
BROADCAST_BYTES = 8 << 20


def join_small(
    rows: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Equi-join with few rows per key, so that a hot key of ``rows`` is not brought together."""
    return rows.join(measured(small, limit), on, how)


def measured(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A side of several joins, written once and measured: marked for broadcast up to ``limit`` bytes.

    Beyond that its joins shuffle both sides, and Spark splits skewed keys at run time.
    """
    held = cut(small)
    size = held.agg(F.sum(F.octet_length(F.to_json(F.struct(*held.columns))))).first()[0] or 0
    return F.broadcast(held) if size <= limit else held
