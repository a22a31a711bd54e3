"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strokelake.plans.fixtures import Inputs, duck_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, fixtures: str = "", sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Register a function of :class:`Inputs`; ``sql`` may use the named fixtures and extra ``ctes``."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            parts = duck_ctes(fixtures.split()) + ([ctes.strip().rstrip(",")] if ctes else [])
            head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
            ORACLES[name] = _whole_counts(head + sql.strip())
        return fn

    return register


def _whole_counts(sql: str) -> str:
    """DuckDB's count_if is wider than BIGINT; cast each use."""
    out, at, mark = [], 0, "count_if("
    while (hit := sql.find(mark, at)) >= 0:
        depth, end = 1, hit + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(sql[at:hit] + f"CAST({sql[hit:end]} AS BIGINT)")
        at = end
    return "".join(out) + sql[at:]


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles to n places and counts to BIGINT, as the oracle side does."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            out.append(F.round(F.col(f.name).cast("double"), n).alias(f.name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
