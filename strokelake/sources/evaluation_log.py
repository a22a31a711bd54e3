"""Evaluations that are appended exactly once, whatever is run again.

An evaluation is keyed by (content hash, template, run). Appending a run reads that run's partition of the newest version,
leaves out the keys it holds, writes the rest and publishes the next version by compare-and-set. A run that is
started again adds only what is missing; files of a run that broke before it was published are named by no version and
are never read; a writer that was overtaken looks again at what is stored now. Ids come from the key, so they are the same
in every attempt.

Defined cases: a drawing without a hash is keyed by its id; drawings of equal content are one evaluation, of the smallest id;
an empty run publishes nothing; runs have names of letters, digits, ``-`` and ``_``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from strokelake.session import cut
from strokelake.sources.keyed_table import ConcurrentUpdate, KeyedTable
from strokelake.sources.tables import SCHEMAS

NAME = "evaluations"
KEY = ["image_hash", "reference_id", "run"]
COUNTS = ["correct_lines", "missing_lines", "extra_lines"]


def evaluation_rows(summary: DataFrame, run: str, reference_id: int, at: str) -> DataFrame:
    """Stored form of match summaries (drawing_id, image_hash and counts), one row per content."""
    if not re.fullmatch(r"[\w-]+", run):
        raise ValueError(f"not a run name: {run!r}")
    known = F.coalesce("image_hash", F.concat(F.lit("id:"), F.col("drawing_id").cast("string")))
    first = summary.withColumn("image_hash", known).groupBy("image_hash").agg(F.min_by(F.struct("drawing_id", *COUNTS, "similarity_score"), "drawing_id").alias("e"))
    named = first.select("image_hash", "e.*", F.lit(reference_id).cast("long").alias("reference_id"), F.lit(run).alias("run"))
    key = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in KEY]), 256)
    given = {
        "id": F.conv(F.substring(key, 1, 15), 16, 10),
        "image_id": F.col("drawing_id"),
        "evaluated_at": F.to_timestamp_ntz(F.lit(at)),
    }
    taken = {"reference_id", "similarity_score", *COUNTS}
    fields = [f for f in SCHEMAS[NAME].fields]
    return named.select(*[given.get(f.name, F.col(f.name) if f.name in taken else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], "image_hash", "run")


def open_log(spark: SparkSession, root: str, like: DataFrame) -> KeyedTable:
    try:
        return KeyedTable.open(spark, root, NAME)
    except FileNotFoundError:
        try:
            return KeyedTable.create(like.limit(0), root, NAME, KEY, ["run"])
        except ConcurrentUpdate:
            return KeyedTable.open(spark, root, NAME)


def append_run(spark: SparkSession, root: str, rows: DataFrame, run: str, attempts: int = 5) -> KeyedTable:
    """Append the evaluations of a run that are not stored yet; the newest version afterwards."""
    rows = cut(rows)  # several attempts store the same rows
    for attempt in range(attempts):
        log = open_log(spark, root, rows)
        held = log.read_partition(run=run).select(*KEY)
        fresh = rows.join(held, KEY, "left_anti")
        if fresh.isEmpty():
            return log
        try:
            return log.append(fresh)
        except ConcurrentUpdate:
            if attempt + 1 == attempts:
                raise
    raise AssertionError("unreachable")


def latest(spark: SparkSession, root: str) -> DataFrame:
    return KeyedTable.open(spark, root, NAME).read()
