"""Line dedup by distinct-site spread.

Normalised lines are hashed; a HyperLogLog sketch of the sites per line hash is built and merged by aggregation. A line
whose estimate is clearly above ``min_sites`` is boilerplate; estimates near the threshold are settled by an exact
distinct count. A boilerplate line stays in the rows of the smallest ``doc_id`` that has it and is removed everywhere else,
so what is removed is never lost.

Everything is DataFrame work. A line seen fewer than ``min_sites`` times cannot lie on that many sites, so
sketches are only built for the others. A row's removals are found by (doc_id, text hash); repeated rows get the same result.

Defined cases: null text counts as empty and stays null; rows with a null site count for no site but lose
boilerplate lines like others; a null ``doc_id`` ranks after all others; blank lines are never boilerplate; ties cannot occur,
as ids decide; an empty table gives an empty result; all other columns are kept (names beginning with ``_line_`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strokelake.llm.common import written

LAST = (1 << 63) - 1


def normalised(line: Column) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(line, r"[\x09-\x0D ]+", " ")))


def line_rows(docs: DataFrame, site: str) -> DataFrame:
    """One row per line with a word: document key, site, line hash; no text."""
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_line_doc"),
        F.xxhash64("text").alias("_line_text"),
        F.col(site).cast("string").alias("_line_site"),
        F.explode(F.split("text", "\n")).alias("_line"),
    )
    return (
        lines.withColumn("_line", normalised(F.col("_line")))
        .where(F.col("_line") != "")
        .select("_line_doc", "_line_text", "_line_site", F.xxhash64("_line").alias("_line_hash"))
    )


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 12, sigmas: float = 4.0) -> DataFrame:
    """Hashes on at least ``min_sites`` sites, with the first document of each."""
    often = lines.groupBy("_line_hash").agg(F.count("*").alias("n"), F.min("_line_doc").alias("_line_first")).where(F.col("n") >= min_sites)
    sited = lines.where(F.col("_line_site").isNotNull()).join(often.select("_line_hash"), "_line_hash", "left_semi")
    sketches = sited.groupBy("_line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_line_site", F.lit(lg_k))).alias("sites"))
    band = sigmas * 1.04 / 2 ** (lg_k / 2)
    sketches = written(sketches.where(F.col("sites") >= F.floor(F.lit(min_sites * (1 - band)))), "sketches")
    sure = F.col("sites") > min_sites * (1 + band) + 1
    near = sited.join(sketches.where(~sure).select("_line_hash"), "_line_hash", "left_semi")
    exact = (
        near.select("_line_hash", "_line_site")
        .distinct()
        .groupBy("_line_hash")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    found = sketches.where(sure).select("_line_hash").union(exact.select("_line_hash"))
    return often.join(found, "_line_hash").select("_line_hash", "_line_first")


def remove_spread_lines(docs: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and ``n_lines``, ``n_removed`` (lines with a word).

    Columns of these two names give way to the counts; names that begin with ``_line_`` are reserved and leave the table too.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed") or c.lower().startswith("_line_")])
    lines = written(line_rows(docs, site), "lines")
    spread = written(boilerplate(lines, min_sites), "spread")
    gone = (
        lines.join(spread, "_line_hash")
        .where(F.col("_line_doc") != F.col("_line_first"))
        .groupBy("_line_doc", "_line_text")
        .agg(F.collect_set("_line_hash").alias("_line_gone"))
    )
    marked = docs.withColumn("_line_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("_line_text", F.xxhash64("text"))
    joined = marked.join(gone, ["_line_doc", "_line_text"], "left")
    parts = F.split("text", "\n")
    worded = F.filter(parts, lambda x: normalised(x) != "")
    dropped = lambda x: (normalised(x) != "") & F.array_contains("_line_gone", F.xxhash64(normalised(x)))
    left = F.filter(parts, lambda x: ~dropped(x))
    hit = F.col("_line_gone").isNotNull()
    out = joined.withColumn("n_lines", F.coalesce(F.size(worded), F.lit(0)).cast("long"))
    out = out.withColumn("_line_left", F.when(hit, left))
    out = out.withColumn("n_removed", F.when(hit, F.size(parts) - F.size("_line_left")).otherwise(0).cast("long"))
    out = out.withColumn("text", F.when(hit, F.array_join("_line_left", "\n")).otherwise(F.col("text")))
    return out.select(*docs.columns, "n_lines", "n_removed")


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, source, lower(trim(regexp_replace(unnest(parts), '[\x09-\x0D ]+', ' ', 'g'))) AS line FROM rows
), spread AS (
  SELECT line, min(doc_id) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), numbered AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM rows
), judged AS (
  SELECT n.doc_id, n.part, n.i, lower(trim(regexp_replace(n.part, '[\x09-\x0D ]+', ' ', 'g'))) AS line FROM numbered n
), marked AS (
  SELECT j.*, s.line IS NOT NULL AND s.first <> j.doc_id AS gone FROM judged j LEFT JOIN spread s ON j.line = s.line
)
SELECT doc_id, coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
  CAST(count(*) FILTER (WHERE line <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed
FROM marked GROUP BY doc_id
"""
