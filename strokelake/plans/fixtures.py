"""Inputs of the registered queries, derived by arithmetic from the given tables.

Each text is valid in Spark SQL and, where a dialect twin is given, in DuckDB. ``{name}``
stands for a base table; ``[[name]]`` stands for another fixture.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

TEXTS: dict[str, str | tuple[str, str]] = {
    "segments": """
SELECT l_orderkey AS drawing_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS line_id,
  CAST((l_partkey*37 + l_linenumber*11) % 568 AS INT) AS x1,
  CAST((l_suppkey*53 + l_linenumber*29) % 274 AS INT) AS y1,
  CAST((l_partkey*91 + l_suppkey*17) % 568 AS INT) AS x2,
  CAST((l_suppkey*31 + l_partkey*7 + l_linenumber*41) % 274 AS INT) AS y2
FROM {lineitem}""",
    "ref_segments": """
SELECT CAST(ref_id AS INT) AS ref_id, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2
FROM (VALUES (0,234,187,334,187),(1,334,187,334,87),(2,334,87,234,87),(3,234,87,284,37),(4,284,37,334,87),
  (5,334,87,234,187),(6,234,187,234,87),(7,234,87,284,37),(8,284,37,334,187)) AS t(ref_id, x1, y1, x2, y2)""",
    "drawings": (
        """
SELECT d.doc_id AS drawing_id, concat('PC', CAST(d.doc_id AS STRING)) AS patient_id,
  CASE d.doc_id % 4 WHEN 0 THEN 'MAT' WHEN 1 THEN 'OCS' WHEN 2 THEN 'OXFORD' ELSE 'DRAWN' END AS source_format,
  CASE d.doc_id % 3 WHEN 0 THEN 'COPY' WHEN 1 THEN 'RECALL' ELSE 'REFERENCE' END AS task_type,
  CASE d.doc_id % 6 WHEN 0 THEN concat('FIG_Pro1003_PC', CAST(d.doc_id AS STRING), '_COPY_drawn.png')
    WHEN 1 THEN concat('Park_', CAST(d.doc_id AS STRING), '_RECALL.png') WHEN 2 THEN concat('teamk', CAST(d.doc_id AS STRING), '_copy.png')
    WHEN 3 THEN concat('Pro', CAST(d.doc_id AS STRING), '_REFERENCE.png') WHEN 4 THEN concat('C0', CAST(d.doc_id AS STRING), '_COPY.png') ELSE 'junk.png' END AS original_filename,
  concat('SES_', CAST(d.doc_id % 25 AS STRING)) AS session_id,
  (d.doc_id * 7919) % 10007 AS uploaded_seq,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE CAST(d.doc_id % 12 AS INT) END AS ground_truth_correct,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE CAST(d.doc_id % 4 AS INT) END AS ground_truth_extra,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL WHEN d.doc_id % 10 = 1 THEN '{{}}'
    WHEN d.doc_id % 10 = 2 THEN '{{"Total_Score": "n/a"}}'
    WHEN l.quality IS NULL THEN concat('{{"Total_Score": ', CAST(d.n_chars % 61 AS STRING), '}}')
    ELSE concat('{{"Total_Score": ', CAST(d.n_chars % 61 AS STRING), ', "Quality": ', CAST(l.quality AS STRING), '}}') END AS features_data,
  CASE WHEN d.doc_id % 8 = 3 THEN NULL ELSE concat('{{"width": ', CAST(560 + d.doc_id % 9 AS STRING), ', "height": 274, "line_thickness": 2.0}}') END AS extraction_metadata,
  d.n_chars, d.text AS body, sha2(d.text, 256) AS image_hash
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
        None,
    ),
    "classed": """
SELECT doc_id AS drawing_id, concat('PC', CAST(doc_id AS STRING)) AS patient_id, n_chars % 61 AS score,
  CASE WHEN doc_id % 9 = 0 THEN NULL
    WHEN doc_id % 3 = 0 THEN concat('{{"Total_Score": ', CAST(n_chars % 61 AS STRING), ', "Custom_Class": {{"2": {{"label": ',
      CASE WHEN n_chars % 61 <= 30 THEN '0' ELSE '1' END, ', "name_custom": ',
      CASE WHEN n_chars % 61 <= 30 THEN '"Poor"' ELSE '"Good"' END, ', "name_generic": "Class [',
      CASE WHEN n_chars % 61 <= 30 THEN '0-30' ELSE '31-60' END, ']", "boundaries": [0, 30, 60]}}}}}}')
    ELSE concat('{{"Total_Score": ', CAST(n_chars % 61 AS STRING), ', "Custom_Class": {{"4": {{"label": ',
      CASE WHEN n_chars % 61 <= 15 THEN '0' WHEN n_chars % 61 <= 30 THEN '1' WHEN n_chars % 61 <= 45 THEN '2' ELSE '3' END,
      ', "name_custom": ', CASE WHEN n_chars % 61 <= 15 THEN '"Poor"' WHEN n_chars % 61 <= 30 THEN '"Fair"' WHEN n_chars % 61 <= 45 THEN '"Good"' ELSE '"Excellent"' END,
      ', "name_generic": "Class [', CASE WHEN n_chars % 61 <= 15 THEN '0-15' WHEN n_chars % 61 <= 30 THEN '16-30' WHEN n_chars % 61 <= 45 THEN '31-45' ELSE '46-60' END,
      ']", "boundaries": [0, 15, 30, 45, 60]}}}}}}') END AS features_data
FROM {documents}""",
    "scores": """
SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS score, p_retailprice AS amount, CAST(p_partkey % 4 AS INT) AS label FROM {part}""",
    "predictions_reg": """
SELECT l_orderkey AS id, l_linenumber AS sub_id, CASE WHEN l_partkey % 5 = 0 THEN 'val' ELSE 'train' END AS split,
  l_quantity - 1 AS target, l_quantity * (0.95e0 + l_discount) AS prediction FROM {lineitem}""",
    "predictions_cls": (
        """
SELECT vec_id AS id, label AS target, CAST(array_position(embedding, array_max(embedding)) - 1 AS INT) AS prediction FROM {embeddings}""",
        """
SELECT vec_id AS id, label AS target, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS prediction FROM {embeddings}""",
    ),
    "history": """
SELECT event_type AS model, CAST(extract(DAY FROM ts) AS INT) AS epoch, round(avg(value), 6) AS train_loss,
  round(avg(value * (1 + (event_id % 7) / 10e0)), 6) AS val_loss, CAST(count(*) AS INT) AS seconds
FROM {events} GROUP BY 1, 2""",
    "batches": """
SELECT event_type AS model, CAST(extract(DAY FROM ts) AS INT) AS epoch,
  CASE WHEN event_id % 5 = 0 THEN 'val' ELSE 'train' END AS phase, value AS loss FROM {events}""",
    "trail_points": """
SELECT user_id AS drawing_id, event_type AS stroke_id,
  CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INT) AS seq,
  CAST((event_id * 13) % 568 AS INT) AS x, CAST((event_id * 7) % 274 AS INT) AS y, ts AS t FROM {events}""",
    "pixels": """
SELECT CAST(floor(l_orderkey / 800e0) AS BIGINT) AS drawing_id, CAST((l_partkey*37 + l_linenumber) % 568 AS INT) AS x, CAST((l_orderkey*53) % 274 AS INT) AS y,
  CAST(max((l_orderkey*17) % 256) AS INT) AS r, CAST(max((l_partkey*29) % 256) AS INT) AS g, CAST(max((l_suppkey*41) % 256) AS INT) AS b
FROM {lineitem} GROUP BY 1, 2, 3""",
    "ink": """
SELECT drawing_id, x, y FROM [[pixels]] WHERE floor(0.299e0*r + 0.587e0*g + 0.114e0*b + 0.5e0) <= 127""",
    "cases": """
SELECT o_orderkey AS test_id, CAST(o_orderkey % 10 AS INT) AS expected_correct, CAST(9 - o_orderkey % 10 AS INT) AS expected_missing,
  CAST(o_custkey % 3 AS INT) AS expected_extra, CAST((o_orderkey + o_custkey) % 10 AS INT) AS correct_lines,
  CAST(9 - (o_orderkey + o_custkey) % 10 AS INT) AS missing_lines, CAST(o_custkey % 4 AS INT) AS extra_lines
FROM {orders}""",
    "evaluations": """
SELECT o_orderkey AS id, o_custkey AS image_id, o_orderdate AS evaluated_at, CAST(o_orderkey % 10 AS INT) AS correct_lines FROM {orders}""",
    "ratings": """
SELECT concat('C', lpad(CAST(c_custkey AS STRING), 7, '0')) AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN 'COPY' ELSE 'RECALL' END AS task_type,
  CAST((c_custkey * 7) % 61 AS INT) AS total_score FROM {customer}""",
    "ratings_stored": """
SELECT concat('C', lpad(CAST(c_custkey AS STRING), 7, '0')) AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN 'COPY' ELSE 'RECALL' END AS task_type,
  CAST((c_custkey * 7) % 61 + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS total_score FROM {customer} WHERE c_custkey % 13 <> 0""",
    "models": """
SELECT concat('model_', n_name, '_202401', lpad(CAST(n_nationkey % 28 + 1 AS STRING), 2, '0'), '_120000') AS stem, n_nationkey AS size_rank FROM {nation} WHERE n_nationkey % 5 <> 0""",
    "model_metadata": """
SELECT concat('model_', n_name, '_202401', lpad(CAST(n_nationkey % 28 + 1 AS STRING), 2, '0'), '_120000') AS stem, n_regionkey AS region FROM {nation} WHERE n_nationkey % 4 <> 0""",
    "samples": """
SELECT o_orderkey AS drawing_id, CAST(o_orderkey % 6 AS INT) AS aug_idx, CASE WHEN o_custkey % 5 = 0 THEN 'val' ELSE 'train' END AS split,
  concat('PC', CAST(o_custkey AS STRING), '_id', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 6 = 0 THEN '_original' ELSE concat('_aug', CAST(o_orderkey % 6 - 1 AS STRING)) END) AS name,
  o_totalprice AS target
FROM {orders}""",
    "split_ids": """
SELECT CASE WHEN p_partkey % 17 = 0 THEN concat('synthetic_bad_', CAST(p_partkey AS STRING)) ELSE CAST(p_partkey AS STRING) END AS sample_id,
  CASE WHEN p_size % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM {part}""",
}


def _twin(text: str) -> str:
    return text.replace("sha2(d.text, 256)", "sha256(d.text)")


def text_of(name: str, engine: str) -> str:
    entry = TEXTS[name]
    if isinstance(entry, tuple):
        spark_text, duck_text = entry
        return spark_text if engine == "spark" else duck_text or _twin(spark_text)
    return entry


def needs(name: str, engine: str) -> list[str]:
    return re.findall(r"\[\[(\w+)\]\]", text_of(name, engine))


class Inputs:
    """Base tables and fixtures of one data folder as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._table(name) if name in BASE else self._fixture(name)
        return self._made[name]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _fixture(self, name: str) -> DataFrame:
        if name not in TEXTS:
            raise AttributeError(name)
        text = text_of(name, "spark")
        inner = needs(name, "spark")
        for other in inner:
            text = text.replace(f"[[{other}]]", "{" + other + "}")
        used = {t: getattr(self, t) for t in {*re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)}}
        return self.spark.sql(text, **used)


def duck_ctes(names: list[str]) -> list[str]:
    """``name AS (...)`` parts for DuckDB, inner fixtures first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for inner in needs(name, "duck"):
            visit(inner)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        text = re.sub(r"\[\[(\w+)\]\]", r"\1", text_of(name, "duck"))
        parts.append(f"{name} AS ({text.format(**{b: b for b in BASE})})")
    return parts
