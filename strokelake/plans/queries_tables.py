"""Registered queries: scans, sinks, filters, names, label bags, joins, paging, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strokelake.functions import labels as L, names as N, values as V
from strokelake.operators import catalog, ingest, lifecycle, metrics, ordered, profile, quality, segments, synth
from strokelake.operators import split as split_ops
from strokelake.plans.registry import query, r, rounded
from strokelake.session import scratch_path
from strokelake.sources.keyed_table import KeyedTable
from strokelake.sources import files, sinks, tables

# --- scans ---------------------------------------------------------------------------------

query("src_01_read_table", sql="SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer")(
    lambda i: rounded(
        tables.read_table(i.spark, f"{i.folder}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), 9
    )
)


@query(
    "src_02_scan_files",
    sql="SELECT * FROM (VALUES ('customer.parquet'), ('orders.parquet'), ('part.parquet')) AS t(filename)",
)
def _(i):
    return files.scan_files(i.spark, i.folder, "*.parquet", ["CUSTOMER", "orders", "part"]).select("filename")


@query(
    "src_04_ratings_csv",
    "ratings",
    "SELECT patient_id, task_type, CAST(total_score AS DOUBLE) AS total_score FROM ratings",
)
def _(i):
    path = scratch_path(i.spark, "ratings")
    i.ratings.select(F.col("patient_id").alias("ID"), F.lower("task_type").alias("Cond"), F.col("total_score").alias("TotalScore")).write.option(
        "header", "true"
    ).csv(path)
    return files.read_ratings_csv(i.spark, path)


@query(
    "src_05_labels_csv",
    "ratings",
    """SELECT row_number() OVER (ORDER BY patient_id) AS line_no, patient_id AS "Patient", task_type AS "Task", CAST(total_score AS VARCHAR) AS "Total_Score", CAST(total_score % 3 AS VARCHAR) AS "Data_Quality" FROM ratings""",
)
def _(i):
    path = scratch_path(i.spark, "labels")
    i.ratings.repartitionByRange(3, "patient_id").sortWithinPartitions("patient_id").select(
        F.col("patient_id").alias("Patient"),
        F.col("task_type").alias("Task"),
        F.col("total_score").alias("Total_Score"),
        (F.col("total_score") % 3).alias("Data_Quality"),
    ).write.option("header", "true").option("sep", ";").csv(path)
    return files.read_labels_csv(i.spark, path)


@query("src_06_augmented_set", "samples", "SELECT drawing_id, CAST(aug_idx AS BIGINT) AS aug_idx, name FROM samples WHERE split = 'val'")
def _(i):
    path = scratch_path(i.spark, "augmented")
    sinks.write_augmented(i.samples, path)
    return rounded(files.read_augmented(i.spark, f"{path}/samples", "val").select("drawing_id", "aug_idx", "name"))


@query(
    "src_06_augmented_pairs",
    "samples",
    "SELECT name AS stem, target FROM samples WHERE drawing_id % 4 <> 0",
)
def _(i):
    labels = i.samples.select(F.col("name").alias("stem"), "target")
    images = i.samples.where("drawing_id % 4 <> 0").select(F.col("name").alias("stem"))
    return files.paired_labels(labels, images)


@query(
    "src_07_model_listing",
    "models model_metadata",
    """SELECT m.stem, CASE WHEN len(p) > 3 THEN array_to_string(p[2:len(p)-2], '_') ELSE p[2] END AS feature,
  array_to_string(p[-2:], '_') AS timestamp, round(size_rank * 1000 / 1048576.0, 6) AS size_mb,
  m.stem IN (SELECT stem FROM model_metadata) AS has_metadata
FROM (SELECT *, string_split(stem, '_') AS p FROM models) m""",
)
def _(i):
    models = i.models.select("stem", (F.col("size_rank") * 1000).alias("length"), F.col("size_rank").alias("modified"))
    return rounded(catalog.model_listing(models, i.model_metadata).drop("modified"))


@query(
    "src_08_model_metadata",
    "model_metadata",
    "SELECT stem, CAST(region AS BIGINT) AS region FROM model_metadata",
)
def _(i):
    path = scratch_path(i.spark, "metadata")
    texts = i.model_metadata.select("stem", F.to_json(F.struct("region")).alias("value"))
    # one directory per model, each with one metadata file
    texts.write.partitionBy("stem").text(path)
    rows = i.spark.read.option("wholetext", "true").text(path)
    return rows.select("stem", F.get_json_object("value", "$.region").cast("bigint").alias("region"))


@query(
    "src_09_trails",
    "trail_points",
    """SELECT drawing_id, count(DISTINCT stroke_id) AS strokes, count(*) AS points, 0::BIGINT AS area_x, 568::BIGINT AS area_w
FROM trail_points GROUP BY 1""",
)
def _(i):
    points = tables.trails_with_area(i.trail_points)
    area = points.groupBy("drawing_id").agg(F.max("area_x").alias("area_x"), F.max("area_w").alias("area_w"))
    return rounded(tables.trail_summary(points).join(area, "drawing_id"))


query("src_10_test_cases", "cases", "SELECT test_id, CAST(expected_correct AS BIGINT) AS expected_correct FROM cases")(
    lambda i: rounded(tables.read_test_cases(i.cases).select("test_id", "expected_correct"))
)
query(
    "src_10_newest_cases",
    "cases",
    "SELECT o_orderkey AS test_id FROM (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25)",
)(
    lambda i: tables.read_test_cases(
        i.orders.select(F.col("o_orderkey").alias("test_id"), F.col("o_orderdate").alias("created_at")), 25
    ).select("test_id")
)

# --- sinks and updates ---------------------------------------------------------------------


@query(
    "snk_01_append_drawings",
    "drawings",
    "SELECT source_format, task_type, count(*) AS n, count(DISTINCT image_hash) AS hashes FROM drawings GROUP BY 1, 2",
)
def _(i):
    path = scratch_path(i.spark, "drawings")
    rows = i.drawings.withColumns({"original_file_data": F.col("body").cast("binary"), "processed_image_data": F.lit(None).cast("binary")})
    sinks.append_drawings(rows.drop("image_hash", "session_id", "body"), path)
    back = i.spark.read.parquet(path)
    per = back.groupBy("source_format", "task_type", "image_hash").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source_format", "task_type").agg(F.sum("n").alias("n"), F.count("image_hash").alias("hashes"))


@query(
    "snk_02_write_augmented",
    "samples",
    """SELECT split, count_if(aug_idx = 0) AS original, count_if(aug_idx > 0) AS augmented, count(*) AS total,
  round(count(*) / count_if(aug_idx = 0), 6) AS multiplier FROM samples GROUP BY 1""",
)
def _(i):
    path = scratch_path(i.spark, "augmented")
    sinks.write_augmented(i.samples, path)
    return rounded(i.spark.read.json(f"{path}/stats")).select("split", "original", "augmented", "total", "multiplier")


query(
    "snk_03_label_template",
    "drawings",
    """SELECT patient_id AS "Patient", task_type AS "Task", coalesce(json_extract_string(features_data, '$.Total_Score'), '') AS "Total_Score",
  coalesce(json_extract_string(features_data, '$.Data_Quality'), '') AS "Data_Quality" FROM drawings""",
)(lambda i: sinks.label_template(i.drawings))


@query(
    "snk_04_feature_json_round_trip",
    "segments",
    "SELECT drawing_id, CAST(line_id AS BIGINT) AS line_id, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM segments",
)
def _(i):
    records = segments.segment_features(i.segments)
    return rounded(segments.segments_of_record(segments.features_from_json(segments.features_to_json(records))))


@query(
    "snk_05_upsert",
    "evaluations",
    """SELECT id, image_id, CAST(CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN correct_lines + 100 ELSE correct_lines END AS BIGINT) AS correct_lines FROM evaluations
UNION ALL SELECT -id - 1, NULL, 7 FROM evaluations WHERE id % 50 = 0""",
)
def _(i):
    stored = KeyedTable.create(i.evaluations.select("id", "image_id", "correct_lines"), scratch_path(i.spark, "store"), "evaluations", ["id"])
    edits = i.evaluations.where("id % 3 = 0 OR id % 7 = 0").select("id", F.when(F.col("id") % 3 != 0, F.col("correct_lines") + 100).alias("correct_lines"))
    fresh = i.evaluations.where("id % 50 = 0").select((-F.col("id") - 1).alias("id"), F.lit(7).alias("correct_lines"))
    return rounded(stored.upsert(edits.unionByName(fresh), ["correct_lines"], insert=True).read())


@query(
    "snk_06_clear_labels",
    "drawings",
    "SELECT drawing_id, CASE WHEN drawing_id % 4 <> 0 THEN features_data END AS features_data FROM drawings",
)
def _(i):
    stored = KeyedTable.create(i.drawings.select("drawing_id", "features_data"), scratch_path(i.spark, "store"), "drawings", ["drawing_id"])
    return stored.change(i.drawings.where("drawing_id % 4 = 0"), lambda rows: rows.withColumn("features_data", F.lit(None).cast("string"))).read()


@query(
    "snk_07_delete_evaluations",
    "evaluations",
    """SELECT 'evaluations' AS name, count(*) AS n FROM kept
UNION ALL SELECT 'drawings', count(*) FROM customer WHERE c_custkey NOT IN (SELECT image_id FROM orphan)
UNION ALL SELECT 'features', count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT image_id FROM orphan)""",
    ctes="""kept AS (SELECT * FROM evaluations WHERE id % 3 <> 1),
orphan AS (SELECT DISTINCT image_id FROM evaluations WHERE image_id NOT IN (SELECT image_id FROM kept))""",
)
def _(i):
    root, ids = scratch_path(i.spark, "store"), i.customer.select(F.col("c_custkey").alias("drawing_id"))
    evaluations = KeyedTable.create(i.evaluations.select("id", "image_id"), root, "evaluations", ["id"])
    drawings = KeyedTable.create(ids, root, "drawings", ["drawing_id"])
    features = KeyedTable.create(ids.where("drawing_id % 2 = 0"), root, "features", ["drawing_id"])
    kept, drawings, features = lifecycle.delete_stored_evaluations(evaluations, drawings, features, i.evaluations.where("id % 3 = 1").select("id"))
    return profile.dashboard_counts(evaluations=kept.read(), drawings=drawings.read(), features=features.read())


@query("snk_08_delete_by_key", "cases", "SELECT test_id FROM cases WHERE test_id % 6 <> 2")
def _(i):
    stored = KeyedTable.create(i.cases.select("test_id"), scratch_path(i.spark, "store"), "test_cases", ["test_id"])
    return stored.delete(i.cases.where("test_id % 6 = 2")).read()


@query(
    "snk_09_backfill_hash",
    "drawings",
    """SELECT drawing_id, CASE WHEN drawing_id % 3 = 2 THEN 'kept' ELSE image_hash END AS image_hash FROM drawings""",
)
def _(i):
    old = F.when(F.col("drawing_id") % 3 == 1, "").when(F.col("drawing_id") % 3 == 2, "kept")
    rows = i.drawings.select("drawing_id", "body", old.alias("image_hash"))
    return lifecycle.backfill_hash(rows, "body", "body").select("drawing_id", "image_hash")


query(
    "snk_09_hash_stats",
    "drawings",
    """SELECT (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h WHERE image_hash <> '') AS with_hash,
  (SELECT count(*) FROM h WHERE image_hash IS NULL OR image_hash = '') AS without_hash,
  (SELECT count(*) FROM (SELECT image_hash FROM h WHERE image_hash <> '' GROUP BY 1 HAVING count(*) > 1)) AS duplicate_groups""",
    ctes="h AS (SELECT CASE WHEN drawing_id % 5 = 0 THEN NULL WHEN drawing_id % 5 = 1 THEN '' ELSE image_hash END AS image_hash FROM drawings)",
)(
    lambda i: lifecycle.hash_stats(
        i.drawings.select(F.when(F.col("drawing_id") % 5 == 0, None).when(F.col("drawing_id") % 5 == 1, "").otherwise(F.col("image_hash")).alias("image_hash"))
    )
)


def _stale_hashes(i):
    return i.drawings.select(
        "drawing_id",
        "source_format",
        F.when(F.col("drawing_id") % 11 != 0, F.col("body")).alias("body"),
        F.when(F.col("drawing_id") % 3 == 0, "stale").otherwise(F.col("image_hash")).alias("image_hash"),
    )


query(
    "snk_10_repair_hashes",
    "drawings",
    """SELECT drawing_id, CASE WHEN drawing_id % 3 <> 0 OR (source_format = 'OXFORD' AND drawing_id % 11 <> 0) THEN image_hash ELSE 'stale' END AS image_hash FROM drawings""",
)(lambda i: lifecycle.repair_hashes(_stale_hashes(i), "OXFORD", "body")[0].select("drawing_id", "image_hash"))
query(
    "snk_10_repair_counts",
    "drawings",
    """SELECT CASE WHEN drawing_id % 11 = 0 THEN 'error' WHEN drawing_id % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS status, count(*) AS n
FROM drawings WHERE source_format = 'OXFORD' GROUP BY 1""",
)(lambda i: lifecycle.repair_hashes(_stale_hashes(i), "OXFORD", "body", dry_run=True)[1])


@query(
    "snk_11_reset_tables",
    sql="""SELECT 'drawings' AS name, 0::BIGINT AS n, (SELECT count(*) FROM orders) AS before_reset""",
)
def _(i):
    root = scratch_path(i.spark, "store")
    seeded = i.orders.select(F.col("o_orderkey").alias("drawing_id"))
    sinks.publish_snapshot(seeded, root, "uploads")
    before = sinks.read_snapshot(i.spark, root, "uploads").count()
    sinks.reset_tables(i.spark, root, "RESET", ["uploads"])
    empty = sinks.read_snapshot(i.spark, root, "uploads")
    return profile.dashboard_counts(drawings=empty).withColumn("before_reset", F.lit(before).cast("bigint"))


def _all_templates(i):
    return i.segments.select(F.col("drawing_id").alias("reference_id"), (F.col("line_id") - 1).alias("ref_id"), "x1", "y1", "x2", "y2")


REF_OUT = "CAST(ref_id AS BIGINT) AS ref_id, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2"
REFS = "refs AS (SELECT drawing_id AS reference_id, line_id - 1 AS ref_id, x1, y1, x2, y2 FROM segments)"

query(
    "snk_12_add_segment",
    "segments",
    f"""SELECT reference_id, {REF_OUT} FROM refs
UNION ALL SELECT 1, coalesce(max(ref_id), -1) + 1, 10, 20, 200, 20 FROM refs WHERE reference_id = 1""",
    ctes=REFS,
)(lambda i: rounded(lifecycle.add_segment(_all_templates(i), 1, 10, 20, 200, 20)))
query(
    "snk_12_drop_segment",
    "segments",
    f"""SELECT reference_id, row_number() OVER (PARTITION BY reference_id ORDER BY ref_id) - 1 AS ref_id,
 CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2
FROM refs WHERE NOT (reference_id = 2 AND ref_id = 1)""",
    ctes=REFS,
)(lambda i: rounded(lifecycle.drop_segment(_all_templates(i), 2, 1)))
query(
    "snk_12_replace_and_clear",
    "segments",
    f"SELECT reference_id, {REF_OUT} FROM refs WHERE reference_id <> 3 AND (x1 <> x2 OR y1 <> y2)",
    ctes="""refs AS (SELECT drawing_id AS reference_id, row_number() OVER (PARTITION BY drawing_id ORDER BY line_id) - 1 AS ref_id, x1, y1, x2, y2
  FROM segments WHERE x1 <> x2 OR y1 <> y2)""",
)(
    lambda i: rounded(
        lifecycle.clear_segments(lifecycle.replace_reference(_all_templates(i).where("x1 <> x2 OR y1 <> y2")), 3)
    )
)

# --- filters -------------------------------------------------------------------------------

query(
    "flt_01_labelled",
    "drawings",
    "SELECT drawing_id, coalesce(features_data NOT IN ('{}', 'null'), false) AS labelled FROM drawings",
)(lambda i: i.drawings.select("drawing_id", L.is_labelled(F.col("features_data")).alias("labelled")))
query(
    "flt_02_equality",
    "drawings",
    "SELECT drawing_id FROM drawings WHERE source_format = 'OCS' AND task_type = 'COPY'",
)(
    lambda i: lifecycle.filter_drawings(i.drawings, patient_id=None, task_type="COPY", source_format="OCS").select("drawing_id")
)
query(
    "flt_03_ground_truth",
    "drawings",
    """SELECT 'any' AS kind, count(*) AS n FROM drawings UNION ALL SELECT 'has', count(ground_truth_correct) FROM drawings
UNION ALL SELECT 'has_not', count(*) - count(ground_truth_correct) FROM drawings""",
)(
    lambda i: profile.dashboard_counts(
        any=lifecycle.filter_ground_truth(i.drawings, None),
        has=lifecycle.filter_ground_truth(i.drawings, True),
        has_not=lifecycle.filter_ground_truth(i.drawings, False),
    ).withColumnRenamed("name", "kind")
)
query(
    "flt_04_with_feature",
    "drawings classed",
    """SELECT drawing_id, 'Quality' AS feature FROM drawings WHERE json_extract(features_data, '$.Quality') IS NOT NULL
UNION ALL SELECT drawing_id, 'Custom_Class_4' FROM classed WHERE json_extract(features_data, '$.Custom_Class."4"') IS NOT NULL""",
)(
    lambda i: lifecycle.with_feature(i.drawings, "Quality")
    .select("drawing_id", F.lit("Quality").alias("feature"))
    .unionByName(lifecycle.with_feature(i.classed, "Custom_Class_4").select("drawing_id", F.lit("Custom_Class_4").alias("feature")))
)
query(
    "flt_05_target_value",
    "drawings classed",
    """SELECT drawing_id, 'score' AS kind, v AS target FROM (SELECT drawing_id, try_cast(json_extract_string(features_data, '$.Total_Score') AS DOUBLE) AS v FROM drawings) WHERE v IS NOT NULL
UNION ALL SELECT drawing_id, 'class', v FROM (SELECT drawing_id, try_cast(json_extract_string(features_data, '$.Custom_Class."2".label') AS DOUBLE) AS v FROM classed) WHERE v IS NOT NULL""",
)(
    lambda i: lifecycle.with_target(i.drawings, "Total_Score")
    .select("drawing_id", F.lit("score").alias("kind"), "target")
    .unionByName(lifecycle.with_target(i.classed, "Custom_Class_2").select("drawing_id", F.lit("class").alias("kind"), "target"))
)
query(
    "flt_06_drop_synthetic",
    "split_ids",
    "SELECT CAST(sample_id AS BIGINT) AS drawing_id, split FROM split_ids WHERE sample_id NOT LIKE 'synthetic%'",
)(lambda i: split_ops.drop_synthetic(i.split_ids).select("drawing_id", "split"))
query(
    "flt_06_synthetic_count",
    "split_ids",
    """SELECT count(*) AS total, count_if(sample_id LIKE 'synthetic%') AS synthetic, count_if(sample_id NOT LIKE 'synthetic%') AS stored FROM split_ids""",
)(lambda i: split_ops.synthetic_count(i.split_ids))
query(
    "flt_06_select_ids",
    "drawings",
    "SELECT drawing_id, patient_id FROM drawings WHERE drawing_id IN (SELECT doc_id FROM labels)",
)(
    lambda i: lifecycle.select_ids(
        i.drawings.select("drawing_id", "patient_id"), i.labels.select(F.col("doc_id").alias("drawing_id"))
    )
)
query(
    "flt_07_low_score",
    "drawings",
    """SELECT drawing_id, v AS score FROM (SELECT drawing_id, try_cast(json_extract_string(features_data, '$.Total_Score') AS DOUBLE) AS v FROM drawings) WHERE v < 20""",
)(lambda i: lifecycle.low_score(i.drawings).select("drawing_id", "score"))
query(
    "flt_08_min_length",
    "segments",
    "SELECT drawing_id, CAST(line_id AS BIGINT) AS line_id FROM segments WHERE sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) >= 30",
)(lambda i: rounded(segments.filter_min_length(i.segments).select("drawing_id", "line_id")))
query(
    "flt_09_clip",
    "segments",
    """SELECT drawing_id, CAST(line_id AS BIGINT) AS line_id, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2
FROM (SELECT drawing_id, line_id, greatest(0, least(399, x1 - 60)) AS x1, greatest(0, least(199, y1 - 40)) AS y1,
 greatest(0, least(399, x2 - 60)) AS x2, greatest(0, least(199, y2 - 40)) AS y2 FROM segments) WHERE x1 <> x2 OR y1 <> y2""",
)(
    lambda i: rounded(
        segments.clip_segments(
            i.segments.withColumns({"x1": F.col("x1") - 60, "x2": F.col("x2") - 60, "y1": F.col("y1") - 40, "y2": F.col("y2") - 40}), 400, 200
        )
    )
)
query(
    "flt_10_lookup",
    "drawings",
    "SELECT drawing_id, patient_id, coalesce(features_data NOT IN ('{}', 'null'), false) AS has_labels FROM drawings WHERE patient_id = 'PC77'",
)(lambda i: lifecycle.lookup(i.drawings.select("drawing_id", "patient_id", "features_data"), patient_id="PC77").drop("features_data"))
query("flt_11_session_rows", "drawings", "SELECT drawing_id, session_id FROM drawings WHERE session_id = 'SES_7'")(
    lambda i: lifecycle.session_rows(i.drawings.select("drawing_id", "session_id"), "SES_7")
)
query(
    "flt_12_drop_templates",
    "drawings",
    "SELECT drawing_id, source_format, task_type FROM drawings WHERE NOT (source_format = 'MAT' AND task_type = 'REFERENCE')",
)(lambda i: ingest.drop_templates(i.drawings.select("drawing_id", "source_format", "task_type")))
query(
    "flt_13_null_if_zero",
    "drawings",
    "SELECT drawing_id, CAST(CASE WHEN ground_truth_correct > 0 THEN ground_truth_correct END AS BIGINT) AS correct, CAST(CASE WHEN ground_truth_extra > 0 THEN ground_truth_extra END AS BIGINT) AS extra FROM drawings",
)(
    lambda i: rounded(
        i.drawings.select(
            "drawing_id",
            L.null_if_zero(F.col("ground_truth_correct")).alias("correct"),
            L.null_if_zero(F.col("ground_truth_extra")).alias("extra"),
        )
    )
)

# --- names and label bags ------------------------------------------------------------------

query(
    "str_01_02_file_names",
    "drawings",
    """SELECT drawing_id, coalesce(upper(nullif(regexp_extract(f, '(?i)(PC[0-9]+)', 1), '')), nullif(regexp_extract(f, '(?i)(Park_[0-9]+)', 1), ''),
  upper(nullif(regexp_extract(f, '(?i)(TEAM[KD][0-9]+)', 1), '')), nullif(regexp_extract(f, '(?i)(Pro[0-9]+)', 1), ''), 'UNKNOWN') AS patient,
  CASE WHEN contains(upper(f), 'REFERENCE') THEN 'REFERENCE' WHEN contains(upper(f), 'RECALL') THEN 'RECALL' WHEN contains(upper(f), 'COPY') THEN 'COPY' ELSE 'UNKNOWN' END AS task
FROM (SELECT drawing_id, original_filename AS f FROM drawings)""",
)(
    lambda i: i.drawings.select(
        "drawing_id", N.patient_id(F.col("original_filename")).alias("patient"), N.task_type(F.col("original_filename")).alias("task")
    )
)
query(
    "str_03_rated_names",
    "drawings",
    """SELECT drawing_id, CASE WHEN ok THEN array_to_string(p[1:len(p)-1], '_') END AS patient, CASE WHEN ok THEN upper(p[len(p)]) END AS task
FROM (SELECT *, len(p) >= 2 AND upper(p[len(p)]) IN ('COPY', 'RECALL') AS ok
 FROM (SELECT drawing_id, string_split(regexp_replace(original_filename, '\\.[^.]*$', ''), '_') AS p FROM drawings))""",
)(
    lambda i: i.drawings.select("drawing_id", N.parse_rated_name(F.col("original_filename")).alias("p")).select(
        "drawing_id", F.col("p.patient_id").alias("patient"), F.col("p.task_type").alias("task")
    )
)
query(
    "str_04_recording_ids",
    "drawings",
    """SELECT drawing_id, coalesce(pc[-1], pro[-1], 'UNKNOWN') AS recording FROM (SELECT drawing_id,
 list_filter(string_split(original_filename, '_'), lambda x: starts_with(x, 'PC')) AS pc,
 list_filter(string_split(original_filename, '_'), lambda x: starts_with(x, 'Pro')) AS pro FROM drawings)""",
)(lambda i: i.drawings.select("drawing_id", N.recording_id(F.col("original_filename")).alias("recording")))
query(
    "str_05_model_names",
    "models",
    """SELECT stem, CASE WHEN len(p) > 3 THEN array_to_string(p[2:len(p)-2], '_') ELSE p[2] END AS feature, array_to_string(p[-2:], '_') AS timestamp
FROM (SELECT stem, string_split(stem, '_') AS p FROM models)""",
)(lambda i: i.models.select("stem", N.parse_model_name(F.col("stem")).alias("p")).select("stem", "p.*"))
query(
    "str_06_class_texts",
    "scores",
    """SELECT id, concat('Class_', CAST(label AS VARCHAR), ' [', CAST(CAST(score AS INT) AS VARCHAR), '-', CAST(CAST(score AS INT) + label AS VARCHAR), ']') AS name,
 CASE WHEN label = 0 THEN concat('= ', CAST(CAST(score AS INT) AS VARCHAR)) ELSE concat('[', CAST(CAST(score AS INT) AS VARCHAR), ', ', CAST(CAST(score AS INT) + label AS VARCHAR), ']') END AS shown FROM scores""",
)(
    lambda i: i.scores.select(
        "id",
        N.class_name(F.col("label"), F.col("score").cast("int"), F.col("score").cast("int") + F.col("label")).alias("name"),
        N.range_text(F.col("score").cast("int"), F.col("score").cast("int") + F.col("label")).alias("shown"),
    )
)
query(
    "str_07_preset_names",
    "scores",
    """SELECT id, CASE WHEN k IN (2,3,4,5) THEN CASE k WHEN 2 THEN ['Poor','Good'] WHEN 3 THEN ['Poor','Fair','Good'] WHEN 4 THEN ['Poor','Fair','Good','Excellent'] ELSE ['Poor','Fair','Moderate','Good','Excellent'] END[label + 1] END AS up,
 CASE WHEN k IN (2,3,4,5) THEN CASE k WHEN 2 THEN ['Good','Poor'] WHEN 3 THEN ['Good','Fair','Poor'] WHEN 4 THEN ['Excellent','Good','Fair','Poor'] ELSE ['Excellent','Good','Moderate','Fair','Poor'] END[label + 1] END AS down
FROM (SELECT id, label, CAST(score AS INT) % 7 AS k FROM scores)""",
)(
    lambda i: i.scores.select(
        "id",
        N.preset_name(F.col("score").cast("int") % 7, F.col("label")).alias("up"),
        N.preset_name(F.col("score").cast("int") % 7, F.col("label"), True).alias("down"),
    )
)
query(
    "str_08_escape",
    "",
    "SELECT page_id, md5(replace(replace(html, '<', '&lt;'), '>', '&gt;')) AS digest FROM pages",
)(lambda i: i.pages.select("page_id", F.md5(N.escape_markup(F.col("html"))).alias("digest")))
query(
    "str_09_session_ids",
    "",
    "SELECT event_id, concat('extract_', strftime(ts, '%Y%m%d_%H%M%S')) AS session_id FROM events",
)(lambda i: i.events.select("event_id", N.session_id("extract", F.col("ts")).alias("session_id")))
query(
    "jsn_01_discover_features",
    "drawings classed",
    """SELECT DISTINCT unnest(json_keys(features_data)) AS feature FROM drawings WHERE features_data NOT IN ('{}', 'null')
UNION SELECT 'Custom_Class_' || unnest(json_keys(features_data, '$.Custom_Class')) FROM classed WHERE features_data IS NOT NULL""",
)(
    lambda i: profile.discover_features(
        i.drawings.select("features_data").unionByName(i.classed.select("features_data"))
    )
)
query(
    "jsn_02_explode_classes",
    "classed",
    """SELECT drawing_id, CAST(k AS BIGINT) AS num_classes, CAST(json_extract_string(features_data, '$.Custom_Class."' || k || '".label') AS BIGINT) AS label,
 json_extract_string(features_data, '$.Custom_Class."' || k || '".name_custom') AS name_custom
FROM (SELECT drawing_id, features_data, unnest(json_keys(features_data, '$.Custom_Class')) AS k FROM classed WHERE features_data IS NOT NULL)""",
)(lambda i: rounded(profile.explode_classes(i.classed).select("drawing_id", "num_classes", "label", "name_custom")))


@query(
    "jsn_03_put_label",
    "classed",
    """SELECT drawing_id, CAST(json_extract_string(features_data, '$.Total_Score') AS DOUBLE) AS score, 1.5::DOUBLE AS quality,
 CAST(json_extract_string(features_data, '$.Custom_Class."4".label') AS BIGINT) AS label4 FROM classed""",
)
def _(i):
    edited = i.classed.withColumn("features_data", L.put_label(F.col("features_data"), "Data_Quality", F.lit("1.5")))
    f = F.col("features_data")
    return edited.select(
        "drawing_id",
        L.target_value(f, "Total_Score").alias("score"),
        L.target_value(f, "Data_Quality").alias("quality"),
        L.target_value(f, "Custom_Class_4").cast("bigint").alias("label4"),
    )


query(
    "jsn_04_extraction_meta",
    "drawings",
    """SELECT drawing_id, CAST(json_extract_string(extraction_metadata, '$.width') AS BIGINT) AS width, CAST(json_extract_string(extraction_metadata, '$.height') AS BIGINT) AS height,
 CAST(json_extract_string(extraction_metadata, '$.line_thickness') AS DOUBLE) AS line_thickness FROM drawings""",
)(lambda i: rounded(i.drawings.select("drawing_id", L.extraction_meta(F.col("extraction_metadata")).alias("m")).select("drawing_id", "m.*")))
query(
    "hsh_01_content_hash",
    "",
    "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN lang ELSE text END) AS image_hash FROM documents",
)(
    lambda i: i.documents.select(
        "doc_id", V.content_hash(F.when(F.col("doc_id") % 3 != 0, F.col("text")), F.col("lang")).alias("image_hash")
    )
)

# --- joins ---------------------------------------------------------------------------------


def _stored(i):
    return i.drawings.where("drawing_id % 5 = 0")


def _batch(i):
    return i.drawings.where("drawing_id % 5 <> 0")


query(
    "jn_01_check_duplicates",
    "drawings",
    """SELECT b.drawing_id, u.m IS NOT NULL OR t.m IS NOT NULL AS is_duplicate,
 CASE WHEN u.m IS NOT NULL THEN 'upload' WHEN t.m IS NOT NULL THEN 'training' END AS found_in,
 CASE WHEN u.m IS NOT NULL THEN u.m ELSE t.m END AS stored_id,
 CASE WHEN u.m IS NOT NULL THEN u.n ELSE t.n END AS stored_name, substring(b.image_hash, 1, 16) AS hash_prefix
FROM (SELECT * FROM drawings WHERE drawing_id % 5 <> 0) b
LEFT JOIN (SELECT image_hash, min(drawing_id) AS m, arg_min(original_filename, drawing_id) AS n FROM drawings WHERE drawing_id % 5 = 0 AND drawing_id % 2 = 0 GROUP BY 1) u USING (image_hash)
LEFT JOIN (SELECT image_hash, min(drawing_id) AS m, arg_min(concat(patient_id, '_', task_type), drawing_id) AS n FROM drawings WHERE drawing_id % 5 = 0 AND drawing_id % 2 = 1 GROUP BY 1) t USING (image_hash)""",
)(
    lambda i: ingest.check_duplicates(
        _batch(i).withColumnRenamed("uploaded_seq", "uploaded_at"),
        _stored(i).where("drawing_id % 2 = 0").withColumnRenamed("uploaded_seq", "uploaded_at"),
        _stored(i).where("drawing_id % 2 = 1").withColumn("original_filename", F.lit(None).cast("string")).withColumnRenamed("uploaded_seq", "uploaded_at"),
    ).drop("stored_at")
)
query(
    "jn_02_dedup_ingest",
    "drawings",
    """SELECT drawing_id, image_hash FROM (SELECT *, row_number() OVER (PARTITION BY image_hash ORDER BY uploaded_seq, drawing_id) AS rn FROM drawings WHERE drawing_id % 5 <> 0)
WHERE rn = 1 AND image_hash NOT IN (SELECT image_hash FROM drawings WHERE drawing_id % 5 = 0)""",
)(lambda i: ingest.dedup_ingest(_batch(i).select("drawing_id", "image_hash", "uploaded_seq"), _stored(i)).select("drawing_id", "image_hash"))
query(
    "jn_02_first_of_hash",
    "drawings",
    "SELECT min(drawing_id) AS drawing_id, image_hash FROM drawings GROUP BY 2",
)(lambda i: ingest.first_of_hash(i.drawings.select("drawing_id", "image_hash"), ["drawing_id"]))
query(
    "jn_03_dedup_by_source",
    "drawings",
    """SELECT b.drawing_id FROM drawings b WHERE drawing_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM drawings s WHERE s.drawing_id % 5 = 0 AND s.source_format = b.source_format
 AND s.image_hash = b.image_hash AND (b.source_format <> 'MAT' OR s.original_filename = b.original_filename))""",
)(lambda i: ingest.dedup_by_source(_batch(i), _stored(i)).select("drawing_id"))
query(
    "jn_04_name_conflicts",
    "drawings",
    "SELECT drawing_id, session_id FROM drawings WHERE drawing_id % 5 <> 0 AND session_id IN (SELECT session_id FROM drawings WHERE drawing_id % 10 = 0)",
)(
    lambda i: ingest.name_conflicts(
        _batch(i).select("drawing_id", "session_id"), i.drawings.where("drawing_id % 10 = 0"), "session_id"
    ).select("drawing_id", "session_id")
)


@query(
    "jn_05_ratings_files",
    "ratings",
    """SELECT patient_id AS id, task_type AS cond, CASE WHEN CAST(substr(patient_id, 2) AS INT) % 7 = 0 THEN 'original' WHEN CAST(substr(patient_id, 2) AS INT) % 5 = 0 THEN 'normalised' END AS missing FROM ratings""",
)
def _(i):
    rows = i.ratings.select(F.col("patient_id").alias("id"), F.col("task_type").alias("cond"), F.substring("patient_id", 2, 9).cast("int").alias("no"))
    name = F.concat("id", F.lit("_"), "cond", F.lit(".png")).alias("filename")
    found = ingest.join_ratings_files(rows, rows.where("no % 7 <> 0").select(name), rows.where("no % 5 <> 0").select(name))
    return found.select("id", "cond", "missing")


CSV_CTE = """csv AS (SELECT doc_id AS line_no, CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('pc', CAST((doc_id * 3) % 1500 AS VARCHAR)) END AS p,
 CASE (doc_id * 3) % 1500 % 3 WHEN 0 THEN 'copy' WHEN 1 THEN 'recall' ELSE 'Reference' END AS t,
 CASE WHEN doc_id % 4 = 0 THEN '<b>' WHEN doc_id % 4 = 1 THEN '' ELSE CAST(doc_id % 61 AS VARCHAR) END AS s FROM documents),
hit AS (SELECT csv.*, d.drawing_id FROM csv LEFT JOIN (SELECT lower(patient_id) AS p, lower(task_type) AS t, min(drawing_id) AS drawing_id FROM drawings GROUP BY 1, 2) d ON csv.p = d.p AND lower(csv.t) = d.t AND csv.p <> '')"""


def _label_lines(i):
    ident = (F.col("doc_id") * 3) % 1500
    return i.documents.select(
        F.col("doc_id").alias("line_no"),
        F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.concat(F.lit(" pc"), ident.cast("string"))).alias("Patient"),
        F.when(ident % 3 == 0, "copy").when(ident % 3 == 1, "recall").otherwise("Reference").alias("Task"),
        F.when(F.col("doc_id") % 4 == 0, "<b>").when(F.col("doc_id") % 4 == 1, "").otherwise((F.col("doc_id") % 61).cast("string")).alias("Total_Score"),
        F.lit(None).cast("string").alias("Data_Quality"),
    )


query(
    "jn_06_label_csv_report",
    "drawings",
    """SELECT line_no, drawing_id, CASE WHEN drawing_id IS NOT NULL AND line_no % 4 > 1 THEN 'updated' ELSE 'skipped' END AS status,
 CASE WHEN drawing_id IS NOT NULL AND line_no % 4 = 0 THEN concat(p, '/', t, ': Invalid Total_Score ''&lt;b&gt;''') ELSE '' END AS errors FROM hit""",
    ctes=CSV_CTE,
)(lambda i: ingest.apply_label_csv(i.drawings, _label_lines(i))[1])
query(
    "jn_06_label_csv_applied",
    "drawings",
    """SELECT d.drawing_id, coalesce(n.v, try_cast(json_extract_string(d.features_data, '$.Total_Score') AS DOUBLE)) AS score,
 try_cast(json_extract_string(d.features_data, '$.Quality') AS DOUBLE) AS quality
FROM drawings d LEFT JOIN (SELECT drawing_id, CAST(arg_max(s, line_no) AS DOUBLE) AS v FROM hit WHERE drawing_id IS NOT NULL AND line_no % 4 > 1 GROUP BY 1) n USING (drawing_id)""",
    ctes=CSV_CTE,
)(
    lambda i: ingest.apply_label_csv(i.drawings, _label_lines(i))[0].select(
        "drawing_id",
        L.target_value(F.col("features_data"), "Total_Score").alias("score"),
        L.target_value(F.col("features_data"), "Quality").alias("quality"),
    )
)
query(
    "jn_06_label_csv_counts",
    "drawings",
    """SELECT count_if(drawing_id IS NOT NULL AND line_no % 4 > 1) AS updated, count_if(drawing_id IS NULL OR line_no % 4 <= 1) AS skipped,
 count_if(drawing_id IS NOT NULL AND line_no % 4 = 0) AS lines_with_errors, count(*) AS total_rows FROM hit""",
    ctes=CSV_CTE,
)(lambda i: ingest.csv_report_counts(ingest.apply_label_csv(i.drawings, _label_lines(i))[1]))
query(
    "jn_07_latest_evaluation",
    "evaluations",
    """SELECT image_id, id, CAST(correct_lines AS BIGINT) AS correct_lines FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY evaluated_at DESC, id DESC) AS rn FROM evaluations) WHERE rn = 1""",
)(lambda i: rounded(ingest.latest_evaluation(i.evaluations, ["correct_lines"]).select("image_id", "id", "correct_lines")))
query(
    "jn_11_validate_scores",
    "ratings ratings_stored",
    """SELECT s.patient_id, s.task_type, CASE WHEN r.patient_id IS NULL THEN concat('Entry not found in CSV: ', s.patient_id, '_', s.task_type)
 WHEN r.total_score <> s.total_score THEN concat('TotalScore mismatch: expected ', CAST(r.total_score AS VARCHAR), ', got ', CAST(s.total_score AS VARCHAR)) ELSE '' END AS errors
FROM ratings_stored s LEFT JOIN (SELECT * FROM ratings WHERE total_score <> 13) r USING (patient_id, task_type)""",
)(
    lambda i: quality.validate_scores(i.ratings_stored, i.ratings.where("total_score <> 13")).select(
        "patient_id", "task_type", F.array_join("errors", "; ").alias("errors")
    )
)


@query(
    "jn_12_validate_files",
    "drawings",
    """SELECT drawing_id, CASE WHEN drawing_id % 7 = 0 THEN 'Original file not found' ELSE CASE WHEN drawing_id % 4 = 0 THEN 'Image hash mismatch' ELSE '' END END AS errors,
 CASE WHEN drawing_id % 7 <> 0 AND drawing_id % 3 = 0 THEN 'Original file size mismatch' ELSE '' END AS warnings FROM drawings""",
)
def _(i):
    size = F.length(F.encode("body", "utf-8")).cast("long")
    base = i.drawings.select(
        "drawing_id", F.concat(F.lit("f"), F.col("drawing_id").cast("string")).alias("original_filename"), "image_hash", size.alias("length")
    )
    stored = base.select(
        "drawing_id",
        "original_filename",
        "image_hash",
        (F.col("length") + (F.col("drawing_id") % 3 == 0).cast("int")).alias("original_length"),
        F.col("length").alias("processed_length"),
    )
    original = base.where("drawing_id % 7 <> 0").withColumn(
        "image_hash", F.when(F.col("drawing_id") % 4 == 0, "other").otherwise(F.col("image_hash"))
    )
    return quality.validate_files(stored, original, base).select(
        "drawing_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings")
    )


query(
    "jn_15_orphan_metadata",
    "models model_metadata",
    "SELECT stem FROM model_metadata WHERE stem NOT IN (SELECT stem FROM models)",
)(lambda i: catalog.orphan_metadata(i.model_metadata, i.models).select("stem"))
query(
    "jn_16_expected_vs_actual",
    "cases",
    """SELECT a.test_id, CAST(a.expected_correct AS BIGINT) AS expected_correct, CAST(b.correct_lines AS BIGINT) AS correct_lines FROM cases a JOIN (SELECT * FROM cases WHERE test_id % 3 <> 0) b USING (test_id)""",
)(
    lambda i: rounded(
        metrics.expected_vs_actual(i.cases.select("test_id", "expected_correct"), i.cases.where("test_id % 3 <> 0").select("test_id", "correct_lines"))
    )
)

# --- ordering, paging, sets ----------------------------------------------------------------

query(
    "srt_01_recent",
    "evaluations",
    "SELECT id, image_id FROM evaluations ORDER BY evaluated_at DESC, id DESC LIMIT 50",
)(lambda i: lifecycle.recent(i.evaluations, "evaluated_at", 50).select("id", "image_id"))
query(
    "srt_02_page",
    "drawings",
    "SELECT drawing_id, uploaded_seq, (SELECT count(*) FROM drawings) AS total FROM drawings ORDER BY uploaded_seq DESC, drawing_id LIMIT 20 OFFSET 40",
)(lambda i: lifecycle.page(i.drawings.select("drawing_id", "uploaded_seq"), [F.desc("uploaded_seq"), "drawing_id"], 40, 20))
query("srt_03_two_keys", "drawings", "SELECT row_number() OVER (ORDER BY task_type, source_format, drawing_id) AS place, task_type, source_format, drawing_id FROM drawings")(
    lambda i: ordered.numbered_sort(i.drawings.select("task_type", "source_format", "drawing_id"), "task_type", "source_format", "drawing_id")
)
query("srt_04_first_by", "drawings", "SELECT drawing_id, patient_id FROM drawings ORDER BY drawing_id LIMIT 1")(
    lambda i: lifecycle.first_by(i.drawings.select("drawing_id", "patient_id"), "drawing_id")
)
query(
    "srt_05_head_where",
    "ratings",
    "SELECT patient_id, CAST(total_score AS BIGINT) AS total_score FROM ratings WHERE task_type = 'RECALL' ORDER BY patient_id LIMIT 5",
)(lambda i: rounded(lifecycle.head_where(i.ratings, F.col("task_type") == "RECALL", 5, "patient_id").select("patient_id", "total_score")))
query(
    "set_01_missing_keys",
    "ratings ratings_stored",
    """SELECT patient_id, task_type FROM ratings WHERE CAST(substr(patient_id, 2) AS INT) % 2 = 0 AND patient_id NOT IN (SELECT patient_id FROM ratings_stored)""",
)(
    lambda i: quality.missing_keys(
        i.ratings,
        i.ratings_stored,
        i.ratings.where(F.substring("patient_id", 2, 9).cast("int") % 2 == 0).select(
            F.concat_ws("_", "patient_id", "task_type").alias("k")
        ).select(F.concat("k", F.lit(".png")).alias("filename")),
    )
)
query(
    "set_02_add_synthetic",
    "drawings",
    """SELECT CAST(drawing_id AS VARCHAR) AS sample_id, patient_id, features_data FROM drawings
UNION ALL SELECT concat('synthetic_bad_', CAST(drawing_id AS VARCHAR)), concat('SYNTHETIC_BAD_L', CAST(drawing_id % 5 AS VARCHAR)), '{"Total_Score": 0.0}' FROM drawings WHERE drawing_id % 50 = 0""",
)(
    lambda i: synth.add_synthetic(
        i.drawings,
        synth.label_synthetic(
            i.drawings.where("drawing_id % 50 = 0").select(F.col("drawing_id").alias("synth_id"), (F.col("drawing_id") % 5).alias("level")),
            "Total_Score",
        ),
    )
)
query(
    "set_05_line_pool",
    "segments ref_segments",
    """SELECT 'real' AS origin, count(*) AS n, CAST(sum(x1) AS BIGINT) AS sx FROM segments UNION ALL SELECT 'template', count(*), CAST(sum(x1) AS BIGINT) FROM ref_segments""",
)(
    lambda i: synth.line_pool(i.segments, i.ref_segments).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("x1").alias("sx"))
)
