"""Registered queries: profiling, classes, splits, scaling, metrics, ordered logic."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window as W, functions as F

from strokelake.config import SCORE_RANGES
from strokelake.functions import labels as L, values as V
from strokelake.operators import augment, catalog, classes, ingest, lifecycle, metrics, ordered, profile, quality, scaler, split
from strokelake.plans import pipelines
from strokelake.plans.registry import query, r, rounded

COUNT_ROWS = "CAST(count(*) AS BIGINT)"
Q = "try_cast(json_extract_string(features_data, '$.Total_Score') AS DOUBLE)"

# --- profiling -----------------------------------------------------------------------------

query(
    "agg_01_dataset_info",
    "drawings",
    """SELECT 'all' AS kind, 'all' AS name, count(*) AS total, count_if(l) AS labelled, count_if(NOT l) AS unlabelled FROM t
UNION ALL SELECT 'source', source_format, count(*), count_if(l), count_if(NOT l) FROM t GROUP BY source_format
UNION ALL SELECT 'task', task_type, count(*), count_if(l), count_if(NOT l) FROM t GROUP BY task_type""",
    ctes="t AS (SELECT *, coalesce(features_data NOT IN ('{}', 'null'), false) AS l FROM drawings)",
)(lambda i: profile.dataset_info(i.drawings))
query(
    "agg_02_feature_stats",
    "drawings",
    """SELECT feature, count(*) AS count, count(v) AS numeric_count, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
 round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median
FROM (SELECT feature, try_cast(json_extract_string(features_data, '$.' || feature) AS DOUBLE) AS v
 FROM (SELECT features_data, unnest(json_keys(features_data)) AS feature FROM drawings WHERE features_data NOT IN ('{}', 'null'))) GROUP BY 1""",
)(lambda i: rounded(profile.feature_stats(i.drawings)))
query(
    "agg_03_class_set_stats",
    "classed",
    """SELECT CAST(k AS BIGINT) AS num_classes, count(*) AS count, array_to_string(list_sort(list(DISTINCT n)), ', ') AS names, CAST(k AS BIGINT) - 1 AS max_label
FROM (SELECT k, json_extract_string(features_data, '$.Custom_Class."' || k || '".name_custom') AS n
 FROM (SELECT features_data, unnest(json_keys(features_data, '$.Custom_Class')) AS k FROM classed WHERE features_data IS NOT NULL)) GROUP BY k""",
)(lambda i: rounded(profile.class_set_stats(i.classed)))
DESCRIBE = """count(v) AS count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
 round(max(v) - min(v), 6) AS range, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75"""
query("agg_04_describe", "scores", f"SELECT {DESCRIBE} FROM (SELECT amount AS v FROM scores)")(
    lambda i: rounded(profile.describe_target(i.scores, "amount"))
)
query(
    "agg_04_describe_by_group",
    "predictions_reg",
    f"SELECT split, {DESCRIBE} FROM (SELECT split, prediction AS v FROM predictions_reg) GROUP BY 1",
)(lambda i: rounded(profile.describe_target(i.predictions_reg, "prediction", ["split"])))


def _histogram_sql(value: str, bins: int) -> str:
    return f"""SELECT CAST(b AS BIGINT) AS bin, round(lo + b * w, 6) AS min, round(lo + (b + 1) * w, 6) AS max, coalesce(n, 0) AS count,
 round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count({value}) FROM scores), 2) AS percentage
FROM (SELECT unnest(range({bins})) AS b) CROSS JOIN (SELECT min({value}) AS lo, (max({value}) - min({value})) / {bins} AS w FROM scores)
LEFT JOIN (SELECT least(floor(({value} - lo) / w), {bins} - 1) AS k, count(*) AS n FROM scores, (SELECT min({value}) AS lo, (max({value}) - min({value})) / {bins} AS w FROM scores) GROUP BY 1) ON k = b"""


query("agg_05_histogram", "scores", _histogram_sql("amount", 25))(lambda i: rounded(profile.histogram(i.scores, "amount")))
RANGES = [(0, 15), (16, 30), (31, 40), (41, 50)]
query(
    "agg_06_recount_classes",
    "scores",
    " UNION ALL ".join(
        f"""SELECT {k}::BIGINT AS class_id, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi, count_if(score BETWEEN {lo} AND {hi}) AS count,
 round(count_if(score BETWEEN {lo} AND {hi}) * 100.0::DOUBLE / count(*), 2) AS percentage FROM scores"""
        for k, (lo, hi) in enumerate(RANGES)
    ),
)(lambda i: rounded(classes.recount_classes(i.scores, "score", RANGES)))
query(
    "agg_07_estimate_from_histogram",
    "scores",
    f"""SELECT CAST(class_id AS BIGINT) AS class_id, CAST(floor(sum(CASE WHEN h.max >= r.lo AND h.min <= r.hi THEN h.count * (least(h.max, r.hi) - greatest(h.min, r.lo)) / (h.max - h.min) ELSE 0 END) + 0.5) AS BIGINT) AS count
FROM h CROSS JOIN (VALUES (0, 0.0::DOUBLE, 15.0::DOUBLE), (1, 16.0, 30.0), (2, 31.0, 40.0), (3, 41.0, 50.0)) AS r(class_id, lo, hi) GROUP BY 1""",
    ctes=f"h AS ({_histogram_sql('score', 25)})",
)(
    lambda i: rounded(
        classes.estimate_from_histogram(profile.histogram(i.scores, "score"), RANGES).select("class_id", "count")
    )
)
query(
    "agg_08_class_distribution",
    "classed",
    """SELECT label, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM t), 2) AS percentage, any_value(name) AS name, any_value(generic) AS generic,
 CASE label WHEN 0 THEN '[0, 14]' WHEN 1 THEN '[15, 29]' WHEN 2 THEN '[30, 44]' ELSE '[45, 60]' END AS range FROM t GROUP BY 1""",
    ctes="""t AS (SELECT CAST(json_extract_string(features_data, '$.Custom_Class."4".label') AS BIGINT) AS label, json_extract_string(features_data, '$.Custom_Class."4".name_custom') AS name,
 json_extract_string(features_data, '$.Custom_Class."4".name_generic') AS generic FROM classed WHERE json_extract(features_data, '$.Custom_Class."4"') IS NOT NULL)""",
)(lambda i: rounded(classes.class_distribution(i.classed, 4)))
query(
    "agg_09_duplicate_groups",
    "drawings",
    "SELECT image_hash, count(*) AS n FROM drawings GROUP BY 1 HAVING count(*) > 1",
)(lambda i: lifecycle.duplicate_groups(i.drawings))


def _status(i):
    batch = i.drawings.where("drawing_id % 5 <> 0").select(
        "drawing_id",
        "original_filename",
        F.when(F.col("drawing_id") % 13 != 0, F.col("image_hash")).alias("image_hash"),
        ((F.col("drawing_id") % 2) + 1).cast("int").alias("images"),
    )
    return ingest.file_status(batch, i.drawings.where("drawing_id % 5 = 0"))


STATUS = """b AS (SELECT drawing_id, CASE WHEN drawing_id % 13 <> 0 THEN image_hash END AS h, drawing_id % 2 + 1 AS images FROM drawings WHERE drawing_id % 5 <> 0),
s AS (SELECT drawing_id, images, CASE WHEN h IS NULL THEN 'error' WHEN h IN (SELECT image_hash FROM drawings WHERE drawing_id % 5 = 0)
 OR drawing_id <> min(drawing_id) OVER (PARTITION BY h) THEN 'duplicate' ELSE 'success' END AS status FROM b)"""
query("agg_10_file_status", "drawings", "SELECT drawing_id, status, CASE WHEN status = 'success' THEN images ELSE 0 END AS images_extracted FROM s", ctes=STATUS)(
    lambda i: rounded(_status(i).select("drawing_id", "status", "images_extracted"))
)
query(
    "agg_10_ingest_report",
    "drawings",
    """SELECT count(*) AS files, count_if(status = 'success') AS success, count_if(status = 'duplicate') AS duplicate, count_if(status = 'error') AS error,
 CAST(sum(CASE WHEN status = 'success' THEN images ELSE 0 END) AS BIGINT) AS images_extracted FROM s""",
    ctes=STATUS,
)(lambda i: ingest.ingest_report(_status(i)))
query(
    "agg_15_score_cases",
    "cases",
    """SELECT test_id, correct_lines - expected_correct AS correct_diff, missing_lines - expected_missing AS missing_diff, extra_lines - expected_extra AS extra_diff,
 round(least(1, greatest(correct_lines - extra_lines, 0) / 9.0::DOUBLE), 6) AS detection_score,
 round(greatest(0, least(1, 1 - (abs(correct_lines - expected_correct) + abs(missing_lines - expected_missing) + abs(extra_lines - expected_extra)) / 27.0::DOUBLE)), 6) AS prediction_accuracy
FROM (SELECT test_id, CAST(correct_lines AS BIGINT) AS correct_lines, CAST(missing_lines AS BIGINT) AS missing_lines, CAST(extra_lines AS BIGINT) AS extra_lines,
 CAST(expected_correct AS BIGINT) AS expected_correct, CAST(expected_missing AS BIGINT) AS expected_missing, CAST(expected_extra AS BIGINT) AS expected_extra FROM cases)""",
)(
    lambda i: rounded(
        metrics.score_cases(i.cases, 9).select("test_id", "correct_diff", "missing_diff", "extra_diff", "detection_score", "prediction_accuracy")
    )
)
CASES = """c AS (SELECT *, test_id % 29 <> 0 AS done, least(1, greatest(correct_lines - extra_lines, 0) / 9.0::DOUBLE) AS d,
 greatest(0, 1 - (abs(correct_lines - expected_correct) + abs(missing_lines - expected_missing) + abs(extra_lines - expected_extra)) / 27.0::DOUBLE) AS p FROM cases)"""
query(
    "agg_16_suite_stats",
    "cases",
    """SELECT count(*) AS total_tests, count_if(done) AS successful, count_if(NOT done) AS failed, round(avg(d) FILTER (WHERE done), 6) AS average_detection_score,
 round(avg(p) FILTER (WHERE done), 6) AS average_prediction_accuracy, count_if(done AND d = 1) AS perfect_detections, count_if(done AND p = 1) AS perfect_predictions,
 round(avg(abs(correct_lines - expected_correct)) FILTER (WHERE done), 6) AS average_correct_diff, round(avg(abs(missing_lines - expected_missing)) FILTER (WHERE done), 6) AS average_missing_diff,
 round(avg(abs(extra_lines - expected_extra)) FILTER (WHERE done), 6) AS average_extra_diff FROM c""",
    ctes=CASES,
)(
    lambda i: rounded(
        metrics.suite_stats(
            metrics.score_cases(i.cases.withColumn("extra_lines", F.when(F.col("test_id") % 29 != 0, F.col("extra_lines"))), 9).withColumns(
                {
                    n: F.when(F.col("test_id") % 29 != 0, F.col(n))
                    for n in ("detection_score", "prediction_accuracy", "correct_diff", "missing_diff", "extra_diff")
                }
            )
        )
    )
)
query(
    "agg_17_ground_truth_accuracy",
    "drawings",
    """SELECT drawing_id, CAST(e AS BIGINT) AS total_error, CASE WHEN e IS NOT NULL THEN round(greatest(0, 1 - e / 27.0::DOUBLE), 6) END AS ground_truth_accuracy
FROM (SELECT drawing_id, abs(n_chars % 10 - ground_truth_correct) + abs((9 - n_chars % 10) - (9 - ground_truth_correct)) + abs(n_chars % 3 - coalesce(ground_truth_extra, 0)) AS e FROM drawings)""",
)(
    lambda i: rounded(
        metrics.ground_truth_accuracy(
            i.drawings.withColumns(
                {"correct_lines": F.col("n_chars") % 10, "missing_lines": 9 - F.col("n_chars") % 10, "extra_lines": F.col("n_chars") % 3}
            ),
            9,
        ).select("drawing_id", "total_error", "ground_truth_accuracy")
    )
)
REG = """count(*) AS num_samples, round(avg((p-t)*(p-t)), 6) AS mse, round(sqrt(avg((p-t)*(p-t))), 6) AS rmse, round(avg(abs(p-t)), 6) AS mae,
 round(1 - sum((p-t)*(p-t)) / (var_pop(t) * count(*)), 6) AS r2, round(100 * avg(CASE WHEN t <> 0 THEN abs((t-p)/t) END), 6) AS mape"""
PRED = "p AS (SELECT split, target AS t, prediction AS p FROM predictions_reg)"
query("agg_18_regression_metrics", "predictions_reg", f"SELECT {REG} FROM p", ctes=PRED)(
    lambda i: rounded(metrics.regression_metrics(i.predictions_reg))
)
query(
    "agg_19_confusion_matrix",
    "predictions_cls",
    """SELECT t AS target, g AS prediction, count(p.id) AS n FROM (SELECT unnest(range(64)) AS t) CROSS JOIN (SELECT unnest(range(64)) AS g)
LEFT JOIN predictions_cls p ON p.target = t AND p.prediction = g GROUP BY 1, 2""",
)(lambda i: rounded(metrics.confusion_matrix(i.predictions_cls, 64)))
CLS = """m AS (SELECT c, (SELECT count(*) FROM predictions_cls WHERE target = c) AS s, (SELECT count(*) FROM predictions_cls WHERE prediction = c) AS g,
 (SELECT count(*) FROM predictions_cls WHERE prediction = c AND target = c) AS tp FROM (SELECT unnest(range(64)) AS c)),
f AS (SELECT c, s, tp, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS p, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS r FROM m),
x AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM f)"""
query(
    "agg_20_class_metrics",
    "predictions_cls",
    "SELECT c AS class_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, s AS support, tp FROM x",
    ctes=CLS,
)(lambda i: rounded(metrics.class_metrics(i.predictions_cls, 64)))
query(
    "agg_20_classification_metrics",
    "predictions_cls",
    """SELECT (SELECT round(avg(CASE WHEN target = prediction THEN 1.0::DOUBLE ELSE 0 END), 6) FROM predictions_cls) AS accuracy, (SELECT round(avg(f1), 6) FROM x) AS macro_f1,
 (SELECT count(*) FROM predictions_cls) AS num_samples""",
    ctes=CLS,
)(lambda i: rounded(metrics.classification_metrics(i.predictions_cls, 64)))
query(
    "agg_21_metric_sample",
    "predictions_reg",
    """SELECT id, CAST(sub_id AS BIGINT) AS sub_id, round(target, 6) AS target, round(prediction, 6) AS prediction FROM predictions_reg ORDER BY id, sub_id, target, prediction LIMIT 1000""",
)(
    lambda i: rounded(
        metrics.metric_sample(i.predictions_reg, 1000, ["id", "sub_id", "target", "prediction"]).select("id", "sub_id", "target", "prediction")
    )
)
query(
    "agg_22_validation_report",
    "ratings ratings_stored",
    """SELECT count(*) AS total, count_if(ok) AS valid, count_if(NOT ok) AS errors, 0::BIGINT AS warnings, CAST(min(total_score) AS BIGINT) AS min_score, CAST(max(total_score) AS BIGINT) AS max_score,
 count_if(task_type = 'COPY') AS copy_rows, count_if(task_type = 'RECALL') AS recall_rows, round(count_if(ok) * 100.0::DOUBLE / count(*), 2) AS valid_pct, round(count_if(NOT ok) * 100.0::DOUBLE / count(*), 2) AS error_pct
FROM (SELECT s.*, r.total_score IS NOT NULL AND r.total_score = s.total_score AS ok FROM ratings_stored s LEFT JOIN ratings r USING (patient_id, task_type))""",
)(lambda i: rounded(quality.validation_report(quality.validate_scores(i.ratings_stored, i.ratings))))
query(
    "agg_22_validation_errors",
    "ratings ratings_stored",
    """SELECT s.patient_id, s.task_type, concat('TotalScore mismatch: expected ', CAST(r.total_score AS VARCHAR), ', got ', CAST(s.total_score AS VARCHAR)) AS error
FROM ratings_stored s JOIN ratings r USING (patient_id, task_type) WHERE r.total_score <> s.total_score""",
)(lambda i: quality.validation_errors(quality.validate_scores(i.ratings_stored, i.ratings)))
READY = {"all": "true", "one": "drawing_id = 3", "none": "drawing_id < 0", "few": "drawing_id IN (3, 4, 10, 11)"}
query(
    "agg_23_readiness",
    "drawings",
    """SELECT g, blocking = '' AS ready, CASE WHEN blocking = '' THEN 'ready' ELSE 'not_ready' END AS status, total, labelled, features, blocking AS issues FROM (
 SELECT g, total, labelled, features, concat_ws('; ', CASE WHEN total < 2 THEN concat('Only ', total, ' images (minimum 2 required)') END, CASE WHEN labelled < 2 THEN concat('Only ', labelled, ' labeled images') END,
  CASE WHEN features = 0 THEN 'No features defined' END, rare) AS blocking
 FROM parts)""",
    ctes=f"""chosen AS ({" UNION ALL ".join(f"SELECT '{g}' AS g, * FROM drawings WHERE {part}" for g, part in READY.items())}),
names AS (SELECT unnest(['{"', '".join(READY)}']) AS g),
carried AS (SELECT g, feature, count(*) AS n FROM (SELECT g, unnest(json_keys(features_data)) AS feature FROM chosen WHERE features_data NOT IN ('{{}}', 'null')) GROUP BY 1, 2),
parts AS (SELECT g, (SELECT count(*) FROM chosen c WHERE c.g = names.g) AS total, (SELECT count(*) FROM chosen c WHERE c.g = names.g AND features_data NOT IN ('{{}}', 'null')) AS labelled,
 (SELECT count(*) FROM carried c WHERE c.g = names.g) AS features,
 (SELECT string_agg(concat('Feature ''', feature, ''' only has ', n, ' samples'), '; ' ORDER BY feature) FROM carried c WHERE c.g = names.g AND n < 2) AS rare FROM names)""",
)(
    lambda i: functools.reduce(
        DataFrame.unionByName,
        [
            profile.training_readiness(i.drawings.where(part)).select(
                F.lit(g).alias("g"), "ready", "status", "total", "labelled", "features", F.array_join("issues", "; ").alias("issues")
            )
            for g, part in READY.items()
        ],
    )
)
query(
    "agg_24_augmentation_stats",
    "samples",
    """SELECT split, count_if(aug_idx = 0) AS original, count_if(aug_idx > 0) AS augmented, count(*) AS total, round(count(*) / count_if(aug_idx = 0), 6) AS multiplier FROM samples GROUP BY 1""",
)(lambda i: rounded(augment.augmentation_stats(i.samples)))
query(
    "agg_25_split_stats",
    "samples",
    """SELECT split, count(*) AS samples, CAST(ceil(count(*) / 8.0) AS BIGINT) AS batches, round(min(target), 6) AS min_target, round(max(target), 6) AS max_target FROM samples GROUP BY 1""",
)(lambda i: rounded(split.split_stats(i.samples, "target", 8)))
query(
    "agg_26_overfit_summary",
    "predictions_reg",
    """SELECT round(abs(max(r2) FILTER (WHERE split = 'train') - max(r2) FILTER (WHERE split = 'val')), 6) AS r2_difference,
 round(max(rmse) FILTER (WHERE split = 'val') / greatest(max(rmse) FILTER (WHERE split = 'train'), 0.0001), 6) AS rmse_ratio
FROM (SELECT split, sqrt(avg((p-t)*(p-t))) AS rmse, 1 - sum((p-t)*(p-t)) / (var_pop(t) * count(*)) AS r2 FROM p GROUP BY 1)""",
    ctes=PRED,
)(lambda i: rounded(metrics.overfit_summary(metrics.regression_metrics(i.predictions_reg, ["split"]))))
query(
    "agg_27_epoch_loss",
    "batches",
    "SELECT model, CAST(epoch AS BIGINT) AS epoch, phase, round(avg(loss), 6) AS loss FROM batches GROUP BY 1, 2, 3",
)(lambda i: rounded(metrics.epoch_loss(i.batches)))
query(
    "agg_29_dashboard",
    "evaluations cases models ref_segments",
    """SELECT 'evaluations' AS name, count(*) AS n FROM evaluations UNION ALL SELECT 'cases', count(*) FROM cases UNION ALL SELECT 'models', count(*) FROM models UNION ALL SELECT 'references', count(*) FROM ref_segments""",
)(lambda i: profile.dashboard_counts(evaluations=i.evaluations, cases=i.cases, models=i.models, references=i.ref_segments))
query(
    "agg_30_infer_augmentation_stats",
    "samples",
    "SELECT split, count(*) AS total, count_if(contains(name, 'original')) AS original, count_if(contains(name, 'aug')) AS augmented FROM samples GROUP BY 1",
)(lambda i: augment.infer_augmentation_stats(i.samples))

# --- ordered logic -------------------------------------------------------------------------

query(
    "win_01_with_share",
    "drawings",
    "SELECT session_id, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM drawings), 2) AS percentage FROM drawings GROUP BY 1",
)(lambda i: profile.with_share(i.drawings.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))))
ORDER = "CAST('0x' || substr(md5('42-' || CAST(id AS VARCHAR)), 1, 7) AS BIGINT)"


def _split_sql(stratum: str, limit: str = "floor(n * 0.8::DOUBLE)") -> str:
    return f"""SELECT id, CASE WHEN rn <= {limit} THEN 'train' ELSE 'val' END AS split FROM (SELECT id, row_number() OVER (PARTITION BY s ORDER BY {ORDER}, id) AS rn,
 count(*) OVER (PARTITION BY s) AS n FROM (SELECT id, {stratum} AS s FROM scores, e))"""


EDGES = "e AS (SELECT quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.75) AS c, min(score) AS lo, max(score) AS hi FROM scores)"
BIN = "CAST(score >= a AS INT) + CAST(score >= b AS INT) + CAST(score >= c AS INT)"
query("win_02_stratified_split", "scores", _split_sql("label"), ctes=EDGES)(
    lambda i: split.stratified_split(i.scores, ["label"], 0.8, 42).select("id", "split")
)


def _balanced_sql(k: int) -> str:
    """The greedy cut as a recursion over distinct scores."""
    return f"""SELECT class_id, CAST(CASE WHEN class_id = 0 THEN 0 ELSE round_even(min(score), 0) END AS BIGINT) AS lo, CAST(round_even(max(score), 0) AS BIGINT) AS hi,
 CAST(sum(cnt) AS BIGINT) AS count, round(sum(cnt) * 100.0::DOUBLE / max(total), 2) AS percentage FROM w{k} GROUP BY 1"""


def _balanced_cte(k: int) -> str:
    close = f"""(w.held > 0 AND w.class_id < {k} - 1 AND (w.held + d.cnt > total / {k}.0::DOUBLE * 1.15 OR (w.held >= total / {k}.0::DOUBLE * 0.85
 AND abs(w.held - total / {k}.0::DOUBLE) <= abs(w.held + d.cnt - total / {k}.0::DOUBLE))))"""
    return f"""w{k} AS (SELECT rn, score, cnt, total, 0::BIGINT AS class_id, cnt AS held FROM d WHERE rn = 1
 UNION ALL SELECT d.rn, d.score, d.cnt, d.total, w.class_id + CAST({close.replace('total', 'd.total')} AS BIGINT), CASE WHEN {close.replace('total', 'd.total')} THEN d.cnt ELSE w.held + d.cnt END
 FROM w{k} w JOIN d ON d.rn = w.rn + 1)"""


DISTINCT = "d AS (SELECT score, count(*) AS cnt, row_number() OVER (ORDER BY score) AS rn, (SELECT count(*) FROM scores) AS total FROM scores GROUP BY score)"
query("win_03_balanced_classes", "scores", _balanced_sql(4), ctes=f"{DISTINCT}, {_balanced_cte(4)}", recursive=True)(
    lambda i: rounded(classes.balanced_classes(i.scores, "score", 4))
)
query(
    "win_07_training_eta",
    "history",
    """SELECT model, CAST(epoch AS BIGINT) AS epoch, CAST(seconds AS BIGINT) AS seconds, round(m, 6) AS mean_seconds, round(m * (50 - epoch), 6) AS remaining_seconds
FROM (SELECT *, avg(seconds) OVER (PARTITION BY model ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS m FROM history)""",
)(lambda i: rounded(metrics.training_eta(i.history, 50)))
query(
    "win_08_best_epoch",
    "history",
    "SELECT model, CAST(epoch AS BIGINT) AS epoch, round(val_loss, 6) AS val_loss FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY val_loss, epoch) AS rn FROM history) WHERE rn = 1",
)(lambda i: rounded(metrics.best_epoch(i.history)))
KS = """v AS (SELECT prediction AS x, count_if(split = 'train') AS a, count_if(split <> 'train') AS b FROM predictions_reg GROUP BY 1),
g AS (SELECT CAST(sum(a) OVER (ORDER BY x) AS DOUBLE) / (SELECT sum(a) FROM v) AS fa, CAST(sum(b) OVER (ORDER BY x) AS DOUBLE) / (SELECT sum(b) FROM v) AS fb FROM v)"""
query(
    "win_09_ks_statistic",
    "predictions_reg",
    """SELECT round(d, 6) AS statistic, n_a, n_b, round(CASE WHEN s < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0,
 list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * j * j * s * s))))) END, 6) AS p_value
FROM (SELECT d, n_a, n_b, sqrt(CAST(n_a AS DOUBLE) * n_b / (n_a + n_b)) * d AS s FROM (SELECT max(abs(fa - fb)) AS d,
 (SELECT CAST(sum(a) AS BIGINT) FROM v) AS n_a, (SELECT CAST(sum(b) AS BIGINT) FROM v) AS n_b FROM g))""",
    ctes=KS,
)(lambda i: rounded(split.ks_2samp(i.predictions_reg, "prediction", F.col("split") == "train")))
query(
    "win_10_first_per_class",
    "scores",
    "SELECT CAST(label AS BIGINT) AS label, min(id) AS id, round(arg_min(score, id), 6) AS score FROM scores GROUP BY 1",
)(lambda i: rounded(metrics.first_per_class(i.scores, "label", "id", ["score"])))
query("win_11_shuffle", "scores", f"SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY {ORDER}, id) - 1 AS place FROM scores")(
    lambda i: rounded(split.shuffle(i.scores.select("id", "score"), 42))
)

# --- classes -------------------------------------------------------------------------------

query(
    "jn_09_assign_class",
    "scores",
    """SELECT id, CAST(CASE WHEN score BETWEEN 0 AND 15 THEN 0 WHEN score BETWEEN 16 AND 30 THEN 1 WHEN score BETWEEN 31 AND 40 THEN 2 WHEN score BETWEEN 41 AND 48 THEN 3 END AS BIGINT) AS class_id FROM scores""",
)(lambda i: rounded(classes.assign_class(i.scores, "score", [(0, 15), (16, 30), (31, 40), (41, 48)]).select("id", "class_id")))


def _width_sql(value: str, k: int) -> str:
    return f"""SELECT CAST(b AS BIGINT) AS class_id, CAST(round_even(lo + b * w, 0) AS BIGINT) AS lo, CAST(round_even(lo + (b + 1) * w, 0) AS BIGINT) AS hi, coalesce(n, 0) AS count,
 round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM scores), 2) AS percentage
FROM (SELECT unnest(range({k})) AS b) CROSS JOIN (SELECT min({value}) AS lo, (max({value}) - min({value})) / {k} AS w FROM scores)
LEFT JOIN (SELECT least(floor(({value} - lo) / w), {k} - 1) AS i, count(*) AS n FROM scores, (SELECT min({value}) AS lo, (max({value}) - min({value})) / {k} AS w FROM scores) GROUP BY 1) ON i = b"""


query("lbl_01_equal_width", "scores", _width_sql("amount", 5))(lambda i: rounded(classes.equal_width_classes(i.scores, "amount", 5)))
query(
    "lbl_02_generate_classes",
    "scores",
    f"SELECT 'quantile' AS method, 5::BIGINT AS requested, (SELECT max(class_id) + 1 FROM w5) AS actual, t.*, concat('Class_', CAST(class_id AS VARCHAR)) AS label FROM ({_balanced_sql(5)}) t",
    ctes=f"{DISTINCT}, {_balanced_cte(5)}",
    recursive=True,
)(lambda i: rounded(classes.generate_classes(i.scores, "score", 5)))
query(
    "lbl_03_class_previews",
    "scores",
    " UNION ALL ".join(f"SELECT {k}::BIGINT AS num_classes, t.* FROM ({_balanced_sql(k)}) t" for k in (2, 3, 4, 5)),
    ctes=", ".join([DISTINCT, *(_balanced_cte(k) for k in (2, 3, 4, 5))]),
    recursive=True,
)(lambda i: rounded(classes.class_previews(i.scores, "score")))
query(
    "lbl_04_label_classes",
    "drawings",
    f"""SELECT drawing_id, CAST(CASE WHEN v BETWEEN 0 AND 20 THEN 0 WHEN v BETWEEN 21 AND 40 THEN 1 WHEN v BETWEEN 41 AND 58 THEN 2 END AS BIGINT) AS class_id,
 CASE WHEN v BETWEEN 0 AND 20 THEN 'Class_0 [0-20]' WHEN v BETWEEN 21 AND 40 THEN 'Class_1 [21-40]' WHEN v BETWEEN 41 AND 58 THEN 'Class_2 [41-58]' END AS generic, v AS score
FROM (SELECT drawing_id, {Q} AS v FROM drawings)""",
)(
    lambda i: classes.label_classes(i.drawings, "Total_Score", [(0, 20), (21, 40), (41, 58)], ["Poor", "Fair", "Good"]).select(
        "drawing_id",
        F.col("class_id").cast("bigint").alias("class_id"),
        F.try_element_at(L.class_map(F.col("features_data")), F.lit("3"))["name_generic"].alias("generic"),
        L.target_value(F.col("features_data"), "Total_Score").alias("score"),
    )
)
query(
    "lbl_05_edit_boundary",
    "scores",
    f"""SELECT class_id, CASE WHEN class_id = 2 THEN 27 ELSE lo END AS lo, CASE WHEN class_id = 1 THEN 26 ELSE hi END AS hi FROM ({_balanced_sql(4)})""",
    ctes=f"{DISTINCT}, {_balanced_cte(4)}",
    recursive=True,
)(
    lambda i: rounded(
        classes.edit_boundary(classes.balanced_classes(i.scores, "score", 4), 2, "min", 27, 0, 50).select("class_id", "lo", "hi")
    )
)

# --- splits --------------------------------------------------------------------------------

query("spl_01_assign_bins", "scores", f"SELECT id, CAST({BIN} AS BIGINT) AS bin FROM scores, e", ctes=EDGES)(
    lambda i: rounded(split.assign_bins(i.scores, "score", 4).select("id", "bin"))
)
query(
    "spl_01_equal_width_bins",
    "scores",
    "SELECT id, CAST(CAST(score >= lo + (hi - lo) * 0.25 AS INT) + CAST(score >= lo + (hi - lo) * 0.5 AS INT) + CAST(score >= lo + (hi - lo) * 0.75 AS INT) AS BIGINT) AS bin FROM scores, e",
    ctes=EDGES,
)(lambda i: rounded(split.assign_bins(i.scores, "score", 4, "equal").select("id", "bin")))
query("spl_02_split_regression", "scores", _split_sql(BIN), ctes=EDGES)(
    lambda i: split.split_regression(i.scores, "score").select("id", "split")
)
query(
    "spl_03_split_classification",
    "scores",
    _split_sql("label", "least(floor(n * 0.8::DOUBLE), CASE WHEN n > 1 THEN n - 1 ELSE n END)"),
    ctes=EDGES,
)(lambda i: split.split_classification(i.scores, "label").select("id", "split"))
query("spl_04_split_random", "scores", _split_sql("0"), ctes=EDGES)(
    lambda i: split.split_random(i.scores, 0.8, 42).select("id", "split")
)
query(
    "spl_05_split_advice",
    "",
    """SELECT user_id, count(*) AS n, CASE WHEN count(*) < 20 THEN 'random' ELSE 'stratified' END AS strategy,
 CAST(CASE WHEN count(*) < 50 THEN 2 WHEN count(*) < 100 THEN 3 ELSE 4 END AS BIGINT) AS n_bins FROM events GROUP BY 1""",
)(
    lambda i: rounded(
        i.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "n", V.split_advice(F.col("n")).alias("a")).select("user_id", "n", "a.*")
    )
)
SIDES = ", ".join(
    f"{fn} FILTER (WHERE split = '{side}') AS {side}_{name}"
    for side in ("train", "val")
    for name, fn in (("mean", "avg(prediction)"), ("std", "stddev_pop(prediction)"), ("min", "min(prediction)"), ("max", "max(prediction)"), ("count", "count(prediction)"))
)
query(
    "spl_06_validate_split",
    "predictions_reg",
    """SELECT train_count, val_count, round(train_mean, 6) AS train_mean, round(val_mean, 6) AS val_mean, round(abs(train_mean - val_mean), 6) AS mean_difference,
 round(abs(train_mean - val_mean) / train_mean * 100, 6) AS mean_difference_pct, round(abs(train_std - val_std), 6) AS std_difference, round(abs(train_std - val_std) / train_std * 100, 6) AS std_difference_pct,
 val_min < train_min OR val_max > train_max AS outside_range, (SELECT round(max(abs(fa - fb)), 6) FROM g) AS ks_statistic FROM s""",
    ctes=f"{KS}, s AS (SELECT {SIDES} FROM predictions_reg)",
)(
    lambda i: rounded(
        split.validate_split(i.predictions_reg, "prediction").select(
            "train_count", "val_count", "train_mean", "val_mean", "mean_difference", "mean_difference_pct", "std_difference",
            "std_difference_pct", "outside_range", "ks_statistic",
        )
    )
)
query(
    "spl_07_validate_class_split",
    "scores",
    """SELECT CAST(label AS BIGINT) AS label, count_if(t) AS train_count, count_if(NOT t) AS val_count, round(count_if(t) * 100.0::DOUBLE / (SELECT count_if(t) FROM x), 6) AS train_pct,
 round(count_if(NOT t) * 100.0::DOUBLE / (SELECT count_if(NOT t) FROM x), 6) AS val_pct,
 abs(count_if(t) * 100.0::DOUBLE / (SELECT count_if(t) FROM x) - count_if(NOT t) * 100.0::DOUBLE / (SELECT count_if(NOT t) FROM x)) <= 15 AND count_if(t) > 0 AND count_if(NOT t) > 0 AS is_balanced
FROM x GROUP BY 1""",
    ctes="x AS (SELECT label, score < 40 - 9 * label AS t FROM scores)",
)(
    lambda i: rounded(
        split.validate_class_split(
            i.scores.withColumn("split", F.when(F.col("score") < 40 - 9 * F.col("label"), "train").otherwise("val")), "label"
        ).drop("warnings")
    )
)
query(
    "jn_13_apply_split",
    "scores split_ids",
    "SELECT id, round(score, 6) AS score, split FROM scores JOIN (SELECT CAST(sample_id AS BIGINT) AS id, split FROM split_ids WHERE sample_id NOT LIKE 'syn%') USING (id)",
)(
    lambda i: rounded(
        split.require_both_sides(
            split.apply_split(i.scores.select("id", "score"), split.drop_synthetic(i.split_ids, "sample_id", "id").select("id", "split"))
        )
    )
)
query(
    "spl_08_evaluation_set",
    "drawings split_ids",
    """SELECT drawing_id FROM drawings WHERE features_data NOT IN ('{}', 'null') AND drawing_id IN (SELECT CAST(sample_id AS BIGINT) FROM split_ids WHERE split = 'val' AND sample_id NOT LIKE 'syn%')""",
)(lambda i: split.evaluation_set(i.drawings, i.split_ids, strict=True).select("drawing_id"))
query(
    "spl_10_load_training_set",
    "drawings",
    f"""SELECT drawing_id, v AS target, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM (SELECT drawing_id, v,
 row_number() OVER (PARTITION BY s ORDER BY CAST('0x' || substr(md5('42-' || CAST(drawing_id AS VARCHAR)), 1, 7) AS BIGINT), drawing_id) AS rn, count(*) OVER (PARTITION BY s) AS n
 FROM (SELECT drawing_id, v, CAST(v >= a AS INT) + CAST(v >= b AS INT) + CAST(v >= c AS INT) AS s FROM t, e))""",
    ctes=f"""t AS (SELECT * FROM (SELECT drawing_id, {Q} AS v FROM drawings) WHERE v IS NOT NULL),
e AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM t)""",
)(lambda i: pipelines.load_training_set(i.drawings, "Total_Score").select("drawing_id", "target", "split"))

# --- scaling and small functions -----------------------------------------------------------


@query(
    "mth_01_scalers",
    "scores",
    """SELECT id, round((amount - lo) / (hi - lo), 6) AS min_max, round((amount - m) / (s + 1e-8), 6) AS standard, round((score - 0) / 60.0::DOUBLE, 6) AS fixed, round(amount, 6) AS back
FROM scores, (SELECT min(amount) AS lo, max(amount) AS hi, avg(amount) AS m, stddev_pop(amount) AS s FROM scores)""",
)
def _(i):
    a = scaler.fit_scaler(i.scores, "amount")
    b = scaler.fit_scaler(i.scores, "amount", "standardize")
    c = scaler.scaler_for_feature(i.scores, "score", "Total_Score")
    x = F.col("amount")
    return rounded(
        i.scores.select(
            "id", a.scale(x).alias("min_max"), b.scale(x).alias("standard"), c.scale(F.col("score")).alias("fixed"), b.unscale(b.scale(x)).alias("back")
        )
    )


query(
    "mth_02_preset_range",
    "scores",
    "SELECT id, CASE label WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 100.0 WHEN 2 THEN 3.0 END AS hi FROM scores",
)(
    lambda i: i.scores.select(
        "id",
        V.preset_range(F.when(F.col("label") == 0, "MMSE").when(F.col("label") == 1, "ACE").when(F.col("label") == 2, "CDR").otherwise("other"))["hi"].alias("hi"),
    )
)
query(
    "mth_03_denormalise",
    "predictions_reg",
    """SELECT id, CAST(sub_id AS BIGINT) AS sub_id, round(greatest(0, least(60, prediction / 50 * 60)), 2) AS value, round(prediction / 50, 4) AS raw_output FROM predictions_reg""",
)(
    lambda i: rounded(
        catalog.finish_regression(i.predictions_reg.withColumn("raw", F.col("prediction") / 50), 0.0, 60.0)
        .select("id", "sub_id", "value", "raw_output")
    )
)
query(
    "mth_04_softmax",
    "",
    """SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS prediction, round(100 / list_sum(list_transform(e, lambda v: exp(v - list_max(e)))), 4) AS confidence
FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 8) AS e FROM embeddings)""",
)(
    lambda i: i.embeddings.select(
        "vec_id", V.softmax(F.transform("embedding", lambda v: v.cast("double") * 8)).alias("p")
    ).select("vec_id", V.top_class(F.col("p")).cast("bigint").alias("prediction"), r(F.array_max("p") * 100, 4).alias("confidence"))
)
query(
    "mth_05_clamp",
    "predictions_reg",
    "SELECT id, CAST(sub_id AS BIGINT) AS sub_id, round(greatest(0, least(1, prediction / 30)), 6) AS clamped FROM predictions_reg",
)(lambda i: rounded(i.predictions_reg.select("id", "sub_id", V.clamp01(F.col("prediction") / 30).alias("clamped"))))


@query(
    "mth_06_config_violations",
    "",
    """SELECT o_orderkey AS id, CAST(CAST(k % 13 / 10.0 < 0.1 OR k % 13 / 10.0 > 0.9 AS INT) + CAST(k % 1100 < 1 OR k % 1100 > 1000 AS INT) + CAST(k % 150 < 1 OR k % 150 > 128 AS INT)
 + CAST(k % 600 > 500 AS INT) + CAST(k % 3 = 0 AND k % 600 = 0 AS INT) + CAST(k % 5 = 0 AND k % 3 = 0 AS INT) AS BIGINT) AS violations FROM (SELECT o_orderkey, o_custkey AS k FROM orders)""",
)
def _(i):
    k = F.col("o_custkey")
    requests = i.orders.select(
        F.col("o_orderkey").alias("id"),
        F.lit("Total_Score").alias("target_feature"),
        (k % 13 / 10.0).alias("train_split"),
        (k % 1100).alias("num_epochs"),
        F.lit(0.001).alias("learning_rate"),
        (k % 150).alias("batch_size"),
        (k % 600).alias("synthetic_n_samples"),
        (k % 3 == 0).alias("add_synthetic_bad_images"),
        (k % 5 != 0).alias("use_augmentation"),
    )
    return quality.config_violations(requests).select("id", F.size("violations").cast("bigint").alias("violations"))


@query(
    "mth_06_augmentation_violations",
    "",
    """SELECT o_orderkey AS id, CAST(CAST(k % 7 - 3 >= 3 AS INT) + CAST(k % 4 = 0 AS INT) + CAST(k % 25 > 20 AS INT) + CAST(k % 40 < 5 OR k % 40 > 30 AS INT) + CAST(k % 300 > 255 AS INT) AS BIGINT) AS violations
FROM (SELECT o_orderkey, o_custkey AS k FROM orders)""",
)
def _(i):
    k = F.col("o_custkey")
    rows = i.orders.select(
        F.col("o_orderkey").alias("id"),
        (k % 7 - 3).alias("rotation_min"), F.lit(3).alias("rotation_max"),
        F.when(k % 4 == 0, 10).otherwise(-10).alias("translation_min"), F.lit(10).alias("translation_max"),
        F.lit(0.95).alias("scale_min"), F.lit(1.05).alias("scale_max"),
        (k % 25).alias("num_augmentations"), (k % 40).alias("warping_displacement"), F.lit(9).alias("warping_control_points"),
        F.lit(0.4).alias("warping_ratio"), (k % 300).alias("binarization_threshold"), F.lit(2).alias("line_thickness"),
    )
    return quality.augmentation_violations(rows).select("id", F.size("violations").cast("bigint").alias("violations"))


@query(
    "mth_06_synthesis_violations",
    "",
    """SELECT o_orderkey AS id, CAST(CAST(k % 600 > 500 AS INT) + CAST(k % 12 < 1 OR k % 12 > 10 AS INT) + CAST(k % 52 < 1 OR k % 52 > 50 AS INT) + CAST(20 <= k % 52 AS INT) AS BIGINT) AS violations
FROM (SELECT o_orderkey, o_custkey AS k FROM orders)""",
)
def _(i):
    k = F.col("o_custkey")
    rows = i.orders.select(
        F.col("o_orderkey").alias("id"), (k % 600).alias("n_samples"), (k % 12).alias("complexity_levels"), F.lit(20.0).alias("score_threshold"),
        (k % 52).alias("min_lines"), F.lit(20).alias("max_lines"),
    )
    return quality.synthesis_violations(rows).select("id", F.size("violations").cast("bigint").alias("violations"))


query(
    "mth_07_band",
    "",
    "SELECT o_orderkey AS id, CASE WHEN s = 1 THEN 'perfect' WHEN s >= 0.8::DOUBLE THEN 'good' WHEN s >= 0.5::DOUBLE THEN 'medium' ELSE 'poor' END AS band FROM (SELECT o_orderkey, o_custkey % 11 / 10.0::DOUBLE AS s FROM orders)",
)(lambda i: i.orders.select(F.col("o_orderkey").alias("id"), V.band(F.col("o_custkey") % 11 / 10.0).alias("band")))
query(
    "dat_01_02_times",
    "",
    """SELECT event_id, ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR AS expired, coalesce(strftime(CASE WHEN event_id % 6 <> 0 THEN ts END, '%Y-%m-%dT%H:%M:%S'), 'N/A') AS shown FROM events""",
)(
    lambda i: i.events.select(
        "event_id",
        V.expired(F.col("ts"), 24, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).alias("expired"),
        V.iso_or_na(F.when(F.col("event_id") % 6 != 0, F.col("ts"))).alias("shown"),
    )
)
