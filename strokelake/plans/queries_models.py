"""Registered queries: images, models, prediction finishing, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from strokelake.functions import values as V
from strokelake.operators import catalog, match, metrics, ml, profile, raster, scaler, segments
from strokelake.plans import pipelines
from strokelake.plans.fixtures import TEXTS
from strokelake.plans.queries_segments import ANG, LEN, OPTIMAL, SUMMARY, kind_of
from strokelake.plans.registry import query, r, rounded
from strokelake.session import scratch_path
from strokelake.streaming import jobs
from strokelake.streaming.known_hashes import KnownHashes

# --- images --------------------------------------------------------------------------------


def _byte_images(i):
    """Each document's bytes as a one-row, three-channel image, padded with blanks to whole pixels."""
    size = F.octet_length(F.encode("text", "utf-8"))
    wide = F.greatest(F.lit(1), F.floor((size + 2) / 3)).cast("int")
    data = F.concat(F.encode("text", "utf-8"), F.encode(F.repeat(F.lit(" "), wide * 3 - size), "utf-8"))
    return i.documents.select(
        F.col("doc_id").alias("drawing_id"), wide.alias("width"), F.lit(1).alias("height"), F.lit(3).alias("nChannels"), data.alias("data")
    )


query(
    "ras_01_explode_pixels",
    "",
    """SELECT drawing_id, count(*) AS pixels, CAST(sum(('0x' || h[k*6+5:k*6+6])::INT) AS BIGINT) AS r, CAST(sum(('0x' || h[k*6+3:k*6+4])::INT) AS BIGINT) AS g, CAST(sum(('0x' || h[k*6+1:k*6+2])::INT) AS BIGINT) AS b,
 CAST(sum(k * ('0x' || h[k*6+1:k*6+2])::INT) AS BIGINT) AS weighted
FROM (SELECT doc_id AS drawing_id, unnest(range(n)) AS k, h FROM (SELECT doc_id, n, rpad(hex(encode(text)), CAST(n * 6 AS INT), '20') AS h FROM (SELECT doc_id, text, greatest(1, (octet_length(encode(text)) + 2) // 3) AS n FROM documents))) GROUP BY 1""",
)(
    lambda i: raster.explode_pixels(_byte_images(i))
    .groupBy("drawing_id")
    .agg(
        F.count(F.lit(1)).alias("pixels"),
        *(F.sum(c).alias(c) for c in "rgb"),
        F.sum(F.col("x").cast("bigint") * F.col("b")).alias("weighted"),
    )
)

# --- models --------------------------------------------------------------------------------


def _features(i):
    """Orientation counts of each drawing as features, its segment count and total length as targets."""
    counts = segments.orientation_counts(i.segments)
    lengths = segments.measured(i.segments).groupBy("drawing_id").agg(F.sum("length").alias("length"))
    return counts.join(lengths, "drawing_id").select(
        "drawing_id",
        F.array(*(F.col(c).cast("double") for c in ("horizontal", "vertical", "diagonal"))).alias("features"),
        F.col("length").alias("target"),
        F.least(F.col("total") - 1, F.lit(3)).cast("int").alias("label"),
        F.when(F.col("drawing_id") % 5 == 0, "val").otherwise("train").alias("split"),
    )


# normal equations of three features by determinants, on centred sums with 0.01 on the diagonal
SOLVED = f"""kinds AS (SELECT drawing_id, {kind_of(ANG)} AS k, {LEN} AS len FROM segments),
feats AS (SELECT drawing_id, CAST(count(*) FILTER (k = 'horizontal') AS DOUBLE) AS a, CAST(count(*) FILTER (k = 'vertical') AS DOUBLE) AS b, CAST(count(*) FILTER (k = 'diagonal') AS DOUBLE) AS c,
 sum(len) AS y, CASE WHEN drawing_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM kinds GROUP BY 1),
sums AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, var_pop(a) + 0.01 AS aa, var_pop(b) + 0.01 AS bb, var_pop(c) + 0.01 AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc,
 covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy FROM feats WHERE split = 'train'),
dets AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS d, ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy) AS da,
 aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac) AS db, aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac) AS dc FROM sums),
fit AS (SELECT da / d AS wa, db / d AS wb, dc / d AS wc, my - ma * da / d - mb * db / d - mc * dc / d AS w0 FROM dets)"""
query(
    "mdl_01_linear_fit",
    "segments",
    "SELECT round(wa, 6) AS horizontal, round(wb, 6) AS vertical, round(wc, 6) AS diagonal, round(w0, 6) AS intercept, (SELECT count(*) FROM feats WHERE split = 'train') AS rows FROM fit",
    ctes=SOLVED,
)(
    lambda i: (lambda m: i.spark.createDataFrame([(*(round(c, 6) for c in m.coefficients), round(m.intercept, 6), m.rows)], "horizontal double, vertical double, diagonal double, intercept double, rows long"))(
        ml.fit_linear(_features(i).where("split = 'train'"))
    )
)


@query(
    "mdl_01_02_regression",
    "segments",
    """SELECT split, count(*) AS num_samples, round(avg((p-t)*(p-t)), 3) AS mse, round(sqrt(avg((p-t)*(p-t))), 3) AS rmse, round(avg(abs(p-t)), 3) AS mae,
 round(1 - sum((p-t)*(p-t)) / (var_pop(t) * count(*)), 3) AS r2, round(100 * avg(CASE WHEN t <> 0 THEN abs((t-p)/t) END), 3) AS mape FROM (SELECT split, y AS t, w0 + wa * a + wb * b + wc * c AS p FROM feats, fit) GROUP BY 1""",
    ctes=SOLVED,
)
def _(i):
    rows = _features(i)
    model = ml.fit_model(rows.where("split = 'train'"), "Total_Score")
    return rounded(metrics.evaluate_model(ml.predict(model, rows), "regression"), 3)


@query("mdl_01_02_classification", "", None)
def _(i):
    rows = _features(i).withColumn("target", F.col("label"))
    model = ml.fit_model(rows.where("split = 'train'"), "Custom_Class_4", regularise=0.0)
    scored = ml.predict(model, rows)
    done = catalog.finish_classification(scored.drop("prediction"))
    return rounded(metrics.evaluate_model(done, "classification", 4), 3)


CLASS_ROWS = """cls AS (SELECT CAST(json_extract_string(features_data, '$.Custom_Class."4".label') AS BIGINT) AS label, arg_min(json_extract_string(features_data, '$.Custom_Class."4".name_custom'), drawing_id) AS name
 FROM classed WHERE json_extract(features_data, '$.Custom_Class."4"') IS NOT NULL GROUP BY 1)"""
query(
    "jn_14_attach_class_names",
    "predictions_cls classed",
    "SELECT id, CAST(prediction AS BIGINT) AS prediction, coalesce(name, concat('Class_', CAST(prediction AS VARCHAR))) AS class_name FROM predictions_cls LEFT JOIN cls ON label = prediction",
    ctes=CLASS_ROWS,
)(
    lambda i: rounded(
        catalog.attach_class_names(i.predictions_cls, catalog.class_info(i.classed, 4)).select("id", "prediction", "class_name")
    )
)


def _finished(i):
    logits = F.transform("embedding", lambda v: v.cast("double") * 8)
    return catalog.finish_classification(i.embeddings.select(F.col("vec_id").alias("id"), logits.alias("logits")))


LOGITS = """z AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 8) AS e FROM embeddings),
s AS (SELECT id, e, list_sum(list_transform(e, lambda v: exp(v - list_max(e)))) AS t FROM z)"""
query(
    "mdl_03_finish_classification",
    "",
    """SELECT id, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS prediction, round(round(100 / t, 1), 1) AS confidence FROM s""",
    ctes=LOGITS,
)(lambda i: rounded(_finished(i).select("id", "prediction", "confidence")))
query(
    "mdl_03_class_details",
    "classed",
    """SELECT id, k AS label, round(exp(e[k + 1] - list_max(e)) / t * 100, 1) AS probability, coalesce(name, concat('Class_', CAST(k AS VARCHAR))) AS class_name,
 CASE k WHEN 0 THEN '[0-15]' WHEN 1 THEN '[15-30]' WHEN 2 THEN '[30-45]' WHEN 3 THEN '[45-60]' ELSE '' END AS range
FROM (SELECT *, unnest(range(64)) AS k FROM s) LEFT JOIN cls ON label = k""",
    ctes=f"{LOGITS}, {CLASS_ROWS}",
)(lambda i: rounded(catalog.class_details(_finished(i), catalog.class_info(i.classed, 4))))
query(
    "mdl_03_finish_regression",
    "predictions_reg",
    "SELECT id, CAST(sub_id AS BIGINT) AS sub_id, round(greatest(0, least(30, prediction / 37 * 30)), 2) AS value FROM predictions_reg",
)(
    lambda i: rounded(
        catalog.finish_regression(i.predictions_reg.withColumn("raw", F.col("prediction") / 37), 0.0, 30.0).select("id", "sub_id", "value")
    )
)
query(
    "mdl_04_evaluate_regression",
    "predictions_reg",
    """SELECT split, count(*) AS num_samples, round(avg((p-t)*(p-t)), 6) AS mse, round(sqrt(avg((p-t)*(p-t))), 6) AS rmse, round(avg(abs(p-t)), 6) AS mae,
 round(1 - sum((p-t)*(p-t)) / (var_pop(t) * count(*)), 6) AS r2, round(100 * avg(CASE WHEN t <> 0 THEN abs((t-p)/t) END), 6) AS mape FROM (SELECT split, target AS t, prediction AS p FROM predictions_reg) GROUP BY 1""",
)(lambda i: rounded(metrics.evaluate_model(i.predictions_reg, "regression")))
query(
    "mdl_04_evaluate_classification",
    "predictions_cls",
    """SELECT split, any_value(n) AS num_samples, round(any_value(a), 6) AS accuracy, round(sum(CASE WHEN s + g > 0 THEN 2.0::DOUBLE * tp / (s + g) ELSE 0 END) / 64, 6) AS macro_f1
FROM (SELECT split, c, (SELECT count(*) FROM q WHERE q.split = k.split AND target = c) AS s, (SELECT count(*) FROM q WHERE q.split = k.split AND prediction = c) AS g, (SELECT count(*) FROM q WHERE q.split = k.split AND prediction = c AND target = c) AS tp,
 (SELECT count(*) FROM q WHERE q.split = k.split) AS n, (SELECT avg(CAST(target = prediction AS INT)) FROM q WHERE q.split = k.split) AS a FROM (SELECT DISTINCT split FROM q) k CROSS JOIN (SELECT unnest(range(64)) AS c)) GROUP BY 1""",
    ctes="q AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM predictions_cls)",
)(
    lambda i: rounded(
        metrics.evaluate_model(
            i.predictions_cls.withColumn("split", F.when(F.col("id") % 4 == 0, "val").otherwise("train")), "classification", 64
        )
    )
)
query(
    "mdl_05_resolve_mode",
    "",
    """SELECT stem, CASE WHEN ok THEN tf ELSE fn END AS feature, CASE WHEN ok AND md IS NOT NULL THEN md WHEN (CASE WHEN ok THEN tf ELSE fn END) LIKE 'Custom\\_Class\\_%' ESCAPE '\\' THEN 'classification' ELSE 'regression' END AS mode,
 CASE WHEN ok AND md IS NOT NULL THEN 'metadata' WHEN ok THEN 'feature' ELSE 'filename' END AS source
FROM (SELECT *, tf IS NOT NULL AND o IS NOT NULL AS ok, CASE WHEN k % 2 = 0 THEN 'Custom_Class_4' ELSE 'Total_Score' END AS fn FROM
 (SELECT o_orderkey AS k, concat('model_', CASE WHEN o_orderkey % 2 = 0 THEN 'Custom_Class_4' ELSE 'Total_Score' END, '_', CAST(o_orderkey AS VARCHAR), '_120000') AS stem,
 CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN 'MMSE' ELSE 'Custom_Class_3' END AS tf, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 1 END AS o,
 CASE WHEN o_custkey % 7 < 3 THEN NULL WHEN o_custkey % 7 < 5 THEN 'regression' ELSE 'classification' END AS md FROM orders))""",
)(lambda i: catalog.resolve_mode(_catalogue(i)).select("stem", "feature", "mode", "source"))


def _catalogue(i):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 2 == 0, "Custom_Class_4").otherwise("Total_Score")
    return i.orders.select(
        F.concat(F.lit("model_"), name, F.lit("_"), k.cast("string"), F.lit("_120000")).alias("stem"),
        F.when(c % 3 == 1, "MMSE").when(c % 3 == 2, "Custom_Class_3").alias("target_feature"),
        F.when(c % 5 != 0, 1).alias("output_neurons"),
        F.when(c % 7 < 3, None).when(c % 7 < 5, "regression").otherwise("classification").alias("training_mode"),
        F.lit(None).cast("int").alias("num_classes"),
    )


@query(
    "mdl_06_catalogue_entry",
    "samples predictions_reg history",
    """SELECT 'click' AS stem, 'Total_Score' AS target_feature, (SELECT count(*) FROM samples) AS total_samples, (SELECT count_if(split = 'val') FROM samples) AS val_samples,
 (SELECT count(*) FROM predictions_reg WHERE split = 'train') AS scored, (SELECT count(*) FROM history WHERE model = 'click') AS epochs""",
)
def _(i):
    entry = catalog.catalogue_entry(
        "click",
        "regression",
        "Total_Score",
        i.samples,
        metrics.regression_metrics(i.predictions_reg, ["split"]),
        i.history,
        scaler.Scaler("min_max", 0.0, 60.0).to_record(),
        {"train_split": 0.8, "num_epochs": 50},
    )
    return entry.select(
        "stem",
        "target_feature",
        F.col("dataset.total_samples").alias("total_samples"),
        F.col("dataset.val_samples").alias("val_samples"),
        F.col("metrics")["train"]["num_samples"].alias("scored"),
        F.size("training_history").cast("bigint").alias("epochs"),
    )


query(
    "mdl_06_sample_ids",
    "samples",
    "SELECT 'm1' AS stem, name AS sample_id, split FROM samples",
)(lambda i: catalog.sample_ids(i.samples.withColumnRenamed("name", "sample_id"), "m1"))


@query(
    "mdl_07_scaler_record",
    "scores",
    "SELECT id, round((amount - lo) / (hi - lo), 6) AS scaled FROM scores, (SELECT min(amount) AS lo, max(amount) AS hi FROM scores)",
)
def _(i):
    record = scaler.fit_scaler(i.scores, "amount").to_record()
    return rounded(i.scores.select("id", scaler.Scaler.from_record(record).scale(F.col("amount")).alias("scaled")))


# --- streams -------------------------------------------------------------------------------

NOW = {"availableNow": True}


def _source(i, table: str):
    # a table is one file or a folder of files: a pattern finds both, a plain path must be a folder
    return jobs.file_stream(i.spark, f"{i.folder}/{table}.parque[t]", getattr(i, table).schema)


def _collect(i, stream, mode: str):
    """Run the stream over all files and hand back the table it leaves behind."""
    path, checkpoint = scratch_path(i.spark, "stream"), scratch_path(i.spark, "stream-state")
    i.spark.createDataFrame([], stream.schema).write.parquet(path if mode == "complete" else f"{path}/batch=-1")  # a feed without rows runs no batch

    def write(batch, batch_id):
        # append keeps every batch, complete replaces the table by the newest state
        target = path if mode == "complete" else f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    job = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**NOW).start()
    job.awaitTermination()
    rows = i.spark.read.parquet(path)
    return rows.drop("batch") if mode == "append" else rows


@query(
    "stm_01_ingest_stream",
    "drawings",
    """SELECT DISTINCT image_hash FROM drawings""",
)
def _(i):
    target, checkpoint = scratch_path(i.spark, "ingested"), scratch_path(i.spark, "ingest-state")
    feed = _source(i, "documents").select("doc_id", "text")
    stored = i.drawings.where("drawing_id % 5 = 0").select(F.col("drawing_id").alias("doc_id"), F.col("body").alias("text"), "image_hash", F.current_timestamp().alias("ingested_at"))
    known = KnownHashes(i.spark, target, digits=1)
    known.add(stored, "earlier", ["doc_id"])
    jobs.start_ingest(jobs.ingest_stream(feed, "text", "text"), target, checkpoint, ("doc_id",), NOW, digits=1).awaitTermination()
    return known.rows().select("image_hash")


@query(
    "stm_02_info_stream",
    "drawings",
    "SELECT source_format, task_type, count(*) AS total, count_if(coalesce(features_data NOT IN ('{}', 'null'), false)) AS labelled FROM drawings GROUP BY 1, 2",
)
def _(i):
    text = TEXTS["drawings"][0]
    feed = i.spark.sql(text, documents=_source(i, "documents"), labels=i.labels)
    return _collect(i, jobs.info_stream(feed), "complete")


@query(
    "stm_03_progress_stream",
    "",
    """SELECT event_type AS model, max(event_id) AS epoch, round(arg_max(value, event_id), 6) AS train_loss, round(avg(event_id % 7 + 1), 6) AS mean_seconds, round(avg(event_id % 7 + 1) * (1000000 - max(event_id)), 4) AS remaining_seconds FROM events GROUP BY 1""",
)
def _(i):
    feed = _source(i, "events").select(
        F.col("event_type").alias("model"),
        F.col("event_id").alias("epoch"),
        F.col("value").alias("train_loss"),
        F.col("value").alias("val_loss"),
        (F.col("event_id") % 7 + 1).alias("seconds"),
    )
    rows = _collect(i, jobs.progress_stream(feed, 1_000_000), "complete")
    return rows.select(
        "model",
        "epoch",
        r("train_loss").alias("train_loss"),
        r("mean_seconds").alias("mean_seconds"),
        r("remaining_seconds", 4).alias("remaining_seconds"),
    )


@query(
    "stm_04_expire_sessions",
    "",
    """SELECT user_id, events FROM (SELECT user_id, run, count(*) AS events, max(ts) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
 FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2)
WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def _(i):
    feed = _source(i, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _collect(i, jobs.expire_sessions(feed, "user_id", "ts", "6 hours", "1 hour"), "append").select("user_id", "events")


@query("stm_05_evaluate_stream", "segments ref_segments", SUMMARY, ctes=OPTIMAL, recursive=True)
def _(i):
    ref = i.ref_segments.select(F.lit(1).alias("reference_id"), "*")

    def evaluate(batch):
        seg = batch.sparkSession.sql(TEXTS["segments"], lineitem=batch)
        return pipelines.match_counts(seg, ref)

    # the columns that segments are made from: what a drawing does not use is not kept in its state
    feed = _source(i, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    target, checkpoint = scratch_path(i.spark, "evaluated"), scratch_path(i.spark, "evaluate-state")
    jobs.evaluate_stream(feed, "l_orderkey", evaluate, target, checkpoint, NOW).awaitTermination()
    return rounded(jobs.latest_results(i.spark, target, "drawing_id"), 4)
