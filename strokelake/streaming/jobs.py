"""Incremental forms of ingest, counters, progress, expiry and evaluation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strokelake.functions import labels as L
from strokelake.functions.values import content_hash
from strokelake.operators.profile import count_rows
from strokelake.session import cut
from strokelake.streaming.known_hashes import KnownHashes, commit_name


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def ingest_stream(source: DataFrame, original: str, processed: str, window: str = "1 day") -> DataFrame:
    """Feed with content hashes; copies that arrive within ``window`` are dropped by keyed state.

    The state runs on the time of arrival, so no row is ever late and the state holds the hashes of one window. Older copies
    are found in the store of known hashes.
    """
    hashed = source.withColumns({"image_hash": content_hash(F.col(original), F.col(processed)), "ingested_at": F.current_timestamp()})
    return hashed.withWatermark("ingested_at", window).dropDuplicatesWithinWatermark(["image_hash"])


def start_ingest(stream: DataFrame, target: str, checkpoint: str, order: tuple[str, ...], trigger: dict, digits: int = 2) -> StreamingQuery:
    """Append rows whose hash the target (``KnownHashes``) does not hold yet.

    A batch reads the lookup partitions of its own hashes only. A batch that runs again after a failure replaces its own commit.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        KnownHashes(batch.sparkSession, target, digits).add(batch, commit_name(checkpoint, batch_id), order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def info_stream(source: DataFrame) -> DataFrame:
    """Running totals by source and task; few groups, so the state stays small."""
    return source.groupBy("source_format", "task_type").agg(
        count_rows().alias("total"), F.count_if(L.is_labelled(F.col("features_data"))).alias("labelled")
    )


def progress_stream(source: DataFrame, total_epochs: int) -> DataFrame:
    """Latest epoch per job with its losses, mean epoch time and remaining time."""
    latest = F.max_by(F.struct("epoch", "train_loss", "val_loss"), "epoch").alias("p")
    return source.groupBy("model").agg(latest, F.avg("seconds").alias("mean_seconds")).select(
        "model",
        F.col("p.epoch").alias("epoch"),
        F.col("p.train_loss").alias("train_loss"),
        F.col("p.val_loss").alias("val_loss"),
        "mean_seconds",
        (F.col("mean_seconds") * (total_epochs - F.col("p.epoch"))).alias("remaining_seconds"),
    )


def expire_sessions(source: DataFrame, session: str, at: str, idle: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Closed sessions: no activity for the idle time; rows later than the allowed delay are dropped."""
    return (
        source.withWatermark(at, late)
        .groupBy(F.session_window(at, idle), F.col(session))
        .agg(count_rows().alias("events"))
        .select(
            session,
            F.col("session_window.start").alias("opened_at"),
            F.col("session_window.end").alias("expires_at"),
            "events",
        )
    )


#: Settings of a stream that keeps rows: its store, and no batches without data; expired rows go when the next data come.
ROW_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def whole_drawings(source: DataFrame, key: str, expiry: str = "PT24H") -> DataFrame:
    """All rows so far of every drawing that a batch touches, from keyed state; a stream in update mode.

    A row counts for ``expiry`` after its arrival (an ISO duration). Spark keeps the rows of a drawing in windows of twice that
    time which start once per ``expiry``; the older of the two that a batch falls into reaches back far enough, and a window
    leaves the state when it has passed. A batch reads and writes the state of its own drawings only; segments that come
    later bring the whole drawing again.
    """
    ms = _milliseconds(expiry)
    columns = [c for c in source.columns if c != key]
    at, window = free_name(source.columns, "_at"), free_name(source.columns, "_window")
    held, newest = free_name(source.columns, "_rows"), free_name(source.columns, "_newest")
    arrived = source.withColumn(at, F.current_timestamp()).withWatermark(at, "1 hour")
    windows = F.window(at, f"{2 * ms} milliseconds", f"{ms} milliseconds").alias(window)
    kept = arrived.groupBy(windows, key).agg(F.collect_list(F.struct(*columns, at)).alias(held), F.max(at).alias(newest))
    oldest = F.unix_millis(newest) - ms
    reaching = kept.where(F.unix_millis(F.col(window)["start"]) <= oldest)
    rows = reaching.select(key, newest, F.inline(held))
    return rows.where(F.unix_millis(at) > oldest).select(source.columns)


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until it is not taken (in any case)."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _milliseconds(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def evaluate_stream(
    source: DataFrame,
    key: str,
    evaluate: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    trigger: dict,
    expiry: str = "PT24H",
) -> StreamingQuery:
    """Evaluate every drawing a batch touches, with its rows of earlier batches.

    Results go to ``target/results``, one directory per batch; a batch that runs again replaces its own.
    """
    root = target.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        whole = cut(batch)  # the stateful step runs once per batch
        evaluate(whole).write.mode("overwrite").parquet(f"{root}/results/batch={batch_id}")

    stream = whole_drawings(source, key, expiry).writeStream.foreachBatch(write).outputMode("update")
    stream = stream.option("checkpointLocation", checkpoint).trigger(**trigger)
    conf = source.sparkSession.conf
    before = {name: conf.get(name) for name in ROW_STATE}
    for name, value in ROW_STATE.items():  # a stream takes its settings when it starts; other streams keep theirs
        conf.set(name, value)
    try:
        return stream.start()
    finally:
        for name, value in before.items():
            conf.set(name, value)


def latest_results(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The newest result of each drawing."""
    rows = spark.read.parquet(f"{target.rstrip('/')}/results")
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(key, "r.*")
