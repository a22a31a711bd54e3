"""Helpers shared by the corpus operators: input columns, batches, scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strokelake.session import scratch_path

ASCII_SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of rows that Spark hands to Python at once, where the session does not say otherwise. Ten thousand texts, Spark's own
#: limit, stand several times in memory: in the executor's buffers, in the worker and behind the batch that follows.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
TIDY_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Key, text (null becomes empty) and the named columns; everything else is pruned at the scan."""
    return docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text), *[F.col(c) for c in more])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it has ended, not when the driver happens to collect its garbage. For steps that are
    :func:`written`, since a result that is read again from its own plan would be shuffled again."""
    before = spark.conf.get(TIDY_SETTING, None)
    spark.conf.set(TIDY_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY_SETTING, before) if before is not None else spark.conf.unset(TIDY_SETTING)


def map_batches(
    df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, Iterable]]], encodes: bool = False
) -> DataFrame:
    """mapInArrow over column lists; ``make`` is called once per task and returns the batch function.

    Batches are cut by text size as well as by rows, so a batch of very long texts stays small: by Spark for the whole session,
    as the setting counts when a job runs, and again in Python. Python workers are reused: a task starts without the encoders of
    earlier stages unless it ``encodes`` itself, and gives freed memory back.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    struct = StructType.fromDDL(schema)
    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            from strokelake.llm.tokens import release_encoders

            release_encoders()
        step = make()
        for batch in batches:
            for part in slices(batch):
                got = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                arrays = [pa.array(got[f.name], type=f.type) for f in out]
                if arrays and len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=out)
        del step
        release_memory()

    return df.mapInArrow(run, struct)


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def release_memory() -> None:
    """Give freed memory back to the system: Arrow's pool, then the C library's (where it is glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text each; a longer row stands alone."""
    rows = batch.num_rows
    if rows == 0:
        return
    if batch.nbytes <= limit:
        yield batch
        return
    step = max(1, int(rows * limit / batch.nbytes))
    for at in range(0, rows, step):
        yield batch.slice(at, step)
