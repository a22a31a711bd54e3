"""Rows reach Python in batches of a few MB."""

import pyarrow as pa

from strokelake.llm import common


def largest_batch(frame):
    return frame.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").agg({"n": "max"}).first()[0]


def test_batches_are_bounded_by_bytes(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        rows = spark.range(0, 8000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 500) AS text")
        out = common.map_batches(rows, "doc_id long, n long", lambda: lambda c: {"doc_id": c["doc_id"], "n": map(len, c["text"])})
        assert out.where("n = 2500").count() == 8000
        assert largest_batch(rows) < 2 * common.BATCH_BYTES
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1048576")
        common.small_batches(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1048576"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        if before is not None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
