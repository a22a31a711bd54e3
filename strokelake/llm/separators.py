"""Token counts by a scan for end-of-document ids in flat, unindexed token files.

A flat file is a run of fixed-size blocks of ids with no document index. Each block is searched on its own
(one vectorised comparison); a prefix scan over the blocks of a file, then over files, gives every block its first
position, the number of separators before it and the last separator before it, which stitches documents
that cross block boundaries.

Defined cases: null text counts as empty (its document is the separator alone); an empty table gives no
rows; ids after the last separator of a file are one document with ``ended`` false; repeated rows are documents of their own;
the string of a special token inside a text is ordinary text, so no text holds the separator; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strokelake.llm.common import release_memory, slices, small_batches, texts
from strokelake.llm.tokens import encode_texts

FLAT = "kind string, file int, block int, data binary, doc_ids array<long>"
#: Bytes of a row group as it is stored; blocks shrink to about a third. A task that writes blocks, and one that reads them, holds a whole one, in the reader as one array that grows by doubling.
#: Parquet's writer looks at the size after a hundred rows else, which may be blocks.
GROUP_BYTES = 2 << 20
GROUPS = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "4"}


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = 1 << 18) -> None:
    """Ids of all documents as flat files, one per task: ``block`` rows, and ``order`` rows that only name the documents in order.

    Ids are stored as unsigned 32-bit little-endian numbers. Rows pass between Spark and Python in batches of a few MB, here and in
    the search, whatever texts and blocks weigh.
    """
    small_batches(docs.sparkSession)
    source = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))

    def run(batches):
        file = TaskContext.get().partitionId()
        rest, block, order = b"", 0, 0

        def row(kind, number, data, keys):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([kind]),
                    pa.array([file], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([data], pa.binary()),
                    pa.array([keys], pa.list_(pa.int64())),
                ],
                names=["kind", "file", "block", "data", "doc_ids"],
            )

        for batch in batches:
            for part in slices(batch):
                keys = part.column(0).to_pylist()
                rest = b"".join([rest, *encode_texts(part.column(1).to_pylist(), tokenizer, end_id, special_as_text=True)])
                yield row("order", order, None, keys)
                order += 1
                whole = len(rest) // (4 * block_ids)
                for i in range(whole):
                    yield row("block", block, rest[4 * block_ids * i : 4 * block_ids * (i + 1)], None)
                    block += 1
                rest = rest[4 * block_ids * whole :]
        if rest:
            yield row("block", block, rest, None)
        del rest
        release_memory()

    source.mapInArrow(run, FLAT).write.options(compression="zstd", **GROUPS).parquet(path)


def scan_blocks(blocks: DataFrame, end_id: int) -> DataFrame:
    """Per document of flat files (file, block, data): file, place in the file, global start, n_tokens, ended."""

    def search(batches):
        for batch in batches:
            sizes, found = [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), "<u4")
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["file", "block", "n_ids", "ends"],
            )

    small_batches(blocks.sparkSession)
    found = blocks.select("file", "block", "data").mapInArrow(search, "file int, block int, n_ids long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    with_base = found.withColumn("base", base).withColumn("last", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1)))
    scanned = (
        with_base.withColumn("first_place", F.coalesce(F.sum(F.size("ends").cast("long")).over(before), F.lit(0).cast("long")))
        .withColumn("open_from", F.coalesce(F.max("last").over(before) + 1, F.lit(0).cast("long")))
        .withColumn("is_last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    )
    stops = F.transform("ends", lambda e: e + F.col("base") + 1)
    stops = F.when(
        F.col("is_last") & (F.coalesce(F.col("last") + 1, F.col("open_from")) < F.col("base") + F.col("n_ids")),
        F.concat(stops, F.array(F.col("base") + F.col("n_ids"))),
    ).otherwise(stops)
    per_doc = (
        scanned.withColumn("stops", stops)
        .withColumn("starts", F.concat(F.array("open_from"), F.col("stops")))
        .select("file", "first_place", "starts", F.size("ends").alias("n_ends"), F.posexplode("stops").alias("i", "stop"))
        .select(
            "file",
            (F.col("first_place") + F.col("i")).alias("place"),
            F.element_at("starts", F.col("i") + 1).alias("start_in_file"),
            (F.col("stop") - F.element_at("starts", F.col("i") + 1)).alias("n_tokens"),
            (F.col("i") < F.col("n_ends")).alias("ended"),
        )
    )
    return per_doc


def file_starts(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """First global position of each file; one row per file, so the one-task prefix stays small."""
    sizes = blocks.groupBy("file").agg(F.sum((F.length("data") / 4).cast("long")).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def document_counts(spark: SparkSession, path: str, end_id: int) -> DataFrame:
    """doc_id, start and n_tokens (with the separator) of every document of the files under ``path``."""
    flat = spark.read.schema(FLAT).parquet(path)
    blocks = flat.where("kind = 'block'")
    counts = scan_blocks(blocks, end_id).join(file_starts(spark, blocks), "file")
    order = flat.where("kind = 'order'").select("file", "block", "doc_ids")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = (
        order.withColumn("base", F.coalesce(F.sum(F.size("doc_ids").cast("long")).over(before), F.lit(0).cast("long")))
        .select("file", "base", F.posexplode("doc_ids").alias("i", "doc_id"))
        .select("file", (F.col("base") + F.col("i")).alias("place"), "doc_id")
    )
    return counts.join(names, ["file", "place"]).select(
        "doc_id", (F.col("file_start") + F.col("start_in_file")).alias("start"), "n_tokens"
    )
