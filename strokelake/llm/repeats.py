"""Removal of long repeated byte strings by distributed suffix sorting.

Every window of ``width`` bytes has a minimizer, which depends on its bytes alone, so equal windows meet under
one minimizer wherever they are. Texts are cut into pieces (runs of windows with one minimizer). Pieces that are equal as a whole
are found by counting and are repeated throughout; only under minimizers with different pieces, or with a piece that holds
its minimizer twice, are bytes compared: there
the windows are ordered by a deep-shallow suffix sort, and a window that shares ``width`` bytes with its neighbour is
repeated. A minimizer with more than ``BUCKET`` different pieces is not sorted in one task: its windows are counted one by one under
their own 128-bit hashes, which gives the same result.

Rows are found again by (doc_id, text hash). Defined cases: null text counts as empty; texts shorter than
``width`` bytes lose nothing; repeated rows are occurrences of each other and lose the same bytes; null ids are kept apart by their
texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strokelake.llm.common import slices, texts, written
from strokelake.llm.suffixes import content, cut_pieces, repeated_windows

BUCKET = 4096
LAST = (1 << 63) - 1
PIECES = "doc long, hash long, start long, windows long, minimizer long, twice long, content long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc (null ids: the largest number), text hash, text."""
    plain = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    return plain.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("hash"), "text", "doc_id")


def text_bytes(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def pieces_of(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in range(7)]
                for doc, own, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), text_bytes(part, 2)):
                    low, start, size, twice = cut_pieces(data, width)
                    view = memoryview(data)
                    out[0] += [doc] * len(start)
                    out[1] += [own] * len(start)
                    out[2].append(start)
                    out[3].append(size)
                    out[4].append(low.view(np.int64))
                    out[5].append(twice)
                    out[6] += [content(view[a : a + n + width - 1])[0] for a, n in zip(start.tolist(), size.tolist())]
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())]
                        + [pa.array(np.concatenate(o)) for o in out[2:6]]
                        + [pa.array(out[6], pa.int64())],
                        names=[c.split()[0] for c in PIECES.split(", ")],
                    )

    return docs.where(F.octet_length("text") >= width).select("doc", "hash", "text").mapInArrow(run, PIECES)


def with_bytes(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (doc, hash, start, windows, minimizer, n) with the bytes of each piece."""
    lists = wanted.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "windows", "minimizer", "n")).alias("pieces"))
    joined = docs.where(F.octet_length("text") >= width).dropDuplicates(["doc", "hash"]).join(lists, ["doc", "hash"]).select("doc", "hash", "text", "pieces")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in range(7)]
                rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), text_bytes(part, 2), part.column(3).to_pylist())
                for doc, own, data, pieces in rows:
                    for p in pieces:
                        row = (doc, own, p["start"], p["windows"], p["minimizer"], p["n"], data[p["start"] : p["start"] + p["windows"] + width - 1])
                        for column, value in zip(out, row):
                            column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(o, pa.int64()) for o in out[:6]] + [pa.array(out[6], pa.binary())],
                        names=["doc", "hash", "start", "windows", "minimizer", "n", "data"],
                    )

    return joined.mapInArrow(run, "doc long, hash long, start long, windows long, minimizer long, n long, data binary")


def sorted_spans(shared: DataFrame, width: int) -> DataFrame:
    """Repeated runs (doc, hash, start, stop) of the pieces that occur once, by sorting the suffixes of each minimizer."""
    dealt = shared.repartition("minimizer").sortWithinPartitions("minimizer")

    def judge(rows: list[tuple]) -> pa.RecordBatch | None:
        out = [[] for _ in range(4)]
        groups = np.array([r[4] for r in rows], np.int64)
        for row, mask in zip(rows, repeated_windows([r[6] for r in rows], groups, width)):
            if row[5] > 1 or not mask.any():
                continue
            edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                for column, value in zip(out, (row[0], row[1], row[2] + a, row[2] + b - 1 + width)):
                    column.append(value)
        if out[0]:
            return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["doc", "hash", "start", "stop"])
        return None

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in chain(batches, [None]):
            rows = [] if batch is None else list(zip(*(c.to_pylist() for c in batch.columns)))
            for row in rows:
                if size > 1 << 20 and row[4] != held[-1][4]:  # whole minimizers only
                    found = judge(held)
                    held, size = [], 0
                    if found is not None:
                        yield found
                held.append(row)
                size += len(row[6])
        if held and (found := judge(held)) is not None:
            yield found

    return dealt.mapInArrow(run, "doc long, hash long, start long, stop long")


def counted_spans(shared: DataFrame, width: int) -> DataFrame:
    """The same for minimizers with very many different pieces: windows counted under their own hashes."""

    def run(batches):
        for batch in batches:
            for doc, own, start, windows, _, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = [content(memoryview(data)[i : i + width]) for i in range(windows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * windows, pa.int64()) for v in (doc, own)]
                    + [pa.array(np.arange(start, start + windows)), pa.array([n] * windows, pa.int64())]
                    + [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)],
                    names=["doc", "hash", "start", "n", "h1", "h2"],
                )

    windows = written(shared.mapInArrow(run, "doc long, hash long, start long, n long, h1 long, h2 long"), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.sum("n").alias("times")).where("times > 1").select("h1", "h2")
    return windows.where("n = 1").join(twice, ["h1", "h2"]).select("doc", "hash", "start", (F.col("start") + width).alias("stop"))


def repeated_spans(docs: DataFrame, width: int = 400) -> DataFrame:
    """Byte spans (doc, hash, start, stop) that repeated strings of ``width`` bytes cover; they may overlap."""
    pieces = written(pieces_of(docs, width), "pieces")
    place = F.min(F.struct("doc", "hash", "start", "windows")).alias("place")
    classes = written(pieces.groupBy("minimizer", "content").agg(F.count("*").alias("n"), place, F.max("twice").alias("twice")), "classes")
    buckets = (
        classes.groupBy("minimizer")
        .agg(
            F.count("*").alias("different"),
            F.sum((F.col("n") == 1).cast("int")).alias("single"),
            F.max(F.when(F.col("n") == 1, F.col("twice"))).alias("twice_in_one"),
        )
        .where("single > 0 and (different > 1 or twice_in_one = 1)")
    )
    open_ = classes.join(buckets, "minimizer").select("place.*", "minimizer", "n", "different")
    large = F.col("different") > BUCKET
    shared = written(with_bytes(docs, open_.withColumn("n", F.when(large, -F.col("n")).otherwise(F.col("n"))), width), "shared")
    by_sort = sorted_spans(shared.where("n > 0"), width)
    by_count = counted_spans(shared.where("n < 0").withColumn("n", -F.col("n")), width)
    whole = (
        pieces.join(classes.where("n > 1").select("minimizer", "content"), ["minimizer", "content"])
        .select("doc", "hash", "start", (F.col("start") + F.col("windows") - 1 + width).alias("stop"))
    )
    return whole.union(by_sort).union(by_count)


def remove_repeats(docs: DataFrame, width: int = 400, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes, on request)."""
    source = keyed(docs)
    spans = written(repeated_spans(source, width), "spans")
    lists = spans.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = source.join(lists, ["doc", "hash"], "left").select("doc_id", "text", "spans.start", "spans.stop")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in range(6)]
                for key, data, start, stop in zip(part.column(0).to_pylist(), text_bytes(part, 1), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    merged: list[list[int]] = []
                    for a, b in sorted(zip(start or [], stop or [])):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    edges = [0, *(e for m in merged for e in m), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    row = (key, len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept)
                    for column, value in zip(out, row):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                wide = 6 if keep_text else 5
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in list(zip(out, kinds))[:wide]], names=names[:wide])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return joined.mapInArrow(run, schema)
