"""Flat token files come in small row groups and pass to Python a few MB at a time, whatever a task holds."""

import os
import random

import pyarrow.parquet as pq

from strokelake.llm import common, separators
from strokelake.llm.tokens import default_path


def test_one_task_writes_many_small_groups(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}" for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(20, 400))) for _ in range(9000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    seen, ready = [], common.small_batches
    monkeypatch.setattr(separators, "small_batches", lambda session: seen.append(1) or ready(session), raising=False)
    path = str(tmp_path / "flat")
    separators.write_flat(docs, path, default_path("byte_bpe_50k.json"), end_id=50256)
    groups = []
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            found = pq.ParquetFile(f"{path}/{name}").metadata
            groups += [found.row_group(i).total_byte_size for i in range(found.num_row_groups)]
    assert sum(groups) > 20 << 20 and max(groups) < 12 << 20
    counts = separators.document_counts(spark, path, end_id=50256)
    assert seen == [1, 1]
    assert counts.count() == len(texts) and counts.agg({"n_tokens": "sum"}).first()[0] == sum(groups_ids(path))
    assert counts.where("n_tokens < 20").count() == 0


def groups_ids(path):
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            for data in pq.read_table(f"{path}/{name}", columns=["data"])["data"].to_pylist():
                yield len(data or b"") // 4
