"""Updates by key rewrite only the files that hold the keys; versions are compared and set."""

import pytest
from pyspark.sql import functions as F

from strokelake.sources.keyed_table import ConcurrentUpdate, KeyedTable


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("a"), F.lit("x").alias("b"), (F.col("id") % 2).cast("int").alias("side"))
    return KeyedTable.create(rows.repartitionByRange(20, "key"), str(tmp_path), "things", ["key"])


def paths(t):
    return {f["path"] for f in t.files}


def many_files(spark, tmp_path, partitions=()):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("a"), F.lit("x").alias("b"), (F.col("id") % 2).cast("int").alias("side"))
        return KeyedTable.create(rows, str(tmp_path), "many", ["key"], partitions)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("partitions", [(), ("side",)])
def test_upsert_writes_only_touched_files(spark, tmp_path, partitions):
    old = many_files(spark, tmp_path, partitions)
    assert len(old.files) >= 18
    updates = spark.createDataFrame([(k, None if k == 503 else -k) for k in range(500, 510)], "key long, a long")
    new = old.upsert(updates, ["a"])
    assert len(paths(old) - paths(new)) <= 4 and len(paths(new) - paths(old)) <= 8
    got = {r.key: (r.a, r.b, r.side) for r in new.read().collect()}
    assert got == {k: ((None if k == 503 else -k) if 500 <= k < 510 else 2 * k, "x", k % 2) for k in range(1000)}
    assert {r.key: r.a for r in old.read().collect()} == {k: 2 * k for k in range(1000)}  # the old version stays readable
    assert sum(f["rows"] for f in new.files) == 1000


def test_second_writer_is_refused(spark, table):
    one, two = KeyedTable.open(spark, table.root, "things"), KeyedTable.open(spark, table.root, "things")
    after = one.delete(spark.createDataFrame([(1,), (2,)], "key long"))
    with pytest.raises(ConcurrentUpdate):
        two.delete(spark.createDataFrame([(3,)], "key long"))
    again = KeyedTable.open(spark, table.root, "things")
    assert again.version == after.version and again.read().count() == 998
    assert again.delete(spark.createDataFrame([(3,)], "key long")).read().count() == 997


def test_cases_of_updates(spark, table):
    assert table.upsert(spark.createDataFrame([], "key long, a long"), ["a"]) is table
    assert table.delete(spark.createDataFrame([(5000,), (None,)], "key long")) is table
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(1, 1), (1, 2)], "key long, a long"), ["a"])
    fresh = table.upsert(spark.createDataFrame([(7, 0), (2000, 5), (None, 6)], "key long, a long"), ["a"], insert=True)
    got = {r.key: (r.a, r.b) for r in fresh.read().collect()}
    assert len(got) == 1002 and got[7] == (0, "x") and got[2000] == (5, None) and got[None] == (6, None)
    empty = fresh.delete(fresh.read().select("key")).read()
    assert [r.key for r in empty.collect()] == [None]  # a null key matches nothing
    none = KeyedTable.create(spark.createDataFrame([], "key long, a long"), table.root, "none", ["key"])
    assert none.read().count() == 0 and none.append(spark.createDataFrame([(1, 2)], "key long, a long")).read().count() == 1


def test_change_and_vacuum(spark, table):
    ids = spark.range(10).withColumnRenamed("id", "key")
    new = table.change(ids, lambda rows: rows.withColumn("b", F.lit(None).cast("string")))
    assert new.read().where("b IS NULL").count() == 10 and new.read().count() == 1000
    assert new.vacuum(keep=1) > 0
    assert KeyedTable.open(spark, table.root, "things").read().count() == 1000
    assert new.vacuum(keep=1) == 0


def test_text_keys(spark, tmp_path):
    rows = spark.range(50).select(F.format_string("k%03d", "id").alias("name"), F.col("id").alias("v"))
    t = KeyedTable.create(rows, str(tmp_path), "named", ["name", "v"])
    kept = t.delete(spark.createDataFrame([("k001", 1), ("k002", 99)], "name string, v long")).read()
    assert kept.count() == 49 and kept.where("name = 'k001'").count() == 0
