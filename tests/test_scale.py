"""Hot keys, large drawings, wide positions and drawings over several batches."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokelake.operators import classes, ingest, match, ordered, raster, segments, split, synth
from strokelake.operators.keyed import join_small
from strokelake.streaming import jobs


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_join_small_is_the_same_join_at_any_limit(rows, limit):
    big = rows([(1, "a"), (2, "b"), (3, None), (4, "c")], "id bigint, k string")
    small = rows([("a", 10), ("c", 30), (None, 99)], "k string, v int")
    got = {r["id"]: r["v"] for r in join_small(big, small, "k", "left", limit).collect()}
    assert got == {1: 10, 2: None, 3: None, 4: 30}
    assert join_small(big, small.where("k = 'x'"), "k", "inner", limit).count() == 0


def test_any_number_of_ranges(rows):
    ranges = [(i, i) for i in range(25)]
    got = classes.assign_class(rows([(float(i),) for i in range(26)], "v double"), "v", ranges).collect()
    assert [r["class_id"] for r in got] == [*range(25), None]
    with pytest.raises(ValueError):
        classes.assign_class(rows([(1.0,)], "v double"), "v", [])


def test_bins_of_an_empty_table(rows):
    empty = rows([], "id bigint, v double")
    assert split.assign_bins(empty, "v", 4).count() == split.assign_bins(empty, "v", 4, "equal").count() == 0
    assert split.split_regression(empty, "v").count() == 0


def test_shuffle_numbers_every_row(spark):
    one, two = (split.shuffle(spark.range(200), seed).collect() for seed in (1, 2))
    assert [r["place"] for r in one] == list(range(200))
    assert sorted(r["id"] for r in one) == list(range(200))
    assert [r["id"] for r in one] != [r["id"] for r in two]


def test_large_drawing_keeps_ids_and_counts(spark):
    seg = spark.range(5000).select(
        F.lit(1).alias("drawing_id"), (F.col("id") + 1).cast("int").alias("line_id"),
        F.lit(0).alias("x1"), F.lit(0).alias("y1"), (F.col("id") + 1).cast("int").alias("x2"), F.lit(0).alias("y2"),
    )
    records = segments.features_from_json(segments.features_to_json(segments.segment_features(seg)))
    assert {(r["num_lines"], r["line_counts"]["total"]) for r in records.collect()} == {(5000, 5000)}
    assert sorted(len(r["lines"]) for r in records.collect()) == [904, 4096]
    back = segments.segments_of_record(records)
    assert back.count() == 5000
    assert back.where("line_id <> x2").count() == 0


def test_template_of_65_segments(rows):
    ref = rows([(1, i, 0, 10 * i, 100, 10 * i) for i in range(65)], "reference_id int, ref_id int, x1 int, y1 int, x2 int, y2 int")
    seg = rows([(7, i + 1, 0, 10 * i, 100, 10 * i) for i in range(65)], "drawing_id int, line_id int, x1 int, y1 int, x2 int, y2 int")
    pairs = match.score_pairs(seg, ref)
    assert pairs.count() == 65 * 65
    for found in (match.assign_segments(pairs, 65), match.assign_greedy(pairs, 65)):
        assert found.where("line_id = ref_id + 1").count() == found.count() == 65


def test_positions_outside_the_canvas_stay_apart(rows):
    places = [(-5, 3), (4091, 2), (4096, 0), (0, 1), (70000, 9), (5, -1)]
    ink = rows([(1, x, y) for x, y in places], "drawing_id int, x int, y int")
    packed = raster.pack_ink(ink).first()["ink"]
    assert sorted(map(tuple, raster.unpack_places(np.array(packed)).tolist())) == sorted(places)
    assert raster.ink_components(ink).first()["components"] == len(places)


def test_every_set_of_places_is_drawn(spark):
    draw = synth.distinct_places(F.lit(5).cast("bigint"), F.lit(2).cast("bigint"), "t", 3, F.col("id"))
    got = Counter(tuple(sorted(r["p"])) for r in spark.range(4000).select(draw.alias("p")).collect())
    assert len(got) == 10 and min(got.values()) > 320 and max(got.values()) < 480
    whole = synth.distinct_places(F.lit(4).cast("bigint"), F.lit(4).cast("bigint"), "t", 3, F.col("id"))
    assert all(sorted(r["p"]) == [0, 1, 2, 3] for r in spark.range(20).select(whole.alias("p")).collect())


def test_files_without_a_hash(rows):
    batch = rows([(1, "a", "h1", 1), (2, "b", None, 1), (3, "c", None, 1), (4, "d", "h1", 1)],
                 "drawing_id bigint, original_filename string, image_hash string, images int")
    status = {r["drawing_id"]: r["status"] for r in ingest.file_status(batch, batch.where("false")).collect()}
    assert status == {1: "success", 2: "error", 3: "error", 4: "duplicate"}
    stored = rows([(9, None)], "drawing_id bigint, image_hash string")
    assert [r["drawing_id"] for r in ingest.dedup_ingest(batch, stored, ("drawing_id",)).collect()] == [1]


def test_drawing_over_two_batches(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(1, 10), (2, 20)], [(1, 11), (3, 30)]):
        spark.createDataFrame(part, "drawing_id int, line_id int").coalesce(1).write.mode("append").parquet(source)
    stream = jobs.file_stream(spark, source, spark.read.parquet(source).schema, per_trigger=1)

    seen = []

    def evaluate(rows):
        seen.append(sorted((r.drawing_id, r.line_id) for r in rows.collect()))
        return rows.groupBy("drawing_id").agg(F.count("*").alias("lines"))

    for _ in range(2):  # the second start finds nothing new
        jobs.evaluate_stream(stream, "drawing_id", evaluate, target, str(tmp_path / "state"), {"availableNow": True}).awaitTermination()
    got = {r["drawing_id"]: r["lines"] for r in jobs.latest_results(spark, target, "drawing_id").collect()}
    assert got == {1: 2, 2: 1, 3: 1}
    assert sorted(seen) == [[(1, 10), (1, 11), (3, 30)], [(1, 10), (2, 20)]]  # drawing 2 is not read again


def test_first_share_of_a_hot_stratum(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("s"))
    picked = ordered.first_share(df, ["s"], F.col("id"), "id", F.floor(F.col("n") * 0.5), 3000)
    assert {(r["s"], r["n"]) for r in picked.where("picked").groupBy("s").agg(F.count("*").alias("n")).collect()} == {(0, 1350), (1, 150)}
