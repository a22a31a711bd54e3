"""Findings of the third review: broadcasts, one shuffle a drawing, bounded spills."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokelake.functions import geometry as G
from strokelake.operators import greedy, raster, segments
from strokelake.plans import all_queries  # noqa: F401  (registers)
from strokelake.plans.registry import QUERIES
from conftest import SF_DIR

SEG = "drawing_id bigint, line_id int, x1 int, y1 int, x2 int, y2 int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_erase_near_equals_distances_and_broadcasts_nothing(rows):
    rng = np.random.default_rng(5)
    ink = {(int(k), int(x), int(y)) for k, x, y in zip(rng.integers(1, 4, 4000), rng.integers(-70, 640, 4000), rng.integers(-70, 330, 4000))}
    lines = [(1, 1, 0, 0, 567, 273), (1, 2, 31, 32, 31, 250), (1, 3, 500, 64, 20, 63), (2, 1, 100, 100, 100, 100), (2, 2, -64, 300, 90, -64), (4, 1, 0, 0, 9, 9)]
    left = [(k, x, y) for k, x, y in ink if all(far(x, y, s[2:]) > 6 for s in lines if s[0] == k)]
    got = raster.erase_near(rows(sorted(ink), "drawing_id bigint, x int, y int"), rows(lines, SEG), 6.0)
    assert "Broadcast" not in plan_of(got)
    assert sorted(map(tuple, got.collect())) == sorted(left)


def far(x, y, s):
    a, d = np.array(s[:2], float), np.array([s[2] - s[0], s[3] - s[1]], float)
    t = np.clip((np.array([x, y]) - a) @ d / max(d @ d, 1e-9), 0, 1)
    return np.hypot(*(np.array([x, y]) - a - t * d))


def test_merges_of_usual_drawings_shuffle_by_drawing_only(rows, spark, monkeypatch):
    rng = np.random.default_rng(3)
    lines = [(d, i, *map(int, rng.integers(0, 200, 4))) for d in range(40) for i in range(1, 31)]
    lines += [(99, 1, 5, 5, 5, 5), (99, 2, 5, 5, 5, 5), (99, 3, None, 1, 2, 3)]
    seg = rows(lines, SEG)
    for merge in (segments.suppress_overlaps, segments.merge_similar, segments.merge_collinear, segments.merge_lines):
        made = merge(seg)
        plan = plan_of(made)
        assert "Join" not in plan and plan.count("Exchange") <= 2, plan
    whole = [sorted(map(tuple, f(seg.where("x1 IS NOT NULL")).collect())) for f in (segments.suppress_overlaps, segments.merge_lines)]
    for few in (0, 1000):  # cells from the first kept row on, or never
        monkeypatch.setattr(greedy, "FEW", few)
        assert whole == [sorted(map(tuple, f(seg.where("x1 IS NOT NULL")).collect())) for f in (segments.suppress_overlaps, segments.merge_lines)]
    assert segments.suppress_overlaps(seg.where("drawing_id = 99")).count() == 2


@pytest.mark.parametrize("files", [0, 1, 3])
def test_streams_read_tables_of_one_file_and_of_several(spark, tmp_path, files):
    names = ("documents", "events", "labels")
    if files:
        for name in names:
            spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path) if files else SF_DIR
    for name in ("stm_01_ingest_stream", "stm_02_info_stream", "stm_03_progress_stream", "stm_04_expire_sessions"):
        got, want = (sorted(map(tuple, q.collect())) for q in (QUERIES[name](spark, folder), QUERIES[name](spark, SF_DIR)))
        assert got == want and want


def test_stream_over_an_empty_table_is_empty(spark, tmp_path):
    for name in ("documents", "labels", "events"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["stm_02_info_stream"](spark, str(tmp_path)).count() == QUERIES["stm_04_expire_sessions"](spark, str(tmp_path)).count() == 0


def test_votes_equal_one_row_per_pixel_and_direction(rows, spark):
    rng = np.random.default_rng(9)
    ink = [(int(k), int(x), int(y)) for k, x, y in zip(rng.integers(1, 4, 900), rng.integers(-9, 568, 900), rng.integers(-9, 274, 900))]
    ink += ink[:50] + [(5, 70000, -40000), (5, 3, 3), (6, None, 4), (6, 1, 1), (7, None, None)]
    df = rows(ink, "drawing_id bigint, x int, y int")
    turn = F.radians(F.col("theta").cast("double"))
    long = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(179), F.lit(3))).alias("theta"))
    rho = F.floor(F.col("x") * F.cos(turn) + F.col("y") * F.sin(turn) + 0.5).cast("int")
    want = long.groupBy("drawing_id", "theta", rho.alias("rho")).agg(F.count(F.lit(1)).alias("votes"))
    got = raster.line_votes(df, 3)
    assert got.dtypes == want.dtypes and plan_of(got).count("Exchange") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # drawings go over batches
    try:
        made = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, made), key=order) == sorted(map(tuple, want.collect()), key=order)


def test_rasterise_equals_one_row_per_step(rows, spark):
    rng = np.random.default_rng(4)
    lines = [(int(d), i, *map(int, rng.integers(-40, 620, 4))) for i, d in enumerate(sorted(rng.integers(1, 30, 300)))]
    lines += [(50, 1, 4, 4, 4, 4), (50, 2, None, 1, 2, 3), (51, 1, -9, -9, -3, -3)]
    want = set()
    for d, _, *s in lines:
        if None in s:
            continue
        n = max(abs(s[2] - s[0]), abs(s[3] - s[1]))
        for i in range(n + 1):
            x, y = (a + (2 * i * (b - a) + max(n, 1)) // (2 * max(n, 1)) for a, b in ((s[0], s[2]), (s[1], s[3])))
            if 0 <= x < 568 and 0 <= y < 274:
                want.add((d, x, y))
    made = raster.rasterise(rows(lines, SEG))
    assert plan_of(made).count("Exchange") == 1 and "Aggregate" not in plan_of(made)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, made.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(want)
