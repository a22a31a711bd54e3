"""Findings of the third review: kept rows of streams, softmax, augmentation, line finding."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from strokelake.config import DETECTOR
from strokelake.functions import values as V
from strokelake.operators import augment, raster
from strokelake.streaming import jobs


def test_softmax_takes_time_by_the_number_of_logits(spark, rows):
    n = 1500  # the cube of it would take minutes
    began = time.time()
    p = spark.range(1).select(V.softmax(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(i * 7, F.lit(13)).cast("double"))).alias("p")).first()["p"]
    assert time.time() - began < 20
    powers = [math.exp(i * 7 % 13 - 12) for i in range(n)]
    assert max(abs(a - b / sum(powers)) for a, b in zip(p, powers)) < 1e-12
    got = [r[0] for r in rows([([],), (None,), ([None, 1.0],), ([5.0],)], "l array<double>").coalesce(1).select(V.softmax(F.col("l"))).collect()]
    assert got == [[], None, [None, None], [1.0]]


def _feed(spark, path):
    return jobs.file_stream(spark, path, spark.read.parquet(path).schema, per_trigger=1)


def _add(spark, path, part):
    spark.createDataFrame(part, "drawing_id int, line_id int, _at string").coalesce(1).write.mode("append").parquet(path)


def test_rows_of_a_drawing_are_kept_without_python(spark, tmp_path):
    source = str(tmp_path / "in")
    _add(spark, source, [(1, 10, "a")])
    plan = jobs.whole_drawings(_feed(spark, source), "drawing_id")._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Py" not in plan and "Pandas" not in plan  # a call of Python per drawing took milliseconds


def test_rows_expire_and_names_stay_free(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []

    def evaluate(rows):
        seen.append(sorted(map(tuple, rows.collect()), key=str))
        return rows.groupBy("drawing_id").agg(F.count("*").alias("lines"))

    def run():
        jobs.evaluate_stream(_feed(spark, source), "drawing_id", evaluate, target, str(tmp_path / "state"), {"availableNow": True}, "PT30S").awaitTermination()

    _add(spark, source, [(1, 10, "a"), (1, 10, "a"), (None, 7, None), (2, 20, "b")])
    run()
    _add(spark, source, [(1, 11, None), (None, 8, "c")])
    run()
    time.sleep(31)
    _add(spark, source, [(1, 12, "d")])
    run()
    assert seen[0] == [(1, 10, "a"), (1, 10, "a"), (2, 20, "b"), (None, 7, None)]
    assert seen[1] == [(1, 10, "a"), (1, 10, "a"), (1, 11, None), (None, 7, None), (None, 8, "c")]
    assert seen[2] == [(1, 12, "d")]


def test_augmented_lines_are_shuffled_by_drawing_only(spark, rows):
    seg = rows([(d, k, 5 * k, 40 + k, 500 - k, 9 * k) for d in range(6) for k in range(1, 4)] + [(9, 1, None, 5, 6, 7)],
               "drawing_id bigint, line_id int, x1 int, y1 int, x2 int, y2 int")
    out, params = augment.augmented_segments(seg, 42)
    moves = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and "Reused" not in x]
    assert moves and not any("aug_idx" in x for x in moves)
    assert all(f", {spark.conf.get('spark.sql.shuffle.partitions')})" in x for x in moves)
    assert out.count() == 6 * 19 and out.select("drawing_id", "aug_idx", "line_id").distinct().count() == 6 * 19
    # a warped sample's box is that of its warped lines, in the lines and in the parameters alike
    got = {tuple(r[:2]): r for r in params.collect()}
    assert len(got) == 6 * 7 and all((got[d, 0].rotation is None) and got[d, 5].rotation is not None for d in (0, 9))


def _by_every_cell(packed, cfg=DETECTOR):
    """The search without bounds: each strong cell of each direction, in order."""
    points = raster.unpack_places(np.asarray(packed)).astype(float)
    turns = np.radians(np.arange(180))
    kept = []
    for step in range(cfg.rounds):
        votes_needed, length_needed = (cfg.strict_votes, cfg.strict_length) if step < cfg.strict_rounds else (cfg.relaxed_votes, cfg.relaxed_length)
        found = []
        for turn, (c, s) in enumerate(zip(np.cos(turns), np.sin(turns))):
            rho = np.floor(points @ np.array([c, s]) + 0.5) if len(points) else np.zeros(0)
            for level, votes in zip(*np.unique(rho, return_counts=True)):
                on = points[np.abs(rho - level) <= 3]
                along = on @ np.array([-s, c])
                on, along = on[np.argsort(along, kind="stable")], np.sort(along)
                for run in np.split(np.arange(len(on)), np.flatnonzero(np.diff(along) > cfg.max_gap) + 1) if votes >= votes_needed else []:
                    size = np.hypot(*(on[run[-1]] - on[run[0]]))
                    if len(run) >= votes_needed and size >= length_needed:
                        found.append(((size, votes, -turn, -level, -run[0]), (*on[run[0]].astype(int), *on[run[-1]].astype(int))))
        if not found:
            break
        best = max(found)[1]
        if not any(raster._alike(best, other, cfg) for other in kept):
            kept.append(best)
        points = points[raster._distance_to(points, best) > cfg.erase_radius] if len(points) else points
        if len(kept) >= cfg.max_lines:
            break
    return [s for s in kept if np.hypot(s[2] - s[0], s[3] - s[1]) >= cfg.final_length]


def test_lines_are_those_of_a_search_of_every_cell(monkeypatch):
    rng = np.random.default_rng(11)
    tried = []
    sort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: tried.append(1) or sort(*a, **k))
    for n, width, height, left in ((0, 5, 5, 0), (1, 5, 5, 0), (60, 200, 2, 0), (250, 90, 70, -40), (900, 280, 130, 0), (60, 2, 200, 7000)):
        packed = np.unique(rng.integers(0, height, n) * raster.SPAN + rng.integers(0, width, n) + left)
        tried.clear()
        got = raster.find_lines(packed)
        assert got == _by_every_cell(packed)
    packed = np.unique(np.random.default_rng(11).integers(0, 100, 800) * raster.SPAN + np.random.default_rng(12).integers(0, 200, 800))
    tried.clear()
    assert len(raster.find_lines(packed)) == 3 and len(tried) < 50  # 90 sorts before


def test_drawings_are_dealt_to_many_tasks(spark, rows):
    ink = rows([(d, x, d) for d in range(40) for x in range(60)], "drawing_id bigint, x int, y int")
    found = raster.detect_segments(ink)
    assert found.count() == 40
    assert found.select(F.spark_partition_id()).distinct().count() > 1  # one task before: few bytes, much work
