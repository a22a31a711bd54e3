import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokelake.functions import geometry as G
from strokelake.operators import align, augment, greedy, match, raster, segments, synth

SEG = "drawing_id bigint, line_id int, x1 int, y1 int, x2 int, y2 int"


def random_segments(seed, sizes, spread=568):
    rng = np.random.default_rng(seed)
    return [
        (d, k + 1, int(rng.integers(spread)), int(rng.integers(274)), int(rng.integers(spread)), int(rng.integers(274)))
        for d, n in enumerate(sizes)
        for k in range(n)
    ]


def fold(s):
    return np.degrees(np.arctan2(s[5] - s[3], s[4] - s[2])) % 180


def mid(s):
    return np.array([(s[2] + s[4]) / 2, (s[3] + s[5]) / 2])


def overlaps(a, b):
    return abs(fold(a) - fold(b)) < 8 and np.linalg.norm(mid(a) - mid(b)) < 25


def test_overlap_pairs_and_suppression_equal_brute_force(rows):
    data = random_segments(5, [400, 3, 1], spread=120)  # one crowded drawing
    df = rows(data, SEG)
    got = {(r["drawing_id"], r["line_i"], r["line_j"]) for r in segments.overlap_pairs(df).collect()}
    want = {(a[0], a[1], b[1]) for a, b in itertools.combinations(data, 2) if a[0] == b[0] and overlaps(a, b)}
    assert got == want and len(want) > 50
    kept = []
    for s in sorted(data, key=lambda s: (-np.hypot(s[4] - s[2], s[5] - s[3]), s[1])):
        if not any(k[0] == s[0] and overlaps(s, k) for k in kept):
            kept.append(s)
    assert {(r["drawing_id"], r["line_id"]) for r in segments.suppress_overlaps(df).collect()} == {(s[0], s[1]) for s in kept}


def merged_similar(lines):
    used, out = set(), {}
    for i, a in enumerate(lines):
        if i in used:
            continue
        group = [a]
        for j in range(i + 1, len(lines)):
            b = lines[j]
            fa, fb = ((180 - abs(v) if abs(v) > 90 else abs(v)) for v in (np.degrees(np.arctan2(s[5] - s[3], s[4] - s[2])) for s in (a, b)))
            if j not in used and abs(fa - fb) < 3 and np.linalg.norm(mid(a) - mid(b)) < 40:
                group.append(b)
                used.add(j)
        out[a[1]] = tuple(int(np.mean([g[k] for g in group])) for k in range(2, 6))
    return out


def test_merge_similar_equals_brute_force(rows):
    data = random_segments(6, [150], spread=150)
    got = {r["line_id"]: (r["x1"], r["y1"], r["x2"], r["y2"]) for r in segments.merge_similar(rows(data, SEG)).collect()}
    assert got == merged_similar(data)


def test_merge_collinear_joins_pieces_of_a_line(rows):
    pieces = [(1, k + 1, 20 + 60 * k, 30 + 30 * k, 60 + 60 * k, 50 + 30 * k) for k in range(6)]
    other = [(1, 7, 20, 200, 300, 200), (1, 8, 40, 40, 40, 200)]
    got = {r["line_id"]: r for r in segments.merge_collinear(rows(pieces + other, SEG)).collect()}
    assert set(got) == {1, 7, 8}
    assert (got[1]["x1"], got[1]["y1"], got[1]["x2"], got[1]["y2"], got[1]["pieces"]) == (20, 30, 360, 200, 6)
    assert (got[7]["x1"], got[7]["x2"], got[7]["pieces"]) == (20, 300, 1)


def brute_cost(cost):
    n, m = cost.shape
    if n > m:
        return brute_cost(cost.T)
    return min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (5, 3), (5, 5), (2, 6)])
def test_least_cost_pairs_equals_brute_force(shape):
    rng = np.random.default_rng(sum(shape))
    stack = rng.random((12, *shape))
    for cost, (r, c) in zip(stack, match.least_cost_pairs(stack)):
        assert len(set(r)) == len(set(c)) == min(shape)
        assert cost[r, c].sum() == pytest.approx(brute_cost(cost))


@pytest.mark.parametrize("n,m", [(6, 6), (4, 9), (9, 9)])
def test_augmenting_paths_equal_the_subset_table(n, m):
    rng = np.random.default_rng(n * m)
    for cost in rng.random((20, n, m)):
        r, c = match._augmenting_paths(cost)
        (tr, tc), = match.least_cost_pairs(cost[None])
        assert len(set(c)) == n and cost[r, c].sum() == pytest.approx(cost[tr, tc].sum())


def test_wide_matrices_use_augmenting_paths():
    rng = np.random.default_rng(1)
    cost = rng.random((2, 20, 15))
    for matrix, (r, c) in zip(cost, match.least_cost_pairs(cost)):
        assert len(set(r)) == len(set(c)) == 15
        assert matrix[r, c].sum() <= np.sort(matrix, axis=0)[:1].sum() * 4


@pytest.fixture
def template(rows):
    return rows(
        [(1, 0, 234, 187, 334, 187), (1, 1, 334, 187, 334, 87), (1, 2, 334, 87, 234, 87), (1, 3, 234, 87, 284, 37)],
        "reference_id int, ref_id int, x1 int, y1 int, x2 int, y2 int",
    )


def test_assignment_is_optimal_and_not_worse_than_greedy(rows, template):
    data = random_segments(8, [1, 2, 3, 4, 5, 7, 300])
    df = rows(data, SEG)
    pairs = match.score_pairs(df, template)
    best = {r["drawing_id"]: (r["n"], r["c"]) for r in match.assign_segments(pairs, 4, None).groupBy("drawing_id").agg(
        F.count("*").alias("n"), F.sum(1 - F.col("similarity")).alias("c")).collect()}
    bounded = {r["drawing_id"]: r["c"] for r in match.assign_segments(pairs, 4, None, bounded=True).groupBy("drawing_id").agg(
        F.sum(1 - F.col("similarity")).alias("c")).collect()}
    greedy = {r["drawing_id"]: r["c"] for r in match.assign_greedy(pairs, 4).groupBy("drawing_id").agg(
        F.sum(1 - F.col("similarity")).alias("c")).collect()}
    table = {}
    for r in pairs.collect():
        table.setdefault(r["drawing_id"], {})[(r["line_id"], r["ref_id"])] = 1 - r["similarity"]
    for d, cells in table.items():
        n = max(k[0] for k in cells)
        assert best[d][0] == min(n, 4)
        assert best[d][1] == pytest.approx(bounded[d])  # pruning loses nothing
        assert best[d][1] <= greedy[d] + 1e-9
        if n <= 7:
            cost = np.array([[cells[(i + 1, j)] for j in range(4)] for i in range(n)])
            assert best[d][1] == pytest.approx(brute_cost(cost))


def test_match_summary_of_empty_sides(rows, template):
    df = rows([(1, 1, 0, 0, 10, 0), (1, 2, 0, 0, 100, 0)], SEG)
    none = rows([], "drawing_id bigint, line_id int, ref_id int, similarity double")
    drawings = rows([(1,), (2,)], "drawing_id bigint")
    got = {r["drawing_id"]: r for r in match.match_summary(none, df, 4, drawings).collect()}
    assert (got[1]["correct_lines"], got[1]["missing_lines"], got[1]["extra_lines"]) == (0, 4, 1)
    assert (got[2]["missing_lines"], got[2]["extra_lines"], got[2]["detected_lines"]) == (4, 0, 0)
    assert match.match_summary(none, df, 0).first()["extra_lines"] == 2


def ink_of(rows, lines):
    return raster.rasterise(rows(lines, SEG))


def test_detector_recovers_planted_lines(rows):
    planted = [(1, 1, 100, 50, 300, 50), (1, 2, 400, 60, 400, 220), (1, 3, 60, 80, 160, 230), (2, 1, 20, 20, 500, 250)]
    found = raster.detect_segments(ink_of(rows, planted)).collect()
    for d, _, x1, y1, x2, y2 in planted:
        near = [
            r for r in found if r["drawing_id"] == d
            and min(max(abs(r["x1"] - x1), abs(r["y1"] - y1), abs(r["x2"] - x2), abs(r["y2"] - y2)),
                    max(abs(r["x1"] - x2), abs(r["y1"] - y2), abs(r["x2"] - x1), abs(r["y2"] - y1))) <= 3
        ]
        assert near, (d, x1, y1, x2, y2, found)
    lengths = [np.hypot(r["x2"] - r["x1"], r["y2"] - r["y1"]) for r in found]
    assert len(found) <= 24 and min(lengths) >= 30


def test_components_equal_flood_fill(rows):
    rng = np.random.default_rng(2)
    mask = rng.random((30, 40)) < 0.35
    points = [(1, int(x), int(y)) for y, x in zip(*np.nonzero(mask))]
    seen, count = set(), 0
    cells = {(x, y) for _, x, y in points}
    for start in cells:
        if start in seen:
            continue
        count += 1
        todo = [start]
        while todo:
            x, y = todo.pop()
            if (x, y) in seen:
                continue
            seen.add((x, y))
            todo += [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (x + dx, y + dy) in cells]
    got = raster.ink_components(rows(points, "drawing_id bigint, x int, y int")).first()
    assert got["components"] == count


def test_align_finds_a_planted_transform(rows):
    shape = [(1, 1, 180, 80, 380, 80), (1, 2, 380, 80, 380, 200), (1, 3, 180, 200, 380, 200), (1, 4, 180, 80, 280, 30)]
    pair = lambda df: df.withColumnRenamed("drawing_id", "pair_id")
    reference = pair(ink_of(rows, shape))
    turned = rows(shape, SEG)
    a = G.affine(F.col("x1"), F.col("y1"), (284, 137), F.lit(6.0), F.lit(1.0), F.lit(4), F.lit(-3))
    b = G.affine(F.col("x2"), F.col("y2"), (284, 137), F.lit(6.0), F.lit(1.0), F.lit(4), F.lit(-3))
    moved = turned.select("drawing_id", "line_id", *(F.round(c).cast("int").alias(n) for c, n in zip((*a, *b), ("x1", "y1", "x2", "y2"))))
    got = align.align(pair(raster.rasterise(moved)), reference).first()
    assert got["success"] and abs(got["rotation_degrees"] + 6) <= 1 and abs(got["translation_x"] + 4) <= 2
    assert got["overlap_score"] > 0.3  # one-pixel strokes never overlap fully after rounding
    few = rows([(1, 5, 5)], "pair_id bigint, x int, y int")
    assert align.align(few, reference).first()["reason"] == "Too few black pixels"


def test_borders_with_real_content_stay(rows):
    full = [(1, x, 1) for x in range(0, 568, 2)] + [(1, 2, y) for y in range(100, 110)]
    got = raster.clean_borders(rows(full, "drawing_id bigint, x int, y int")).collect()
    assert {(r["x"], r["y"]) for r in got} == {(x, 1) for x in range(6, 568, 2) if x < 563}


def test_augmented_segments_stay_inside_and_repeat(rows):
    data = random_segments(9, [4, 6, 1])
    out, params = augment.augmented_segments(rows(data, SEG), 42)
    got = {(r["drawing_id"], r["aug_idx"], r["line_id"]): r for r in out.collect()}
    assert len(got) == len(data) * 6
    for r in got.values():
        assert 0 <= r["x1"] <= 567 and 0 <= r["y2"] <= 273
    for d, k, *ends in data:
        r = got[(d, 0, k)]
        assert [r["x1"], r["y1"], r["x2"], r["y2"]] == ends
    again, _ = augment.augmented_segments(rows(data, SEG).repartition(7), 42)
    assert {(r["drawing_id"], r["aug_idx"], r["line_id"]): r["x1"] for r in again.collect()} == {k: r["x1"] for k, r in got.items()}
    for p in params.collect():
        assert (p["kind"] == "original") == (p["rotation"] is None)
        if p["rotation"] is not None:
            assert abs(p["rotation"]) <= 3 and -10 <= p["tx"] < 10 and 0.95 <= p["scale"] <= 1.05


def test_synthesis_counts(rows, template, spark):
    low = rows(random_segments(11, [8, 8, 9]), SEG)
    wanted, pieces = synth.synthesise(low, template, 23)
    levels = {r["level"]: r["n"] for r in wanted.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert levels == {0: 4, 1: 4, 2: 5, 3: 5, 4: 5}
    assert sorted(r["synth_id"] for r in wanted.collect()) == list(range(23))
    pool = synth.line_pool(low, template)
    drawn = synth.sample_pool(wanted, pool, "n_real", 1, "real")
    per = drawn.groupBy("synth_id").agg(F.count("*").alias("n"), F.countDistinct("x1", "y1", "x2", "y2").alias("d")).collect()
    need = {r["synth_id"]: min(r["n_real"], 25) for r in wanted.collect()}
    assert all(r["n"] == need[r["synth_id"]] and r["d"] == r["n"] for r in per)
    assert pieces.where("x1 < 0 OR x2 > 567 OR y1 < 0 OR y2 > 273").count() == 0
    assert pieces.where("curved AND step > 0").count() > 0


def chain(spark, n, key=1):
    """Parallel segments, each in conflict with the next one only, in falling length."""
    rows = [(key, i, 20 * i, 0, 20 * i + 4 * (n - i) + 10, 0) for i in range(n)]
    rows = [(k, i, x1 - (x2 - x1) // 2, y1, x1 - (x2 - x1) // 2 + (x2 - x1), y2) for k, i, x1, y1, x2, y2 in rows]
    return spark.createDataFrame(rows, "drawing_id long, line_id int, x1 int, y1 int, x2 int, y2 int")


def test_long_chain_of_conflicts_takes_few_steps(spark, monkeypatch):
    cuts = []
    real = greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda df: (cuts.append(1), real(df))[1])
    kept = segments.suppress_overlaps(chain(spark, 5000))
    assert sorted(r.line_id for r in kept.collect()) == list(range(0, 5000, 2)) and len(cuts) <= 10


def test_rounds_and_whole_drawings_keep_the_same(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(d, i, rng.randrange(60), rng.randrange(60), rng.randrange(60), rng.randrange(60)) for d in range(6) for i in range(60)]
    seg = spark.createDataFrame(rows, "drawing_id long, line_id int, x1 int, y1 int, x2 int, y2 int").where("x1 <> x2 OR y1 <> y2")

    def results():
        return [sorted(map(tuple, f(seg).collect())) for f in (segments.suppress_overlaps, segments.merge_similar, segments.merge_collinear)]

    whole = results()
    monkeypatch.setattr(greedy, "WHOLE", 40)  # most drawings take rounds, the others do not
    assert results() == whole
