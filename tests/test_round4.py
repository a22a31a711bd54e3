"""Findings of the fourth review."""

import numpy as np
import pytest

from strokelake.operators import align, match
from strokelake.operators.raster import SPAN
from strokelake.plans import pipelines


def packed(x, y):
    return np.sort(np.asarray(y, np.int64) * SPAN + np.asarray(x, np.int64))


@pytest.mark.parametrize("hits", [align.HITS, 0])
def test_shifts_are_counted_as_by_hand(monkeypatch, hits):
    """Sparse ink needs no correlation; dense ink gives the same by it."""
    rng = np.random.default_rng(2)
    ref, src = (np.stack([rng.integers(0, 60, 300), rng.integers(0, 40, 300)], 1) for _ in range(2))
    monkeypatch.setattr(align, "HITS", hits)
    if hits:
        monkeypatch.setattr(np.fft, "rfft2", None)
    (got,) = align.best_shifts(packed(*src.T), packed(*ref.T), 1.0, [9.0], [0.9, 1.0], 4, 60, 40)
    best, known = -1.0, set(map(tuple, ref))
    for scale in (0.9, 1.0):
        moved = {(x, y) for x, y in align.move(np.unique(src, axis=0).astype(float), 9.0, scale, 60, 40) if -4 <= x < 64 and -4 <= y < 44}
        for dx in range(-4, 5):
            for dy in range(-4, 5):
                at = {(x + dx, y + dy) for x, y in moved}
                held = {(x, y) for x, y in at if 0 <= x < 60 and 0 <= y < 40}
                best = max(best, len(at & known) / len(held | known))
    assert got[4] == pytest.approx(best, abs=1e-6)


def test_pairs_are_searched_in_tasks_of_their_own(spark, rows):
    rng = np.random.default_rng(4)
    ink = sorted({(p, int(x), int(y)) for p in range(16) for x, y in zip(rng.integers(0, 568, 150), rng.integers(0, 274, 150))})
    made = align.align(rows(ink, "pair_id bigint, x int, y int"), rows(ink, "pair_id bigint, x int, y int"))
    got = made.collect()
    assert len(got) == 16 and all(r["success"] and r["overlap_score"] == 1 and r["rotation_degrees"] == 0 for r in got)
    assert "Generate explode" not in made._jdf.queryExecution().executedPlan().toString()  # a pair's ink is not repeated


SEG = "drawing_id bigint, line_id int, x1 int, y1 int, x2 int, y2 int"


def drawings_of(rng, sizes):
    return [(d, i, *map(int, rng.integers(0, 250, 4))) for d, n in enumerate(sizes) for i in range(1, n + 1)]


@pytest.mark.parametrize("optimal", [True, False])
def test_usual_drawings_are_matched_in_one_pass(rows, monkeypatch, optimal):
    """Equal to the pruned path, without joins and without a row per pair; lines of several rows and large drawings included."""
    rng = np.random.default_rng(6)
    lines = drawings_of(rng, [1, 3, 4, 5, 9, 17, 2, 64, 70])
    lines += [(3, 2, 5, 5, 90, 90), (50, 1, 7, 7, 7, 7), (50, 2, 7, 7, 7, 7)]
    seg = rows(lines, SEG)
    ref = rows([(1, k, *map(int, rng.integers(0, 250, 4))) for k in range(4)], "reference_id int, ref_id int, x1 int, y1 int, x2 int, y2 int")
    kept = seg.where("drawing_id <> 3")  # of a line with two rows either may count in the pruned path
    assign = match.assign_segments if optimal else match.assign_greedy

    def pairs(df):
        return sorted((r["drawing_id"], r["line_id"], r["ref_id"], round(r["similarity"], 9)) for r in df.collect())

    want = pairs(assign(match.score_pairs(kept, ref), 4, None))
    assert pairs(pipelines.match_drawings(kept, ref, optimal, None)) == want
    assert match.split_by_size(kept)[1].select("drawing_id").distinct().count() == 1
    marked = pipelines.matched_drawings(seg, ref, optimal)
    usual = pipelines.matched_drawings(seg.where("drawing_id <> 8"), ref, optimal)
    plan = usual._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange") == 1, plan
    assert marked.count() == len(lines)
    old = match.match_summary(assign(match.score_pairs(kept, ref), 4, 0.5), kept, 4)
    new = pipelines.match_counts(kept, ref, optimal=optimal)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
    old = match.tag_matches(kept, ref, assign(match.score_pairs(kept, ref), 4, 0.5))
    new = match.tag_segments(pipelines.matched_drawings(kept, ref, optimal), ref)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))


def test_large_templates_are_scored_in_the_same_way(rows, monkeypatch):
    rng = np.random.default_rng(8)
    seg = rows(drawings_of(rng, [3, 8, 20]), SEG)
    ref = rows([(1, k, *map(int, rng.integers(0, 250, 4))) for k in range(14)], "reference_id int, ref_id int, x1 int, y1 int, x2 int, y2 int")
    first = sorted(map(tuple, match.matched_segments(seg, ref).collect()))
    monkeypatch.setattr(match, "UNROLLED", 0)
    assert first == sorted(map(tuple, match.matched_segments(seg, ref).collect()))
    none = match.matched_segments(seg, ref.where("false"))
    assert none.count() == 31 and none.where("ref_id IS NOT NULL").count() == 0
