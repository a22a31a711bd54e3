"""Appended evaluations are stored once; equal totals are assigned in one order."""

import itertools

import numpy as np
import pandas as pd
import pytest

from strokelake.operators import match
from strokelake.sources import evaluation_log as log, keyed_table
from strokelake.sources.keyed_table import ConcurrentUpdate, KeyedTable

AT = "2024-05-01 10:00:00"


def summary(spark, ids, correct=3):
    rows = [(i, None if i % 7 == 6 else f"h{i // 2}", correct, 9 - correct, 1, correct / 9, 8) for i in ids]
    return spark.createDataFrame(rows, "drawing_id long, image_hash string, correct_lines int, missing_lines int, extra_lines int, similarity_score double, detected_lines int")


def keys(table):
    return sorted((r.run, r.image_hash, r.image_id, r.correct_lines) for r in table.read().collect())


def test_reruns_add_only_what_is_missing(spark, tmp_path):
    root = str(tmp_path)
    first = log.append_run(spark, root, log.evaluation_rows(summary(spark, range(6)), "a", 1, AT), "a")
    assert [k[1:3] for k in keys(first)] == [("h0", 0), ("h1", 2), ("h2", 4)]
    again = log.append_run(spark, root, log.evaluation_rows(summary(spark, range(10), 5), "a", 1, AT), "a")
    assert [k[1:] for k in keys(again)] == [("h0", 0, 3), ("h1", 2, 3), ("h2", 4, 3), ("h3", 7, 5), ("h4", 8, 5), ("id:6", 6, 5)]
    same = log.append_run(spark, root, log.evaluation_rows(summary(spark, range(10)), "a", 1, AT), "a")
    assert same.version == again.version
    other = log.append_run(spark, root, log.evaluation_rows(summary(spark, range(4)), "b", 1, AT), "b")
    assert len(keys(other)) == 8 and other.read_partition(run="b").count() == 2
    ids = [r.id for r in other.read().collect()]
    assert len(set(ids)) == 8
    with pytest.raises(ValueError):
        log.evaluation_rows(summary(spark, range(2)), "a/b", 1, AT)


def test_broken_run_leaves_no_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = log.evaluation_rows(summary(spark, range(6)), "a", 1, AT)

    def lost(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(keyed_table, "_create", lost)
        with pytest.raises(OSError):
            log.append_run(spark, root, rows, "a")
    done = log.append_run(spark, root, rows, "a")
    with monkeypatch.context() as m:
        m.setattr(keyed_table, "_create", lost)
        with pytest.raises(OSError):
            log.append_run(spark, root, log.evaluation_rows(summary(spark, range(12)), "a", 1, AT), "a")
    assert KeyedTable.open(spark, root, log.NAME).version == done.version
    whole = log.append_run(spark, root, log.evaluation_rows(summary(spark, range(12)), "a", 1, AT), "a")
    assert len(keys(whole)) == len({k[1] for k in keys(whole)}) == 7


def test_overtaken_writer_looks_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    log.append_run(spark, root, log.evaluation_rows(summary(spark, range(2)), "a", 1, AT), "a")
    real, calls = KeyedTable.append, []

    def slow(self, rows):
        if not calls:
            calls.append(1)
            real(KeyedTable.open(spark, root, log.NAME), log.evaluation_rows(summary(spark, [2, 3]), "a", 1, AT))
        return real(self, rows)

    monkeypatch.setattr(KeyedTable, "append", slow)
    got = log.append_run(spark, root, log.evaluation_rows(summary(spark, range(6)), "a", 1, AT), "a")
    assert [k[1] for k in keys(got)] == ["h0", "h1", "h2"]
    with pytest.raises(ConcurrentUpdate):
        monkeypatch.setattr(KeyedTable, "append", lambda *_: (_ for _ in ()).throw(ConcurrentUpdate("x")))
        log.append_run(spark, root, log.evaluation_rows(summary(spark, range(60)), "a", 1, AT), "a")


@pytest.mark.parametrize("lines,refs", [(3, 5), (5, 3), (4, 4), (2, 14), (15, 13)])
def test_ties_have_one_order(lines, refs):
    """Many equal similarities: the subset table, augmenting paths and trying all agree on one assignment."""
    rng = np.random.default_rng(lines * refs)
    sim = rng.integers(0, 3, (lines, refs)) / 4.0
    ids, templates = np.arange(10, 10 + lines), np.arange(refs)
    cost = match.ordered_cost(ids, templates, sim)
    (rows, cols), = match.least_cost_pairs(cost[None])
    assert len(rows) == min(lines, refs)
    paths = match._augmenting_paths(cost) if lines <= refs else tuple(reversed(match._augmenting_paths(cost.T)))
    assert cost[rows, cols].sum() == cost[paths[0], paths[1]].sum()
    assert sorted(zip(rows, cols)) == sorted(zip(*paths))
    if max(lines, refs) <= 5:
        small, large = sorted((lines, refs))
        ways = [[(i, p[i]) if lines <= refs else (p[i], i) for i in range(small)] for p in itertools.permutations(range(large), small)]
        best = min(ways, key=lambda w: sum(cost[a, b] for a, b in w))
        assert sorted(zip(rows, cols)) == sorted(best)
    flat = [np.repeat(ids, refs).tolist(), np.tile(templates, lines).tolist(), sim.ravel().tolist()]
    out = match.solve_batch(*[pd.Series([x, x[::-1]]) for x in flat])
    assert out.line_id[0].tolist() == out.line_id[1].tolist() and out.ref_id[0].tolist() == out.ref_id[1].tolist()
