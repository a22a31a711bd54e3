import numpy as np
import pytest
from pyspark.sql import functions as F

from strokelake.operators import classes, metrics, ordered, profile, scaler, split


def frame(rows, values, name="v"):
    return rows([(i, float(v)) for i, v in enumerate(values)], f"id bigint, {name} double")


def greedy_classes(values, k):
    """Row-by-row statement of the equal-size rule."""
    scores, counts = np.unique(values, return_counts=True)
    target, out, held, first = len(values) / k, [], 0, 0
    for i, c in enumerate(counts):
        over = held + c > target * 1.15
        near = held >= target * 0.85 and abs(held - target) <= abs(held + c - target)
        if len(out) < k - 1 and held > 0 and (over or near):
            out.append((scores[first], scores[i - 1], held))
            held, first = 0, i
        held += c
    out.append((scores[first], scores[-1], held))
    return out


@pytest.mark.parametrize("seed,k", [(0, 2), (1, 3), (2, 5), (3, 10), (4, 4)])
def test_balanced_classes_follow_the_rule(rows, seed, k):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, rng.integers(3, 61), 150)
    got = classes.ScoreTotals(frame(rows, values), "v").classes(k).orderBy("class_id").collect()
    want = greedy_classes(values, k)
    assert [r["count"] for r in got] == [w[2] for w in want]
    assert [r["hi"] for r in got] == [int(w[1]) for w in want]


def test_identical_scores_give_one_class(rows):
    got = classes.balanced_classes(frame(rows, [7] * 20), "v", 3).collect()
    assert len(got) == 1 and got[0]["count"] == 20 and got[0]["lo"] == 0
    wide = classes.equal_width_classes(frame(rows, [7] * 20), "v", 3).orderBy("class_id").collect()
    assert [r["count"] for r in wide] == [0, 0, 20]


@pytest.mark.parametrize("k", [1, 11])
def test_class_count_limits(rows, k):
    with pytest.raises(ValueError):
        classes.balanced_classes(frame(rows, [1, 2]), "v", k)
    with pytest.raises(ValueError):
        classes.ScoreTotals(frame(rows, []), "v")


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_equal_numpy(rows, seed):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=301) if seed else rng.integers(0, 4, 300)
    got = ordered.exact_percentiles(frame(rows, values), "v", {"a": 0.1, "m": 0.5, "z": 0.95}, buckets=16).first()
    assert [got["a"], got["m"], got["z"]] == pytest.approx(list(np.percentile(values, [10, 50, 95])))


def test_running_totals_with_one_dominant_value(rows):
    values = [5.0] * 500 + list(np.linspace(0, 10, 101))
    got = ordered.running_totals(frame(rows, values), "v", buckets=8).orderBy("v").collect()
    before = 0
    for r in got:
        assert r["n_before"] == before and r["n_total"] == len(values)
        before += r["n"]
    assert before == len(values)


def test_next_in_order_crosses_chunks(rows):
    data = [("a", i, i * 10) for i in range(25) if i not in (7, 8, 9, 10, 11)] + [("b", 3, 1)]
    got = ordered.next_in_order(rows(data, "k string, seq int, x int"), ["k"], "seq", ["x"], chunk=4).orderBy("k", "seq").collect()
    xs = [r for r in got if r["k"] == "a"]
    assert [r["next_x"] for r in xs] == [r["x"] for r in xs[1:]] + [None]
    assert got[-1]["next_x"] is None


def test_number_rows_is_a_permutation(spark):
    df = ordered.number_rows(spark.range(500), F.pmod(F.xxhash64("id"), F.lit(1000)), "id", 1000, buckets=7)
    assert sorted(r["place"] for r in df.collect()) == list(range(500))


def test_histogram_of_identical_values(rows):
    got = profile.histogram(frame(rows, [3, 3, 3]), "v", 4).orderBy("bin").collect()
    assert got[0]["min"] == 2.5 and got[-1]["max"] == 3.5 and sum(r["count"] for r in got) == 3


@pytest.mark.parametrize("buckets", [3, 64])
def test_split_is_exact_complete_and_stable(spark, buckets):
    df = spark.range(1003).select("id", (F.col("id") % 4).cast("int").alias("s"))
    wanted = F.floor(F.col("n") * 0.8)
    from strokelake.functions.values import ORDER_MODULUS, seeded_order

    a = ordered.first_share(df.repartition(1), ["s"], seeded_order(F.col("id"), 1), "id", wanted, ORDER_MODULUS, buckets=buckets)
    b = ordered.first_share(df.repartition(8), ["s"], seeded_order(F.col("id"), 1), "id", wanted, ORDER_MODULUS)
    left = {r["id"]: r["picked"] for r in a.collect()}
    assert left == {r["id"]: r["picked"] for r in b.collect()} and len(left) == 1003
    for s, n in ((0, 251), (1, 251), (2, 251), (3, 250)):
        assert sum(v for k, v in left.items() if k % 4 == s) == int(n * 0.8)


def test_class_split_leaves_one_for_validation(rows):
    df = rows([(1, 0), (2, 0), (3, 1), (4, 1), (5, 1)], "id bigint, label int")
    got = split.split_classification(df, "label", 1.0).collect()
    for label in (0, 1):
        assert sum(r["split"] == "val" for r in got if r["label"] == label) == 1


def test_small_class_falls_back_to_random(rows):
    df = rows([(i, 0) for i in range(9)] + [(9, 1)], "id bigint, label int")
    got = split.split_classification(df, "label", 0.8).collect()
    assert sum(r["split"] == "train" for r in got) == 8


def test_bins_collapse_on_equal_edges(rows):
    got = split.assign_bins(frame(rows, [1] * 9 + [5]), "v", 4).collect()
    want = np.digitize([1] * 9 + [5], np.percentile([1] * 9 + [5], [25, 50, 75]))
    assert [r["bin"] for r in sorted(got, key=lambda r: r["id"])] == list(want)


def test_ks_of_equal_and_shifted_samples(rows):
    same = rows([(float(v), s) for v in range(60) for s in ("train", "val")], "v double, split string")
    got = split.ks_2samp(same, "v", F.col("split") == "train").first()
    assert got["statistic"] == 0 and got["p_value"] == 1
    far = rows([(float(v), "train") for v in range(60)] + [(float(v + 100), "val") for v in range(60)], "v double, split string")
    got = split.ks_2samp(far, "v", F.col("split") == "train").first()
    assert got["statistic"] == 1 and got["p_value"] < 1e-6


def test_scaler_round_trip_and_errors(rows):
    df = frame(rows, [1, 2, 4])
    for method in ("min_max", "standardize", "none"):
        s = scaler.Scaler.from_record(scaler.fit_scaler(df, "v", method).to_record())
        back = [r["b"] for r in df.orderBy("id").select(s.unscale(s.scale(F.col("v"))).alias("b")).collect()]
        assert back == pytest.approx([1, 2, 4])
    for bad in ({"enabled": False, "method": "none"}, {"enabled": True}):
        with pytest.raises(ValueError):
            scaler.Scaler.from_record(bad)
    with pytest.raises(ValueError):
        scaler.fit_scaler(df, "v", "other")


def test_regression_metrics_edges(rows):
    flat = rows([(5.0, 6.0), (5.0, 4.0)], "target double, prediction double")
    assert metrics.regression_metrics(flat).first()["r2"] == 0.0
    zero = rows([(0.0, 1.0)], "target double, prediction double")
    assert metrics.regression_metrics(zero).first()["mape"] == 0.0


def test_class_never_seen_scores_zero(rows):
    df = rows([(0, 0), (1, 0)], "target int, prediction int")
    got = {r["class_id"]: r for r in metrics.class_metrics(df, 3).collect()}
    assert got[2]["f1"] == 0 and got[2]["support"] == 0 and got[0]["precision"] == 0.5


def test_edit_boundary(rows):
    defs = rows([(0, 0, 10), (1, 11, 20), (2, 21, 30)], "class_id int, lo int, hi int")
    got = classes.edit_boundary(defs, 1, "single", 15, 0, 30).orderBy("class_id").collect()
    assert [tuple(r) for r in got] == [(0, 0, 14), (1, 15, 15), (2, 16, 30)]
    with pytest.raises(ValueError):
        classes.edit_boundary(defs, 1, "min", 99, 0, 30)
