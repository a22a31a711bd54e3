import hashlib
import math

import pytest
from pyspark.sql import functions as F

from strokelake.functions import geometry as G, labels as L, names as N, values as V

SEG = "x1 int, y1 int, x2 int, y2 int"


@pytest.mark.parametrize(
    "dx,dy,kind",
    [(100, 0, "horizontal"), (-100, 0, "horizontal"), (0, 50, "vertical"), (50, 50, "diagonal"), (-50, 50, "diagonal"),
     (1000, 267, "horizontal"), (1000, 268, "diagonal"), (268, 1000, "diagonal"), (267, 1000, "vertical")],
)
def test_orientation_limits(rows, dx, dy, kind):
    df = rows([(0, 0, dx, dy)], SEG).select(G.orientation(G.seg_angle(G.seg())).alias("k"))
    assert df.first()["k"] == kind


def test_similarity_of_equal_and_reversed_segments(rows):
    df = rows([(10, 10, 110, 10, 10, 10, 110, 10), (10, 10, 110, 10, 110, 10, 10, 10)],
              "x1 int, y1 int, x2 int, y2 int, r_x1 int, r_y1 int, r_x2 int, r_y2 int")
    out = df.select(
        G.line_similarity(G.seg(), G.seg("r_")).alias("s"),
        G.line_similarity(G.seg(), G.seg("r_"), undirected=True).alias("u"),
    ).collect()
    assert out[0]["s"] == pytest.approx(1.0)
    assert out[1]["s"] == pytest.approx(0.7)  # opposite directions score no angle similarity
    assert out[1]["u"] == pytest.approx(1.0)


def test_zero_length_segment_has_no_length_similarity(rows):
    df = rows([(5, 5, 5, 5, 0, 0, 10, 0)], "x1 int, y1 int, x2 int, y2 int, r_x1 int, r_y1 int, r_x2 int, r_y2 int")
    assert df.select(G.length_similarity(G.seg(), G.seg("r_")).alias("s")).first()["s"] == 0.0
    assert df.select(G.point_line_distance(F.lit(8), F.lit(9), G.seg()).alias("d")).first()["d"] == pytest.approx(5.0)


def test_crossing(rows):
    df = rows([(0, 0, 10, 10, 0, 10, 10, 0), (0, 0, 10, 10, 20, 0, 30, 10)],
              "x1 int, y1 int, x2 int, y2 int, r_x1 int, r_y1 int, r_x2 int, r_y2 int")
    assert [r["c"] for r in df.select(G.segments_cross(G.seg(), G.seg("r_")).alias("c")).collect()] == [True, False]


def test_affine_inverse(rows):
    df = rows([(40.0, 70.0)], "x double, y double")
    x, y = G.affine(F.col("x"), F.col("y"), (284, 137), F.lit(12.0), F.lit(1.0), F.lit(0), F.lit(0))
    moved = df.select(x.alias("x"), y.alias("y"))
    bx, by = G.affine(F.col("x"), F.col("y"), (284, 137), F.lit(-12.0), F.lit(1.0), F.lit(0), F.lit(0))
    back = moved.select(bx.alias("x"), by.alias("y")).first()
    assert back["x"] == pytest.approx(40.0) and back["y"] == pytest.approx(70.0)


def test_file_names(rows):
    names = ["FIG_Pro1_pc56_copy.png", "Park_16_RECALL.png", "teamd7_x.png", "Pro9_REFERENCE_COPY.png", "junk"]
    out = rows([(n,) for n in names], "f string").select(N.patient_id(F.col("f")).alias("p"), N.task_type(F.col("f")).alias("t")).collect()
    assert [(r["p"], r["t"]) for r in out] == [
        ("PC56", "COPY"), ("Park_16", "RECALL"), ("TEAMD7", "UNKNOWN"), ("Pro9", "REFERENCE"), ("UNKNOWN", "UNKNOWN")]


def test_rated_names(rows):
    names = ["C0078_COPY.png", "Park_16_recall.png", "COPY.png", "C1_OTHER.png", ".png"]
    out = [r["p"] for r in rows([(n,) for n in names], "f string").select(N.parse_rated_name(F.col("f")).alias("p")).collect()]
    assert out[0] == ("C0078", "COPY") and out[1] == ("Park_16", "RECALL") and out[2:] == [None, None, None]


def test_model_names(rows):
    names = ["model_Total_Score_20240101_120000", "model_MMSE_1", "model"]
    out = [tuple(r["p"]) for r in rows([(n,) for n in names], "f string").select(N.parse_model_name(F.col("f")).alias("p")).collect()]
    assert out == [("Total_Score", "20240101_120000"), ("MMSE", "MMSE_1"), ("unknown", "unknown")]


def test_label_bag_edit_keeps_other_keys(rows):
    bag = '{"Total_Score": 12, "note": "a \\"q\\"", "flag": true, "Custom_Class": {"3": {"label": 1}}}'
    df = rows([(bag,)], "b string").select(L.put_label(F.col("b"), "Custom_Class", F.lit('{"2":{"label":0}}')).alias("b"))
    import json

    out = json.loads(df.first()["b"])
    assert out == {"Total_Score": 12, "note": 'a "q"', "flag": True, "Custom_Class": {"2": {"label": 0}}}


@pytest.mark.parametrize("bag,feature,want", [
    ('{"Total_Score": "7"}', "Total_Score", 7.0), ('{"Total_Score": "n/a"}', "Total_Score", None), ("{}", "Total_Score", None),
    ('{"Custom_Class": {"4": {"label": 3}}}', "Custom_Class_4", 3.0), ('{"Custom_Class": {"4": {"label": 3}}}', "Custom_Class_2", None),
    ("broken", "Total_Score", None)])
def test_target_value(rows, bag, feature, want):
    assert rows([(bag,)], "b string").select(L.target_value(F.col("b"), feature).alias("v")).first()["v"] == want


def test_draws_do_not_depend_on_partitioning(spark):
    ids = spark.range(1000)
    draw = V.uniform("t", 7, F.col("id")).alias("u")
    a = {r["id"]: r["u"] for r in ids.repartition(1).select("id", draw).collect()}
    b = {r["id"]: r["u"] for r in ids.repartition(8).select("id", draw).collect()}
    assert a == b and all(0 <= u < 1 for u in a.values())
    assert sum(a.values()) / 1000 == pytest.approx(0.5, abs=0.05)


def test_normal_moments(spark):
    r = spark.range(20000).select(V.normal("n", 3, F.col("id")).alias("v")).agg(F.avg("v"), F.stddev("v")).first()
    assert r[0] == pytest.approx(0, abs=0.03) and r[1] == pytest.approx(1, abs=0.03)


def test_softmax_and_top_class(rows):
    p = rows([([1.0, 2.0, 2.0],)], "l array<double>").select(V.softmax(F.col("l")).alias("p")).first()["p"]
    assert sum(p) == pytest.approx(1) and p[1] == pytest.approx(math.e / (1 + 2 * math.e) * 1)
    assert rows([(p,)], "l array<double>").select(V.top_class(F.col("l")).alias("c")).first()["c"] == 1


def test_seeded_order_is_safe_for_huge_keys(rows):
    big = 2**62 + 12345
    out = rows([(big,), (-big,)], "k bigint").select(V.seeded_order(F.col("k"), 5).alias("o")).collect()
    assert [r["o"] for r in out] == [int(hashlib.md5(f"5-{k}".encode()).hexdigest()[:7], 16) for k in (big, -big)]


def test_two_seeds_give_different_splits(spark):
    cut = int(0.8 * V.ORDER_MODULUS)
    ids = spark.range(20_000)
    both = ids.select((V.seeded_order(F.col("id"), 42) < cut).alias("a"), (V.seeded_order(F.col("id"), 43) < cut).alias("b"))
    differ = both.where("a <> b").count() / 20_000
    assert abs(differ - 2 * 0.8 * 0.2) < 0.02
