"""Conversation repair, quality scores and hard negatives: brute force, SQL and held-out accuracy."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from check_oracle import compare, duck
from strokelake.llm import conversations, hard_negatives, quality_model
from strokelake.llm.queries import ORACLES, QUERIES

SPACES = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_grammar_repair", "op13_rtree_negatives"])
def test_equals_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES[name](spark, folder), duck(folder), ORACLES[name]) == "ok"


# ---- conversations --------------------------------------------------------------------------------------------------


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = text.rstrip(SPACES)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Row by row over states, edit lists as plain strings: (cost, audit, lines)."""
    best = {0: (0, "", ())}
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for at, (cost, audit, lines) in list(out.items()):
                to, role = (3, "assistant") if at == 2 else (2, "user")
                offer = (cost + 5, audit + "I", (*lines, f"{role}:"))
                if to not in out or offer < out[to]:
                    out[to] = offer
        return out

    for (role, text), fault in zip(rows, faults(rows)):
        new = {}

        def put(to, offer, new=new):
            if to not in new or offer < new[to]:
                new[to] = offer

        for at, (cost, audit, lines) in inserted(best).items():
            put(at, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                stays = 5 * (fault == "truncated")
                if at in step.get(role[:1], {}):
                    put(step[role[:1]][at], (cost + stays, audit + "K", (*lines, f"{role}:{text}")))
                to, name = (3, "assistant") if at == 2 else (2, "user")
                put(to, (cost + stays + 1, audit + "R", (*lines, f"{name}:{text}")))
        best = new
    return min(v for at, v in inserted(best).items() if at in (0, 3))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    lines = [(r, t) for _, r, t in rows]
    found, turns = faults(lines), [t for t, _, _ in rows if t is not None]
    cost, audit, kept = plain_repair(lines)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(lines))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[found.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def talk(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "  ", "", "Why?", "é \n", "So!\n", None, "A longer line. And more", *[f"t{i}." for i in range(12)]]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_repair_equals_brute_force(spark):
    talks = {i: talk(i, n) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 9, 14, 30, 60] * 2)}
    talks[900] = [(t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(700)]
    talks[901] = [(1, "user", "again.")] * 900 + talk(7, 200)
    talks[None] = talk(3, 8)
    data = [(c, t, r, x, 1, 2) for c, rows in talks.items() for t, r, x in rows]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, blank int, part int").repartition(5)
    whole = conversations.repair(conversations.as_given(frame), chunk=64).collect()
    got = {r.conv_id: tuple(r)[1:] for r in whole}
    assert len(whole) == len(got) == sum(1 for rows in talks.values() if rows)
    for c, rows in talks.items():
        if rows:
            assert got[c] == expected([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]), c
    lines = conversations.repaired_rows(conversations.as_given(frame), chunk=64).collect()
    for c in (9, 901, None):
        own = sorted((r for r in lines if r.conv_id == c), key=lambda r: r.place)
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == got[c][-1]


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c? d") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    got = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for (c, t, role, text), r in zip(rows, got):
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = ("user" if case == 4 else role, "" if case == 1 else "A b c d" if case == 2 and c is not None else text, {0: 0, 3: 2}.get(case, 1))
        assert (r.role, r.text, r.copies) == want


def test_repair_of_nothing(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert conversations.repair(conversations.as_given(spark.createDataFrame([], schema))).collect() == []
    rows = conversations.as_given(spark.createDataFrame([("a", 1, "user", "x.")], schema)).selectExpr("conv_id", "turn", "role", "text", "0 AS copies")
    assert tuple(conversations.repair(rows).first()) == ("a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_ropes_compare_as_text():
    ropes, rng = conversations.Ropes(), random.Random(5)
    nodes = [ropes.add(s) for s in ("K", "D", "ID", "R", "IK", "IIR")]
    for _ in range(200):
        nodes.append(ropes.add((rng.choice(nodes[-40:]), rng.choice(nodes[-40:]))))
    for _ in range(2000):
        a, b = [(rng.choice(nodes[:60]), rng.choice(nodes[:60])) for _ in range(2)]
        assert ropes.less(a, b) == (ropes.text(a[0]) + ropes.text(a[1]) < ropes.text(b[0]) + ropes.text(b[1]))


# ---- quality --------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op12_quadratic_discriminant"](spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    good = found.quality == 1
    assert len(found) > 500 and (found.predicted == found.quality).mean() > 0.98
    assert found.predicted[good].mean() > 0.99 and found.predicted[~good].mean() < 0.1


def test_quality_cases(spark):
    texts = [(1, None), (1, ""), (None, "x y z."), (2, "|" * 4000), (3, "word " * 3000), (4, "Some plain words here. And a few more.")]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in texts], "doc_id long, text string, x int, label double").repartition(3)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_model.score(docs, none).collect()
    assert len(rows) == 6 and {r.score for r in rows} == {0.0}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    many = spark.createDataFrame([(i, "Plain words stand here." if i % 2 else "### $$$ !!! ***", 0, 0.0) for i in range(1, 60)], docs.schema)
    rows = quality_model.score(docs.union(many), labels).collect()
    assert len(rows) == 65 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    sure = {r.doc_id: r.score for r in rows if r.doc_id and r.doc_id > 10}
    assert min(v for k, v in sure.items() if k % 2) > max(v for k, v in sure.items() if k % 2 == 0)
    assert quality_model.score(docs.limit(0), labels).collect() == []


def test_discriminant_is_the_gaussian_formula():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + i for i in range(2)]
    tables = [np.hstack([np.ones((300, 1)), a]).T @ np.hstack([np.ones((300, 1)), a]) for a in x]
    model = quality_model.Discriminant(tables, 0.0, 0.0)
    point = rng.normal(size=(5, 3))

    def density(a):
        cov = np.cov(a.T, bias=True) + quality_model.FLOOR * np.eye(3)
        apart = point - a.mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", apart, np.linalg.inv(cov), apart) - 0.5 * np.log(np.linalg.det(cov))

    assert np.allclose(model.difference(point), density(x[1]) - density(x[0]))


# ---- hard negatives -------------------------------------------------------------------------------------------------


def plain_negatives(rows):
    out = []
    for i, (a, q, label) in enumerate(rows):
        if a is None or a % 10:
            continue
        score = [sum(x * y for x, y in itertools.zip_longest(q, p, fillvalue=0)) for _, p, _ in rows]
        order = sorted(range(len(rows)), key=lambda j: (-score[j], rows[j][0] is None, rows[j][0] or 0))
        positives = [j for j in order if j != i and rows[j][2] == label][:5]
        for j in positives:
            found = [n for n in order if rows[n][2] != label and 30 * score[j] <= 100 * score[n] <= 90 * score[j]][:10]
            out += [(a, rows[j][0], r + 1, rows[n][0], score[j], score[n]) for r, n in enumerate(found)]
    return sorted(out, key=str)


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)], rng.randrange(4)) for i in range(300)]
    vectors += [(300 + i, [0.5] * 6, i % 2) for i in range(80)]  # copies
    vectors += [(None, [0.4] * 6, 1), (600, [], 1), (601, [0.3], 2), (602, None, 1), (603, [0.1, None], 1), (604, [float("nan")] * 6, 1), (605, [float("inf")] * 6, 1), (606, [0.1] * 6, None), (610, [0.2] * 6, 9)]
    schema = "vec_id long, embedding array<float>, label int, row int, q int, page int"
    frame = spark.createDataFrame([(*v, 1, 1, 1) for v in vectors], schema).repartition(4)
    points = hard_negatives.quantised(frame)
    rows = [(r.id, r.q, r.label) for r in points.collect()]
    assert len(rows) == len(vectors) - 5
    monkeypatch.setattr(hard_negatives, "LEAST_PAGE", 40)
    monkeypatch.setattr(hard_negatives, "GROUP", 16)
    got = hard_negatives.mine(points, hard_negatives.F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, got), key=str) == plain_negatives(rows)
    assert hard_negatives.mine(points.limit(0), hard_negatives.F.col("id") % 10 == 0).collect() == []


def test_too_large_products_are_refused(spark):
    frame = spark.createDataFrame([(0, [1e12] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        hard_negatives.mine(hard_negatives.quantised(frame), hard_negatives.F.col("id") == 0)
