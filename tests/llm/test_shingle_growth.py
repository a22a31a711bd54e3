"""Candidates of the pipeline's near-duplicate stage, and its files, grow with the input and no faster."""

import random

import numpy as np

from strokelake.llm import common, shingle_sets


def test_large_unrelated_sets_are_no_candidates(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**7)}" for _ in range(6000)]
    near = [*base[:5900], *(f"n{i}" for i in range(100))]
    others = [[f"v{rng.randrange(10**7)}" for _ in range(6000)] for _ in range(3)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([base, near, *others], 1)], "doc_id long, text string")
    rows = shingle_sets.prefixes(docs, np.zeros(0, np.uint64), np.zeros(0, np.int64)).cache()
    node = {r.doc_id: r.node for r in rows.select("doc_id", "node").collect()}
    pairs = [(node[i], node[j]) for i in node for j in node if i < j]
    kept = shingle_sets.within_bound(spark.createDataFrame(pairs, "a long, b long"), rows.select("node", "n", "buckets"))
    assert [tuple(r) for r in kept.collect()] == [(node[1], node[2])]


def test_odd_buckets_never_differ_more_than_the_sets():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 2, 63, 64, 65, 128, 129, 900, 1100, 3000, 4900)] + [pool[:0]]
    pairs = [(a, b) for a in sets for b in sets] + [(a, np.setdiff1d(a, a[:k])) for a in sets for k in (1, 5, 40)]
    found = shingle_sets.changed_buckets([shingle_sets.odd_buckets(a) for a, _ in pairs], [shingle_sets.odd_buckets(b) for _, b in pairs])
    apart = np.array([len(np.setxor1d(a, b)) for a, b in pairs])
    assert (found <= apart).all() and (found % 2 == apart % 2).all() and (found[apart == 1] == 1).all()
    assert shingle_sets.changed_buckets([], []).tolist() == []


def test_common_shingles_are_found_in_a_corpus_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(shingle_sets, "SAMPLE", 20)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(40)] + passage * (i % 20 == 0)) for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed, counts = shingle_sets.common_shingles(docs)
    assert np.isin(shingle_sets.shingle_set(" ".join(passage)), listed).all()
    assert len(listed) == len(counts) and (np.diff(listed.view(np.int64)) != 0).all() and (np.sort(listed) == listed).all()
    monkeypatch.setattr(shingle_sets, "COMMON", 10)
    assert len(shingle_sets.common_shingles(docs)[0]) <= 10


def test_shuffle_files_of_written_steps_do_not_stay(spark):
    kept = spark.conf.get(common.TIDY_SETTING)
    seen, plain = [], common.written
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z")], "doc_id long, text string")
    try:
        shingle_sets.written = lambda df, name="step": seen.append(spark.conf.get(common.TIDY_SETTING)) or plain(df, name)
        assert sorted(r.doc_id for r in shingle_sets.keep_one_similar(docs).collect()) == [1, 3]
    finally:
        shingle_sets.written = plain
    assert seen and set(seen) == {"true"}
    assert spark.conf.get(common.TIDY_SETTING) == kept
