"""Short benchmark items, clashing column names, pattern fitting and grammars without a round limit."""

import numpy as np
import pytest

from strokelake.llm import common, decontaminate, grammar, packing, site_lines, tokens, toxicity


def test_short_items_are_found_inside_long_texts(spark):
    items = spark.createDataFrame([(1, "capital of france paris"), (2, "Yes!"), (3, "not there"), (4, "of france"), (5, ""), (6, None)], "item_id long, text string")
    long = "some words before " * 40 + "the Capital of France, Paris and some more words after it " * 2
    docs = spark.createDataFrame([(1, long), (2, "capital of france"), (3, "yes"), (4, ""), (5, None), (6, "not  there\nyes")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word, r.n_words, r.similarity) for r in decontaminate.mark_leaks(docs, items).collect())
    assert got == [(1, 1, 121, 4, 1.0), (1, 4, 122, 2, 1.0), (2, 4, 1, 2, 1.0), (3, 2, 0, 1, 1.0), (6, 2, 2, 1, 1.0), (6, 3, 0, 2, 1.0)]


def test_clashing_names(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three four five six", "s", 7, 8, 9), (2, "clean words only", "s", 7, 8, 9)], "doc_id long, text string, source string, _leak_id int, _toxic_id int, N_LINES int")
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()] == [2]
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, labels).count() == 2
    out = site_lines.remove_spread_lines(docs)
    assert out.columns == ["doc_id", "text", "source", "_leak_id", "_toxic_id", "n_lines", "n_removed"] and out.count() == 2
    assert common.free_name(docs, "n_lines") == "n_lines_"


def test_toxicity_of_repeated_ids(spark):
    rows = [(i, f"plain words number {i} here") for i in range(40)] + [(100 + i, f"you vile zorb {i}") for i in range(40)] + [(7, "you vile zorb too"), (None, "you vile zorb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(40)], "doc_id long, toxic int")
    left = sorted((r.doc_id is None, r.doc_id) for r in toxicity.drop_toxic(docs, labels).collect())
    assert all(not none and key < 100 and key != 7 for none, key in left) and len(left) == 39


def test_plan_says_what_won():
    lengths = np.random.default_rng(3).integers(1, 129, 500)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.make_plan(dict(zip(values.tolist(), counts.tolist())), 128)
    assert plan.share in packing.SHARES and 0 < plan.by_pattern <= plan.sequences
    assert plan.sequences <= -(-int(lengths.sum()) // 128) * 1.03


def test_few_pieces_use_patterns():
    patterns = packing.exact_patterns(np.arange(1, 60), 64)
    h = np.zeros(65)
    h[[10, 20, 30, 34, 44, 54]] = 1
    x = packing.fit_counts(patterns, h)
    n = packing.rounded_counts(patterns, x, h)
    used = sum(np.bincount(patterns[:, u], n, 65) for u in range(3))[1:]
    assert (used <= h[1:]).all() and n.sum() == 3


@pytest.mark.parametrize("most", [3, 15_000])
def test_grammar_ends_without_a_frequent_pair(most):
    rng = np.random.default_rng(1)
    words = [rng.integers(1, 50, rng.integers(2, 9)).astype("<u4") for _ in range(40)]
    docs = [np.concatenate([words[i] for i in rng.zipf(1.5, 60) % 40]).tobytes() for _ in range(30)]
    shard = grammar.Shard(grammar.encode_shard(docs, least=4, most_rules=most))
    assert shard.documents() == docs and len(shard.rules) <= most
    if most > 3:
        inside = np.ones(len(shard.symbols) - 1, bool)
        inside[shard.starts[1:-1] - 1] = False
        pairs, n = np.unique((shard.symbols[:-1].astype(np.int64) << 32 | shard.symbols[1:])[inside], return_counts=True)
        twins = (pairs >> 32) == (pairs & 0xFFFFFFFF)  # runs of one symbol count overlapping places
        assert n[~twins].max() < 4 and shard.lengths.max() > 4


def test_released_encoders_come_back(spark):
    path = tokens.default_path("byte_bpe_50k.json")
    tokens.encode_texts(["a b"], path, 0)
    assert tokens._ENCODERS
    tokens.release_encoders()
    assert not tokens._ENCODERS and tokens.encode_texts(["a b"], path, None) == [tokens.encoder(path).encode(["a b"])[0]]
