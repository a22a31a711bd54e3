import random

import pytest

import corpus_pipeline
from strokelake.llm import near_dups, shingle_sets


def shingles(text):
    words = (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """Ids that stay: single links between sets of Jaccard similarity 0.8 or more, the smallest id of each component."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * both:
                label = [label[j] if x == label[i] else x for x in label]
    return sorted(min(k for (k, _), x in zip(rows, label) if x == c) for c in set(label))


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    passage = prose(60)
    texts = [None, "", " \n", "one", "ONE".lower(), "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = prose(rng.randrange(6, 260))
        texts.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(3))
            texts.append(" ".join(copy + prose(rng.randrange(12))))
    chained = prose(120)
    for k in range(12):  # each next to the one before, the ends far apart
        texts.append(" ".join(chained[5 * k :] + prose(5 * k)))
    texts += [" ".join(prose(rng.randrange(1, 40)) + passage) for _ in range(30)]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("sample", [4096, 20])
def test_stage_keeps_what_brute_force_keeps(spark, monkeypatch, sample):
    monkeypatch.setattr(shingle_sets, "SAMPLE", sample)
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.repartition(3), "").collect())
    want = brute_force(rows)
    assert kept == want and len(want) < len(rows) - 40
    by_radius = sorted(r.doc_id for r in near_dups.keep_one(docs).collect())
    assert by_radius != want  # four bits do not bring these copies together


def test_repeated_rows_and_missing_ids(spark):
    a, b, c = "one two three four five six seven eight", "quite another text with words of its own here", "lonely words stand here by themselves now"
    docs = spark.createDataFrame([(1, a, "x"), (1, a, "x"), (2, a, "y"), (3, b, "z"), (None, c, "n")], "doc_id int, text string, _dup_id string")
    got = sorted((r["doc_id"] or 0, r["text"], r["_dup_id"]) for r in shingle_sets.keep_one_similar(docs).collect())
    assert got == [(0, c, "n"), (1, a, "x"), (3, b, "z")]
    assert shingle_sets.keep_one_similar(docs.where("false")).count() == 0


def test_fingerprints_give_the_first_candidates(spark, monkeypatch):
    """The range join over fingerprints takes part; without a common shingle in the sets' prefixes it is the only way."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    seen = []
    found = shingle_sets.near_by_print
    monkeypatch.setattr(shingle_sets, "near_by_print", lambda nodes: seen.append(found(nodes)) or seen[-1])
    monkeypatch.setattr(shingle_sets, "prefix", lambda shingles, *_: shingles[:0])
    assert sorted(r.doc_id for r in shingle_sets.keep_one_similar(docs).collect()) == [1, 3]
    assert seen[0].count() == 1
