"""Toxicity by weak supervision.

1. From a bounded sample of labelled rows that are not held out, words and word beginnings are counted by label
   (``LABELLED`` rows at most); the ones that speak for the label form the lexicons and patterns of the voters.
2. Every document is read once; the hits of the selected features are kept, the text is not.
3. Voters: lexicon voters (words), pattern voters (word beginnings), and two rules on the number and density of hits. The
   counts of all vote patterns over all documents, at most ``2 ** VOTERS`` rows, feed a generative label model: expectation maximisation
   estimates how each voter behaves per class, then the correlation of voters within the classes; correlated voters share
   their weight. It yields a posterior for each pattern.
4. A linear (logistic) classifier is fitted to the posteriors of a bounded sample (``FITTED`` rows) over hit counts and scores every
   document. Only rows that are not held out are used to learn; lang, source and ids are no inputs.

Defined cases: null text counts as empty; empty texts are scored like any other; repeated label rows count once, with
the largest label; null labels are ignored; without a positive label the score is 0; a null ``doc_id`` is not held out; an empty
table gives an empty result; other columns are not read (:func:`score`) or kept (:func:`drop_toxic`).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strokelake.llm.common import free_name, map_batches, texts, written

LABELLED = 12_000
FITTED = 20_000
FEATURES = 512
VOTERS = 10
GROUPS = 4
CUT = 0.3
WORD = re.compile(r"\w+")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def features_of(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings of four and five letters."""
    out = ["w" + word]
    if len(word) > 4:
        out.append("p" + word[:4])
    if len(word) > 5:
        out.append("p" + word[:5])
    return tuple(out)


def feature_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of each label by feature, over the labelled sample."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)  # two numbers a row: its size is bounded
    rows = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")

    def make():
        def step(cols):
            counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, label in zip(cols["text"], cols["toxic"]):
                for f in {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}:
                    counts[f][label] += 1
            return {"feature": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}

        return step

    parts = map_batches(rows, "feature string, clean long, toxic long", make)
    return parts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def select_features(docs: DataFrame, labels: DataFrame) -> list[tuple[str, float]]:
    """The ``FEATURES`` strongest features with their log odds; the positive ones come first."""
    counts = written(feature_counts(docs, labels), "features")
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    sums = counts.where(F.col("feature").startswith("w")).agg(F.sum("toxic"), F.sum("clean")).first()
    if not sums[0]:
        return []
    base = float(np.log((sums[0] + 0.5) / (sums[1] + 0.5)))
    strong = counts.withColumn("odds", odds - base).where(F.col("toxic") + F.col("clean") >= 4)
    first = strong.where("odds >= 2 and toxic >= 4").orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "feature").limit(FEATURES * 3 // 4)
    found = [(r[0], r[1]) for r in first.select("feature", "odds").collect()]
    rest = strong.where("odds < 2").orderBy(F.desc(F.abs("odds") * F.log1p(F.col("toxic") + F.col("clean"))), "feature")
    return found + [(r[0], r[1]) for r in rest.limit(FEATURES - len(found)).select("feature", "odds").collect()]


def hits(docs: DataFrame, features: list[str]) -> DataFrame:
    """Per document: its number of words, and place and count of every feature that occurs."""
    place = {f: i for i, f in enumerate(features)}

    def make():
        memory: dict[str, tuple[int, ...]] = {}

        def step(cols):
            if len(memory) > 150_000:
                memory.clear()
            out = defaultdict(list)
            for key, text in zip(cols["doc_id"], cols["text"]):
                words = WORD.findall(text.lower())
                found: Counter[int] = Counter()
                for word, n in Counter(words).items():
                    own = memory.get(word)
                    if own is None:
                        own = memory[word] = tuple(place[f] for f in features_of(word) if f in place)
                    for f in own:
                        found[f] += n
                out["doc_id"].append(key)
                out["n_words"].append(len(words))
                out["at"].append(list(found))
                out["n"].append(list(found.values()))
            return out

        return step

    source = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    return map_batches(source, "doc_id long, n_words long, at array<int>, n array<long>", make)


def voter_groups(features: list[tuple[str, float]]) -> np.ndarray:
    """Voter of each feature: words and beginnings that speak for the label, dealt out in turn; -1 for the others."""
    group = np.full(len(features), -1, np.int64)
    seen = {"w": 0, "p": 0}
    for i, (name, odds) in enumerate(features):
        if odds >= 2:
            kind = name[0]
            group[i] = seen[kind] % GROUPS + (GROUPS if kind == "p" else 0)
            seen[kind] += 1
    return group


def votes(at: list[np.ndarray], n: list[np.ndarray], words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Vote pattern of each document as a number of ``VOTERS`` bits."""
    out = np.zeros(len(at), np.int64)
    for i, (places, counts) in enumerate(zip(at, n)):
        own = group[places] if len(places) else np.zeros(0, np.int64)
        for_it = own >= 0
        for g in set(own[for_it].tolist()):
            out[i] |= 1 << g
        total = int(np.asarray(counts)[for_it].sum()) if len(places) else 0
        out[i] |= (int(for_it.sum()) >= 2) << (2 * GROUPS)
        out[i] |= (1000 * total > 2 * max(1, int(words[i]))) << (2 * GROUPS + 1)
    return out


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of each vote pattern. ``counts``: per pattern, rows without label, labelled 0 and labelled 1.

    Naive Bayes with a latent class, fitted by expectation maximisation; labelled rows keep their class. The correlation of
    two voters within the classes is then estimated, and each voter's weight is divided by the size of its correlated group.
    """
    v = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    free, clean, toxic = counts.astype(float).T
    weight = np.ones(VOTERS)
    labelled = clean + toxic
    q = (toxic + 0.1 * (v.sum(1) > 1) + 0.01) / (labelled + 0.2)
    q = np.clip(q, 0.01, 0.99)
    correlation = np.eye(VOTERS)
    for again in range(2):
        for _ in range(rounds):
            one, zero = free * q + toxic, free * (1 - q) + clean
            prior = (one.sum() + 1) / (one.sum() + zero.sum() + 2)
            rate1 = (one @ v + 0.5) / (one.sum() + 1)
            rate0 = (zero @ v + 0.5) / (zero.sum() + 1)
            score = np.log(prior / (1 - prior)) + (weight * (v * np.log(rate1 / rate0) + (1 - v) * np.log((1 - rate1) / (1 - rate0)))).sum(1)
            q = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        if again == 0:
            one, zero = free * q + toxic, free * (1 - q) + clean
            residual = lambda mass, rate: ((v - rate).T * mass) @ (v - rate)
            cov = residual(one, rate1) + residual(zero, rate0)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            correlation = cov / scale[:, None] / scale[None, :]
            np.fill_diagonal(correlation, 1)
            weight = 1 / np.maximum(correlation, 0).sum(1)
    return q, {"hit_if_toxic": rate1, "hit_if_clean": rate0, "correlation": correlation, "weight": weight}


def design(at, n, words, size: int) -> np.ndarray:
    """Rows of the classifier: log counts of the features, and a constant."""
    x = np.zeros((len(at), size + 1), np.float32)
    x[:, size] = 1
    for i, (places, counts) in enumerate(zip(at, n)):
        if len(places):
            x[i, places] = np.log1p(counts)
    return x


def fit_linear(x: np.ndarray, q: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    rate = np.clip(q.mean(), 1e-4, 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(ridge), x.T @ (q - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    out = ["doc_id", held_out(F.col("doc_id")).alias("held_out")]
    features = select_features(docs, labels)
    if not features:
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        return plain.select(*out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    group, size = voter_groups(features), len(features)
    found = hits(docs, [f for f, _ in features])

    def vote(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            at, n = [c.as_py() for c in cols["at"]], [c.as_py() for c in cols["n"]]
            got = votes([np.array(a, np.int64) for a in at], n, cols["n_words"].to_numpy(), group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, "votes"])

    voted = written(found.mapInArrow(vote, "doc_id long, n_words long, at array<int>, n array<long>, votes long"), "votes")
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    learning = voted.where(~held_out(F.col("doc_id")))
    marked = learning.select("doc_id", "votes").join(known, "doc_id", "left").groupBy("votes", "toxic").count().collect()  # bounded by 3 * 2 ** VOTERS
    patterns = np.array(sorted({r[0] for r in marked}), np.int64)
    counts = np.zeros((len(patterns), 3), np.int64)
    for pattern, label, n in marked:
        counts[np.searchsorted(patterns, pattern), 0 if label is None else 1 + min(1, label)] += n
    posterior, _ = label_model(patterns, counts)
    sample = learning.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FITTED).select("at", "n", "n_words", "votes").collect()
    x = design([r[0] for r in sample], [r[1] for r in sample], None, size)
    q = posterior[np.searchsorted(patterns, [r[3] for r in sample])]
    weights = fit_linear(x, q)

    def apply(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                rows = design([a.as_py() for a in part.column(1)], [a.as_py() for a in part.column(2)], None, size)
                value = 1 / (1 + np.exp(-np.clip(rows @ weights, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value)], names=["doc_id", "score"])

    scored = voted.select("doc_id", "at", "n").mapInArrow(apply, "doc_id long, score double")
    return scored.select(*out, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents not predicted toxic; all columns stay. Of repeated ids all rows go if one is toxic."""
    own = free_name(docs, "_toxic_id")
    bad = written(score(docs, labels).where("predicted = 1").select(F.col("doc_id").alias(own)).distinct(), "toxic")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col(own)), "left_anti")
