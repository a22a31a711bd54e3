"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each whole text becomes ``len(STATISTICS)`` numbers (logarithms and log odds of counts). Per class, one Spark pass sums the
first and second moments of every labelled training row; the class covariances shrink towards the pooled one and towards its
diagonal. The score is the logistic function of the difference of the two log densities (Mahalanobis distances through
Cholesky factors that are computed once) plus the log of the class shares. The two shrinkage weights and the slope of the
logistic function are chosen by log loss on one fifth of the training rows, then the moments of all training rows are used.
What the driver holds is fixed: 2 x 2 moment tables and one sum per setting.

Defined cases: null and empty texts have the statistics of a text without words; a null ``doc_id`` belongs to no fold of the
training rows, is not held out and gets a score; repeated rows are scored each; of several labels of one id the
largest counts; labels other than 0 and 1 and null labels are left out; without both classes among the training
rows every score is the share of label 1 (0 without labels). Other columns are not read.
"""

from __future__ import annotations

from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strokelake.llm.common import slices, texts, written

#: Byte classes: letters, capitals, digits, symbols, ends of sentences, calls, other marks, white space, bytes beyond ASCII.
CLASSES = ["lower", "upper", "digit", "symbol", "stop", "call", "mark", "space", "wide"]
STATISTICS = [
    "words", "word_bytes", "capitals", "symbols", "calls", "stops", "marks", "digits", "wide", "same_neighbours", "distinct", "lines", "same_lines", "line_symbols",
]
CUT = 0.3
#: Shrinkage of a class covariance towards the pooled one, of the result towards its diagonal, and slopes.
POOLED = (0.0, 0.05, 0.2, 0.5, 1.0)
DIAGONAL = (0.01, 0.1, 0.4)
SLOPES = (0.1, 0.25, 0.5, 1.0)
FLOOR = 1e-3  # least variance of a statistic


def byte_classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("mark"), np.intp)
    table[128:] = CLASSES.index("wide")
    for name, chars in (
        ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"),
        ("symbol", b"#*$%&|<>"), ("stop", b".,;:"), ("call", b"!?"), ("space", b" \t\n\v\f\r"),
    ):
        table[np.frombuffer(chars, np.uint8)] = CLASSES.index(name)
    return table


BYTE_CLASS = byte_classes()
WINDOW = 1 << 20


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(len(CLASSES), np.int64)
    for at in range(0, len(raw), WINDOW):
        counts += np.bincount(BYTE_CLASS[raw[at : at + WINDOW]], minlength=len(CLASSES))
    lower, upper, digit, symbol, stop, call, mark, space, wide = counts.tolist()
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    odd = sum(1 for x in lines if "|" in x or "*" in x or "#" in x or "!!" in x)
    ink = len(raw) - space

    def odds(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))

    def rate(part: float) -> float:
        return float(np.log((part + 0.1) / (n + 1.0)))

    return [
        float(np.log1p(n)), float(np.log1p(ink / max(n, 1))), odds(upper, upper + lower), rate(symbol), rate(call), rate(stop), rate(mark), rate(digit), odds(wide, ink),
        rate(sum(map(eq, words, islice(words, 1, None)))), float(np.log((len(set(words)) + 1.0) / (n + 1.0))), rate(len(lines)),
        odds(len(lines) - len(set(lines)), len(lines)), odds(odd, len(lines)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [statistics(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    source = texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    return source.mapInArrow(run, "doc_id long, x array<double>")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def moments(marked: DataFrame, d: int) -> dict[tuple[int, int], np.ndarray]:
    """Per (fold is the tuning fold, label): sums of 1, x and x xᵀ over all rows, as a (d + 1) x (d + 1) table."""
    size = d + 1

    def run(batches):
        sums = np.zeros((4, size, size))
        for batch in batches:
            x = np.hstack([np.ones((batch.num_rows, 1)), matrix(batch)])
            key = batch.column(1).to_numpy() * 2 + batch.column(2).to_numpy()
            for k in range(4):
                own = x[key == k]
                sums[k] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "value"])

    summed = marked.select("x", "tuning", "label").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(4 * size * size)
    for at, value in summed:
        out[at] = value
    return {(k // 2, k % 2): out.reshape(4, size, size)[k] for k in range(4)}


class Discriminant:
    """Two Gaussian classes with shrunken covariances, their Cholesky factors and log determinants."""

    def __init__(self, tables: list[np.ndarray], pooled: float, diagonal: float):
        counts = np.array([t[0, 0] for t in tables])
        self.means = [t[0, 1:] / t[0, 0] for t in tables]
        scatter = [t[1:, 1:] - t[0, 0] * np.outer(m, m) for t, m in zip(tables, self.means)]
        common = sum(scatter) / counts.sum()
        self.offset = float(np.log(counts[1] / counts[0]))
        self.factors, self.logs = [], []
        for own, n in zip(scatter, counts):
            cov = ((1 - pooled) * own + pooled * n * common) / n
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
            lower = np.linalg.cholesky(cov)
            self.factors.append(np.linalg.inv(lower))
            self.logs.append(float(2 * np.log(np.diag(lower)).sum()))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 minus that of class 0."""
        value = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * log for m, f, log in zip(self.means, self.factors, self.logs)]
        return value[1] - value[0]

    def score(self, difference: np.ndarray, slope: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(slope * difference + self.offset, -30, 30)))


def choose(marked: DataFrame, tables: dict[tuple[int, int], np.ndarray]) -> tuple[float, float, float]:
    """The setting with the least log loss on the tuning rows, fitted on the others; the first of equals."""
    first = [tables[0, label] for label in (0, 1)]
    second = [tables[1, label] for label in (0, 1)]
    if min(t[0, 0] for t in first + second) < 2:
        return POOLED[2], DIAGONAL[1], SLOPES[1]
    models = [(p, g, Discriminant(first, p, g)) for p in POOLED for g in DIAGONAL]

    def run(batches):
        loss = np.zeros((len(models), len(SLOPES)))
        for batch in batches:
            x, y = matrix(batch), batch.column(1).to_numpy()
            for i, (_, _, model) in enumerate(models):
                apart = model.difference(x)
                for j, slope in enumerate(SLOPES):
                    p = model.score(apart, slope)
                    loss[i, j] -= np.log(np.where(y == 1, p, 1 - p)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(loss.size)), pa.array(loss.ravel())], names=["at", "value"])

    got = marked.where("tuning = 1").select("x", "label").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    best = min(got, key=lambda r: (round(r.value, 6), r.at)).at
    return *models[best // len(SLOPES)][:2], SLOPES[best % len(SLOPES)]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    found = written(document_statistics(docs), "statistics")
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
    )
    marked = found.join(known, "doc_id").select("x", (fold(F.col("doc_id")) == 1).cast("int").alias("tuning"), "label")
    marked = written(marked, "labelled")
    tables = moments(marked, len(STATISTICS))
    total = [tables[0, label] + tables[1, label] for label in (0, 1)]
    n = [float(t[0, 0]) for t in total]
    if min(n) < 2:
        constant = n[1] / sum(n) if sum(n) else 0.0
        scored = found.select("doc_id", F.lit(constant).alias("score"))
    else:
        pooled, diagonal, slope = choose(marked, tables)
        model = Discriminant(total, pooled, diagonal)

        def run(batches):
            for batch in batches:
                value = model.score(model.difference(matrix(batch)), slope)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=["doc_id", "score"])

        scored = found.mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", out, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
