"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares.

1. Texts become pieces of at most ``capacity`` tokens (only longer documents are cut).
2. The histogram of piece lengths, at most ``capacity`` numbers, goes to the driver. Patterns are all pairs
   and triples of present lengths that fill a sequence exactly; non-negative least squares fits how often
   each pattern repeats; the counts are rounded by largest remainder and what is left over is packed best-fit, longest
   first, run by run over the residual histogram. Several shares of the fitted counts are tried; ``Plan`` says which won.
3. Every piece finds its slot from its length and its rank among the pieces of that length, so pieces of one
   length (a third of all rows, say) are interchangeable and no task ever holds them together.

The plan has a size bound that does not depend on the data: at most ``capacity**2 / 12`` patterns of three
entries and a few runs per length, so it may be sent to all tasks.

Defined cases: null text counts as empty; an empty text is one piece that holds only the end id; repeated rows are
packed as rows of their own; an empty table gives an empty result. Other columns of the input, whatever their names, are
not read by :func:`token_pieces` and are kept by :func:`pack_pieces` (names that begin with ``_pack_`` are reserved).
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from strokelake.llm.common import map_batches, texts, written
from strokelake.llm.tokens import STORE_LIMIT, encode_texts

#: Parts of the fitted counts that are tried.
SHARES = (1.0, 0.75, 0.5, 0.25)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, keep_ids: bool = False, stored_words: int = STORE_LIMIT) -> DataFrame:
    """Pieces of each document's ids; ``keep_ids`` adds the ids themselves."""

    def make():
        def step(cols):
            out = defaultdict(list)
            for key, data in zip(cols["doc_id"], encode_texts(cols["text"], tokenizer, end_id, stored=stored_words)):
                size = len(data) // 4
                for piece, start in enumerate(range(0, size, capacity)):
                    ids = data[4 * start : 4 * (start + capacity)]
                    out["doc_id"].append(key)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(len(ids) // 4)
                    out["ids_crc32"].append(zlib.crc32(ids))
                    if keep_ids:
                        out["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
            return out

        return step

    source = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    return map_batches(source, PIECES + (", ids array<int>" if keep_ids else ""), make, encodes=True)


# ---- the plan: driver-side arithmetic on at most ``capacity`` counts ----


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Pairs (third entry 0) and triples a <= b <= c of present lengths whose sum is the capacity."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    low = lengths[lengths <= capacity // 2]
    found = [np.stack([low, capacity - low, np.zeros_like(low)], 1)[present[capacity - low]]]
    for a in lengths[lengths <= capacity // 3]:
        b = lengths[(lengths >= a) & (lengths <= (capacity - a) // 2)]
        c = capacity - a - b
        ok = present[c]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(found).astype(np.int64)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that minimises |W (A x - h)| (accelerated projected gradient; A is applied by counting).

    W weighs a length by itself: a long piece that is left over costs a sequence, a short one hardly anything.
    """
    size = len(histogram)
    if not len(patterns):
        return np.zeros(0)
    used = [patterns[:, i] for i in range(3)]
    weight = np.arange(size) / size
    histogram = histogram * weight

    def forward(x):
        return sum(np.bincount(u, x, size) for u in used) * weight

    def backward(r):
        r = r * weight
        return sum(r[u] for u in used)

    v = np.ones(len(patterns))
    for _ in range(12):  # largest eigenvalue of A'A
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (norm * 1.05)
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - step * backward(forward(y) - histogram))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def rounded_counts(patterns: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole counts that use no length more often than it occurs: whole parts, then one more by falling remainder.

    With more patterns than pieces most fitted counts lie below one; the remainders then say which patterns are used.
    """
    n = np.floor(x + 1e-9).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for u in range(3):
        left -= np.bincount(patterns[:, u], n, len(histogram)).astype(np.int64)
    left[0] = 0
    for length in np.flatnonzero(left < 0):
        for p in np.flatnonzero((patterns == length).any(1) & (n > 0)):
            if left[length] >= 0:
                break
            each = int((patterns[p] == length).sum())
            back = min(int(n[p]), -(int(left[length]) // each))
            n[p] -= back
            for entry in patterns[p]:
                if entry:
                    left[entry] += back
    rest = x - n
    order = np.argsort(-rest, kind="stable")
    room = left.tolist()
    for p in order[rest[order] > 1e-6].tolist():
        a, b, c = patterns[p].tolist()
        if room[b] < 1 + (a == b) or room[a] < 1 or (c and room[c] < 1 + (b == c) + (a == c)):
            continue
        n[p] += 1
        room[a] -= 1
        room[b] -= 1
        if c:
            room[c] -= 1
    return n


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over counts: (number of sequences, [(length, copies in each)])."""
    open_by_space: dict[int, list[tuple[int, list]]] = defaultdict(list)
    done = []
    spaces = np.zeros(capacity + 2, bool)

    def put(space: int, n: int, runs: list) -> None:
        if n <= 0:
            return
        if space == 0:
            done.append((n, runs))
        else:
            open_by_space[space].append((n, runs))
            spaces[space] = True

    for length in range(capacity, 0, -1):
        need = int(histogram[length])
        while need:
            at = np.flatnonzero(spaces[length:])
            if len(at):
                space = length + int(at[0])
                n, runs = open_by_space[space].pop()
                if not open_by_space[space]:
                    spaces[space] = False
            else:
                space, n, runs = capacity, need, []
            copies = min(space // length, need)
            full = min(n, need // copies)
            put(space - copies * length, full, runs + [(length, copies)])
            need -= full * copies
            if full < n:
                if runs:
                    put(space, n - full, runs)
    for space, groups in open_by_space.items():
        done += groups
    return done


@dataclass
class Plan:
    """Slots by (length, rank); ``key`` is sorted."""

    key: np.ndarray
    low: np.ndarray
    copies: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int
    by_pattern: int  # sequences that follow a fitted pattern
    share: float  # of the fitted counts that gave the fewest sequences

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) | rank, "right") - 1
        inside = rank - self.low[at]
        return self.base[at] + inside // self.copies[at], self.offset[at] + inside % self.copies[at] * length


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Patterns by least squares, the rest best-fit."""
    h = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        h[length] = n
    inner = h.copy()
    inner[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(inner), capacity)
    fitted = fit_counts(patterns, inner.astype(float))
    best = None
    for share in SHARES:  # of the fitted counts; what is left over is packed best-fit
        n = rounded_counts(patterns, fitted * share, inner)
        left = h.copy()
        for u in range(3):
            left -= np.bincount(patterns[:, u], n, capacity + 1).astype(np.int64)
        left[0] = 0
        groups = best_fit(left, capacity)
        total = int(n.sum()) + sum(count for count, _ in groups)
        if best is None or total < best[0]:
            best = total, n, groups, share
    _, n, groups, share = best
    by_pattern = int(n.sum())
    for p in np.flatnonzero(n):
        runs: list[tuple[int, int]] = []
        for entry in patterns[p].tolist():
            if entry and runs and runs[-1][0] == entry:
                runs[-1] = (entry, runs[-1][1] + 1)
            elif entry:
                runs.append((entry, 1))
        groups.append((int(n[p]), runs))
    slots, base, rank = [], 0, defaultdict(int)
    for count, runs in groups:
        at = 0
        for length, copies in runs:
            slots.append((length, rank[length], copies, base, at))
            rank[length] += count * copies
            at += length * copies
        base += count
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan((table[:, 0] << 44) | table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4], base, by_pattern, share)


def pack_pieces(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``."""
    marked = written(
        pieces.withColumn("_pack_part", F.spark_partition_id()).withColumn("_pack_row", F.monotonically_increasing_id()), "pieces"
    )
    counts = written(marked.groupBy("_pack_part", F.col(length).alias("_pack_length")).agg(F.count("*").alias("_pack_n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("_pack_length").agg(F.sum("_pack_n")).collect()}  # at most ``capacity`` rows
    plan = pieces.sparkSession.sparkContext.broadcast(make_plan(histogram, capacity))
    before = Window.partitionBy("_pack_length").orderBy("_pack_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_pack_before", F.coalesce(F.sum("_pack_n").over(before), F.lit(0))).drop("_pack_n")
    own = Window.partitionBy("_pack_part", "_pack_length").orderBy("_pack_row")
    ranked = (
        marked.withColumn("_pack_length", F.col(length).cast("long"))
        .withColumn("_pack_rank", F.row_number().over(own).cast("long"))
        .join(starts.withColumn("_pack_length", F.col("_pack_length").cast("long")), ["_pack_part", "_pack_length"])
        .select(*[F.col(c) for c in pieces.columns], F.col("_pack_length"), (F.col("_pack_rank") - 1 + F.col("_pack_before")).alias("_pack_rank"))
    )
    schema = T.StructType(pieces.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [*pieces.columns, "sequence_id", "offset"]
    kept = len(pieces.columns)

    def run(batches):
        for batch in batches:
            ids, offset = plan.value.place(batch.column(kept).to_numpy(), batch.column(kept + 1).to_numpy())
            yield pa.RecordBatch.from_arrays(
                batch.columns[:kept] + [pa.array(ids, pa.int64()), pa.array(offset, pa.int64())],
                names=names,
            )

    return ranked.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, stored_words: int = STORE_LIMIT
) -> DataFrame:
    """Pieces of all documents with the place of each in its sequence."""
    return pack_pieces(token_pieces(docs, tokenizer, capacity, end_id, keep_ids, stored_words), capacity)
