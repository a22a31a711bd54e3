"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints, so fingerprints within ``radius`` bits are within ``radius`` of each
other in the embedding. The range join lays a grid over it: the segments form ``g`` groups of axes; a distance of ``radius``
spread over ``g`` groups leaves at least ``g - radius`` groups without any difference, so each choice of ``g - radius`` groups gives one
grid, its cell being the counts of these groups. Candidates of a cell, whatever its size, pass the Manhattan bound on all segments, then the
exact Hamming distance. No link is lost; ``g`` only changes the cost: it is six for radius 4 and grows with the number of
different fingerprints beyond some millions (``grid_groups``), so that the candidates of one fingerprint stay few.

Equal fingerprints are one node. A cell with more than ``CELL`` nodes is cut into blocks; each pair of blocks
is a group of its own, so no task holds a large cell, and a group returns a spanning forest of its links, never all pairs.

Defined cases: null text and texts without words have fingerprint zero and are linked like any other; a null ``doc_id`` counts
after all others (``component_id`` is null only if a component has no id at all); repeated rows share a component; an empty
table gives an empty result; other columns are not read (:func:`near_duplicates`) or kept (:func:`keep_one`).
"""

from __future__ import annotations

from itertools import chain, combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strokelake.llm.common import map_batches, texts, written
from strokelake.llm.graph import components

SHINGLE = 4
SEED = 42
SEGMENTS = 32
CELL = 4096
PAIRWISE = 24
#: Longs that are broadcast at most: 8 MB.
BROADCAST_IDS = 1 << 20
#: Chance that two independent two-bit segments have the same count: (1/4)^2 + (1/2)^2 + (1/4)^2.
SAME_COUNT = 3 / 8


def fingerprint(text: str) -> int:
    """SimHash of the 4-word shingles, repeats included; zero without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    starts = (end - size)[: len(words) - SHINGLE + 1].tolist()
    ends = end[SHINGLE - 1 :].tolist()
    view = memoryview(joined)
    pieces = map(view.__getitem__, map(slice, starts, ends))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts))
    return int(majority(hashes))


def majority(hashes: np.ndarray) -> np.uint64:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 128):  # a long text is counted in blocks
        part = hashes[at : at + 255 * 128].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[whole:].sum(0, dtype=np.int64)
        if whole:  # sums of 255 rows fit a byte
            counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long)."""

    def make():
        def step(cols):
            prints = np.array([fingerprint(t) for t in cols["text"]], np.uint64)
            return {"doc_id": cols["doc_id"], "print": prints.view(np.int64)}

        return step

    return map_batches(texts(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id long, print long", make)


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """The embedding: bit counts of the 32 segments, a row per fingerprint."""
    pairs = (prints[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)[None, :]) & np.uint64(3)
    return np.bitwise_count(pairs)


def grid_groups(n: int, radius: int) -> int:
    """Number of axis groups with the least work: rows of all grids plus expected candidates."""

    def cost(g: int) -> float:
        grids = comb(g, radius)
        same = SAME_COUNT ** (SEGMENTS * (g - radius) / g)
        return grids * (n + n * n / 2 * same / 50)

    return min(range(min(SEGMENTS, radius + 2), min(SEGMENTS, radius + 8) + 1), key=cost)


def cell_rows(prints: np.ndarray, groups: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid number and cell of every fingerprint in every grid: arrays of shape (grids, fingerprints)."""
    counts = segment_counts(prints).astype(np.uint64)
    edges = np.linspace(0, SEGMENTS, groups + 1).round().astype(int)
    parts = []
    for a, b in zip(edges, edges[1:]):
        weight = np.uint64(3) ** np.arange(b - a, dtype=np.uint64)
        parts.append((counts[:, a:b] * weight).sum(1, dtype=np.uint64))
    cells = []
    for chosen in combinations(range(groups), groups - radius):
        cell = np.zeros(len(prints), np.uint64)
        for c in chosen:
            width = int(edges[c + 1] - edges[c])
            cell = cell * np.uint64(3) ** np.uint64(width) + parts[c]
        cells.append(cell)
    grid = np.repeat(np.arange(len(cells), dtype=np.int32)[:, None], len(prints), axis=1)
    return grid, np.array(cells).view(np.int64)


def unary(prints: np.ndarray) -> np.ndarray:
    """The embedding in one word: each segment's count as 00, 01 or 11, so that unequal bits of two words are their Manhattan distance."""
    low = np.uint64(0x5555555555555555)
    first, second = prints & low, (prints >> np.uint64(1)) & low
    return (first | second) | ((first & second) << np.uint64(1))


def within(a: np.ndarray, b: np.ndarray, coded_a: np.ndarray, coded_b: np.ndarray, radius: int) -> np.ndarray:
    """Manhattan bound on the counts of the 32 segments, then the exact distance. One side may be a single fingerprint."""
    near = np.bitwise_count(coded_a ^ coded_b) <= radius
    near[near] = np.bitwise_count((a ^ b)[near]) <= radius
    return near


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in one group: each fingerprint is reached once."""
    open_ = np.arange(len(prints))
    coded = unary(prints)
    left, right = [], []
    while len(open_):
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            i = queue.pop()
            near = within(prints[open_], prints[i], coded[open_], coded[i], radius)
            if near.any():
                found = open_[near]
                left.append(np.full(len(found), i))
                right.append(found)
                queue += found.tolist()
                open_ = open_[~near]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def group_links(starts: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many groups that lie one after another; ``starts`` has each group's first place and the end."""
    size = np.diff(starts)
    a, b = [], []
    small = np.repeat((size > 1) & (size <= PAIRWISE), size)
    place = np.arange(len(prints))
    ends = np.repeat(starts[1:], size)
    coded = unary(prints)
    for d in range(1, PAIRWISE):
        i = place[small & (place + d < ends)]
        if not len(i):
            break
        i = i[within(prints[i], prints[i + d], coded[i], coded[i + d], radius)]
        a.append(prints[i])
        b.append(prints[i + d])
    for g in np.flatnonzero(size > PAIRWISE):
        own = prints[starts[g] : starts[g + 1]]
        i, j = forest(own, radius)
        a.append(own[i])
        b.append(own[j])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(nodes: DataFrame, radius: int, groups: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within the radius, enough to connect all that are linked."""

    def spread(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(prints), 2000):
                part = prints[at : at + 2000]
                grid, cell = cell_rows(part, groups, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grid.ravel()), pa.array(cell.ravel()), pa.array(np.tile(part.view(np.int64), len(grid)))],
                    names=["grid", "cell", "print"],
                )

    rows = written(nodes.select("print").mapInArrow(spread, "grid int, cell long, print long"), "cells")
    large = rows.groupBy("grid", "cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    blocks = F.coalesce(F.ceil(F.col("n") / CELL), F.lit(1)).cast("int")
    shared = rows.join(large, ["grid", "cell"], "left").withColumn("blocks", blocks)
    shared = shared.withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks").cast("long")).cast("int"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = shared.select("grid", "cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "print")
    keys = ["grid", "cell", "p", "q"]
    dealt = shared.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches):
        held_keys: list[np.ndarray] | None = None
        held_prints = np.zeros(0, np.uint64)
        for batch in chain(batches, [None]):
            if batch is not None:
                own_keys = [batch.column(i).to_numpy() for i in range(4)]
                own_prints = batch.column(4).to_numpy().view(np.uint64)
                if held_keys is not None:
                    own_keys = [np.concatenate(x) for x in zip(held_keys, own_keys)]
                    own_prints = np.concatenate([held_prints, own_prints])
            else:
                if held_keys is None:
                    return
                own_keys, own_prints = held_keys, held_prints
            n = len(own_prints)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in own_keys])
            starts = np.flatnonzero(new)
            cut = n if batch is None else int(starts[-1])  # the last group may go on in the next batch
            held_keys, held_prints = [k[cut:] for k in own_keys], own_prints[cut:]
            starts = np.append(starts[starts < cut], cut)
            if cut:
                a, b = group_links(starts, own_prints[:cut], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, groups: int | None = None) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    prints = written(fingerprints(docs), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    groups = groups or grid_groups(nodes.count(), radius)
    roots = written(components(links(nodes, radius, groups)), "roots")
    named = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = written(named, "named")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(ids, "root").select("print", "component_id")
    return prints.join(classes, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The document of the smallest id of each component, once; see :func:`keep_first`."""
    return keep_first(docs, near_duplicates(docs, radius))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The document of the smallest id of each component of ``found`` (doc_id, component_id), once; all columns stay.
    Rows without an id cannot be told apart and stay if their component has no other row.

    Only ids are grouped. The ids to drop are broadcast up to ``BROADCAST_IDS`` of them, so that the texts stay where they
    are; beyond that the join shuffles the documents. Texts are compared for ids that occur more than once alone.
    """
    first = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    marked = written(found.groupBy(F.col("doc_id").alias("_dup_id")).agg(first.alias("_first"), F.count("*").alias("_rows")), "marked")

    def joined(rows: DataFrame, how: str) -> DataFrame:
        ids = rows.select("_dup_id")
        small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return docs.join(small, docs["doc_id"].cast("long").eqNullSafe(small["_dup_id"]), how)

    repeated = marked.where("_first AND _rows > 1")
    if repeated.isEmpty():
        return joined(marked.where("NOT _first"), "left_anti")
    single = joined(marked.where("NOT _first OR _rows > 1"), "left_anti")
    return single.unionByName(joined(repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
