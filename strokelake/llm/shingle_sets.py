"""Near-duplicates of the corpus pipeline: five-word shingle sets with a Jaccard similarity of 0.8 or more.

The set of a text holds the 64-bit hashes of its five-word shingles (ASCII case folded; a shorter text is one shingle). Equal
sets are one node. Each set has a SimHash fingerprint; sets whose fingerprints lie within ``RADIUS`` bits, found by the range join over
the segment-popcount embedding (:mod:`strokelake.llm.near_dups`), are the first candidates. A fingerprint radius cannot promise a
similarity, so further candidates come from prefix filtering, which misses none: under one order of all shingles, two sets of similarity 0.8 share a shingle among the first ``n - ceil(0.8 n) + 1``
of each. Rare shingles come first; which ones are common is read off a sample that is a fixed share of a large corpus, so that texts under one
shingle do not become more with the corpus. Any order gives the same result.

Sets are compared in two rounds. The first takes those near by fingerprint and, under each shingle, neighbours by size, a number of pairs linear in the
rows; the second takes all pairs whose sizes and positions allow 0.8 and that the first left in different components. So a
large group of near copies is not paired with itself and no link between components is lost. Candidates pass a bound first: shingles are
dealt to as many buckets as the set has shingles or more, and no more buckets change between odd and even than shingles differ. Every remaining
one is decided by the exact overlap.

Defined cases: texts without words (null included) have the empty set and are one node; a null ``doc_id`` counts after all others.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strokelake.llm.common import map_batches, release_memory, texts, tidy_shuffles, written
from strokelake.llm.graph import components
from strokelake.llm.near_dups import BROADCAST_IDS, grid_groups, keep_first, links as near_prints, majority

SHINGLE = 5
SEED = 42
#: To put common shingles last, those of one text in ``SHARE`` are counted, of more in a corpus of less than ``SAMPLE`` times as many texts.
SAMPLE = 4096
SHARE = 16
#: The most shingles that are listed as common: 5 MB.
COMMON = 1 << 19
LEAST_BUCKETS = 64
#: Bits in which the fingerprints of the first candidates differ at most.
RADIUS = 4


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles; empty without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    starts = (end - size)[: len(words) - SHINGLE + 1].tolist()
    pieces = map(memoryview(joined).__getitem__, map(slice, starts, end[SHINGLE - 1 :].tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts)))


def node_of(shingles: np.ndarray) -> int:
    """Name of a set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def odd_buckets(shingles: np.ndarray) -> bytes:
    """A bit for each bucket that holds an odd number of the shingles. The buckets, a power of two, are no fewer than the shingles."""
    buckets = max(LEAST_BUCKETS, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount(shingles & np.uint64(buckets - 1), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> bytes:
    """The bits of fewer buckets, in ``size`` bytes: each has the shingles of two buckets, and again."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = (int.from_bytes(sketch[:half]) ^ int.from_bytes(sketch[half:])).to_bytes(half)
    return sketch


def changed_buckets(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Buckets that are odd in one of two sets alone, for each pair; their number never exceeds that of the shingles in one set alone."""
    sizes = np.fromiter(map(min, map(len, left), map(len, right)), np.int64, len(left))
    out = np.zeros(len(left), np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        a, b = (np.frombuffer(b"".join(folded(side[i], size) for i in at), "<u8").reshape(len(at), -1) for side in (left, right))
        out[at] = np.bitwise_count(a ^ b).sum(1)
    return out


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which a set with similarity 0.8 shares one."""
    n = len(shingles)
    if not n:
        return shingles
    weight = np.zeros(n, np.int64)
    if len(common):
        place = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        weight = np.where(common[place] == shingles, counts[place], 0)
    return shingles[np.argsort(weight, kind="stable")[: n - -(-4 * n // 5) + 1]]


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least two counted texts, sorted, and the numbers of these texts. If they are too many, only the most common."""
    every = min(SHARE, max(1, docs.count() // SAMPLE))
    sample = texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def make():
        def step(cols):
            found, n = np.unique(np.concatenate([shingle_set(t) for t in cols["text"]]), return_counts=True)
            return {"h": found.view(np.int64), "n": n}

        return step

    counted = map_batches(sample, "h long, n int", make).groupBy("h").agg(F.sum("n").cast("int").alias("n")).where("n >= 2")
    counted = written(counted, "common")
    least, listed = 2, 0
    for n, rows in counted.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.desc("n")).collect():
        if listed and listed + rows > COMMON:
            least = n + 1
            break
        listed += rows
    got = counted.where(F.col("n") >= least).limit(COMMON).toArrow()
    common, counts = got["h"].to_numpy().view(np.uint64), np.minimum(got["n"].to_numpy(), 65535).astype(np.uint16)
    order = np.argsort(common)
    return common[order], counts[order]


def prefixes(docs: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, node, fingerprint, size of the set, its odd buckets and its prefix."""

    def make():
        def step(cols):
            sets = [shingle_set(t) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"], "node": [node_of(s) for s in sets], "n": [len(s) for s in sets],
                "print": np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64),
                "buckets": [odd_buckets(s) for s in sets], "prefix": [prefix(s, common, counts).view(np.int64) for s in sets],
            }

        return step

    return map_batches(texts(docs), "doc_id long, node long, print long, n int, buckets binary, prefix array<long>", make)


def near_by_print(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of nodes (node, print) that connect all whose fingerprints lie within the radius."""
    prints = written(nodes.groupBy("print").agg(F.min("node").alias("least")), "prints")
    equal = nodes.join(prints, "print").select(F.col("least").alias("a"), F.col("node").alias("b")).where("a <> b")
    found = near_prints(prints, radius, grid_groups(prints.count(), radius))
    left, right = (prints.select(F.col("print").alias(side), F.col("least").alias(f"_{side}")) for side in "ab")
    return equal.union(found.join(left, "a").join(right, "b").select("_a", "_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def whole_groups(batches):
    """Columns of sorted batches as arrays, cut so that no group of the first column is parted."""
    held: list[np.ndarray] | None = None
    for batch in chain(batches, [None]):
        cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)] if batch is not None else held
        if batch is None:
            release_memory()
        if cols is None:
            return
        if batch is not None and held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        n = len(cols[0])
        if not n:
            continue
        starts = np.r_[0, np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1]
        cut = n if batch is None else int(starts[-1])  # the last group may go on in the next batch
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols], np.append(starts[starts < cut], cut)


def may_reach(n, pos, i, j) -> np.ndarray:
    """Sizes allow 0.8, and so do the shingles from the shared one on, as it holds for the first one that two sets share."""
    need = -(-4 * (n[i] + n[j]) // 9)
    return (4 * n[j] <= 5 * n[i]) & (1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= need)


def met(rows: DataFrame) -> DataFrame:
    """The rows whose shingle has others, with the neighbour before by size (null where 0.8 is out of reach)."""

    def step(batches):
        for (token, n, pos, node), starts in whole_groups(batches):
            size = np.repeat(np.diff(starts), np.diff(starts))
            i = np.flatnonzero(size > 1)
            before = np.maximum(i - 1, 0)
            near = (token[before] == token[i]) & (before < i)
            near &= may_reach(n.astype(np.int64), pos.astype(np.int64), before, i)
            cols = [pa.array(c[i]) for c in (token, n, pos, node)] + [pa.array(node[before], mask=~near)]
            yield pa.RecordBatch.from_arrays(cols, names=["token", "n", "pos", "node", "other"])

    dealt = rows.repartition("token").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(step, "token long, n int, pos int, node long, other long")


def across(rows: DataFrame) -> DataFrame:
    """Pairs of a shingle's rows (token, n, pos, node, label) with different labels that may reach 0.8."""

    def step(batches):
        for (_, n, pos, node, label), starts in whole_groups(batches):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            mixed = np.minimum.reduceat(label, starts[:-1]) != np.maximum.reduceat(label, starts[:-1])
            ends = np.repeat(starts[1:], np.diff(starts))
            i = np.flatnonzero(np.repeat(mixed, np.diff(starts)))
            d = 0
            while len(i):
                d += 1
                i = i[i + d < ends[i]]
                i = i[4 * n[i + d] <= 5 * n[i]]  # sizes rise within a group
                k = i[label[i] != label[i + d]]
                k = k[may_reach(n, pos, k, k + d)]
                if len(k):
                    pair = np.unique(np.stack([np.minimum(node[k], node[k + d]), np.maximum(node[k], node[k + d])]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    dealt = rows.repartition("token").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(step, "a long, b long").distinct()


def within_bound(pairs: DataFrame, counted: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and odd buckets allow 0.8: the sets then differ in at most a ninth of both sizes."""

    def step(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            keep = pa.array(9 * changed_buckets(batch.column(4).to_pylist(), batch.column(5).to_pylist()) <= na + nb)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])
        release_memory()

    left = counted.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("buckets").alias("_s"))
    right = counted.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("buckets").alias("_t"))
    both = pairs.join(left, "a").join(right, "b").where("9 * abs(na - nb) <= na + nb").select("a", "b", "na", "nb", "_s", "_t")
    return both.mapInArrow(step, "a long, b long")


def verified(docs: DataFrame, firsts: DataFrame, counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have similarity 0.8 or more, by the exact overlap."""
    pairs = written(within_bound(pairs, counted), "pairs")
    nodes = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")
    if nodes.isEmpty():
        return pairs
    ids = written(firsts.join(nodes, "node", "left_semi").select(F.col("first").alias("_id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = texts(docs)
    rows = rows.join(ids, rows["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select("text")

    def make():
        def step(cols):
            sets = [shingle_set(t) for t in cols["text"]]
            return {"node": [node_of(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]}

        return step

    # an id may have other texts too, and a text may come several times: its links then come again
    sets = written(map_batches(rows, "node long, shingles array<long>", make), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_t"))
    shared = F.size(F.array_intersect("_s", "_t"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(9 * shared >= 4 * (F.size("_s") + F.size("_t"))).select("a", "b")


def similar(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (its smallest doc_id) of every row."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = written(prefixes(docs, *common_shingles(docs)).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    firsts = written(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.count("*").alias("rows")), "nodes")
    again = rows.join(firsts.where("rows > 1").select("node", F.col("row").alias("_row")), "node").where("row <> _row").select("row")
    again = written(again, "again")
    again = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    single = rows.join(again, "row", "left_anti")
    prints = single.select("node", "print")
    counted = single.select("node", "n", "buckets")
    single = single.select("n", "node", F.posexplode("prefix").alias("pos", "token"))
    shared = written(met(single.select("token", "n", "pos", "node")), "met")

    near = shared.where("other IS NOT NULL").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    near = near.union(near_by_print(prints)).distinct()
    links = written(verified(docs, firsts, counted, near), "links")
    labels = written(components(links), "labels")
    labelled = shared.drop("other").join(labels, "node", "left").select("token", "n", "pos", "node", F.coalesce("root", "node").alias("label"))
    links = links.union(written(verified(docs, firsts, counted, across(labelled)), "links"))

    roots = written(components(links), "roots").withColumnRenamed("root", "_root")
    named = written(firsts.join(roots, "node", "left").select("node", "first", F.coalesce("_root", "node").alias("root")), "named")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "node").join(named.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """The document of the smallest id of each component, once; see :func:`strokelake.llm.near_dups.keep_first`."""
    with tidy_shuffles(docs.sparkSession):
        found = similar(docs)
    return keep_first(docs, found)
