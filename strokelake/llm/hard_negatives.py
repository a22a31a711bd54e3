"""Hard negatives by a packed R-tree: different-label vectors whose inner product lies in a window below a positive's.

Sort-tile-recursive packing: vectors are ordered by label, by slabs of the coordinate with most variance, by slabs of the next
one inside each slab, and by a third; a range partitioning on these keys (and the row number, so that repeated vectors spread)
cuts the order into pages, each page into leaves by two more coordinates. Root (page boxes), pages and leaves carry minimum
bounding boxes, which give an interval of the inner product with a query coordinate by coordinate.

A search sends blocks of queries to pages. First each query visits its two most promising pages, which gives a bound on the
k-th score of each window; then it visits every other page whose box is not outside all windows and not strictly below the
bound. Inside a page leaves are taken from a best-first queue under the same rule. Nothing is approximated: pages left
out cannot hold a result. Driver and broadcast data: the page boxes, at most about ``PAGES`` plus one per partition.

Scores are exact integers: float64 products where they stay below 2^53, int64 below 2^62, an error beyond.

Defined cases: rows with a null label, a null vector, or any null or non-finite component take no part. Vectors of unlike length
count as padded with zeros; empty ones have score 0. Repeated rows are rows of their own: an anchor leaves out itself only,
and repeated anchors are answered each. Rows with a null id can be found (last among equals) and are no anchors.
Ties go to the smaller id, then to the row read first. An anchor without other rows of its label gives no rows, a window
without rows neither; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from strokelake.llm.common import written

PAGES = 1024
LEAST_PAGE = 1024
LEAF = 32
BLOCK = 256
#: Queries per copy of a page; more are dealt to further copies.
GROUP = 1 << 16
TOP = 2**63 - 1  # stands for a null id, which comes last


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = 256) -> DataFrame:
    """id, label and q = floor(scale * x) of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label") if label is None else label
    taken = vectors.where(v.isNotNull() & finite).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("q")
    )
    return taken.where("label IS NOT NULL")


def padded(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``dim`` numbers."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(flat) == len(column) * dim:
        return flat.reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(column), dim), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Shape:
    """Dimensions, number types and packing coordinates of an index."""

    def __init__(self, points: DataFrame):
        n, dim, high, labels = points.agg(
            F.count("*"), F.max(F.size("q")), F.max(F.array_max(F.transform("q", F.abs))), F.approx_count_distinct("label")
        ).first()
        self.n, self.dim, high = n, dim or 0, int(high or 0)
        bound = max(1, self.dim) * high * high
        if bound >= 1 << 62:
            raise ValueError("inner products exceed 64 bits")
        self.work = np.float64 if bound < 1 << 53 else np.int64
        self.kind = "<i2" if high < 1 << 15 else "<i4" if high < 1 << 31 else "<i8"
        self.page = max(LEAST_PAGE, -(-n // PAGES))
        self.slabs = max(1, min(32, round((n / self.page / max(1, labels)) ** (1 / 3))))
        self.axes = self._axes(points)

    def _axes(self, points: DataFrame) -> list[int]:
        """Coordinates by falling variance."""
        dim = self.dim

        def run(batches):
            sums = np.zeros((2, dim))
            for batch in batches:
                x = padded(batch.column(0), dim).astype(np.float64)
                sums += [x.sum(0), (x * x).sum(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * dim)), pa.array(sums.ravel())], names=["at", "value"])

        if not self.n or not dim:
            return [0]
        got = dict(points.select("q").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value")).collect())
        spread = [got[dim + i] / self.n - (got[i] / self.n) ** 2 for i in range(dim)]
        return sorted(range(dim), key=lambda i: (-round(spread[i], 6), i))


def build_index(points: DataFrame, shape: Shape) -> DataFrame:
    """Pages: page, n, labels and corners of the box, and the packed rows."""
    spark = points.sparkSession
    axes = (shape.axes + [shape.axes[-1]] * 5)[:5]
    x = [F.coalesce(F.get("q", F.lit(a)), F.lit(0)) for a in axes[:3]]
    parts = [(i + 1) / shape.slabs for i in range(shape.slabs - 1)]
    placed = points.withColumns({"x0": x[0], "x1": x[1], "x2": x[2]})
    cuts = placed.agg(F.percentile_approx("x0", parts, 1000)).first()[0] if parts else []
    above = lambda value, limits: F.size(F.filter(limits, lambda c: c < value))
    listed = lambda numbers: F.array(*[F.lit(int(c)).cast("long") for c in numbers])
    placed = placed.withColumn("s0", above(F.col("x0"), listed(cuts)) if cuts else F.lit(0))
    inner = dict(placed.groupBy("s0").agg(F.percentile_approx("x1", parts, 1000)).collect()) if parts else {}
    if inner:
        table = F.array(*[listed(inner.get(i, [])) for i in range(shape.slabs)])
        placed = placed.withColumn("s1", above(F.col("x1"), F.get(table, F.col("s0"))))
    else:
        placed = placed.withColumn("s1", F.lit(0))
    keys = ["label", "s0", "s1", "x2", "row"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select("id", "label", "row", "q")
    dim, kind, size = shape.dim, shape.kind, shape.page

    def packed(part: int, no: int, ids, labels, rows, q) -> pa.RecordBatch:
        order = leaf_order(labels, q, axes[3], axes[4])
        ids, labels, rows, q = ids[order], labels[order], rows[order], q[order]
        load = ids.astype("<i8").tobytes() + labels.astype("<i8").tobytes() + rows.astype("<i8").tobytes() + q.astype(kind).tobytes()
        columns = [(part << 32) | no, len(ids), int(labels.min()), int(labels.max()), q.min(0).astype("<i8").tobytes(), q.max(0).astype("<i8").tobytes(), load]
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names=["page", "n", "label_lo", "label_hi", "lo", "hi", "load"])

    def run(batches):
        part, no, held, count = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids = batch.column(0).fill_null(TOP).to_numpy()
            held.append((ids, batch.column(1).to_numpy(), batch.column(2).to_numpy(), padded(batch.column(3), dim)))
            count += len(ids)
            while count >= size:
                joined = [np.concatenate(c) for c in zip(*held)]
                yield packed(part, no, *[c[:size] for c in joined])
                held, count, no = [tuple(c[size:] for c in joined)], count - size, no + 1
        if count:
            yield packed(part, no, *[np.concatenate(c) for c in zip(*held)])

    return written(ordered.mapInArrow(run, "page long, n long, label_lo long, label_hi long, lo binary, hi binary, load binary"), "pages")


def leaf_order(labels: np.ndarray, q: np.ndarray, first: int, second: int) -> np.ndarray:
    """Rows of a page by label, slices of one coordinate, and another inside the slice."""
    if not q.shape[1]:
        return np.argsort(labels, kind="stable")
    order = np.lexsort([q[:, first], labels])
    depth = LEAF * max(1, round((len(order) / LEAF) ** 0.5))
    strip = np.empty(len(order), np.int64)
    strip[order] = np.arange(len(order)) // depth
    return np.lexsort([q[:, second], strip, labels])


class Page:
    """The rows of a page and its leaves, opened for searching."""

    def __init__(self, n: int, load: bytes, shape: Shape):
        self.ids, self.labels, self.rows = np.frombuffer(load, "<i8", 3 * n).reshape(3, n)
        self.q = np.frombuffer(load[24 * n :], shape.kind).reshape(n, shape.dim).astype(shape.work)
        at = np.arange(0, n, LEAF)
        self.lo, self.hi = np.minimum.reduceat(self.q, at), np.maximum.reduceat(self.q, at)
        self.label_lo, self.label_hi = np.minimum.reduceat(self.labels, at), np.maximum.reduceat(self.labels, at)


def interval(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each query with anything inside each box."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T


def wanted(least, most, fits, low, high, kth) -> np.ndarray:
    """Whether a box may hold a result of any window; ``kth`` is the k-th score known so far."""
    out = np.zeros(least.shape, bool)
    for w in range(low.shape[1]):
        out |= (most >= np.maximum(low[:, w], kth[:, w])[:, None]) & (least <= high[:, w][:, None])
    return out & fits


def label_fits(labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool) -> np.ndarray:
    inside = (lo[None] <= labels[:, None]) & (labels[:, None] <= hi[None])
    return inside if same else ~(inside & (lo == hi)[None])


def search_page(page: Page, rows, labels, q, low, high, kth, k: int, same: bool):
    """Best k rows of each query and window in this page, by a best-first queue of leaves: (query, window, place, score)."""
    least, most = interval(q, page.lo, page.hi)
    usable = wanted(least, most, label_fits(labels, page.label_lo, page.label_hi, same), low, high, kth)
    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    spread = np.arange(LEAF)
    for i in range(len(rows)):
        queue = [(-most[i, leaf], leaf) for leaf in np.flatnonzero(usable[i]).tolist()]
        heapq.heapify(queue)
        kept = [(np.zeros(0, np.int64), np.zeros(0, page.q.dtype)) for _ in range(low.shape[1])]
        bound = np.maximum(low[i], kth[i])
        while queue and -queue[0][0] >= bound.min():
            leaves = [heapq.heappop(queue)[1] for _ in range(min(8, len(queue)))]
            place = (np.array(leaves)[:, None] * LEAF + spread).ravel()
            place = place[place < len(page.ids)]
            fits = page.labels[place] == labels[i]
            place = place[(fits if same else ~fits) & (page.rows[place] != rows[i])]
            score = page.q[place] @ q[i]
            for w, (at, have) in enumerate(kept):
                inside = (score >= bound[w]) & (score <= high[i, w])
                if inside.any():
                    at, have = np.r_[at, place[inside]], np.r_[have, score[inside]]
                    first = np.lexsort([page.rows[at], page.ids[at], -have])[:k]
                    kept[w] = at[first], have[first]
                    if len(first) == k:
                        bound[w] = max(bound[w], kept[w][1][-1])
        out += [(i, w, at, have) for w, (at, have) in enumerate(kept) if len(at)]
    return out


BLOCKS = "page long, grp int, rows array<long>, labels array<long>, q binary, low binary, high binary, kth binary"
NONE = -(1 << 62)


def route(queries: DataFrame, boxes: tuple, shape: Shape, groups: int, same: bool, first: bool) -> DataFrame:
    """Blocks of queries per page: first the two best pages of each query, later all others that may hold a result."""
    pages, lo, hi, label_lo, label_hi = boxes

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                q = padded(part.column(2), shape.dim).astype(shape.work)
                low, high, kth = (padded(c, len(part.column(3)[0])) for c in part.columns[3:6])
                least, most = interval(q, lo, hi)
                usable = wanted(least, most, label_fits(labels, label_lo, label_hi, same), low, high, np.full(kth.shape, NONE))
                best = np.argsort(np.where(usable, -most, np.inf), axis=1, kind="stable")[:, :2]
                chosen = np.zeros(usable.shape, bool)
                np.put_along_axis(chosen, best, True, 1)
                go = chosen & usable if first else wanted(least, most, usable & ~chosen, low, high, kth)
                group = int(rows[0] % groups)
                for p in np.flatnonzero(go.any(0)).tolist():
                    own = go[:, p]
                    load = [np.ascontiguousarray(a[own]).astype("<i8").tobytes() for a in (q, low, high, kth)]
                    values = [int(pages[p]), group, rows[own].tolist(), labels[own].tolist(), *load]
                    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[f.split()[0] for f in BLOCKS.split(", ")])

    return queries.select("row", "label", "q", "low", "high", "kth").mapInArrow(run, BLOCKS)


def search(blocks: DataFrame, index: DataFrame, shape: Shape, groups: int, k: int, same: bool) -> DataFrame:
    """Rows (row, w, id, score, found): the best k of each page; each page is read once per group of queries."""
    opened = index.select("page", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(0).alias("tag"), "n", "load")
    both = opened.unionByName(blocks.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    ordered = both.repartition("page", "grp").sortWithinPartitions("page", "grp", "tag")

    def run(batches):
        at, page, held = None, None, None
        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                value = {name: c[r].as_py() for name, c in cols.items()}
                if value["tag"] == 0:
                    at, page, held = value["page"], None, (value["n"], value["load"])
                    continue
                if value["page"] != at:
                    raise ValueError("a block without its page")
                if page is None:
                    page = Page(*held, shape)
                rows, labels = np.array(value["rows"], np.int64), np.array(value["labels"], np.int64)
                q, low, high, kth = (np.frombuffer(value[c], "<i8").reshape(len(rows), -1) for c in ("q", "low", "high", "kth"))
                found = search_page(page, rows, labels, q.astype(shape.work), low, high, kth, k, same)
                if found:
                    places = np.concatenate([f[2] for f in found])
                    sizes = [len(f[2]) for f in found]
                    ids = page.ids[places]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(rows[[f[0] for f in found]], sizes)),
                            pa.array(np.repeat([f[1] for f in found], sizes).astype(np.int32)),
                            pa.array(ids, mask=ids == TOP),
                            pa.array(np.concatenate([f[3] for f in found]).astype(np.int64)),
                            pa.array(page.rows[places]),
                        ],
                        names=["row", "w", "id", "score", "found"],
                    )

    return ordered.mapInArrow(run, "row long, w int, id long, score long, found long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, index: DataFrame, shape: Shape, k: int, same: bool) -> DataFrame:
    """For each query row and window (``low`` and ``high`` arrays of equal length) the best k rows: row, w, rank, id, score."""
    queries = written(queries, "queries")
    groups = max(1, -(-queries.count() // GROUP))
    corners = index.select("page", "lo", "hi", "label_lo", "label_hi").collect()  # bounded by PAGES and the partitions
    table = lambda name: np.array([np.frombuffer(r[name], "<i8") for r in corners]).reshape(len(corners), shape.dim).astype(shape.work)
    boxes = ([r.page for r in corners], table("lo"), table("hi"), np.array([r.label_lo for r in corners]), np.array([r.label_hi for r in corners]))
    none = queries.withColumn("kth", F.transform("low", lambda _: F.lit(NONE)))
    one = written(search(route(none, boxes, shape, groups, same, True), index, shape, groups, k, same), "found")
    kth = best(one, k).where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("known"))
    known = queries.join(kth, "row", "left").withColumn(
        "kth", F.transform("low", lambda _, w: F.coalesce(F.col("known")[w], F.lit(NONE)))
    )
    two = search(route(known, boxes, shape, groups, same, False), index, shape, groups, k, same)
    return best(one.unionByName(two), k)


def mine(points: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of each (anchor, positive); ``points`` has id, label and q, ``anchors`` is a condition on them.

    A negative has another label and a score between ``low`` and ``high`` percent of the positive's, bounds included.
    """
    points = written(points.withColumn("row", F.monotonically_increasing_id()), "points")
    shape = Shape(points)
    index = build_index(points, shape)
    asked = points.where(anchors)
    whole = asked.select("row", "label", "q", F.array(F.lit(NONE)).alias("low"), F.array(F.lit(-NONE)).alias("high"))
    near = written(nearest(whole, index, shape, positives, True).select("row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    listed = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))  # at most ``positives`` entries
    floor = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("long")  # noqa: E731  whole multiples of 100
    fill = lambda x, empty: F.concat(x, F.array_repeat(F.lit(empty), F.lit(positives) - F.size(x)))  # noqa: E731  windows that nothing fits
    windows = asked.join(listed, "row").select(
        "row", "label", "q",
        fill(F.transform("p", lambda s: -floor(s["positive_score"] * -low)), -NONE).alias("low"),
        fill(F.transform("p", lambda s: floor(s["positive_score"] * high)), NONE).alias("high"),
    )
    found = nearest(windows, index, shape, negatives, False)
    named = found.select("row", (F.col("w") + 1).alias("at"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = asked.select("row", F.col("id").alias("anchor_id")).join(near.withColumnRenamed("rank", "at"), "row")
    return pairs.join(named, ["row", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH points AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other, b.label, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS score
  FROM points a, points b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(score AS BIGINT) AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND s.own <> s.label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
"""
