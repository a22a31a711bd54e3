"""Matching drawings to a template: pair scores, assignment, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strokelake.config import TOLERANCE, MatchTolerance
from strokelake.functions import geometry as G
from strokelake.operators.keyed import join_small
from strokelake.operators.profile import count_rows
from strokelake.operators.segments import ENDS, KEY
from strokelake.session import cut

REF_KEY = "reference_id"
EXACT_MASK = 12  # templates (or drawings) up to this size use the subset table
PLACES = 1e8  # similarities are compared to eight places
TIE_SPAN, TIE_PRIME, TIE_FACTOR = 65536, 65521, 40503  # weights of (line, template segment) that order equal totals
UNROLLED = 16  # templates up to this size are scored as columns of their own
STACK = 4_000_000  # entries of the subset tables of one stack of drawings
SMALL_DRAWING = 64  # a drawing's pair list is built directly up to here, and pruned beyond


def template_arrays(ref: DataFrame, single: bool = False) -> DataFrame:
    """One row per template with its segments as an array."""
    if single and ref.select(REF_KEY).distinct().limit(2).count() > 1:
        raise ValueError("segments need a reference_id when there are several templates")
    item = F.struct("ref_id", *ENDS)
    return ref.groupBy(REF_KEY).agg(F.array_sort(F.collect_list(item)).alias("template"))


def candidate_pairs(seg: DataFrame, ref: DataFrame) -> DataFrame:
    """Every segment next to every segment of its own template.

    A template is one array row, so the join is by ``reference_id`` with one row per template
    and the pairs come from exploding that array: no cross join. Segments without a
    ``reference_id`` belong to the only template.
    """
    arrays = template_arrays(ref, single=REF_KEY not in seg.columns)
    if REF_KEY in seg.columns:
        rows = join_small(seg, arrays, REF_KEY)
    else:
        rows = seg.withColumn("template", arrays.agg(F.first("template")).scalar())
    return rows.select(*seg.columns, F.explode("template").alias("_t")).select(
        *seg.columns, F.col("_t.ref_id").alias("ref_id"), *(F.col(f"_t.{c}").alias(f"r_{c}") for c in ENDS)
    )


def score_pairs(
    seg: DataFrame,
    ref: DataFrame,
    tol: MatchTolerance = TOLERANCE,
    similarity: Callable[[G.Seg, G.Seg], Column] | None = None,
) -> DataFrame:
    """Similarity of every candidate pair; a caller's own Column function may replace the formula."""
    score = similarity or (lambda a, b: G.line_similarity(a, b, tol))
    return candidate_pairs(seg, ref).select(
        KEY, "line_id", "ref_id", score(G.seg(), G.seg("r_")).alias("similarity")
    )


def prune_candidates(pairs: DataFrame, template_size: int) -> DataFrame:
    """Per drawing and template segment keep the ``template_size`` most similar segments.

    Lossless for both assignments: at most ``template_size - 1`` better segments can be taken
    by the other template segments. The limit is applied before the shuffle as well, so even
    a drawing with a huge number of segments ends up with at most size squared pairs.
    """
    order = W.partitionBy(KEY, "ref_id").orderBy(F.desc("similarity"), "line_id")
    return pairs.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= template_size).drop("_p")


def split_by_size(seg: DataFrame, limit: int = SMALL_DRAWING) -> tuple[DataFrame, DataFrame | None]:
    """Segments of drawings with at most ``limit`` segments, and those of larger ones (None: there are none)."""
    large = cut(seg.groupBy(KEY).agg(count_rows().alias("_n")).where(F.col("_n") > limit).select(KEY))
    if large.isEmpty():
        return seg, None
    return seg.join(large, KEY, "left_anti"), seg.join(large, KEY, "left_semi")


def template_size(ref: DataFrame) -> int:
    return ref.groupBy(REF_KEY).agg(count_rows().alias("n")).agg(F.max("n")).first()[0] or 0


def _per_drawing(pairs: DataFrame, size: int, bounded: bool) -> DataFrame:
    """Pairs of a drawing as one bounded array, best first."""
    item = F.struct((-F.col("similarity")).alias("cost"), "line_id", "ref_id")
    rows = pairs if bounded else prune_candidates(pairs, size)
    return rows.groupBy(KEY).agg(F.array_sort(F.collect_list(item)).alias("pairs"))


def assign_greedy(pairs: DataFrame, size: int, threshold: float | None = None, bounded: bool = False) -> DataFrame:
    """Best pair first, each side used once; a fold over the drawing's sorted pair array.

    ``bounded`` says that every drawing is known to be small, so pruning is not needed.
    """
    start = F.struct(
        F.array().cast("array<int>").alias("lines"),
        F.array().cast("array<int>").alias("refs"),
        F.array().cast("array<struct<cost:double,line_id:int,ref_id:int>>").alias("picks"),
    )

    def take(acc: Column, p: Column) -> Column:
        used = F.array_contains(acc["lines"], p["line_id"]) | F.array_contains(acc["refs"], p["ref_id"])
        return F.when(used, acc).otherwise(
            F.struct(
                F.array_append(acc["lines"], p["line_id"]).alias("lines"),
                F.array_append(acc["refs"], p["ref_id"]).alias("refs"),
                F.array_append(acc["picks"], p).alias("picks"),
            )
        )

    typed = pairs.withColumns({"line_id": F.col("line_id").cast("int"), "ref_id": F.col("ref_id").cast("int")})
    picks = _per_drawing(typed, size, bounded).select(KEY, F.aggregate("pairs", start, take)["picks"].alias("picks"))
    return _threshold(picks.select(KEY, F.inline("picks")).withColumn("similarity", -F.col("cost")), threshold)


def _threshold(matches: DataFrame, threshold: float | None) -> DataFrame:
    rows = matches.select(KEY, "line_id", "ref_id", "similarity")
    return rows if threshold is None else rows.where(F.col("similarity") >= threshold)


def assign_segments(
    pairs: DataFrame, size: int, threshold: float | None = TOLERANCE.threshold, bounded: bool = False
) -> DataFrame:
    """Optimal one-to-one assignment per drawing, then the similarity threshold.

    Exactly ``min(segments, template)`` pairs with the least total of (1 - similarity) are
    chosen before the threshold; ``ordered_cost`` says which of several. ``threshold=None`` returns them all.
    """
    packed = _per_drawing(pairs, size, bounded).select(
        KEY,
        F.transform("pairs", lambda p: p["line_id"].cast("int")).alias("lines"),
        F.transform("pairs", lambda p: p["ref_id"].cast("int")).alias("refs"),
        F.transform("pairs", lambda p: -p["cost"]).alias("sims"),
    )
    solved = packed.select(KEY, _solver()("lines", "refs", "sims").alias("m"))
    return _threshold(solved.select(KEY, F.inline(F.arrays_zip("m.line_id", "m.ref_id", "m.similarity"))), threshold)


def matched_segments(
    seg: DataFrame, ref: DataFrame, optimal: bool = True, threshold: float | None = TOLERANCE.threshold, tol: MatchTolerance = TOLERANCE
) -> DataFrame:
    """Every segment with its template segment and similarity (null: none); ``listed`` marks one row of each pair.

    For the only template, and drawings that ``split_by_size`` calls usual. The segments are brought together by drawing, which
    takes no shuffle where they already are; scores are columns, and a task solves its drawings in stacks of one size.
    """
    template = sorted(map(tuple, ref.select("ref_id", *ENDS).collect()))
    refs = np.array([t[0] for t in template], np.int64)
    columns = [c for c in (KEY, "line_id", *ENDS) if c in seg.columns]
    # the row number asks for whole drawings, in order
    place = F.row_number().over(W.partitionBy(KEY).orderBy("line_id"))
    ordered = seg.select(*columns, place.alias("_place"))
    if len(template) <= UNROLLED:
        sims = F.array(*(G.line_similarity(G.seg(), G.Seg(*map(F.lit, t[1:])), tol) for t in template))
    else:
        every = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(t[1:], ENDS))) for t in template))
        sims = F.transform(every, lambda t: G.line_similarity(G.seg(), G.Seg(*(t[c] for c in ENDS)), tol))
    scored = ordered.select(*columns, "_place", sims.cast("array<double>").alias("_sims"))
    kinds = {f.name: f.dataType.simpleString() for f in seg.schema}
    out = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", ref_id int, similarity double, listed boolean"
    width, solve = len(columns), least_cost_columns if optimal else None

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                first = np.flatnonzero(batch.column(width).to_numpy() == 1)
                if not len(first):
                    held.append(batch)
                    continue
                cut = int(first[-1])  # the last drawing may go on in the next batch
                whole, rest = [*held, batch.slice(0, cut)], [batch.slice(cut)]
            else:
                whole, rest = held, []
            held = rest
            rows = sum(b.num_rows for b in whole)
            if rows:
                yield _matched(pa.Table.from_batches(whole).combine_chunks().to_batches()[0], width, refs, solve, threshold)

    return scored.mapInArrow(run, out)


def _matched(batch, width: int, refs: np.ndarray, solve, threshold: float | None):
    """One batch of whole drawings with their pairs."""
    n, m = batch.num_rows, len(refs)
    sims = batch.column(width + 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, m)
    lines = batch.column(1).to_numpy().astype(np.int64)
    starts = np.flatnonzero(batch.column(width).to_numpy() == 1)
    drawing = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    # a line may have several rows: the last one counts, and all of them are marked
    last = np.append((drawing[1:] != drawing[:-1]) | (lines[1:] != lines[:-1]), True)
    at = np.flatnonzero(last)
    column = np.full(len(at), -1)
    sizes = np.bincount(drawing[at], minlength=len(starts))
    begins = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist() if m else []:
        members = begins[sizes == size]
        step = max(1, STACK // (max(size, m) << min(size, m, EXACT_MASK)))
        for low in range(0, len(members), step):
            rows = members[low : low + step, None] + np.arange(size)
            some = sims[at[rows]]
            column[rows] = solve(stacked_cost(lines[at[rows]], refs, some)) if solve else _best_first(some)
    found = np.where(column >= 0, sims[at, column] if m else np.nan, np.nan)
    if threshold is not None:
        column = np.where(found >= threshold, column, -1)
    none = column < 0
    line = np.cumsum(last) - last
    ref_id = pa.array(refs[column].astype(np.int32) if m else np.zeros(len(at), np.int32), mask=none)
    similarity = pa.array(found, mask=none | np.isnan(found))
    arrays = [*batch.columns[:width], ref_id.take(pa.array(line)), similarity.take(pa.array(line)), pa.array(last & ~none[line])]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:width], "ref_id", "similarity", "listed"])


def _best_first(sims: np.ndarray) -> np.ndarray:
    """Greedy columns of a stack (d, n, m): the best pair, then the best of what is left; ties go to the first line and segment."""
    d, n, m = sims.shape
    left = np.where(np.isnan(sims), -2.0, sims)
    out, every = np.full((d, n), -1), np.arange(d)
    for _ in range(min(n, m)):
        i, j = np.divmod(left.reshape(d, -1).argmax(axis=1), m)
        out[every, i] = j
        left[every, i, :] = -3.0
        left[every, :, j] = -3.0
    return out


def _solver():
    @F.pandas_udf("struct<line_id:array<int>,ref_id:array<int>,similarity:array<double>>")
    def solve(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lines, refs, sims in batches:
            yield solve_batch(lines, refs, sims)

    return solve


def solve_batch(lines, refs, sims) -> pd.DataFrame:
    """Solve many small drawings at once, grouped by matrix shape."""
    count = len(lines)
    out = {name: [None] * count for name in ("line_id", "ref_id", "similarity")}
    tables, shapes = [], {}
    for i in range(count):
        rows, r = np.unique(np.asarray(lines.iloc[i], np.int64), return_inverse=True)
        cols, c = np.unique(np.asarray(refs.iloc[i], np.int64), return_inverse=True)
        sim = np.full((len(rows), len(cols)), np.nan)
        sim[r, c] = sims.iloc[i]
        tables.append((rows, cols, sim))
        shapes.setdefault(sim.shape, []).append(i)
    for (n, m), members in shapes.items():
        wide = min(n, m)
        step = len(members) if wide > EXACT_MASK else max(1, 4_000_000 // (max(n, m) << wide))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            cost = np.stack([ordered_cost(*tables[i]) for i in part])
            for i, (rows_at, cols_at) in zip(part, least_cost_pairs(cost)):
                rows, cols, sim = tables[i]
                out["line_id"][i] = rows[rows_at].astype("int32")
                out["ref_id"][i] = cols[cols_at].astype("int32")
                out["similarity"][i] = sim[rows_at, cols_at]
    return pd.DataFrame(out)


def ordered_cost(lines: np.ndarray, refs: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Whole-number costs in which assignments of equal total similarity (to ``PLACES``) differ.

    The first digits are 1 - similarity, the last ones a fixed weight of the two ids, so every way of solving (and SQL)
    takes the same one of several best assignments. Only the pairs that ``prune_candidates`` would keep count.
    """
    known = ~np.isnan(sim)
    if sim.shape[0] > sim.shape[1]:
        order = np.lexsort([np.broadcast_to(lines[:, None], sim.shape), np.where(known, -sim, np.inf)], axis=0)
        place = np.argsort(order, axis=0)
        known &= place < sim.shape[1]
    return _tied_cost(lines, refs, sim, known)


def stacked_cost(lines: np.ndarray, refs: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """``ordered_cost`` of many drawings of one size (d, n, m) with ascending lines."""
    known = ~np.isnan(sim)
    if sim.shape[1] > sim.shape[2]:
        order = np.argsort(np.where(known, -sim, np.inf), axis=1, kind="stable")
        known &= np.argsort(order, axis=1) < sim.shape[2]
    return _tied_cost(lines, refs, sim, known)


def _tied_cost(lines: np.ndarray, refs: np.ndarray, sim: np.ndarray, known: np.ndarray) -> np.ndarray:
    weight = ((lines % TIE_PRIME + 1)[..., None] * (refs + 1) * TIE_FACTOR) % TIE_PRIME
    return np.where(known, np.rint((1.0 - np.nan_to_num(sim)) * PLACES), 2 * PLACES) * TIE_SPAN + weight


def least_cost_pairs(cost: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row and column places of the cheapest full matching for each matrix of a stack (d, n, m)."""
    chosen = least_cost_columns(cost)
    return [(rows, own[rows]) for own, rows in ((c, np.flatnonzero(c >= 0)) for c in chosen)]


def least_cost_columns(cost: np.ndarray) -> np.ndarray:
    """Column of each row (-1: none) in the cheapest full matching for each matrix of a stack (d, n, m)."""
    d, n, m = cost.shape
    out = np.full((d, n), -1)
    if min(n, m) > EXACT_MASK:
        for k, c in enumerate(cost):
            rows, cols = _augmenting_paths(c) if n <= m else reversed(_augmenting_paths(c.T))
            out[k, rows] = cols
        return out
    flip = n < m
    if flip:  # the subset runs over the smaller side
        cost, n, m = cost.transpose(0, 2, 1), m, n
    subsets = 1 << m
    best = np.full((d, subsets), np.inf)
    best[:, 0] = 0.0
    choice = np.full((n, d, subsets), -1, dtype=np.int8)
    masks = np.arange(subsets)
    with_bit = [masks[(masks >> j) & 1 == 1] for j in range(m)]
    for i in range(n):
        grown = best.copy()
        for j, sets in enumerate(with_bit):
            offer = best[:, sets ^ (1 << j)] + cost[:, i, j][:, None]
            better = offer < grown[:, sets]
            grown[:, sets] = np.where(better, offer, grown[:, sets])
            choice[i][:, sets] = np.where(better, j, choice[i][:, sets])
        best = grown
    state = np.full(d, subsets - 1)
    every = np.arange(d)
    for i in range(n - 1, -1, -1):
        picked = choice[i][every, state].astype(np.int64)
        took = np.flatnonzero(picked >= 0)
        if flip:
            out[took, picked[took]] = i
        else:
            out[took, i] = picked[took]
        state = np.where(picked >= 0, state ^ (1 << np.maximum(picked, 0)), state)
    return out


def _augmenting_paths(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shortest augmenting paths with row and column prices, for n <= m."""
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        reach, came = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, col, walked = start, -1, 0.0
        while True:
            offer = walked + cost[row] - row_price[row] - col_price
            closer = ~done & (offer < reach)
            reach[closer], came[closer] = offer[closer], row
            col = int(np.argmin(np.where(done, np.inf, reach)))
            walked, done[col] = reach[col], True
            if owner[col] < 0:
                break
            row = owner[col]
        row_price[start] += walked
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                row_price[owner[j]] += walked - reach[j]
            col_price[j] -= walked - reach[j]
        while True:
            row = came[col]
            previous = np.flatnonzero(owner == row)
            owner[col] = row
            if row == start:
                break
            col = int(previous[previous != col][0])
    cols = np.flatnonzero(owner >= 0)
    rows = owner[cols]
    order = np.argsort(rows)
    return rows[order], cols[order]


def match_summary(
    matches: DataFrame, seg: DataFrame, size: int, drawings: DataFrame | None = None, tol: MatchTolerance = TOLERANCE
) -> DataFrame:
    """Correct, missing and extra segments and the score per drawing.

    ``drawings`` (a ``drawing_id`` column) adds drawings without any segment.
    """
    taken = matches.select(KEY, "line_id", "ref_id")
    return segment_summary(seg.join(taken, [KEY, "line_id"], "left"), size, drawings, tol)


def segment_summary(rows: DataFrame, size: int, drawings: DataFrame | None = None, tol: MatchTolerance = TOLERANCE) -> DataFrame:
    """``match_summary`` of segments that carry their ``ref_id`` (null: none)."""
    long_enough = G.seg_length(G.seg()) >= tol.min_extra_length
    counts = rows.groupBy(KEY).agg(
        count_rows().alias("detected_lines"),
        F.count("ref_id").alias("correct_lines"),
        F.count_if(F.col("ref_id").isNull() & long_enough).alias("extra_lines"),
    )
    if drawings is not None:
        counts = drawings.select(KEY).join(counts, KEY, "left").na.fill(0)
    # without a template every segment is extra, whatever its length
    extra = F.col("extra_lines") if size else F.col("detected_lines")
    return counts.select(
        KEY,
        "correct_lines",
        (F.lit(size) - F.col("correct_lines")).alias("missing_lines"),
        extra.alias("extra_lines"),
        (F.col("correct_lines") / size if size else F.lit(0.0)).alias("similarity_score"),
        "detected_lines",
    )


def overall_metrics(summary: DataFrame, size: int) -> DataFrame:
    """The summary with totals of both sides."""
    return summary.select(
        KEY, "correct_lines", "missing_lines", "extra_lines", "similarity_score",
        F.lit(size).alias("total_reference_lines"), F.col("detected_lines").alias("total_detected_lines"),
    )


def tag_matches(seg: DataFrame, ref: DataFrame, matches: DataFrame) -> DataFrame:
    """Both sides with their state: detected matched/extra, reference matched/missing."""
    hit = matches.select(KEY, "line_id", "ref_id")
    detected = seg.join(hit.select(KEY, "line_id", F.lit(1).alias("_m")), [KEY, "line_id"], "left").select(
        KEY, F.lit("detected").alias("side"), F.col("line_id").alias("segment_id"),
        F.when(F.col("_m").isNotNull(), "matched").otherwise("extra").alias("state"),
    )
    drawings = seg.select(KEY).distinct()
    listed = drawings.select(
        KEY, F.explode(template_arrays(ref).agg(F.first("template")).scalar()["ref_id"]).alias("ref_id")
    )
    reference = listed.join(hit.select(KEY, "ref_id", F.lit(1).alias("_m")), [KEY, "ref_id"], "left").select(
        KEY, F.lit("reference").alias("side"), F.col("ref_id").alias("segment_id"),
        F.when(F.col("_m").isNotNull(), "matched").otherwise("missing").alias("state"),
    )
    return detected.unionByName(reference)


def tag_segments(rows: DataFrame, ref: DataFrame) -> DataFrame:
    """``tag_matches`` of segments that carry their ``ref_id``; a drawing's taken template segments are one bounded array."""
    detected = F.struct(
        F.lit("detected").alias("side"), F.col("line_id").cast("int").alias("segment_id"),
        F.when(F.col("ref_id").isNotNull(), "matched").otherwise("extra").alias("state"),
    )
    every = F.array(*(F.lit(k).cast("int") for k in sorted(r[0] for r in ref.select("ref_id").collect())))
    taken = rows.groupBy(KEY).agg(F.collect_set(F.col("ref_id").cast("int")).alias("taken"))
    reference = F.transform(
        every.cast("array<int>"),
        lambda k: F.struct(
            F.lit("reference").alias("side"), k.alias("segment_id"),
            F.when(F.array_contains("taken", k), "matched").otherwise("missing").alias("state"),
        ),
    )
    return rows.select(KEY, detected.alias("t")).select(KEY, "t.*").unionByName(taken.select(KEY, F.inline(reference)))


def reference_status(ref: DataFrame) -> DataFrame:
    """Per template: usable or not, and its segments by orientation."""
    kind = G.orientation(G.seg_angle(G.seg()))
    return ref.groupBy(REF_KEY).agg(
        (F.count("ref_id") > 0).alias("has_features"),
        F.count("ref_id").alias("total"),
        *(F.count_if(F.col("ref_id").isNotNull() & (kind == k)).alias(k) for k in ("horizontal", "vertical", "diagonal")),
    ).withColumn("status", F.when(F.col("has_features"), "ready").otherwise("empty"))
