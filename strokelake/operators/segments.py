"""Operators on sets of segments: records, filters, overlaps, merging."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strokelake.config import CANVAS, DETECTOR, TEMPLATE_POINTS, Detector
from strokelake.functions import geometry as G
from strokelake.operators.greedy import greedy_owned, spread, with_cells
from strokelake.operators.ordered import next_in_order
from strokelake.operators.profile import count_rows
from strokelake.session import cut

KEY = "drawing_id"
ENDS = ["x1", "y1", "x2", "y2"]


def measured(seg: DataFrame) -> DataFrame:
    """Length, directed angle and orientation next to each segment."""
    s = G.seg()
    return seg.withColumns(
        {"length": G.seg_length(s), "angle": G.seg_angle(s), "orientation": G.orientation(G.seg_angle(s))}
    )


def filter_min_length(seg: DataFrame, pixels: float = DETECTOR.final_length) -> DataFrame:
    return seg.where(G.seg_length(G.seg()) >= pixels)


def clip_segments(seg: DataFrame, width: int = CANVAS.width, height: int = CANVAS.height) -> DataFrame:
    """Ends held inside the canvas; segments left without length are dropped."""
    clipped = G.clip_segment(G.seg(), width, height)
    rows = seg.withColumns(dict(zip(ENDS, clipped)))
    return rows.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def top_segments(seg: DataFrame, n: int) -> DataFrame:
    """Longest first, n per drawing; pre-limited before the shuffle."""
    order = W.partitionBy(KEY).orderBy(F.desc(G.seg_length(G.seg())), "line_id")
    return seg.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def orientation_counts(seg: DataFrame) -> DataFrame:
    kind = G.orientation(G.seg_angle(G.seg()))
    return seg.groupBy(KEY).agg(
        *(F.count_if(kind == k).alias(k) for k in ("horizontal", "vertical", "diagonal")), count_rows().alias("total")
    )


def segment_features(seg: DataFrame, per_record: int = 4096) -> DataFrame:
    """The feature record: ordered lists of segments, lengths and angles with counts.

    A part lists up to ``per_record`` segments; larger drawings continue in further parts, so
    that no list grows without bound. The counts are those of the whole drawing in each part.
    """
    s = G.seg()
    item = F.struct(
        F.col("line_id"), *ENDS, G.seg_length(s).alias("length"), G.seg_angle(s).alias("angle"),
        G.orientation(G.seg_angle(s)).alias("orientation"),
    )
    part = F.floor((F.col("line_id") - 1) / per_record).cast("int")
    packed = seg.groupBy(KEY, part.alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    counts = orientation_counts(seg)

    def of(kind: str) -> Column:
        return F.col(kind).cast("int")

    return packed.join(counts, KEY).select(
        KEY,
        "part",
        of("total").alias("num_lines"),
        F.transform("items", lambda i: F.array(i["x1"], i["y1"], i["x2"], i["y2"])).alias("lines"),
        F.transform("items", lambda i: i["length"]).alias("line_lengths"),
        F.transform("items", lambda i: i["angle"]).alias("line_angles"),
        F.struct(
            of("horizontal").alias("horizontal"),
            of("vertical").alias("vertical"),
            of("diagonal").alias("diagonal"),
            of("total").alias("total"),
        ).alias("line_counts"),
    )


RECORD_FIELDS = ("num_lines", "lines", "line_lengths", "line_angles", "line_counts")
RECORD_SCHEMA = (
    "num_lines int, lines array<array<int>>, line_lengths array<double>, line_angles array<double>, "
    "line_counts struct<horizontal:int,vertical:int,diagonal:int,total:int>"
)


def features_to_json(records: DataFrame) -> DataFrame:
    return records.select(KEY, "part", F.to_json(F.struct(*RECORD_FIELDS)).alias("feature_json"))


def features_from_json(texts: DataFrame) -> DataFrame:
    return texts.select(KEY, "part", F.from_json("feature_json", RECORD_SCHEMA).alias("r")).select(KEY, "part", "r.*")


def segments_of_record(records: DataFrame, per_record: int = 4096) -> DataFrame:
    """Back to one row per segment; numbering goes on from part to part."""
    lines = records.select(KEY, "part", F.posexplode("lines").alias("pos", "line"))
    return lines.select(
        KEY, (F.col("part") * per_record + F.col("pos") + 1).alias("line_id"), *(F.col("line")[i].alias(c) for i, c in enumerate(ENDS))
    )


def validate_counts(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected and detected lines per category; a category absent on one side counts as zero.

    ``counts`` and ``expected`` carry ``drawing_id, category, n``.
    """
    left = counts.select(KEY, "category", F.col("n").alias("detected"))
    right = expected.select(KEY, "category", F.col("n").alias("expected"))
    both = left.join(right, [KEY, "category"], "full").na.fill(0, ["detected", "expected"])
    gap = F.col("detected") - F.col("expected")
    note = (
        F.when(gap > 0, F.format_string("%s: +%d extra lines", F.col("category"), gap))
        .when(gap < 0, F.format_string("%s: %d missing lines", F.col("category"), gap))
        .otherwise(F.format_string("%s: correct (%d)", F.col("category"), F.col("detected")))
    )
    return both.select(KEY, "category", "expected", "detected", gap.alias("difference"), note.alias("note"))


def count_verdict(checked: DataFrame) -> DataFrame:
    """Per drawing: every category right, and the totals equal."""
    return checked.groupBy(KEY).agg(
        F.bool_and(F.col("difference") == 0).alias("perfect_match"),
        (F.sum("expected") == F.sum("detected")).alias("total_match"),
    )


def counts_long(seg: DataFrame) -> DataFrame:
    kind = G.orientation(G.seg_angle(G.seg()))
    return seg.groupBy(KEY, kind.alias("category")).agg(count_rows().alias("n"))


def line_pool_stats(seg: DataFrame) -> DataFrame:
    s = G.seg()
    per = seg.groupBy(KEY).agg(
        count_rows().alias("n"),
        F.min(G.seg_length(s)).alias("lo"),
        F.max(G.seg_length(s)).alias("hi"),
        F.min(G.seg_angle(s)).alias("alo"),
        F.max(G.seg_angle(s)).alias("ahi"),
    )
    return per.agg(
        F.sum("n").alias("lines"),
        count_rows().alias("drawings"),
        F.avg("n").alias("mean_lines"),
        F.min("lo").alias("min_length"),
        F.max("hi").alias("max_length"),
        F.min("alo").alias("min_angle"),
        F.max("ahi").alias("max_angle"),
    )


# --- overlap and merging -------------------------------------------------------------------


def _overlaps(cfg: Detector):
    def test(a: str, b: str) -> Column:
        gap = F.abs(F.col(f"{a}fold") - F.col(f"{b}fold"))
        apart = G.distance(F.col(f"{a}mx"), F.col(f"{a}my"), F.col(f"{b}mx"), F.col(f"{b}my"))
        crossing = (gap >= cfg.crossing_low) & (gap <= cfg.crossing_high)
        return ~crossing & (gap < cfg.overlap_angle) & (apart < cfg.overlap_distance)

    return test


def _overlaps_of(columns: list[str], cfg: Detector):
    """The same test on two rows as tuples of ``columns``."""
    f, x, y = (columns.index(c) for c in ("fold", "mx", "my"))
    low, high, angle, reach = cfg.crossing_low, cfg.crossing_high, cfg.overlap_angle, cfg.overlap_distance

    def test(a: tuple, b: tuple) -> bool:
        gap, dx, dy = abs(a[f] - b[f]), a[x] - b[x], a[y] - b[y]
        return not low <= gap <= high and gap < angle and math.sqrt(dx * dx + dy * dy) < reach

    return test


def _folded(seg: DataFrame) -> DataFrame:
    mx, my = G.midpoint(G.seg())
    return seg.withColumns({"mx": mx, "my": my, "fold": G.undirected_angle(G.seg_angle(G.seg()), 180)})


def overlap_pairs(seg: DataFrame, cfg: Detector = DETECTOR) -> DataFrame:
    """Pairs of one drawing with like angle and near midpoint.

    Midpoints go into cells as wide as the reach; a cell meets itself and its four forward
    neighbours, so candidates grow with real neighbourhoods, not with the drawing squared.
    """
    cells = ["cx", "cy"]
    reach = {"cx": (F.col("mx"), cfg.overlap_distance), "cy": (F.col("my"), cfg.overlap_distance)}
    rows = with_cells(_folded(seg), reach).select(KEY, *cells, "line_id", "mx", "my", "fold")
    forward = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    tagged = rows.withColumns({"ox": F.col("cx"), "oy": F.col("cy")})
    a = spread(tagged, cells, forward).select(
        KEY, *cells, "ox", "oy", *(F.col(c).alias(f"a_{c}") for c in ("line_id", "mx", "my", "fold"))
    )
    b = rows.select(KEY, *cells, *(F.col(c).alias(f"b_{c}") for c in ("line_id", "mx", "my", "fold")))
    own = (F.col("ox") == F.col("cx")) & (F.col("oy") == F.col("cy"))
    pairs = a.join(b, [KEY, *cells]).where(
        (~own | (F.col("a_line_id") < F.col("b_line_id"))) & _overlaps(cfg)("a_", "b_")
    )
    return pairs.select(
        KEY, F.least("a_line_id", "b_line_id").alias("line_i"), F.greatest("a_line_id", "b_line_id").alias("line_j")
    )


def suppress_overlaps(seg: DataFrame, cfg: Detector = DETECTOR) -> DataFrame:
    """Longest first, drop a segment that overlaps one already kept."""
    cells = {
        "_cx": (F.col("mx"), cfg.overlap_distance),
        "_cy": (F.col("my"), cfg.overlap_distance),
        "_ca": (F.col("fold"), cfg.overlap_angle),
    }
    rank = F.struct((-F.col("length")).alias("l"), F.col("line_id").alias("i"))
    columns = ["line_id", *ENDS, "mx", "my", "fold", "length"]

    def derive(rows: DataFrame) -> DataFrame:
        return _folded(rows).withColumn("length", G.seg_length(G.seg()))

    base = seg.select(KEY, "line_id", *ENDS)
    owned = greedy_owned(base, [KEY], derive, rank, columns, cells, _overlaps(cfg), _overlaps_of(columns, cfg), ["line_id"])
    return owned.where(F.col("owner_line_id") == F.col("line_id")).select(KEY, "line_id", *ENDS)


def merge_collinear(seg: DataFrame, canvas=CANVAS, angle_reach: float = 1.5, pixels: float = 5.0) -> DataFrame:
    """Join pieces of one straight line: angle groups first, then seeds and their near-collinear pieces.

    Each result row spans the two farthest ends of its pieces. Output ids are the seeds' line ids; ``angle_group`` is
    the first line of the angle group. Groups come in the order of their first lines, seeds in theirs.
    """
    def turned(rows: DataFrame) -> DataFrame:
        raw = G.seg_angle(G.seg())
        return rows.withColumn("turn", F.when(raw < 0, raw + 180).otherwise(raw))

    near = lambda a, b: F.abs(F.col(f"{a}turn") - F.col(f"{b}turn")) < angle_reach
    near_rows = lambda a, b: abs(a[1] - b[1]) < angle_reach
    angle_cell = {"_ca": (F.col("turn"), angle_reach)}
    base = seg.select(KEY, "line_id", *ENDS)
    grouped = greedy_owned(
        base, [KEY], turned, F.col("line_id"), ["line_id", "turn", *ENDS], angle_cell, near, near_rows, ["line_id", "turn"]
    )
    # distance of the midpoint along the group's normal: pieces of one line differ by less than the reach
    diagonal = math.hypot(canvas.width, canvas.height)
    reach = pixels + diagonal * 2 * math.sin(math.radians(angle_reach / 2)) + 1
    # the groups are asked for twice below (sizes, then rows): computed once
    placed = cut(grouped.select(KEY, F.col("owner_line_id").alias("angle_group"), F.col("owner_turn").alias("group_turn"), "line_id", *ENDS))

    def shifted(rows: DataFrame) -> DataFrame:
        mx, my = G.midpoint(G.seg())
        theta = F.radians(F.col("group_turn"))
        return rows.withColumn("rho", my * F.cos(theta) - mx * F.sin(theta))

    def collinear(a: str, b: str) -> Column:
        s, w = G.seg(a), G.seg(b)
        return (
            ~G.segments_cross(s, w)
            & (G.point_line_distance(w.x1, w.y1, s) < pixels)
            & (G.point_line_distance(w.x2, w.y2, s) < pixels)
        )

    keys = [KEY, "angle_group"]
    columns = ["line_id", *ENDS, "rho"]
    rho_cell = {"_cr": (F.col("rho"), reach)}
    owned = greedy_owned(
        placed, keys, shifted, F.col("line_id"), columns, rho_cell, collinear, _collinear_of(columns, pixels), ["line_id"]
    )
    return _farthest_ends(owned.select(KEY, "angle_group", F.col("owner_line_id").alias("seed"), "line_id", *ENDS))


def _collinear_of(columns: list[str], pixels: float):
    """``collinear`` of ``merge_collinear`` on two rows as tuples of ``columns``."""
    at = columns.index("x1")

    def left(ax, ay, bx, by, cx, cy):
        return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)

    def test(a: tuple, b: tuple) -> bool:
        x1, y1, x2, y2 = a[at : at + 4]
        p, q, r, s = (x1, y1), (x2, y2), b[at : at + 2], b[at + 2 : at + 4]
        if left(*p, *r, *s) != left(*q, *r, *s) and left(*p, *q, *r) != left(*p, *q, *s):
            return False
        length = math.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
        for x, y in (r, s):
            if length == 0:
                far = math.sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1))
            else:
                far = abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1) / length
            if far >= pixels:
                return False
        return True

    return test


def merge_lines(seg: DataFrame) -> DataFrame:
    """Both merges as one job: collinear pieces first, then like lines in the order in which the first merge made them."""
    return merge_similar(cut(merge_collinear(seg).drop("pieces")), order=("angle_group", "line_id"))


def _farthest_ends(pieces: DataFrame) -> DataFrame:
    """Two farthest end points per seed; a lone piece stays as it is.

    Only the lowest and highest point of each pixel column can be an end of the longest span,
    so at most two points per column enter the pairing, however many pieces there are.
    """
    keys = [KEY, "seed"]
    first = F.struct("line_id", *ENDS)
    # every step below groups by these keys: the pieces are shuffled once
    ends = pieces.repartition(*keys).select(
        *keys,
        "angle_group",
        first.alias("own"),
        F.inline(
            F.array(
                F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("line_id") * 2).alias("pos")),
                F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), (F.col("line_id") * 2 + 1).alias("pos")),
            )
        ),
    )
    columns = ends.groupBy(*keys, "x").agg(
        F.min(F.struct("y", "pos")).alias("low"),
        F.min(F.struct((-F.col("y")).alias("y"), F.col("pos"))).alias("high"),
        count_rows().alias("ends"),
        F.min("own").alias("own"),
        F.min("angle_group").alias("angle_group"),
    )
    low = F.struct("x", F.col("low.y").alias("y"), F.col("low.pos").alias("pos"))
    high = F.struct("x", (-F.col("high.y")).alias("y"), F.col("high.pos").alias("pos"))
    facts = columns.groupBy(*keys).agg(
        F.array_distinct(F.flatten(F.collect_list(F.array(low, high)))).alias("points"),
        F.sum("ends").alias("ends"),
        F.min("own").alias("own"),
        F.min("angle_group").alias("angle_group"),
    )
    known = [*keys, "ends", "own", "angle_group"]
    pairs = facts.select(*known, "points", F.explode("points").alias("p")).select(*known, "p", F.explode("points").alias("q"))
    dx, dy = F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")
    # a point is its own partner where all ends are one point
    far = pairs.where(F.col("p.pos") <= F.col("q.pos")).groupBy(*keys).agg(
        F.max_by(F.struct("p", "q"), F.struct(dx * dx + dy * dy, -F.col("p.pos"), -F.col("q.pos"))).alias("f"),
        *(F.first(c).alias(c) for c in known[2:]),
    )
    pieces_of = (F.col("ends") / 2).cast("bigint")
    return far.select(
        KEY,
        "angle_group",
        F.col("seed").alias("line_id"),
        *(
            F.when(pieces_of == 1, F.col(f"own.{c}")).otherwise(F.col(f"f.{e}")).alias(c)
            for c, e in zip(ENDS, ("p.x", "p.y", "q.x", "q.y"))
        ),
        pieces_of.alias("pieces"),
    )


def _folded_90(seg: DataFrame) -> DataFrame:
    mx, my = G.midpoint(G.seg())
    return seg.withColumns({"mx": mx, "my": my, "fold": G.undirected_angle(G.seg_angle(G.seg()))})


def merge_similar(seg: DataFrame, pixels: float = 40.0, degrees: float = 3.0, order: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Average segments of like angle and near midpoint into their earliest one; ``order`` says which comes first."""
    rank = F.struct(*order)

    def alike(a: str, b: str) -> Column:
        apart = G.distance(F.col(f"{a}mx"), F.col(f"{a}my"), F.col(f"{b}mx"), F.col(f"{b}my"))
        return (F.abs(F.col(f"{a}fold") - F.col(f"{b}fold")) < degrees) & (apart < pixels)

    cells = {"_cx": (F.col("mx"), pixels), "_cy": (F.col("my"), pixels), "_ca": (F.col("fold"), degrees)}
    columns = ["line_id", *ENDS, "mx", "my", "fold"]
    f, x, y = (columns.index(c) for c in ("fold", "mx", "my"))

    def alike_rows(a: tuple, b: tuple) -> bool:
        dx, dy = a[x] - b[x], a[y] - b[y]
        return abs(a[f] - b[f]) < degrees and math.sqrt(dx * dx + dy * dy) < pixels

    base = seg.select(KEY, *dict.fromkeys([*order, "line_id"]), *ENDS)
    owned = greedy_owned(base, [KEY], _folded_90, rank, columns, cells, alike, alike_rows, ["line_id"])
    return owned.groupBy(KEY, F.col("owner_line_id").alias("line_id")).agg(
        *(F.avg(c).cast("int").alias(c) for c in ENDS), count_rows().alias("pieces")
    )


# --- trails and templates ------------------------------------------------------------------


def trail_segments(points: DataFrame, keys: tuple[str, ...] = (KEY, "stroke_id"), order: str = "seq") -> DataFrame:
    """Consecutive points of a stroke as segments."""
    rows = next_in_order(points, list(keys), order, ["x", "y"])
    return rows.where(F.col("next_x").isNotNull()).select(
        *keys, order, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("next_x").alias("x2"), F.col("next_y").alias("y2")
    )


def default_template(spark, reference_id: int = 1) -> DataFrame:
    """The nine template segments through the fixed corner points."""
    corners = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in TEMPLATE_POINTS]
    line = spark.range(1).select(F.posexplode(F.array(*corners)).alias("seq", "p"))
    rows = line.select(F.lit(reference_id).alias("reference_id"), "seq", "p.x", "p.y")
    ends = trail_segments(rows, ("reference_id",))
    return ends.select("reference_id", F.col("seq").alias("ref_id"), *ENDS)
