"""Pixel and ink tables: one row per pixel, keyed by drawing.

The canvas bounds a drawing (568 x 274 pixels), so a window or a list per drawing is bounded
as soon as its pixels are distinct.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from strokelake.config import ALIGNMENT, CANVAS, DETECTOR, Canvas, Detector
from strokelake.functions import geometry as G
from strokelake.operators.profile import count_rows
from strokelake.session import cut

KEY = "drawing_id"
CELL = 32  # side of a grid cell in pixels
SPAN = 1 << 32  # packing base for a pixel position: every 32-bit x, negative ones too, has its own place


def grey(method: str = "luma") -> Column:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    if method == "mean":
        return (r + g + b) / 3.0
    return 0.299 * r + 0.587 * g + 0.114 * b  # fixed values: luma weights


def explode_pixels(images: DataFrame, key: str = KEY) -> DataFrame:
    """Decoded images (``width, height, nChannels, data``) to pixel rows; bytes come B, G, R[, A].

    Transparent pixels are laid over white.
    """
    # image rows first, pixels second: a pixel row then carries only its own image row's bytes
    n, w = F.col("nChannels"), F.col("width")
    lines = images.select(
        key, "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")
    ).select(key, "width", "nChannels", "y", F.substring("data", F.col("y") * w * n + 1, w * n).alias("line"))
    rows = lines.select(
        key, "y", "nChannels", "line", F.explode(F.sequence(F.lit(0), w - 1)).alias("x")
    ).select(key, "x", "y", "nChannels", F.hex(F.substring("line", F.col("x") * n + 1, n)).alias("h"))

    def channel(c: Column) -> Column:
        return F.conv(F.substring(F.col("h"), c * 2 + 1, F.lit(2)), 16, 10).cast("int")

    blue, green, red = channel(F.lit(0)), channel(F.least(n - 1, F.lit(1))), channel(F.least(n - 1, F.lit(2)))
    alpha = F.when(n == 4, channel(F.lit(3)) / 255.0).otherwise(1.0)

    def over_white(c: Column) -> Column:
        return F.floor(c * alpha + 255 * (1 - alpha) + 0.5).cast("int")

    return rows.select(
        key,
        "x",
        "y",
        over_white(red).alias("r"),
        over_white(green).alias("g"),
        over_white(blue).alias("b"),
    )


def ink(pixels: DataFrame, threshold: int = CANVAS.binarise) -> DataFrame:
    """Dark pixels: grey at most the threshold (inverted binary mask)."""
    level = F.floor(grey() + 0.5)
    return pixels.where(level <= threshold).select(KEY, "x", "y")


def colour_mask(pixels: DataFrame, r_min: int = 200, g_max: int = 100, b_max: int = 100) -> DataFrame:
    return pixels.where((F.col("r") >= r_min) & (F.col("g") <= g_max) & (F.col("b") <= b_max)).select(KEY, "x", "y")


def content_bbox(ink_rows: DataFrame, canvas: Canvas = CANVAS, pad: int = CANVAS.crop_padding) -> DataFrame:
    """Padded box of the ink, held inside the image; drawings without ink have no row."""
    return ink_rows.groupBy(KEY).agg(
        F.greatest(F.min("x") - pad, F.lit(0)).alias("x_min"),
        F.greatest(F.min("y") - pad, F.lit(0)).alias("y_min"),
        F.least(F.max("x") + pad, F.lit(canvas.width - 1)).alias("x_max"),
        F.least(F.max("y") + pad, F.lit(canvas.height - 1)).alias("y_max"),
    )


def points_bbox(points: DataFrame, pad: int = 0, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    return points.groupBy(*keys).agg(
        (F.min("x") - pad).alias("x_min"),
        (F.min("y") - pad).alias("y_min"),
        (F.max("x") + pad).alias("x_max"),
        (F.max("y") + pad).alias("y_max"),
        count_rows().alias("points"),
    )


def crop(ink_rows: DataFrame, bbox: DataFrame) -> DataFrame:
    """Ink inside its drawing's box, re-origined to the box."""
    box = bbox.select(KEY, "x_min", "y_min", "x_max", "y_max")
    inside = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    return ink_rows.join(box, KEY).where(inside).select(
        KEY, (F.col("x") - F.col("x_min")).alias("x"), (F.col("y") - F.col("y_min")).alias("y")
    )


def ink_stats(ink_rows: DataFrame, canvas: Canvas = CANVAS, least: int = ALIGNMENT.min_ink) -> DataFrame:
    return ink_rows.groupBy(KEY).agg(count_rows().alias("ink")).select(
        KEY, "ink", (F.col("ink") >= least).alias("enough"), (F.col("ink") / (canvas.width * canvas.height)).alias("coverage")
    )


def mask_overlap(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Pixels of both masks per key: in both, in either, only in one.

    Tagged union and one aggregation per pixel instead of a full join.
    """
    one = a.select(*keys, "x", "y", F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    two = b.select(*keys, "x", "y", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    cell = one.unionByName(two).groupBy(*keys, "x", "y").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return cell.groupBy(*keys).agg(
        F.sum(F.col("_a") * F.col("_b")).alias("intersection"),
        count_rows().alias("union"),
        F.sum(F.col("_a") * (1 - F.col("_b"))).alias("only_a"),
        F.sum((1 - F.col("_a")) * F.col("_b")).alias("only_b"),
    )


def iou(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    return mask_overlap(a, b, keys).withColumn("iou", F.col("intersection") / F.col("union"))


def clean_borders(dark: DataFrame, canvas: Canvas = CANVAS, border: int = 5, share: float = 0.05) -> DataFrame:
    """Blank border strips with under ``share`` dark pixels; shares are taken before any blanking.

    ``dark`` holds the dark pixels. Four conditional counts per drawing decide the strips.
    """
    w, h = canvas.width, canvas.height
    strips = {
        "top": (F.col("y") < border, border * w),
        "bottom": (F.col("y") >= h - border, border * w),
        "left": (F.col("x") < border, border * h),
        "right": (F.col("x") >= w - border, border * h),
    }
    sparse = dark.groupBy(KEY).agg(
        *((F.count_if(inside) / size < share).alias(f"_{name}") for name, (inside, size) in strips.items())
    )
    blank = F.lit(False)
    for name, (inside, _) in strips.items():
        blank = blank | (F.col(f"_{name}") & inside)
    return dark.join(sparse, KEY).where(~blank).select(*dark.columns)


def prescale(source: DataFrame, reference: DataFrame, pair: str = KEY) -> DataFrame:
    """Size factor that brings a drawing to its reference: 1 when alike, else held in 0.5-2.5.

    Both sides are unpadded boxes (``x_min .. y_max``) with a common ``pair`` column.
    """
    s = source.select(pair, (F.col("y_max") - F.col("y_min")).alias("sh"), (F.col("x_max") - F.col("x_min")).alias("sw"))
    r = reference.select(pair, (F.col("y_max") - F.col("y_min")).alias("rh"), (F.col("x_max") - F.col("x_min")).alias("rw"))
    by_h = F.when(F.col("sh") > 0, F.col("rh") / F.col("sh")).otherwise(1.0)
    by_w = F.when(F.col("sw") > 0, F.col("rw") / F.col("sw")).otherwise(1.0)
    raw = F.least(by_h, by_w)
    lo, hi = ALIGNMENT.similar
    held = G.clip(raw, *ALIGNMENT.prescale)
    return s.join(r, pair).select(
        pair, raw.alias("potential_scale"), F.when(raw.between(lo, hi), 1.0).otherwise(held).alias("scale")
    )


def fit_to_canvas(points: DataFrame, width: int = CANVAS.width, height: int = CANVAS.height, mode: str = "contain") -> DataFrame:
    """Map points of a ``w`` x ``h`` drawing onto the canvas: one scale and centring, or per-axis stretch."""
    if mode == "stretch":
        return points.select(
            "*", (F.col("x") * (width / F.col("w"))).alias("fx"), (F.col("y") * (height / F.col("h"))).alias("fy")
        )
    if mode != "contain":
        raise ValueError(f"unknown mode: {mode}")
    scale = G.fit_scale(F.col("w"), F.col("h"), width, height)
    new_w = F.least(F.bround(F.col("w") * scale), F.lit(float(width)))
    new_h = F.least(F.bround(F.col("h") * scale), F.lit(float(height)))
    return points.select(
        "*",
        (F.col("x") * scale + F.floor((width - new_w) / 2)).alias("fx"),
        (F.col("y") * scale + F.floor((height - new_h) / 2)).alias("fy"),
    )


def rasterise(seg: DataFrame, canvas: Canvas = CANVAS, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Ink pixels of segments, sampled once per step of the longer axis.

    Segments are brought together by key and grow to pixels inside the task, which drops copies at once: pixels are not
    shuffled. A task holds a chunk of pixels and those of one key, which the canvas bounds.
    """
    ends = ["x1", "y1", "x2", "y2"]
    known = seg.select(*keys, *ends).dropna(subset=ends).repartition(*keys).sortWithinPartitions(*keys)
    width, height, chunk = canvas.width, canvas.height, 1 << 20
    kinds = [known.schema[k] for k in keys]

    def packed(s: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct pixels of some segments: owner, row and column in one number."""
        dx, dy = s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]
        steps = np.trunc(np.maximum(np.abs(dx), np.abs(dy))).astype(np.int64)
        of = np.repeat(np.arange(len(s)), steps + 1)
        i = np.arange(len(of)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
        n = np.maximum(steps, 1)[of]
        # half-up rounding on whole numbers keeps every engine on the same pixel
        x, y = (np.trunc(s[of, j] + np.floor((2 * i * d[of] + n) / (2 * n))).astype(np.int64) for j, d in ((0, dx), (1, dy)))
        ok = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        return _sorted_set((owner[of[ok]] * height + y[ok]) * width + x[ok])

    def draw(batches):
        def rows(names, codes):
            place, x = np.divmod(codes, width)
            who, y = np.divmod(place, height)
            columns = [pa.array([name[j] for name in names], type_of[j]).take(pa.array(who)) for j in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(x, pa.int32()), pa.array(y, pa.int32())], [*keys, "x", "y"])

        last, held = None, np.zeros(0, np.int64)  # the key that may go on, and its pixels so far
        for batch in batches:
            type_of = [batch.schema.field(k).type for k in keys]
            own = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            s = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ends], axis=1)
            size = np.maximum(np.abs(s[:, 2] - s[:, 0]), np.abs(s[:, 3] - s[:, 1])) + 1
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // chunk)) + 1
            for at in np.split(np.arange(len(s)), cuts):
                names, owner = ([] if last is None else [last]), []
                for k in (own[j] for j in at):
                    if not names or names[-1] != k:
                        names.append(k)
                    owner.append(len(names) - 1)
                codes = _sorted_set(np.concatenate([held, packed(s[at], np.array(owner, np.int64))]))
                open_from = np.searchsorted(codes, (len(names) - 1) * height * width)
                if open_from:
                    yield rows(names, codes[:open_from])
                if names:
                    last, held = names[-1], codes[open_from:] - (len(names) - 1) * height * width
        if len(held):
            yield rows([last], held)

    return known.mapInArrow(draw, StructType([*kinds, StructField("x", IntegerType()), StructField("y", IntegerType())]))


def _sorted_set(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def grid_counts(ink_rows: DataFrame, nx: int, ny: int, canvas: Canvas = CANVAS) -> DataFrame:
    """Ink per cell of a coarse grid and its share of the cell, cells with ink only."""
    gx = F.floor(F.col("x") * nx / canvas.width).cast("int")
    gy = F.floor(F.col("y") * ny / canvas.height).cast("int")
    area = (canvas.width / nx) * (canvas.height / ny)
    return ink_rows.groupBy(KEY, gx.alias("gx"), gy.alias("gy")).agg(count_rows().alias("n")).withColumn(
        "share", F.least(F.lit(1.0), F.col("n") / area)
    )


def grid_features(ink_rows: DataFrame, nx: int = 8, ny: int = 4, canvas: Canvas = CANVAS) -> DataFrame:
    """Dense array of nx*ny cell shares per drawing, row by row."""
    cells = grid_counts(ink_rows, nx, ny, canvas)
    place = F.col("gy") * nx + F.col("gx")
    sums = cells.groupBy(KEY).agg(
        *(F.coalesce(F.sum(F.when(place == i, F.col("share"))), F.lit(0.0)).alias(f"_c{i}") for i in range(nx * ny))
    )
    return sums.select(KEY, F.array(*(f"_c{i}" for i in range(nx * ny))).alias("features"))


def validate_raster(df: DataFrame, canvas: Canvas = CANVAS) -> DataFrame:
    """Findings on image size and on the stored extraction metadata."""
    size = F.format_string("Image resolution mismatch: expected 568x274, got %dx%d", F.col("width"), F.col("height"))
    errors = F.array_compact(
        F.array(
            F.when((F.col("width") != canvas.width) | (F.col("height") != canvas.height), size),
            F.when(
                F.col("meta_width").isNotNull()
                & ((F.col("meta_width") != canvas.width) | (F.col("meta_height") != canvas.height)),
                F.lit("Metadata resolution mismatch: expected 568x274"),
            ),
            F.when(
                F.col("meta_thickness").isNotNull() & (F.col("meta_thickness") != canvas.line_thickness),
                F.lit("Metadata line_thickness mismatch: expected 2.0"),
            ),
        )
    )
    return df.withColumn("errors", errors)


# --- lines in ink --------------------------------------------------------------------------


def line_votes(ink_rows: DataFrame, dtheta: int = 1) -> DataFrame:
    """Votes of ink for straight lines (theta in degrees, whole-pixel rho).

    A drawing's ink is brought together and counted in one table of directions and distances; neither the rows of all
    pixels and directions nor the votes are shuffled. Pixels are counted in chunks, repeated ones as well.
    """
    turn = F.radians(F.col("d").cast("double"))
    # sines by Spark: the last digit decides at the edge between two distances
    turns = ink_rows.sparkSession.range(0, 180, dtheta).select(F.col("id").alias("d")).select("d", F.cos(turn), F.sin(turn)).collect()
    theta, cos, sin = (np.array(c) for c in zip(*sorted(map(tuple, turns))))
    ordered = ink_rows.select(KEY, "x", "y").repartition(KEY).sortWithinPartitions(KEY)
    kind = ordered.schema[KEY]

    def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows of place of theta, rho and votes, of some pixels."""
        parts = []
        for at in range(0, len(x), 8192):
            px, py = x[at : at + 8192, None], y[at : at + 8192, None]
            rho = np.floor(px * cos + py * sin + 0.5).astype(np.int64)
            parts.append(_counted(np.broadcast_to(np.arange(len(cos)), rho.shape).ravel(), rho.ravel(), None))
        return _merged(parts)

    def vote(batches):
        def rows(key, parts, unknown):
            turn_at, rho, votes = _merged(parts)
            columns = [np.r_[theta[turn_at], theta if unknown else theta[:0]], np.r_[votes, np.full(len(theta) if unknown else 0, unknown)]]
            far = pa.concat_arrays([pa.array(rho, pa.int32()), pa.nulls(len(columns[0]) - len(rho), pa.int32())])
            keys = pa.repeat(pa.scalar(key, key_type), len(far))
            return pa.RecordBatch.from_arrays([keys, pa.array(columns[0], pa.int32()), far, pa.array(columns[1], pa.int64())], [KEY, "theta", "rho", "votes"])

        key, parts, unknown = None, None, 0
        for batch in batches:
            key_type = batch.schema.field(KEY).type
            own = batch.column(KEY).to_pylist()
            known = pc.and_(pc.is_valid(batch.column("x")), pc.is_valid(batch.column("y"))).to_numpy(zero_copy_only=False)
            x, y = (pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y"))
            starts = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
            for low, high in zip(starts, [*starts[1:], len(own)]):
                if parts is None or own[low] != key:
                    if parts is not None:
                        yield rows(key, parts, unknown)
                    key, parts, unknown = own[low], [], 0
                ok = known[low:high]
                unknown += int((~ok).sum())  # a pixel without a place votes for no distance, as in SQL
                parts = [_merged([*parts, count(x[low:high][ok], y[low:high][ok])])]
        if parts is not None:
            yield rows(key, parts, unknown)

    return ordered.mapInArrow(vote, StructType([kind, StructField("theta", IntegerType()), StructField("rho", IntegerType()), StructField("votes", LongType())]))


def _counted(turn: np.ndarray, rho: np.ndarray, votes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes by direction and distance, in order."""
    if not len(rho):
        return (np.zeros(0, np.int64),) * 3
    base, width = int(rho.min()), int(rho.max()) - int(rho.min()) + 1
    place = turn * width + (rho - base)
    if width < 1 << 14:
        table = np.bincount(place, votes).astype(np.int64)
        cells = np.flatnonzero(table)
        votes = table[cells]
    else:  # positions far outside a canvas
        cells, of = np.unique(place, return_inverse=True)
        votes = np.bincount(of, votes).astype(np.int64)
    turn, at = np.divmod(cells, width)
    return turn, at + base, votes


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return parts[0] if len(parts) == 1 else _counted(*(np.concatenate(c) for c in zip(*parts))) if parts else _counted(*(np.zeros(0, np.int64),) * 3)


def vote_peaks(votes: DataFrame, least: int = DETECTOR.strict_votes, n: int | None = None) -> DataFrame:
    """Cells with enough votes, strongest first when limited to n per drawing."""
    rows = votes.where(F.col("votes") >= least)
    if n is None:
        return rows
    order = W.partitionBy(KEY).orderBy(F.desc("votes"), "theta", "rho")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def ink_runs(
    on_line: DataFrame, gap: int = DETECTOR.max_gap, least: int = DETECTOR.strict_length, line: tuple[str, ...] = ("line",)
) -> DataFrame:
    """Runs of ink along each line: neighbours at most ``gap`` apart, run at least ``least`` long.

    ``on_line`` holds whole-pixel positions ``pos`` along the line; distinct positions of a line
    are bounded by the canvas diagonal, so the window is small.
    """
    keys = [KEY, *line]
    rows = on_line.select(*keys, "pos").distinct()
    order = W.partitionBy(*keys).orderBy("pos")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(order) > gap).cast("int"), F.lit(0))
    island = F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))
    tagged = rows.withColumn("_new", new).withColumn("run", island)
    return tagged.groupBy(*keys, "run").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), count_rows().alias("ink")
    ).where(F.col("end") - F.col("start") >= least)


def erase_near(ink_rows: DataFrame, seg: DataFrame, radius: float = DETECTOR.erase_radius) -> DataFrame:
    """Ink farther than ``radius`` from every segment of its drawing.

    Ink meets the segments that come near its own grid cell. Both sides are shuffled by cell: Spark's estimate of the
    segment side does not see that it grows, so a broadcast would send all of it through the driver.
    """
    cells = near_cells(seg, radius)
    placed = ink_rows.withColumns({c: F.floor(F.col(v) / CELL) for c, v in (("_cx", "x"), ("_cy", "y"))})
    near = G.point_segment_distance(F.col("x"), F.col("y"), G.seg("s_")) <= radius
    same = [placed[c] == cells[f"s{c}"] for c in ("_cx", "_cy")]
    return placed.join(cells.hint("merge"), [placed[KEY] == cells["s_key"], *same, near], "left_anti").select(*ink_rows.columns)


def near_cells(seg: DataFrame, radius: float) -> DataFrame:
    """Segments (``s_key, s_x1 .. s_y2``) next to the grid cells that hold a point within ``radius`` of them.

    Per column of cells only the part of the segment that can be nearest to it counts, so the cells of a segment
    grow with its length.
    """
    reach = float(radius) + 1  # a pixel more than needed: no cell is lost by rounding
    s = G.seg("s_")
    named = seg.select(F.col(KEY).alias("s_key"), *(F.col(c).alias(f"s_{c}") for c in ("x1", "y1", "x2", "y2")))

    def places(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor((low - reach) / CELL), F.floor((high + reach) / CELL)))

    columns = named.select("*", places(F.least(s.x1, s.x2), F.greatest(s.x1, s.x2)).alias("s_cx"))
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    left, right = F.col("s_cx") * CELL - reach, (F.col("s_cx") + 1) * CELL + reach
    ends = [F.when(dx == 0, float(i)).otherwise(G.clip((side - s.x1) / F.nullif(dx, F.lit(0)), 0.0, 1.0)) for i, side in enumerate((left, right))]
    at = [s.y1 + t * dy for t in ends]
    return columns.select("*", places(F.least(*at), F.greatest(*at)).alias("s_cy"))


def packed_place(x: str = "x") -> Column:
    return F.col("y").cast("long") * F.lit(SPAN) + F.col(x)


def unpack_places(packed) -> np.ndarray:
    """Rows of x and y."""
    packed = np.asarray(packed, dtype=np.int64)
    y = (packed + SPAN // 2) // SPAN
    return np.stack([packed - y * SPAN, y], axis=1)


def pack_ink(ink_rows: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """A drawing's ink as one sorted array of packed positions; distinct pixels bound its size."""
    return ink_rows.groupBy(*keys).agg(F.array_sort(F.collect_set(packed_place())).alias("ink"))


def detect_segments(ink_rows: DataFrame, cfg: Detector = DETECTOR) -> DataFrame:
    """Straight segments of each drawing, longest first.

    One shuffle brings each drawing's ink (bounded by the canvas) together, a second deals the arrays out: the work per byte is
    large, so the number of tasks does not follow the bytes. The rounds of "take the longest run, erase its ink" then run on
    that array inside the task.
    """
    tasks = int(ink_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = pack_ink(ink_rows).repartition(tasks, F.xxhash64(KEY))  # by the key itself Spark would keep the few tasks of the first shuffle
    found = rounds.select(KEY, F.posexplode(_find_lines(cfg)("ink")).alias("pos", "s"))
    return found.select(KEY, (F.col("pos") + 1).alias("line_id"), "s.*")


def _find_lines(cfg: Detector):
    @F.pandas_udf("array<struct<x1:int,y1:int,x2:int,y2:int>>")
    def find(inks: pd.Series) -> pd.Series:
        return inks.map(lambda packed: [dict(zip(("x1", "y1", "x2", "y2"), map(int, s))) for s in find_lines(packed, cfg)])

    return find


def find_lines(packed: np.ndarray, cfg: Detector = DETECTOR) -> list[tuple]:
    """Votes, longest run on the strongest lines, overlap test, erase; strict rounds, then relaxed."""
    points = unpack_places(np.asarray(packed)).astype(np.float64)
    turns = np.radians(np.arange(180))
    normals = np.stack([np.cos(turns), np.sin(turns)])
    bands = _Bands(points, np.floor(points @ normals + 0.5).astype(np.int32), normals)
    left = np.ones(len(points), bool)
    kept: list[tuple] = []
    for step in range(cfg.rounds):
        strict = step < cfg.strict_rounds
        votes_needed = cfg.strict_votes if strict else cfg.relaxed_votes
        length_needed = cfg.strict_length if strict else cfg.relaxed_length
        best = bands.longest_run(votes_needed, length_needed, cfg.max_gap) if left.any() else None
        if best is None:
            break
        if not any(_alike(best, other, cfg) for other in kept):
            kept.append(best)
        left &= _distance_to(points, best) > cfg.erase_radius
        bands.keep(left)
        if len(kept) >= cfg.max_lines:
            break
    return [s for s in kept if np.hypot(s[2] - s[0], s[3] - s[1]) >= cfg.final_length]


class _Bands:
    """Points in order of their whole-pixel distance for each direction, so that a band of distances is a run of places."""

    def __init__(self, points: np.ndarray, rho: np.ndarray, normals: np.ndarray):
        self.points, self.normals = points, normals
        if not rho.size:
            return
        rho = rho.T - rho.min()
        self.width = int(rho.max()) + 8  # three empty distances on both sides at least
        small = rho.astype(np.int16) if self.width < 1 << 15 else rho  # sorted by digits
        self.order = np.argsort(small, axis=1, kind="stable").astype(np.int32)
        self.cell = np.take_along_axis(rho, self.order, 1) + 4 + np.arange(len(rho), dtype=np.int32)[:, None] * self.width
        near = np.abs(points).max() < 4096
        along = np.stack([-normals[1], normals[0]], axis=1) @ points.T
        self.along = np.take_along_axis(along.astype(np.float32) if near else along, self.order, 1)
        self.order, self.cell, self.along = (x.ravel() for x in (self.order, self.cell, self.along))

    def keep(self, left: np.ndarray) -> None:
        still = left[self.order]
        self.order, self.cell, self.along = self.order[still], self.cell[still], self.along[still]

    def strong(self, least: int) -> tuple[np.ndarray, ...]:
        """Cells with enough votes, their votes, the places of their bands, and the bands' lengths (never too small)."""
        votes = np.bincount(self.cell)
        cells = np.flatnonzero(votes >= least)
        # whole-degree directions drift by up to half a degree over a long stroke
        low, high = np.searchsorted(self.cell, cells - 3), np.searchsorted(self.cell, cells + 4)
        places = np.stack([low, high], axis=1).ravel()
        ends = np.append(self.along, self.along[-1:])
        extent = np.maximum.reduceat(ends, places)[::2] - np.minimum.reduceat(ends, places)[::2] if len(cells) else np.zeros(0)
        return cells, votes[cells], low, high, extent.astype(np.float64) + 0.01

    def longest_run(self, votes_needed, length_needed, max_gap):
        """The longest run of all cells with enough votes; a cell is left out if its band is shorter than a run found before."""
        cells, votes, low, high, extent = self.strong(votes_needed)
        # no run of the band is longer than its diagonal; it is at most seven pixels wide and a pixel wider by rounding
        bound = np.hypot(extent, 8)
        longest, mark, best = -1.0, (0, 0), None
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < max(longest, length_needed):
                break
            turn = int(cells[k]) // self.width
            on = self.points[np.sort(self.order[low[k] : high[k]])]
            along = on @ np.array([-self.normals[1, turn], self.normals[0, turn]])
            order = np.argsort(along, kind="stable")
            on, along = on[order], along[order]
            edges = np.flatnonzero(along[1:] - along[:-1] > max_gap)
            starts, ends = np.append(0, edges + 1), np.append(edges, len(along) - 1)
            full = ends - starts + 1 >= votes_needed
            starts, ends = starts[full], ends[full]
            if not len(starts):
                continue
            lengths = np.hypot(*(on[ends] - on[starts]).T)
            i = int(np.argmax(lengths))
            here = (int(votes[k]), -int(cells[k]))  # of equal lengths the cell with most votes counts
            if lengths[i] >= length_needed and (lengths[i], here) > (longest, mark):
                longest, mark, best = float(lengths[i]), here, (*on[starts[i]].astype(int), *on[ends[i]].astype(int))
        return best


def _longest_run(points, rho, normals, votes_needed, length_needed, max_gap):
    return _Bands(points, rho, normals).longest_run(votes_needed, length_needed, max_gap) if len(points) else None


def _alike(a, b, cfg: Detector) -> bool:
    def fold(s):
        return np.degrees(np.arctan2(s[3] - s[1], s[2] - s[0])) % 180

    gap = abs(fold(a) - fold(b))
    apart = np.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
    return gap < cfg.overlap_angle and apart < cfg.overlap_distance


def _distance_to(points, s):
    a, d = np.array(s[:2], float), np.array([s[2] - s[0], s[3] - s[1]], float)
    t = np.clip((points - a) @ d / max(d @ d, 1e-9), 0, 1)
    return np.hypot(*(points - a - t[:, None] * d).T)


def ink_components(ink_rows: DataFrame) -> DataFrame:
    """Number of 8-connected ink components per drawing.

    Pixels shrink to horizontal runs first; runs of neighbouring rows that touch are edges.
    Labels then fall to the smallest reachable run, with a jump to the label's own label per
    round, so the rounds grow with the logarithm of a component's size.
    """
    runs = horizontal_runs(ink_rows)
    a = runs.select(KEY, F.col("y").alias("y"), F.col("run_id").alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = runs.select(KEY, (F.col("y") - 1).alias("y"), F.col("run_id").alias("b"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    touch = (F.col("a0") <= F.col("b1") + 1) & (F.col("b0") <= F.col("a1") + 1)
    half = a.join(b, [KEY, "y"]).where(touch).select(KEY, "a", "b")
    edges = cut(half.unionByName(half.select(KEY, F.col("b").alias("a"), F.col("a").alias("b"))))
    state = cut(runs.select(KEY, F.col("run_id").alias("node"), F.col("run_id").alias("label")))
    while True:
        label_of = state.select(KEY, F.col("node").alias("b"), F.col("label").alias("_l"))
        low = edges.join(label_of, [KEY, "b"]).groupBy(KEY, F.col("a").alias("node")).agg(F.min("_l").alias("_low"))
        near = state.join(low, [KEY, "node"], "left").select(
            KEY, "node", "label", F.least("label", F.coalesce("_low", "label")).alias("_new")
        )
        # hook: the old label's own run also learns the lower label
        hooks = near.groupBy(KEY, F.col("label").alias("node")).agg(F.min("_new").alias("_hook"))
        hooked = near.join(hooks, [KEY, "node"], "left").select(
            KEY, "node", "label", F.least("_new", F.coalesce("_hook", "_new")).alias("_new")
        )
        hooked = cut(hooked)
        jump = hooked.select(KEY, F.col("node").alias("_new"), F.col("_new").alias("_far"))
        following = cut(
            hooked.join(jump, [KEY, "_new"]).select(KEY, "node", F.col("_far").alias("label"), (F.col("_far") != F.col("label")).alias("_changed"))
        )
        changed = not following.where("_changed").isEmpty()
        state = following.select(KEY, "node", "label")
        if not changed:
            break
    return state.where(F.col("node") == F.col("label")).groupBy(KEY).agg(count_rows().alias("components"))


def horizontal_runs(ink_rows: DataFrame) -> DataFrame:
    """Maximal horizontal runs ``y, x0, x1`` with an id in reading order."""
    rows = ink_rows.select(KEY, "x", "y").distinct()
    order = W.partitionBy(KEY, "y").orderBy("x")
    start = F.col("x") - F.row_number().over(order)
    runs = rows.withColumn("_g", start).groupBy(KEY, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return runs.select(KEY, "y", "x0", "x1", packed_place("x0").alias("run_id"))
