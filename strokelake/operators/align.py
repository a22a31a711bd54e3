"""Aligning a drawing's ink to a reference by a two-pass search over rotation, scale and shift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strokelake.config import ALIGNMENT, CANVAS, Alignment, Canvas
from strokelake.operators.raster import pack_ink, points_bbox, prescale, unpack_places
from strokelake.session import cut

PAIR = "pair_id"
HITS = 1 << 18  # places looked at, or pixels met, by one drawing over all shifts; beyond, a correlation is cheaper
RESULT = "struct<rotation:double,scale:double,tx:int,ty:int,iou:double>"


def align(
    source: DataFrame,
    reference: DataFrame,
    rotation_step: float = 3.0,
    scale_step: float = 0.05,
    cfg: Alignment = ALIGNMENT,
    canvas: Canvas = CANVAS,
) -> DataFrame:
    """Best similarity transform per ``pair_id`` and whether it is accepted.

    Both inputs are ink rows ``pair_id, x, y``. Each side becomes one packed array (bounded by
    the canvas). A pair is one row, dealt to tasks by its key; all shifts of one rotation and scale
    are scored together. A finer pass follows around the best coarse result.
    """
    keys = (PAIR,)
    boxes = prescale(points_bbox(source, keys=keys), points_bbox(reference, keys=keys), PAIR)
    src = pack_ink(source, keys).withColumnRenamed("ink", "src")
    ref = pack_ink(reference, keys).withColumnRenamed("ink", "ref")
    both = src.join(ref, PAIR, "left").join(boxes.select(PAIR, F.col("scale").alias("pre")), PAIR, "left")
    enough = (F.size("src") >= cfg.min_ink) & (F.coalesce(F.size("ref"), F.lit(0)) >= cfg.min_ink)
    # little data, much work: a number of tasks that small arrays do not lower
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = cut(both.withColumn("enough", F.coalesce(enough, F.lit(False)))).repartition(tasks, PAIR)
    half = int(cfg.max_rotation // rotation_step)
    coarse = [i * rotation_step for i in range(-half, half + 1)]
    scales = np.arange(cfg.scale[0], cfg.scale[1] + 1e-9, scale_step).tolist()
    first = cut(_search(ready.where("enough"), [F.lit(r) for r in coarse], [F.lit(s) for s in scales], cfg, canvas))
    around = ready.where("enough").join(first.select(PAIR, F.col("best").alias("near")), PAIR)
    fine_r = [F.col("near.rotation") + d for d in np.linspace(-rotation_step, rotation_step, 9).tolist()]
    fine_s = [
        F.greatest(F.lit(cfg.scale[0]), F.least(F.lit(cfg.scale[1]), F.col("near.scale") + d))
        for d in np.linspace(-scale_step, scale_step, 5).tolist()
    ]
    second = _search(around, fine_r, fine_s, cfg, canvas)
    found = ready.select(PAIR, "enough", F.coalesce("pre", F.lit(1.0)).alias("pre_scale")).join(second, PAIR, "left")
    ok = F.col("enough") & (F.col("best.iou") >= cfg.accept_iou)
    reason = F.when(~F.col("enough"), "Too few black pixels").when(
        ~ok,
        F.format_string("Low IoU score (%.4f < 0.15) - images too different", F.col("best.iou")),
    )
    return found.select(
        PAIR,
        F.coalesce(ok, F.lit(False)).alias("success"),
        reason.alias("reason"),
        F.when(ok, F.col("best.rotation")).otherwise(0.0).alias("rotation_degrees"),
        F.when(ok, F.col("best.scale")).otherwise(1.0).alias("scale"),
        F.when(ok, F.col("best.tx")).otherwise(0).alias("translation_x"),
        F.when(ok, F.col("best.ty")).otherwise(0).alias("translation_y"),
        "pre_scale",
        F.col("best.iou").alias("overlap_score"),
    )


def _search(rows: DataFrame, rotations: list[Column], scales: list[Column], cfg: Alignment, canvas: Canvas) -> DataFrame:
    score = _scorer(cfg.max_shift, canvas.width, canvas.height)
    scored = rows.select(PAIR, score("src", "ref", "pre", F.array(*rotations), F.array(*scales)).alias("tried"))
    # ties go to the smaller change
    order = F.transform(
        "tried",
        lambda b: F.struct(
            b["iou"].alias("iou"), (-F.abs(b["rotation"])).alias("turn"), (-F.abs(b["scale"] - 1)).alias("change"),
            b["rotation"].alias("rotation"), b.alias("b"),
        ),
    )
    return scored.select(PAIR, F.array_max(order)["b"].alias("best"))


def _scorer(max_shift: int, width: int, height: int):
    @F.pandas_udf(f"array<{RESULT}>")
    def best_of(src: pd.Series, ref: pd.Series, pre: pd.Series, rotations: pd.Series, scales: pd.Series) -> pd.Series:
        names = ("rotation", "scale", "tx", "ty", "iou")
        return pd.Series(
            [
                [dict(zip(names, b)) for b in best_shifts(s, r, p, turns, each, max_shift, width, height)]
                for s, r, p, turns, each in zip(src, ref, pre, rotations, scales)
            ]
        )

    return best_of


def move(points: np.ndarray, turn: float, scale: float, width: int, height: int) -> np.ndarray:
    """Rotate (image axes, y down) and scale about the canvas centre, to whole pixels."""
    centre = np.array([width / 2, height / 2])
    c, s = scale * np.cos(np.radians(turn)), scale * np.sin(np.radians(turn))
    return np.floor((points - centre) @ np.array([[c, -s], [s, c]]) + centre + 0.5).astype(int)


def best_shifts(src, ref, pre, turns, scales, max_shift, width, height) -> list[tuple]:
    """Best (rotation, scale, shift, IoU) of each rotation: overlaps of all shifts at once, then IoU on the canvas."""
    points = unpack_places(src).astype(float)
    if pre and pre != 1.0:
        points = move(points, 0.0, pre, width, height).astype(float)
    overlaps = Overlaps(unpack_places(ref), max_shift, width, height)
    shifts = np.arange(-max_shift, max_shift + 1)
    out = []
    for turn in turns:
        best = (float(turn), 1.0, 0, 0, -1.0)
        for scale in scales:
            moved = overlaps.places(move(points, turn, scale, width, height))
            overlap = overlaps.count(moved)
            union = overlaps.held(moved) + np.float32(overlaps.size) - overlap
            score = np.where(union > 0, overlap / np.maximum(union, 1), 0.0)
            i, j = np.unravel_index(np.argmax(score), score.shape)
            if score[i, j] > best[4]:
                best = (float(turn), float(scale), int(shifts[j]), int(shifts[i]), float(score[i, j]))
        out.append(best)
    return out


class Overlaps:
    """Numbers of reference pixels that moved ink meets, for all shifts up to ``max_shift`` on both axes.

    Sparse ink is counted hit by hit: the reference pixels near a pixel stand in a few runs of the row-major order.
    Ink with more than ``HITS`` of them is counted by a correlation, so time and memory are bounded by the canvas.
    """

    def __init__(self, ref: np.ndarray, max_shift: int, width: int, height: int):
        self.pad, self.width, self.height = max_shift, width, height
        self.shape = (height + 2 * max_shift, width + 2 * max_shift)
        self.ref = self.places(ref)
        self.size = len(self.ref)
        self.stride = self.shape[1] + 2 * max_shift + 1  # a margin on all sides: no run goes on in the next row
        y, x = np.divmod(self.ref, self.shape[1])
        marks = np.zeros((self.shape[0] + 2 * max_shift) * self.stride + 1, np.int32)
        marks[(y + max_shift) * self.stride + x + max_shift + 1] = 1
        self.before = np.cumsum(marks, dtype=np.int32)
        self.ref_x = x + max_shift
        self.spectrum = None

    def places(self, points: np.ndarray) -> np.ndarray:
        """Distinct places on the canvas and its margin, row by row."""
        at = points + self.pad
        ok = (at[:, 0] >= 0) & (at[:, 0] < self.shape[1]) & (at[:, 1] >= 0) & (at[:, 1] < self.shape[0])
        found = np.zeros(self.shape[0] * self.shape[1], bool)
        found[at[ok, 1] * self.shape[1] + at[ok, 0]] = True
        return np.flatnonzero(found)

    def count(self, moved: np.ndarray) -> np.ndarray:
        side = 2 * self.pad + 1
        if len(moved) * side <= HITS:
            y, x = np.divmod(moved, self.shape[1])
            rows = np.arange(side)
            first = ((y[:, None] + rows) * self.stride + x[:, None]).ravel()
            low = self.before[first]
            hits = self.before[first + side] - low
            total = int(hits.sum())
            if total <= HITS:
                some = np.flatnonzero(hits)
                low, hits = low[some], hits[some]
                at = np.arange(total) + np.repeat(low - (np.cumsum(hits) - hits), hits)
                shift = self.ref_x[at] + np.repeat(some % side * side - x[some // side], hits)
                return np.bincount(shift, minlength=side * side).reshape(side, side).astype(np.float32)
        return self.correlate(moved)

    def correlate(self, moved: np.ndarray) -> np.ndarray:
        size = tuple(map(fast_size, self.shape))
        if self.spectrum is None:
            self.spectrum = np.fft.rfft2(self._mask(self.ref), s=size)
        overlap = np.fft.irfft2(self.spectrum * np.conj(np.fft.rfft2(self._mask(moved), s=size)), s=size)
        shifts = np.arange(-self.pad, self.pad + 1)
        return np.round(overlap[np.ix_(shifts, shifts)])

    def _mask(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape, dtype=np.float32)
        out.ravel()[places] = 1
        return out

    def held(self, moved: np.ndarray) -> np.ndarray:
        """Ink left on the canvas after each shift: each pixel counts for a rectangle of shifts, whose corners are summed up."""
        side = 2 * self.pad + 1
        y, x = np.divmod(moved, self.shape[1])
        edge = (y < 2 * self.pad) | (y >= self.height) | (x < 2 * self.pad) | (x >= self.width)
        y, x = y[edge], x[edge]  # the others stay on the canvas
        y0, y1 = np.clip(2 * self.pad - y, 0, side), np.clip(2 * self.pad + self.height - y, 0, side)
        x0, x1 = np.clip(2 * self.pad - x, 0, side), np.clip(2 * self.pad + self.width - x, 0, side)
        n = side + 1

        def corners(rows, columns):
            return np.bincount(rows * n + columns, minlength=n * n).reshape(n, n)

        edges = corners(y0, x0) - corners(y1, x0) - corners(y0, x1) + corners(y1, x1)
        return (edges.cumsum(0).cumsum(1)[:side, :side] + (len(moved) - len(y))).astype(np.float32)


def fast_size(n: int) -> int:
    """The next number from ``n`` on without a prime factor over 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1
