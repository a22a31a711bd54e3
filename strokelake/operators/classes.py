"""Class building from scores: equal width, equal sample, custom ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strokelake.functions import labels as L
from strokelake.functions.names import class_name, range_from_name, range_text
from strokelake.operators.ordered import running_totals
from strokelake.operators.profile import count_rows, explode_classes, histogram, one_row
from strokelake.session import cut

TOLERANCE = 0.15  # fixed value: allowed deviation from the equal share


def half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("int")


def _check(k: int) -> None:
    if not 2 <= k <= 10:
        raise ValueError("number of classes must be between 2 and 10")


def equal_width_classes(df: DataFrame, value: str, k: int) -> DataFrame:
    _check(k)
    bins = histogram(df, value, k)
    flat = one_row(df.agg((F.min(value) == F.max(value)).alias("flat"), F.min(value).cast("double").alias("lo")))
    total = one_row(df.agg(F.count(value).alias("n")))["n"]
    # identical scores: every edge is the score itself and only the closed last class holds it
    low = F.when(flat["flat"], flat["lo"]).otherwise(F.col("min"))
    high = F.when(flat["flat"], flat["lo"]).otherwise(F.col("max"))
    count = F.when(flat["flat"], F.when(F.col("bin") == k - 1, total).otherwise(0)).otherwise(F.col("count"))
    return bins.select(
        F.col("bin").alias("class_id"),
        half_even(low).alias("lo"),
        half_even(high).alias("hi"),
        count.cast("long").alias("count"),
        F.round(count * 100.0 / total, 2).alias("percentage"),
    )


class ScoreTotals:
    """An index of the scores for all probes of the class builder: distinct scores with the counts before and after them.

    The scores are read once and the index is written in score order, so a probe opens only the part in which its cut can lie.
    The builder takes one step at a time for all class counts together: at most nine probes.
    """

    def __init__(self, df: DataFrame, value: str):
        rows = df.select(F.col(value).cast("double").alias("score"))
        table = running_totals(rows, "score").select(
            "score", F.col("n").alias("cnt"), F.col("n_before").alias("before"), (F.col("n_before") + F.col("n")).alias("after"), F.col("n_total").alias("total")
        )
        self.table = cut(table.sortWithinPartitions("score"))
        ends = self.table.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.max("total").alias("n")).first()
        self.lowest, self.highest, self.total = ends["lo"], ends["hi"], ends["n"]
        if not self.total:
            raise ValueError("no scores")

    def next_cuts(self, wanted: dict[int, tuple[int, float]]) -> dict[int, tuple[float, int] | None]:
        """Per class count: first score that opens a new class when the open one began at a rank, for a target size.

        Every score that may be it ends above 85 % of the target, and the first of them begins at 115 % at most.
        """
        part, found = F.lit(False), []
        for k, (start, target) in wanted.items():
            held, grown = F.col("before") - start, F.col("after") - start
            over = grown > target * (1 + TOLERANCE)
            near = (held >= target * (1 - TOLERANCE)) & (F.abs(held - target) <= F.abs(grown - target))
            part = part | ((F.col("after") > start + target * (1 - TOLERANCE)) & (F.col("before") <= start + target * (1 + TOLERANCE)))
            found.append(F.min(F.when((held > 0) & (over | near), F.struct("score", "before"))).alias(f"cut_{k}"))
        row = self.table.where(part).agg(*found).first()
        return {k: None if row[f"cut_{k}"] is None else (row[f"cut_{k}"]["score"], row[f"cut_{k}"]["before"]) for k in wanted}

    def cuts(self, *counts: int) -> dict[int, list[tuple[float, int]]]:
        """Starts (score, rank) of the classes for each class count; one probe per step for all of them."""
        starts = {k: [(self.lowest, 0)] for k in counts}
        open_counts = set(counts)
        while open_counts := {k for k in open_counts if len(starts[k]) < k}:
            got = self.next_cuts({k: (starts[k][-1][1], self.total / k) for k in sorted(open_counts)})
            for k, cut_at in got.items():
                if cut_at is None:
                    open_counts.discard(k)
                else:
                    starts[k].append(cut_at)
        return starts

    def classes(self, k: int, starts: list[tuple[float, int]] | None = None) -> DataFrame:
        starts = starts or self.cuts(k)[k]
        # highest label whose start does not exceed the score; at most ten constants
        label = F.lit(0)
        for i, (score, _) in enumerate(starts):
            label = F.when(F.col("score") >= F.lit(score), i).otherwise(label)
        rows = self.table.groupBy(label.alias("class_id")).agg(
            F.min("score").alias("first"), F.max("score").alias("last"), F.sum("cnt").alias("count")
        )
        return rows.select(
            F.col("class_id").cast("int").alias("class_id"),
            F.when(F.col("class_id") == 0, 0).otherwise(half_even(F.col("first"))).alias("lo"),
            half_even(F.col("last")).alias("hi"),
            "count",
            F.round(F.col("count") * 100.0 / self.total, 2).alias("percentage"),
        )


def balanced_classes(df: DataFrame, value: str, k: int) -> DataFrame:
    """Classes of nearly equal size; equal scores are never split."""
    _check(k)
    return ScoreTotals(df, value).classes(k)


def generate_classes(df: DataFrame, value: str, k: int, method: str = "quantile") -> DataFrame:
    if method not in ("quantile", "equal-width"):
        raise ValueError(f"unknown method: {method}")
    rows = equal_width_classes(df, value, k) if method == "equal-width" else balanced_classes(df, value, k)
    found = one_row(rows.agg(count_rows().cast("int").alias("n")))["n"]
    return rows.select(
        F.lit(method).alias("method"),
        F.lit(k).alias("requested"),
        found.alias("actual"),
        "*",
        F.concat(F.lit("Class_"), F.col("class_id")).alias("label"),
    )


def class_previews(df: DataFrame, value: str, counts: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """Balanced classes for several class counts over one set of running totals."""
    totals = ScoreTotals(df, value)
    starts = totals.cuts(*counts)
    parts = [totals.classes(k, starts[k]).withColumn("num_classes", F.lit(k)) for k in counts]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def ranges_array(ranges: list[tuple[float, float]]) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("class_id"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
                     for i, (lo, hi) in enumerate(ranges)))


def assign_class(df: DataFrame, value: str, ranges: list[tuple[float, float]], out: str = "class_id") -> DataFrame:
    """First class whose inclusive range holds the value; null when none does.

    The ranges are constants of one expression, not a join.
    """
    _check_ranges(ranges)
    score = F.col(value)
    label = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(ranges))):
        label = F.when((score >= float(lo)) & (score <= float(hi)), F.lit(i)).otherwise(label)
    return df.withColumn(out, label)


def _check_ranges(ranges: list[tuple[float, float]]) -> None:
    if not ranges:
        raise ValueError("class ranges are needed")


def recount_classes(df: DataFrame, value: str, ranges: list[tuple[float, float]]) -> DataFrame:
    """Rows inside each inclusive range, percent of all rows; ranges may overlap."""
    _check_ranges(ranges)
    score = F.col(value)
    one = df.agg(
        F.count(value).alias("n"),
        *(F.count_if((score >= float(lo)) & (score <= float(hi))).alias(f"c{i}") for i, (lo, hi) in enumerate(ranges)),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("class_id"),
                F.lit(float(lo)).alias("lo"),
                F.lit(float(hi)).alias("hi"),
                F.col(f"c{i}").alias("count"),
                F.when(F.col("n") > 0, F.round(F.col(f"c{i}") * 100.0 / F.col("n"), 2)).otherwise(0.0).alias("percentage"),
            )
            for i, (lo, hi) in enumerate(ranges)
        )
    )
    return one.select(F.inline(rows))


def estimate_from_histogram(hist: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
    """Estimated rows per range by overlap with histogram bins."""
    parts = hist.select("min", "max", "count", F.inline(ranges_array(ranges)))
    width = F.col("max") - F.col("min")
    overlap = F.least("max", "hi") - F.greatest("min", "lo")
    share = F.when(width > 0, overlap / width).otherwise(1.0)
    touches = (F.col("max") >= F.col("lo")) & (F.col("min") <= F.col("hi"))
    sums = parts.groupBy("class_id", "lo", "hi").agg(
        F.sum(F.when(touches, F.col("count") * share).otherwise(0.0)).alias("estimate")
    )
    total = hist.agg(F.sum("count")).scalar()
    return sums.select(
        "class_id",
        F.floor(F.col("estimate") + 0.5).cast("long").alias("count"),
        F.round(F.floor(F.col("estimate") + 0.5) * 100.0 / total, 2).alias("percentage"),
        "estimate",
    )


def class_record(ranges: list[tuple[float, float]], names: list[str] | None, label: Column, k: int) -> Column:
    """The JSON class map written into the label bag for one row."""
    edges = [int(ranges[0][0]), *(int(hi) for _, hi in ranges)]
    lows = F.array(*(F.lit(int(lo)) for lo, _ in ranges))
    highs = F.array(*(F.lit(int(hi)) for _, hi in ranges))
    generic = class_name(label, F.get(lows, label), F.get(highs, label))
    custom = F.get(F.array(*(F.lit(n) for n in names)), label) if names else F.lit(None).cast("string")
    entry = F.struct(
        label.alias("label"),
        custom.alias("name_custom"),
        generic.alias("name_generic"),
        F.array(*(F.lit(e) for e in edges)).alias("boundaries"),
    )
    return F.to_json(F.struct(entry.alias(str(k))))


def label_classes(
    df: DataFrame, feature: str, ranges: list[tuple[float, float]], names: list[str] | None = None
) -> DataFrame:
    """Write the class of each row into its label bag, replacing any earlier class map.

    Rows without the feature, or whose score falls in no range, keep their bag (``class_id`` null).
    """
    scored = df.withColumn("_score", L.target_value(F.col("features_data"), feature))
    placed = assign_class(scored, "_score", ranges)
    record = class_record(ranges, names, F.col("class_id"), len(ranges))
    bag = F.when(
        F.col("class_id").isNotNull(), L.put_label(F.col("features_data"), L.CLASS_KEY, record)
    ).otherwise(F.col("features_data"))
    return placed.withColumn("features_data", bag).drop("_score")


def class_distribution(df: DataFrame, k: int, key: str = "drawing_id") -> DataFrame:
    """Stored classes of one class set: count, share, names and printed range."""
    rows = explode_classes(df, key).where(F.col("num_classes") == k)
    info = F.struct("name_custom", "name_generic", "boundaries")
    groups = rows.groupBy("label").agg(count_rows().alias("count"), F.min_by(info, F.col(key)).alias("i"))
    total = rows.agg(count_rows().alias("n")).scalar()
    # the edges of class 0 serve all classes
    edges = rows.where(F.col("label") == 0).agg(F.min_by("boundaries", F.col(key)).alias("b")).scalar()
    label = F.col("label")
    low, high = F.get(edges, label), F.get(edges, label + 1)
    high = F.when(label < F.size(edges) - 2, high - 1).otherwise(high)
    shown = F.when(F.size(edges) > label + 1, range_text(low, high)).otherwise(
        range_from_name(F.col("i.name_generic"), label)
    )
    return groups.select(
        "label",
        "count",
        F.round(F.col("count") * 100.0 / total, 2).alias("percentage"),
        F.col("i.name_custom").alias("name"),
        F.col("i.name_generic").alias("generic"),
        shown.alias("range"),
    )


def edit_boundary(defs: DataFrame, class_id: int, side: str, value: int, low: float, high: float) -> DataFrame:
    """Move one edge of one class; the neighbour's edge follows so that ranges stay disjoint."""
    if side not in ("min", "max", "single"):
        raise ValueError(f"unknown side: {side}")
    if not low <= value <= high:
        raise ValueError(f"value must be between {low} and {high}")
    this = F.col("class_id") == class_id
    lo, hi = F.col("lo"), F.col("hi")
    if side in ("min", "single"):
        lo = F.when(this, value).otherwise(lo)
        hi = F.when(F.col("class_id") == class_id - 1, value - 1).otherwise(hi)
    if side in ("max", "single"):
        hi = F.when(this, value).otherwise(hi)
        lo = F.when(F.col("class_id") == class_id + 1, value + 1).otherwise(lo)
    return defs.withColumns({"lo": lo, "hi": hi})
