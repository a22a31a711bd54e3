"""Train/validation splits and their quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strokelake.functions import labels as L
from strokelake.functions.values import ORDER_MODULUS, seeded_order, split_advice
from strokelake.operators.ordered import exact_percentiles, first_share, number_rows, running_totals
from strokelake.operators.profile import count_rows, describe_target, one_row


def assign_bins(df: DataFrame, value: str, n: int, method: str = "quantile", out: str = "bin") -> DataFrame:
    """Bin number = inner edges not above the value; equal edges collapse.

    The edges, ``n - 1`` numbers, are found first and become constants of the plan.
    """
    number = F.col(value).cast("double")
    if method == "quantile":
        edges = exact_percentiles(df, value, {f"e{i}": i / n for i in range(1, n)}).first() if n > 1 else None
        inner = [edges[f"e{i}"] for i in range(1, n)]
    elif method == "equal":
        low, high = df.agg(F.min(number), F.max(number)).first()
        inner = [None if low is None else low + (high - low) * (i / n) for i in range(1, n)]
    else:
        raise ValueError(f"unknown binning method: {method}")
    place = F.lit(0)
    for edge in inner:
        place = place + (number >= F.lit(edge).cast("double")).cast("int")
    return df.withColumn(out, place)


def stratified_split(
    df: DataFrame, strata: Sequence[str], fraction: float, seed: int, key: str = "id", keep_one: bool = False
) -> DataFrame:
    """First ``int(n * fraction)`` rows of each stratum in seeded order are ``train``, the rest ``val``.

    With ``keep_one`` a stratum of two or more rows always leaves one for ``val``.
    """
    wanted = F.floor(F.col("n") * F.lit(float(fraction)))
    if keep_one:
        wanted = F.when(F.col("n") > 1, F.least(wanted, F.col("n") - 1)).otherwise(wanted)
    picked = first_share(df, strata, seeded_order(F.col(key), seed), key, wanted, ORDER_MODULUS, "_train")
    return picked.withColumn("split", F.when(F.col("_train"), "train").otherwise("val")).drop("_train")


def split_random(df: DataFrame, fraction: float, seed: int, key: str = "id") -> DataFrame:
    return stratified_split(df, [], fraction, seed, key)


def _with_fallback(df: DataFrame, stratum: str, least: int) -> DataFrame:
    """One common stratum when any stratum is smaller than ``least``."""
    smallest = df.groupBy(stratum).agg(count_rows().alias("n")).agg(F.min("n")).first()[0]
    too_small = smallest is not None and smallest < least
    return df.withColumn("_stratum", F.lit(-1) if too_small else F.col(stratum))


def split_regression(
    df: DataFrame, value: str, fraction: float = 0.8, seed: int = 42, key: str = "id", bins: int = 4, least: int = 2
) -> DataFrame:
    """Quantile-bin stratified split; random when a bin is too small."""
    binned = assign_bins(df, value, bins)
    return stratified_split(_with_fallback(binned, "bin", least), ["_stratum"], fraction, seed, key).drop("_stratum")


def split_classification(
    df: DataFrame, label: str, fraction: float = 0.8, seed: int = 42, key: str = "id", least: int = 2
) -> DataFrame:
    """Class-stratified split that leaves one validation row per class; random when a class is too small."""
    ready = _with_fallback(df, label, least)
    return stratified_split(ready, ["_stratum"], fraction, seed, key, keep_one=True).drop("_stratum")


def split_by_advice(df: DataFrame, value: str, fraction: float = 0.8, seed: int = 42, key: str = "id") -> DataFrame:
    """Split as advised for the sample size; identical targets are split at random."""
    facts = df.agg(F.count(value).alias("n"), F.countDistinct(value).alias("d")).select(
        "d", split_advice(F.col("n")).alias("a")
    ).first()
    if facts["a"]["strategy"] == "random" or facts["d"] < 2:
        return split_random(df, fraction, seed, key)
    return split_regression(df, value, fraction, seed, key, bins=facts["a"]["n_bins"])


def shuffle(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """Rows in seeded order with their ``place`` from 0."""
    return number_rows(df, seeded_order(F.col(key), seed), key, ORDER_MODULUS).orderBy("place")


def ks_2samp(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic with the asymptotic p-value."""
    totals = running_totals(df, value, {"a": F.count_if(is_first), "b": F.count_if(~is_first)})
    gap = F.abs(
        (F.col("a_before") + F.col("a")) / F.col("a_total") - (F.col("b_before") + F.col("b")) / F.col("b_total")
    )
    stat = totals.agg(F.max(gap).alias("statistic"), F.max("a_total").alias("n_a"), F.max("b_total").alias("n_b"))
    root = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    scaled = root * F.col("statistic")
    # alternating series of the Kolmogorov distribution; 100 terms leave nothing at double precision
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * scaled * scaled),
    )
    p = F.when(scaled < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return stat.withColumn("p_value", p)


def validate_split(df: DataFrame, value: str, split: str = "split") -> DataFrame:
    """Compare train and validation targets: mean, spread, range, distribution."""
    stats = describe_target(df, value, [split])
    names = ["count", "mean", "std", "min", "max"]
    wide = stats.agg(
        *(
            F.max(F.when(F.col(split) == side, F.col(n))).alias(f"{side}_{n}")
            for side in ("train", "val")
            for n in names
        )
    )
    ks = one_row(ks_2samp(df, value, F.col(split) == "train"))

    def gap(name: str) -> tuple[Column, Column]:
        diff = F.abs(F.col(f"train_{name}") - F.col(f"val_{name}"))
        percent = F.when(F.col(f"train_{name}") != 0, diff / F.col(f"train_{name}") * 100).otherwise(0.0)
        return diff, percent

    mean_diff, mean_pct = gap("mean")
    std_diff, std_pct = gap("std")
    outside = (F.col("val_min") < F.col("train_min")) | (F.col("val_max") > F.col("train_max"))
    enough = (F.col("train_count") > 2) & (F.col("val_count") > 2)
    # fixed values: warning limits
    warnings = F.array_compact(
        F.array(
            F.when(mean_pct > 20, F.format_string("Mean difference: %.1f%% (should be < 20%%)", mean_pct)),
            F.when(std_pct > 30, F.format_string("Std deviation difference: %.1f%% (should be < 30%%)", std_pct)),
            F.when(outside, F.lit("Test set has values outside training range (extrapolation required)")),
            F.when(
                enough & (ks["p_value"] < 0.05),
                F.format_string("Distributions significantly different (KS p-value: %.3f)", ks["p_value"]),
            ),
        )
    )
    return wide.select(
        "*",
        mean_diff.alias("mean_difference"),
        mean_pct.alias("mean_difference_pct"),
        std_diff.alias("std_difference"),
        std_pct.alias("std_difference_pct"),
        outside.alias("outside_range"),
        ks["statistic"].alias("ks_statistic"),
        ks["p_value"].alias("ks_p_value"),
        warnings.alias("warnings"),
        (F.size(warnings) == 0).alias("is_balanced"),
    )


def validate_class_split(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Per class: counts and shares on both sides, absent classes, gaps over 15 points."""
    counts = df.groupBy(label).agg(
        F.count_if(F.col(split) == "train").alias("train_count"),
        F.count_if(F.col(split) == "val").alias("val_count"),
    )
    sides = one_row(counts.agg(F.sum("train_count").alias("t"), F.sum("val_count").alias("v")))
    train_pct = F.col("train_count") * 100.0 / sides["t"]
    val_pct = F.col("val_count") * 100.0 / sides["v"]
    gap = F.abs(train_pct - val_pct)
    warnings = F.array_compact(
        F.array(
            F.when(F.col("train_count") == 0, F.format_string("Class %d has no samples in training set", label)),
            F.when(F.col("val_count") == 0, F.format_string("Class %d has no samples in test set", label)),
            F.when(gap > 15, F.format_string("Class %d: %.1f%% imbalance between train and test", F.col(label), gap)),
        )
    )
    return counts.select(
        label,
        "train_count",
        "val_count",
        train_pct.alias("train_pct"),
        val_pct.alias("val_pct"),
        warnings.alias("warnings"),
        (F.size(warnings) == 0).alias("is_balanced"),
    )


def split_stats(df: DataFrame, value: str, batch: int, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(
        count_rows().alias("samples"),
        F.ceil(count_rows() / batch).alias("batches"),
        F.min(value).alias("min_target"),
        F.max(value).alias("max_target"),
    )


def apply_split(df: DataFrame, split_ids: DataFrame, key: str = "id") -> DataFrame:
    """Replay a stored split: rows of stored ids with their side; ids without a row are ignored."""
    ids = split_ids.groupBy(key).agg(F.min("split").alias("split"))
    return df.join(ids, key, "inner")


def require_both_sides(df: DataFrame, split: str = "split") -> DataFrame:
    """Raise when the train or the validation side is empty."""
    found = df.agg(
        F.bool_or(F.col(split) == "train").alias("train"), F.bool_or(F.col(split) == "val").alias("val")
    ).first()
    for side in ("train", "val"):
        if not found[side]:
            raise ValueError(f"no rows on the {side} side of the split")
    return df


def drop_synthetic(ids: DataFrame, key: str = "sample_id", out: str = "drawing_id") -> DataFrame:
    """Keep whole-number ids (stored drawings); synthetic samples carry text ids."""
    return ids.withColumn(out, F.col(key).try_cast("bigint")).where(F.col(out).isNotNull())


def synthetic_count(ids: DataFrame, key: str = "sample_id") -> DataFrame:
    number = F.col(key).try_cast("bigint")
    return ids.agg(count_rows().alias("total"), F.count_if(number.isNull()).alias("synthetic"), F.count(number).alias("stored"))


def evaluation_set(
    drawings: DataFrame, split_ids: DataFrame, key: str = "drawing_id", strict: bool = False
) -> DataFrame:
    """Stored validation drawings that are still present and labelled, synthetic ones left out."""
    ids = drop_synthetic(split_ids.where(F.col("split") == "val"), "sample_id", key).select(key).distinct()
    rows = drawings.where(L.is_labelled(F.col("features_data"))).join(ids, key, "left_semi")
    if strict and rows.limit(1).count() == 0:
        raise ValueError("no validation drawings left for this model")
    return rows
