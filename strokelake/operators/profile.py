"""Label profiling: counts, feature statistics, distributions, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strokelake.functions import labels as L
from strokelake.functions.values import clamp
from strokelake.operators.ordered import exact_percentiles, percentiles_of_totals, running_totals

def count_rows() -> Column:
    return F.count(F.lit(1))


def one_row(df: DataFrame) -> Column:
    """A one-row result as a struct-valued scalar subquery."""
    return df.select(F.struct(*df.columns).alias("v")).scalar()


def dataset_info(df: DataFrame) -> DataFrame:
    """Totals, labelled and unlabelled, counts by source and by task in one pass."""
    labelled = F.count_if(L.is_labelled(F.col("features_data")))
    sets = df.groupingSets(
        [[], [F.col("source_format")], [F.col("task_type")]], F.col("source_format"), F.col("task_type")
    ).agg(
        count_rows().alias("total"),
        labelled.alias("labelled"),
        F.grouping("source_format").alias("_gs"),
        F.grouping("task_type").alias("_gt"),
    )
    whole = (F.col("_gs") == 1) & (F.col("_gt") == 1)
    kind = F.when(whole, "all").when(F.col("_gs") == 0, "source").otherwise("task")
    rows = sets.select(
        kind.alias("kind"),
        F.when(whole, "all").otherwise(F.coalesce("source_format", "task_type")).alias("name"),
        "total",
        "labelled",
        (F.col("total") - F.col("labelled")).alias("unlabelled"),
    )
    return rows.where(F.col("name").isNotNull())


def labels_long(df: DataFrame, key: str = "drawing_id") -> DataFrame:
    """One row per drawing and plain label, with the raw value text."""
    rows = df.where(L.is_labelled(F.col("features_data")))
    return rows.select(key, F.explode(L.label_map(F.col("features_data"))).alias("feature", "value")).where(
        F.col("feature") != L.CLASS_KEY
    )


def explode_classes(df: DataFrame, key: str = "drawing_id") -> DataFrame:
    """One row per drawing and class set of the nested class map."""
    rows = df.where(L.is_labelled(F.col("features_data")))
    return rows.select(key, F.explode(L.class_map(F.col("features_data"))).alias("num_classes", "_c")).select(
        key,
        F.col("num_classes").cast("int").alias("num_classes"),
        F.col("_c.label").alias("label"),
        F.col("_c.name_custom").alias("name_custom"),
        F.col("_c.name_generic").alias("name_generic"),
        F.col("_c.boundaries").alias("boundaries"),
    )


def discover_features(df: DataFrame) -> DataFrame:
    """Every label key in use; class sets appear as ``Custom_Class_<n>``."""
    rows = df.where(L.is_labelled(F.col("features_data"))).select("features_data")
    plain = rows.select(F.explode(F.json_object_keys("features_data")).alias("feature")).where(
        F.col("feature") != L.CLASS_KEY
    )
    nested = rows.select(
        F.explode(F.map_keys(L.class_map(F.col("features_data")))).alias("k")
    ).select(F.concat(F.lit(f"{L.CLASS_KEY}_"), F.col("k")).alias("feature"))
    return plain.unionByName(nested).distinct()


def feature_stats(df: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Count of carriers and statistics of the numeric values, per feature."""
    long = labels_long(df, key).withColumn("number", F.col("value").try_cast("double"))
    basic = long.groupBy("feature").agg(
        count_rows().alias("count"),
        F.count("number").alias("numeric_count"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.avg("number").alias("mean"),
        F.stddev_pop("number").alias("std"),
    )
    middle = exact_percentiles(long, "number", {"median": 0.5}, ["feature"])
    return basic.join(middle, "feature", "left")


def class_set_stats(df: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Per class set: carriers, distinct labels' display names, highest label."""
    # two steps, so that the name set is built from few rows per class set
    named = explode_classes(df, key).groupBy("num_classes", "label", "name_custom").agg(count_rows().alias("n"))
    return named.groupBy("num_classes").agg(
        F.sum("n").alias("count"),
        F.array_join(F.array_sort(F.collect_set("name_custom")), ", ").alias("names"),
        (F.max("num_classes") - 1).alias("max_label"),
    )


def describe_target(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population std, min, max, quartiles and range."""
    groups = list(groups)
    totals = running_totals(df, value, groups=groups)
    number = F.col(value).cast("double")
    basic = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.count(value).alias("count"),
        F.avg(number).alias("mean"),
        F.stddev_pop(number).alias("std"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        (F.max(number) - F.min(number)).alias("range"),
    )
    quarters = percentiles_of_totals(totals, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, groups)
    if groups:
        return basic.join(quarters, groups)
    found = one_row(quarters)
    return basic.select("*", *(found[c].alias(c) for c in quarters.columns))


def histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """Equal-width bins, last one closed, empty ones kept; share in percent to 2 places."""
    number = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull())
    span = one_row(rows.agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count(number).alias("n")))
    flat = span["lo"] == span["hi"]
    low = F.when(flat, span["lo"] - 0.5).otherwise(span["lo"])
    high = F.when(flat, span["hi"] + 0.5).otherwise(span["hi"])
    width = (high - low) / bins
    place = clamp(F.floor((number - low) / width), 0, bins - 1).cast("int")
    # a value rounding across an edge goes by the printed edges
    place = (
        F.when(number < low + place * width, place - 1)
        .when((place < bins - 1) & (number >= low + (place + 1) * width), place + 1)
        .otherwise(place)
    )
    counts = rows.groupBy(place.alias("bin")).agg(count_rows().alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("min"),
        (low + (F.col("bin") + 1) * width).alias("max"),
        F.coalesce("n", F.lit(0)).alias("count"),
        F.round(F.coalesce("n", F.lit(0)) * 100.0 / span["n"], 2).alias("percentage"),
    )


def with_share(df: DataFrame, count: str = "n", out: str = "percentage") -> DataFrame:
    """Share of each row's count in the total, in percent to 2 places."""
    total = df.agg(F.sum(count)).scalar()
    return df.withColumn(out, F.round(F.col(count) * 100.0 / total, 2))


def training_readiness(df: DataFrame, key: str = "drawing_id") -> DataFrame:
    """One row: blocking and advisory findings on the label set."""
    info = one_row(
        df.agg(count_rows().alias("total"), F.count_if(L.is_labelled(F.col("features_data"))).alias("labelled"))
    )
    carriers = labels_long(df, key).groupBy("feature").agg(count_rows().alias("n"))
    rare = F.concat(F.lit("Feature '"), F.col("feature"), F.lit("' only has "), F.col("n"), F.lit(" samples"))
    # feature names are few; only those with under two carriers are listed
    base = carriers.agg(
        count_rows().alias("features"),
        F.array_sort(F.collect_list(F.when(F.col("n") < 2, rare))).alias("rare"),
    )
    # fixed values: minimum and recommended counts
    few = F.when(info["total"] < 2, F.format_string("Only %d images (minimum 2 required)", info["total"]))
    unlabelled = F.when(info["labelled"] < 2, F.format_string("Only %d labeled images", info["labelled"]))
    bare = F.when(F.col("features") == 0, F.lit("No features defined"))
    small = F.when(info["total"] < 10, F.format_string("Only %d images (10+ recommended)", info["total"]))
    blocking = F.concat(F.array_compact(F.array(few, unlabelled, bare)), F.col("rare"))
    advice = F.array_compact(
        F.array(
            F.when(few.isNotNull(), F.lit("Upload more training data")),
            F.when(unlabelled.isNotNull(), F.lit("Add features to more images")),
            F.when(bare.isNotNull(), F.lit("Add feature labels to training data")),
        )
    )
    return base.select(
        (F.size(blocking) == 0).alias("ready"),
        F.when(F.size(blocking) == 0, "ready").otherwise("not_ready").alias("status"),
        info["total"].alias("total"),
        info["labelled"].alias("labelled"),
        F.col("features"),
        blocking.alias("issues"),
        F.array_compact(F.array(small)).alias("advisories"),
        advice.alias("recommendations"),
    )


def dashboard_counts(**tables: DataFrame) -> DataFrame:
    """One row per named table with its row count."""
    parts = [df.agg(count_rows().alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows
