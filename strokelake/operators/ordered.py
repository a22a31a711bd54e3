"""Order-dependent work without one-task windows.

A window over a whole table, or over one hot group, runs in a single task. Here
the ordered range is cut into buckets first: per-bucket totals (a small table)
give each bucket its offset, and the inner window runs per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strokelake.operators.keyed import join_small
from strokelake.session import cut


def bucket_count(df: DataFrame) -> int:
    """A few buckets per shuffle task, so that their number follows the cluster."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(32, min(8192, 4 * tasks))


def value_buckets(df: DataFrame, value: str, buckets: int | None = None, out: str = "_bucket") -> DataFrame:
    """Tag rows with a bucket of nearly equal row share, increasing in ``value``.

    The split points come back to the driver (at most ``buckets`` numbers) and are
    put into the plan as constants, so every use of the tag agrees.
    """
    n = buckets or bucket_count(df)
    shares = [i / n for i in range(1, n)]
    points = df.agg(F.percentile_approx(value, shares, 10 * n).alias("p")).first()["p"] or []
    inner = sorted({float(p) for p in points}) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    tagged = Bucketizer(splits=splits, inputCol="_ordered", outputCol=out, handleInvalid="keep").transform(
        df.withColumn("_ordered", F.col(value).cast("double"))
    )
    return tagged.drop("_ordered").withColumn(out, F.col(out).cast("int"))


def running_totals(
    df: DataFrame,
    value: str,
    weights: Mapping[str, Column] | None = None,
    groups: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """One row per (groups, value) with each weight, its sum over smaller values and its group total.

    Columns per weight ``w``: ``w``, ``w_before``, ``w_total``. The default weight ``n`` is the row count.
    """
    weights = dict(weights or {"n": F.count(F.lit(1))})
    groups = list(groups)
    rows = df.where(F.col(value).isNotNull())
    distinct = value_buckets(rows, value, buckets).groupBy(*groups, "_bucket", value).agg(
        *(agg.alias(name) for name, agg in weights.items())
    )
    sums = distinct.groupBy(*groups, "_bucket").agg(*(F.sum(w).alias(f"_s_{w}") for w in weights))
    keys = [F.col(g) for g in groups] or [F.lit(0)]
    by_bucket = W.partitionBy(*keys).orderBy("_bucket")
    whole = W.partitionBy(*keys)
    offsets = sums.select(
        *groups,
        "_bucket",
        *(F.sum(f"_s_{w}").over(by_bucket).alias(f"_c_{w}") for w in weights),
        *(F.sum(f"_s_{w}").over(whole).alias(f"{w}_total") for w in weights),
        *(f"_s_{w}" for w in weights),
    ).select(
        *groups,
        "_bucket",
        *((F.col(f"_c_{w}") - F.col(f"_s_{w}")).alias(f"_o_{w}") for w in weights),
        *(f"{w}_total" for w in weights),
    )
    inner = W.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    local = distinct.select(
        *groups, "_bucket", value, *weights, *(F.sum(w).over(inner).alias(f"_l_{w}") for w in weights)
    )
    return local.join(offsets, [*groups, "_bucket"]).select(
        *groups,
        value,
        *weights,
        *((F.col(f"_o_{w}") + F.col(f"_l_{w}") - F.col(w)).alias(f"{w}_before") for w in weights),
        *(f"{w}_total" for w in weights),
    )


def exact_percentiles(
    df: DataFrame, value: str, shares: Mapping[str, float], groups: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Linear-interpolated percentiles per group, one column per named share."""
    return percentiles_of_totals(running_totals(df, value, groups=groups, buckets=buckets), value, shares, groups)


def percentiles_of_totals(totals: DataFrame, value: str, shares: Mapping[str, float], groups: Sequence[str] = ()) -> DataFrame:
    end = F.col("n_before") + F.col("n")

    def at(place: Column) -> Column:
        return F.min(F.when(end > place, F.col(value).cast("double")))

    picks = []
    for name, share in shares.items():
        place = share * (F.col("n_total") - 1)
        picks += [
            at(F.floor(place)).alias(f"_lo_{name}"),
            at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_w_{name}"),
        ]
    found = totals.groupBy(*groups).agg(*picks)
    return found.select(
        *groups,
        *(
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in shares
        ),
    )


def next_in_order(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], prefix: str = "next_", chunk: int = 65536
) -> DataFrame:
    """The following row's columns per key, for a whole-number order of any length.

    Long sequences are cut into chunks of the order; only chunk heads cross chunk borders.
    """
    keys = list(keys)
    tagged = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    payload = F.struct(*columns)
    inner = W.partitionBy(*keys, "_chunk").orderBy(order)
    local = tagged.withColumn("_next", F.lead(payload).over(inner))
    heads = tagged.groupBy(*keys, "_chunk").agg(F.min_by(payload, F.col(order)).alias("_head"))
    follow = heads.select(*keys, "_chunk", F.lead("_head").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_after"))
    follow = follow.where(F.col("_after").isNotNull())
    joined = local.join(follow, [*keys, "_chunk"], "left")
    following = F.coalesce(F.col("_next"), F.col("_after"))
    return joined.select(*df.columns, *(following[c].alias(f"{prefix}{c}") for c in columns))


def first_share(
    df: DataFrame,
    strata: Sequence[str],
    order: Column,
    tie: str,
    wanted: Column,
    modulus: int,
    out: str = "picked",
    buckets: int | None = None,
) -> DataFrame:
    """Flag the first ``wanted`` rows of each stratum in (order, tie) order; exact counts.

    ``order`` is a whole number in [0, modulus), spread evenly; ``wanted`` is computed from
    the stratum size column ``n``. Counts per (stratum, bucket) locate the bucket holding the
    cut; only that bucket is ranked, and all other rows are decided by comparison alone. The
    cuts, one row per stratum, travel to the rows.
    """
    strata = list(strata)
    n = buckets or 16384
    rows = df.withColumn("_order", order.cast("long")).withColumn("_bucket", F.floor(F.col("_order") * n / modulus))
    per_bucket = rows.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    keys = [F.col(s) for s in strata] or [F.lit(0)]
    upto = W.partitionBy(*keys).orderBy("_bucket")
    counted = (
        per_bucket.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("n", F.sum("_n").over(W.partitionBy(*keys)))
        .withColumn("_wanted", wanted.cast("long"))
    )
    holding = counted.where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
    holding = holding.select(*strata, "_bucket", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_place"))
    ranked = (
        join_small(rows.select(*strata, "_bucket", "_order", tie), holding, [*strata, "_bucket"])
        .withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy("_order", tie)))
    )
    cuts = ranked.where(F.col("_rank") == F.col("_place")).select(
        *strata, F.col("_order").alias("_cut_order"), F.col(tie).alias("_cut_tie")
    )
    flag = F.coalesce(
        (F.col("_order") < F.col("_cut_order"))
        | ((F.col("_order") == F.col("_cut_order")) & (F.col(tie) <= F.col("_cut_tie"))),
        F.lit(False),
    )
    if strata:
        marked = join_small(rows, cuts, strata, "left")
    else:
        cut = cuts.agg(F.first(F.struct("_cut_order", "_cut_tie"))).scalar()
        marked = rows.withColumn("_cut_order", cut["_cut_order"]).withColumn("_cut_tie", cut["_cut_tie"])
    return marked.select(*df.columns, flag.alias(out))


def number_rows(df: DataFrame, order: Column, tie: str, modulus: int, out: str = "place", buckets: int | None = None) -> DataFrame:
    """Consecutive numbers from 0 in (order, tie) order; ``order`` is spread evenly over [0, modulus)."""
    n = buckets or 16 * bucket_count(df)
    rows = df.withColumn("_order", order.cast("long")).withColumn("_bucket", F.floor(F.col("_order") * n / modulus))
    sums = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sums.select("_bucket", (F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_bucket")) - F.col("_n")).alias("_off"))
    inner = F.row_number().over(W.partitionBy("_bucket").orderBy("_order", tie))
    return rows.withColumn("_in", inner).join(offsets, "_bucket").select(
        *df.columns, (F.col("_off") + F.col("_in") - 1).alias(out)
    )


def numbered(rows: DataFrame, block: Sequence[Column], order: Sequence[str] = ("_part",), out: str = "line_no") -> DataFrame:
    """Rows numbered from 1 in the order of their blocks, and as read inside a block.

    ``block`` are columns named as in ``order`` that tell the blocks of the input apart (a task's number after a sort, a
    file and its split while reading). Counts per block, a prefix sum over the blocks (one row each) and the place inside
    the block give the number; rows are neither sorted nor brought together.
    """
    order = list(order)
    read = cut(rows.select("*", *block, F.monotonically_increasing_id().alias("_row")))
    blocks = read.groupBy(*order).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(*order, (F.coalesce(before, F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    joined = read.join(F.broadcast(blocks), order)  # one row per block of the input
    return joined.select((F.col("_row") + F.col("_shift")).alias(out), *rows.columns)


def numbered_sort(rows: DataFrame, *by: Column | str, out: str = "place") -> DataFrame:
    """Rows with their places in a total order."""
    return numbered(rows.orderBy(*by), [F.spark_partition_id().alias("_part")], out=out)
