"""Oversampling of low scores: synthetic drawings composed from pools of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strokelake.config import CANVAS, Canvas
from strokelake.functions import geometry as G
from strokelake.functions.values import ORDER_MODULUS, normal, seeded_order, uniform, uniform_between, uniform_int
from strokelake.operators.ordered import number_rows
from strokelake.operators.profile import count_rows, one_row

ENDS = ["x1", "y1", "x2", "y2"]


def allocation(n: Column, levels: int) -> Column:
    """Array of (level, complexity, count): equal shares, the remainder to the last levels."""
    per, rest = F.floor(n / levels), F.pmod(n, F.lit(levels))

    def one(level: int) -> Column:
        complexity = level / (levels - 1) if levels > 1 else 0.5
        return F.struct(
            F.lit(level).alias("level"),
            F.lit(float(complexity)).alias("complexity"),
            (per + (F.lit(level) >= levels - rest).cast("int")).cast("int").alias("samples"),
        )

    return F.array(*(one(i) for i in range(levels)))


def allocate_levels(df: DataFrame, n: str, levels: int) -> DataFrame:
    """One row per input row and level with its share of the ``n`` requested samples."""
    return df.select(*df.columns, F.inline(allocation(F.col(n), levels)))


def compose(complexity: Column) -> dict[str, Column]:
    """Segments of each origin for one drawing of the given complexity."""
    # fixed values: total and ratios by complexity
    total = (5 + complexity * 15).cast("int")
    real = F.when(complexity < 0.3, 0.8).when(complexity < 0.7, 0.5).otherwise(0.3)
    template = F.when(complexity < 0.3, 0.2).otherwise(0.3)
    n_real, n_template = (total * real).cast("int"), (total * template).cast("int")
    return {"total": total, "n_real": n_real, "n_template": n_template, "n_random": total - n_real - n_template}


def line_pool(real: DataFrame, template: DataFrame) -> DataFrame:
    """Segments of low-score drawings and of the template under one origin column.

    ``line_key`` is unique inside an origin.
    """
    a = real.select(F.lit("real").alias("origin"), F.concat_ws("-", "drawing_id", "line_id").alias("line_key"), *ENDS)
    b = template.select(F.lit("template").alias("origin"), F.col("ref_id").cast("string").alias("line_key"), *ENDS)
    return a.unionByName(b)


def synthetic_drawings(spark, n: int, levels: int = 5) -> DataFrame:
    """One row per requested drawing with level, complexity and composition."""
    per_level = spark.range(1).select(F.inline(allocation(F.lit(n), levels)))
    rows = per_level.where(F.col("samples") > 0).select(
        "level", "complexity", F.explode(F.sequence(F.lit(0), F.col("samples") - 1)).alias("i")
    )
    per, rest = divmod(n, levels)
    before = F.col("level") * per + F.greatest(F.col("level") - (levels - rest), F.lit(0))
    numbered = rows.withColumn("synth_id", (before + F.col("i")).cast("long")).drop("i")
    return numbered.withColumns(compose(F.col("complexity")))


def distinct_places(size: Column, take: Column, tag: str, seed: int, *keys: Column) -> Column:
    """``take`` different numbers in [0, size), every set of them with equal chance.

    One draw per number: step j draws from 0..j and takes j itself when the draw is taken already.
    """
    def add(picked: Column, j: Column) -> Column:
        at = F.least(F.floor(uniform(tag, seed, *keys, j) * (j + 1)), j)
        return F.array_append(picked, F.when(F.array_contains(picked, at), j).otherwise(at))

    return F.aggregate(F.sequence(size - take, size - 1), F.array().cast("array<bigint>"), add)


def sample_pool(wanted: DataFrame, pool: DataFrame, need: str, seed: int, origin: str) -> DataFrame:
    """``need`` different pool segments for each wanted row (all of them when the pool is smaller).

    The pool is numbered once in seeded order. Each drawing draws its own numbers, every set of
    them with equal chance, and an equi-join on the number fetches the segments whatever the
    pool's size.
    """
    mine = pool.where(F.col("origin") == origin).select("line_key", *ENDS)
    numbered = number_rows(mine, seeded_order(F.col("line_key"), seed), "line_key", ORDER_MODULUS)
    size = mine.agg(count_rows().alias("n")).scalar()
    take = F.least(F.col(need).cast("long"), size)
    drawn = wanted.withColumns({"_take": take, "_size": size}).where(F.col("_take") > 0).select(
        "synth_id",
        "complexity",
        F.posexplode(distinct_places(F.col("_size"), F.col("_take"), f"pool-{origin}", seed, F.col("synth_id"))).alias("slot", "place"),
    )
    return drawn.join(numbered, "place").select("synth_id", "complexity", "slot", F.lit(origin).alias("origin"), *ENDS)


def random_segments(wanted: DataFrame, need: str, seed: int, canvas: Canvas = CANVAS) -> DataFrame:
    """Horizontal, vertical and diagonal segments (40/30/30) inside the canvas."""
    w, h = canvas.width, canvas.height
    rows = wanted.where(F.col(need) > 0).select(
        "synth_id", "complexity", F.explode(F.sequence(F.lit(0), F.col(need) - 1)).alias("slot")
    )
    who = [F.col("synth_id"), F.col("slot")]

    def whole(low: int, high: int, tag: str) -> Column:
        return uniform_int(low, high, tag, seed, *who)

    # fixed values: ranges of positions and lengths
    kind = uniform("kind", seed, *who)
    flat, upright = kind < 0.4, (kind >= 0.4) & (kind < 0.7)
    x = F.when(upright, whole(20, w - 20, "x")).otherwise(whole(20, w - 100, "x"))
    y = F.when(flat, whole(20, h - 20, "y")).otherwise(whole(20, h - 100, "y"))
    reach, turn = whole(50, 150, "len"), uniform_between(-3.141592653589793, 3.141592653589793, "turn", seed, *who)
    placed = rows.withColumns({"x1": x, "y1": y, "_flat": flat, "_up": upright})
    far_x = F.when(F.col("_flat"), F.least(F.col("x1") + whole(50, 200, "w"), F.lit(w - 20))).when(F.col("_up"), F.col("x1")).otherwise(
        G.clip((F.col("x1") + reach * F.cos(turn)).cast("int"), 20, w - 20)
    )
    far_y = F.when(F.col("_flat"), F.col("y1")).when(F.col("_up"), F.least(F.col("y1") + reach, F.lit(h - 20))).otherwise(
        G.clip((F.col("y1") + reach * F.sin(turn)).cast("int"), 20, h - 20)
    )
    return placed.select("synth_id", "complexity", "slot", F.lit("random").alias("origin"), "x1", "y1", far_x.alias("x2"), far_y.alias("y2"))


def modify(lines: DataFrame, seed: int, canvas: Canvas = CANVAS) -> DataFrame:
    """Shorten, bend and shake segments by chance; returns the drawn pieces.

    Every piece computes both of its ends from (drawing, segment, step), so no ordering of
    points is needed.
    """
    who = [F.col("synth_id"), F.col("origin"), F.col("slot")]
    c = F.col("complexity")
    # fixed values: chances and strengths
    cut_it = (F.col("origin") == "template") & (c > 0.5) & (uniform("shorten", seed, *who) < 0.4)
    short = G.shorten(G.seg(), uniform_between(0.6, 0.9, "factor", seed, *who))
    rows = lines.withColumns({n: F.when(cut_it, s).otherwise(F.col(n)) for n, s in zip(ENDS, short)})
    held = G.clip_segment(G.seg(), canvas.width, canvas.height)
    rows = rows.withColumns(dict(zip(ENDS, held))).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    rows = rows.withColumns(
        {
            "curved": uniform("curve", seed, *who) < 0.3 * c,
            "shaky": uniform("tremor", seed, *who) < 0.6 * c,
            "curvature": uniform_between(0.1, 0.4, "curvature", seed, *who) * c,
        }
    )
    strength = F.when(F.col("curved"), 1.5 + 1.5 * c).otherwise(1.0 + 2.0 * c)
    steps = F.when(F.col("curved"), G.bezier_steps(G.seg())).when(
        F.col("shaky"), F.greatest(F.lit(5), (G.seg_length(G.seg()) / 10).cast("int"))
    ).otherwise(1)
    rows = rows.withColumns({"steps": steps, "strength": strength})
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("step"))

    def at(i: Column) -> tuple[Column, Column]:
        t = i / F.col("steps")
        bent = G.bezier_at(G.seg(), F.col("curvature"), t)
        straight = (
            (F.col("x1") + t * (F.col("x2") - F.col("x1"))).cast("int"),
            (F.col("y1") + t * (F.col("y2") - F.col("y1"))).cast("int"),
        )
        end = (i == 0) | (i == F.col("steps"))
        out = []
        for axis, b, s in zip("xy", bent, straight):
            base = F.when(F.col("curved"), b).otherwise(s)
            out.append(F.when(F.col("shaky"), jitter(base, F.col("strength"), end, f"shake-{axis}", seed, *who, i)).otherwise(base))
        return G.clip(out[0], 0, canvas.width - 1), G.clip(out[1], 0, canvas.height - 1)

    a, b = at(F.col("step")), at(F.col("step") + 1)
    return pieces.select("synth_id", "origin", "slot", "step", "curved", "shaky", *(v.alias(n) for v, n in zip((*a, *b), ENDS)))


def jitter(value: Column, strength: Column, at_end: Column, tag: str, seed: int, *keys: Column) -> Column:
    """Normal noise, weaker at the ends of a line, to whole pixels."""
    return (value + normal(tag, seed, *keys) * strength * F.when(at_end, 0.3).otherwise(1.0)).cast("int")


def label_synthetic(
    drawings: DataFrame, feature: str, num_classes: int | None = None, boundaries: list[int] | None = None
) -> DataFrame:
    """Ids and label bags of synthetic drawings: score 0, or class 0 with the stored class edges."""
    if num_classes is None:
        bag = F.lit(f'{{"{feature}": 0.0}}')
    else:
        edges = boundaries or []
        generic = f"Class_0 [{edges[0]}-{edges[1]}]" if len(edges) > 1 else "Class_0"
        record = F.struct(
            F.lit(0).alias("label"),
            F.lit("Synthetic Bad").alias("name_custom"),
            F.lit(generic).alias("name_generic"),
            F.array(*(F.lit(int(e)) for e in edges)).cast("array<int>").alias("boundaries"),
        )
        bag = F.to_json(F.struct(F.struct(record.alias(str(num_classes))).alias("Custom_Class")))
    return drawings.select(
        F.concat(F.lit("synthetic_bad_"), F.col("synth_id")).alias("sample_id"),
        F.concat(F.lit("SYNTHETIC_BAD_L"), F.col("level")).alias("patient_id"),
        "synth_id",
        "level",
        bag.alias("features_data"),
    )


def add_synthetic(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real and synthetic samples as one table; one plan, so it is all or nothing."""
    a = real.select(F.col("drawing_id").cast("string").alias("sample_id"), "patient_id", "features_data")
    return a.unionByName(synthetic.select("sample_id", "patient_id", "features_data"))


def synthetic_info(samples: DataFrame, requested: int, threshold: float = 20.0) -> DataFrame:
    made = F.count_if(F.col("sample_id").startswith("synthetic_bad_"))
    return samples.agg(made.alias("added"), count_rows().alias("total")).select(
        F.lit(requested > 0).alias("enabled"),
        F.lit(requested).cast("long").alias("requested"),
        F.lit(threshold).alias("score_threshold"),
        "added",
        "total",
    )


def synthesise(
    low_lines: DataFrame, template: DataFrame, n: int, seed: int = 42, levels: int = 5, canvas: Canvas = CANVAS
) -> tuple[DataFrame, DataFrame]:
    """Synthetic drawings and their pieces, from the segments of low-score drawings and the template."""
    spark = low_lines.sparkSession
    wanted = synthetic_drawings(spark, n, levels)
    pool = line_pool(low_lines, template)
    lines = sample_pool(wanted, pool, "n_real", seed, "real")
    lines = lines.unionByName(sample_pool(wanted, pool, "n_template", seed, "template"))
    lines = lines.unionByName(random_segments(wanted, "n_random", seed, canvas))
    return wanted, modify(lines, seed, canvas)
