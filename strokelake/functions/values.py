"""Hashes, seeded draws, scores and clamps as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from strokelake.config import SCORE_RANGES

#: Seven hexadecimal digits of a digest.
ORDER_MODULUS = 1 << 28


def content_hash(original: Column, processed: Column) -> Column:
    return F.sha2(F.coalesce(original, processed).cast("binary"), 256)


def uniform(tag: str, seed: int, *keys: Column) -> Column:
    """A repeatable draw in [0, 1): depends on the keys only, never on partitioning.

    A counter-based generator: 13 hexadecimal digits of the MD5 of ``tag|seed|key|...``, so other engines draw the same.
    """
    text = F.concat_ws("|", F.lit(tag), F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def uniform_between(low: float, high: float, tag: str, seed: int, *keys: Column) -> Column:
    return low + (high - low) * uniform(tag, seed, *keys)


def uniform_int(low: int, high: int, tag: str, seed: int, *keys: Column) -> Column:
    """Whole number in [low, high)."""
    return (low + F.floor((high - low) * uniform(tag, seed, *keys))).cast("int")


def normal(tag: str, seed: int, *keys: Column) -> Column:
    """Box-Muller over two repeatable draws."""
    u = 1 - uniform(f"{tag}-r", seed, *keys)
    v = uniform(f"{tag}-a", seed, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def seeded_order(key: Column, seed: int) -> Column:
    """Shuffle order in [0, ORDER_MODULUS) from a digest of seed and key; ties are broken by the key.

    Each seed gives an order of its own, and regular keys fall irregularly.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def preset_range(feature: Column) -> Column:
    """Known score range of a test, null when it must come from the data."""
    picked = None
    for name, (low, high) in SCORE_RANGES.items():
        span = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
        picked = F.when(feature == name, span) if picked is None else picked.when(feature == name, span)
    return picked


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


def clamp01(value: Column) -> Column:
    return clamp(value, 0.0, 1.0)


def denormalise(raw: Column, low, high) -> Column:
    """Back to the score scale, held inside the score range."""
    return clamp(raw * (high - low) + low, low, high)


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; Spark computes what a lambda only refers to anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
        return named(total, lambda t: F.transform(powers, lambda v: v / t))

    def powers_of(z: Column) -> Column:
        return named(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top)))

    return named(logits, lambda z: named(powers_of(z), shares))


def top_class(scores: Column) -> Column:
    """Zero-based place of the first largest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def band(score: Column) -> Column:
    return (
        F.when(score == 1, "perfect").when(score >= 0.8, "good").when(score >= 0.5, "medium").otherwise("poor")
    )


def expired(at: Column, hours: int, now: Column) -> Column:
    return at < now - F.make_interval(hours=F.lit(hours))


def iso_or_na(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("N/A"))


def split_advice(n: Column) -> Column:
    """Strategy and bin count by sample size."""

    def advice(strategy: str, bins: int) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), F.lit(bins).alias("n_bins"))

    # fixed values: size steps
    return (
        F.when(n < 20, advice("random", 2))
        .when(n < 50, advice("stratified", 2))
        .when(n < 100, advice("stratified", 3))
        .otherwise(advice("stratified", 4))
    )
