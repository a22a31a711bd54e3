"""Quality rules with cross-document line frequency.

Each text is read once: base counts, and the hash and word count of every distinct normalised line (lower-case ASCII,
digits as 0, white space runs as one space). Distinct documents are counted per (host, line); a line above the host's limit
is removed, and a document that loses too many of its words is rejected. The limit of a host is
``max(min_docs, share * documents of the host)``.

Hot lines: counting is a partial aggregation; the join with the lines above limits is salted.

Defined cases: null text has no words; a null host is a host of its own; repeated rows count as documents of their own; an empty table
gives an empty result; columns other than the key, text and host are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from strokelake.llm.common import map_batches, texts, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
SALTS = 16
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def line_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    data = text.encode()
    words = data.split()
    seen: set[bytes] = set()
    repeats = 0
    lines: dict[int, int] = defaultdict(int)
    for line in data.split(b"\n"):
        if not line.strip():
            continue
        if line in seen:
            repeats += 1
        else:
            seen.add(line)
        own = line.translate(FOLD).split()
        lines[line_hash(own)] += len(own)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeats, repeated_words(words), list(lines.items())


def document_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base counts and distinct lines of each document, written once; ``row`` names a row of that table."""

    def make():
        def step(cols):
            out = defaultdict(list)
            for key, text, site in zip(cols["doc_id"], cols["text"], cols["host"]):
                words, chars, symbols, repeats, repeated, lines = base_counts(text)
                for name, value in zip(
                    ("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"),
                    (key, site, words, chars, symbols, repeats, repeated, [{"h": h, "w": w} for h, w in lines]),
                ):
                    out[name].append(value)
            return out

        return step

    source = docs.withColumn("_host", F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("")))
    source = texts(source.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text", "_host").withColumnRenamed("_host", "host")
    schema = f"doc_id long, host string, {COUNTS}, lines array<struct<h: long, w: int>>"
    return written(map_batches(source, schema, make).withColumn("row", F.monotonically_increasing_id()), "lines")


def frequent_lines(rows: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, h) of lines in more documents of the host than its limit."""
    sizes = rows.groupBy("host").agg(F.count("*").alias("docs"))
    lines = rows.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    return lines.join(sizes, "host").where(F.col("n") > share * F.col("docs")).select("host", "h")


def judge(docs: DataFrame, host: str = "source", min_docs: int = 20, share: float = 0.02, least_left: float = 0.3) -> DataFrame:
    """Counts, base rule and verdict per document, with ``removed_words`` and the hashes of the removed lines."""
    rows = document_lines(docs, host)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    over = frequent_lines(rows, min_docs, share).select("host", "h", salts)
    lost = (
        rows.select("row", "host", F.explode("lines").alias("line"))
        .select("row", "host", F.col("line.h").alias("h"), F.col("line.w").alias("w"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(over, ["host", "h", "salt"])
        .groupBy("row")
        .agg(F.sum("w").alias("removed_words"), F.collect_set("h").alias("removed_lines"))
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        rows.drop("lines")
        .join(lost, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (left >= least_left * F.col("n_words")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "removed_lines"
        )
    )


def without_lines(text: str, removed: list[int]) -> str:
    """The text without its removed lines."""
    gone = set(removed)
    return "\n".join(x for x in text.split("\n") if not (own := x.encode().translate(FOLD).split()) or line_hash(own) not in gone)
