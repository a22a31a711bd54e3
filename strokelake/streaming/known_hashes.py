"""Rows stored once per content hash, with lookups that read only what a batch touches.

Layout under ``root``: ``rows/commit=<c>``, ``hashes/prefix=<p>/commit=<c>`` and ``filters/prefix=<p>/commit=<c>``, where a prefix
is the first hex digits of a hash. A filter is a blocked Bloom filter kept as rows (block, 64 bits): the digits after the
prefix choose the block and four bits of it, blocks of several commits are joined by OR. A batch reads the filters of its own
prefixes, then the hashes of those prefixes where a filter says that one may be stored. A filter that is too full costs
reads, never rows.

A commit counts once its marker exists under ``commits``; a commit that is written again replaces its own files, and what a
broken writer left has no marker. ``compact`` joins the small files of many commits.

Defined cases: rows without a hash are left out (``file_status`` reports them); of equal hashes in a batch the first by the given
order is stored; an empty batch makes no commit; hashes are hex texts of at least 24 digits, others are an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strokelake.operators.ingest import first_of_hash
from strokelake.session import cut
from strokelake.sources.keyed_table import _create, _fs

HASH = "image_hash"


class KnownHashes:
    """``digits``: length of a prefix (16 ** digits partitions); ``blocks``: 64-bit blocks of a partition's filter, about 8 hashes each."""

    def __init__(self, spark: SparkSession, root: str, digits: int = 2, blocks: int = 4096):
        self.spark, self.root, self.digits, self.blocks = spark, root.rstrip("/"), digits, blocks

    # ---- keys ---------------------------------------------------------------------------------------------------

    def _number(self, at: int, n: int) -> Column:
        """Hex digits of the hash, counted behind the prefix, as a number."""
        return F.conv(F.substring(HASH, self.digits + at, n), 16, 10).cast("long")

    def tagged(self, rows: DataFrame) -> DataFrame:
        """Rows with a hash, and their prefix, block and mask."""
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), (self._number(8 + 2 * i, 2) % 64).cast("int")) for i in range(4)]
        mask = bits[0]
        for b in bits[1:]:
            mask = mask.bitwiseOR(b)
        checked = F.when(F.col(HASH).rlike("^[0-9a-f]{24,}$"), F.substring(HASH, 1, self.digits)).otherwise(
            F.raise_error(F.concat(F.lit("not a hash: "), F.col(HASH))).cast("string")
        )
        return rows.where(F.col(HASH).isNotNull()).withColumns({"prefix": checked, "block": self._number(1, 7) % self.blocks, "mask": mask})

    # ---- commits ------------------------------------------------------------------------------------------------

    def commits(self) -> list[str]:
        """Names of finished commits; a base that ``compact`` made stands for those it names."""
        fs, path = _fs(self.spark, f"{self.root}/commits")
        if not fs.exists(path(f"{self.root}/commits")):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/commits")) if not s.getPath().getName().startswith((".", "_")))

    def _lookup_commits(self) -> list[str]:
        """Commits whose lookup files count: the newest base and what came after it."""
        names = self.commits()
        bases = [n for n in names if n.startswith("base-")]
        if not bases:
            return names
        base = max(bases)
        merged = set(self.spark.read.text(f"{self.root}/commits/{base}").first()[0].split(","))
        return [base, *(n for n in names if n not in merged and not n.startswith("base-"))]

    def _read(self, kind: str, schema: str, prefixes: Sequence[str], without: str | None = None) -> DataFrame:
        """Lookup rows of some prefixes; the other partitions are neither listed nor opened."""
        fs, path = _fs(self.spark, self.root)
        base = f"{self.root}/{kind}"
        found = [p for p in (f"{base}/prefix={x}" for x in prefixes) if fs.exists(path(p))]
        names = [c for c in self._lookup_commits() if c != without]
        if not found or not names:
            return self.spark.createDataFrame([], f"{schema}, prefix string, commit string")
        rows = self.spark.read.schema(f"{schema}, prefix string, commit string").option("basePath", base).parquet(*found)
        return rows.where(F.col("commit").isin(names))

    # ---- lookups ------------------------------------------------------------------------------------------------

    def maybe_known(self, tagged: DataFrame, without: str | None = None) -> DataFrame:
        """Rows of a batch that a filter does not rule out."""
        prefixes = [r[0] for r in tagged.select("prefix").distinct().collect()]  # at most 16 ** digits
        filters = self._read("filters", "block long, bits long", prefixes, without)
        joined = filters.groupBy("prefix", "block").agg(F.bit_or("bits").alias("bits"))
        return tagged.join(joined, ["prefix", "block"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select(HASH, "prefix")

    def stored_hashes(self, maybe: DataFrame, without: str | None = None) -> DataFrame:
        """Hashes of the partitions that may hold one of the given rows."""
        prefixes = [r[0] for r in maybe.select("prefix").distinct().collect()]
        return self._read("hashes", f"{HASH} string", prefixes, without)

    def fresh(self, tagged: DataFrame, without: str | None = None) -> DataFrame:
        maybe = cut(self.maybe_known(tagged, without).distinct())
        known = maybe.join(self.stored_hashes(maybe, without), [HASH, "prefix"], "left_semi")
        return tagged.join(known.select(HASH), HASH, "left_anti")

    # ---- writing ------------------------------------------------------------------------------------------------

    def add(self, batch: DataFrame, commit: str, order: Sequence[str]) -> None:
        """Store the rows of a batch whose hash is not stored by another commit; a commit may be repeated."""
        tagged = cut(self.tagged(batch))
        if tagged.isEmpty():
            return
        rows = cut(first_of_hash(self.fresh(tagged, commit), list(order)).dropDuplicates([HASH]))
        rows.drop("prefix", "block", "mask").write.mode("overwrite").parquet(f"{self.root}/rows/commit={commit}")
        self._write_lookup(rows.select(HASH, "prefix"), rows.groupBy("prefix", "block").agg(F.bit_or("mask").alias("bits")), commit)
        self._mark(commit, commit)

    def _write_lookup(self, hashes: DataFrame, filters: DataFrame, commit: str) -> None:
        for kind, rows in (("hashes", hashes.repartition("prefix")), ("filters", filters.repartition("prefix"))):
            own = rows.withColumn("commit", F.lit(commit))
            own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "commit").parquet(f"{self.root}/{kind}")

    def _mark(self, commit: str, text: str) -> None:
        if commit not in self.commits():
            _create(self.spark, f"{self.root}/commits/{commit}", text)

    def compact(self) -> str | None:
        """One set of lookup files for all finished commits; older lookup files are no longer read. Rows stay where they are."""
        names = self._lookup_commits()
        if len(names) < 2:
            return None
        merged = [n for n in self.commits() if not n.startswith("base-")]
        all_prefixes = [format(i, f"0{self.digits}x") for i in range(16**self.digits)]
        filters = self._read("filters", "block long, bits long", all_prefixes).groupBy("prefix", "block").agg(F.bit_or("bits").alias("bits"))
        hashes = self._read("hashes", f"{HASH} string", all_prefixes).select(HASH, "prefix")
        base = f"base-{1 + max((int(n[5:]) for n in self.commits() if n.startswith('base-')), default=0):09d}"
        self._write_lookup(hashes, filters, base)
        self._mark(base, ",".join(merged))
        return base

    def rows(self) -> DataFrame:
        """All stored rows of finished commits."""
        names = [n for n in self.commits() if not n.startswith("base-")]
        if not names:
            raise FileNotFoundError(f"nothing stored under {self.root}")
        found = self.spark.read.option("basePath", f"{self.root}/rows").parquet(*[f"{self.root}/rows/commit={n}" for n in names])
        return found.drop("commit")


def commit_name(checkpoint: str, batch_id: int) -> str:
    """The same for every attempt at a batch, unlike for another stream's batch of that number."""
    return f"{zlib.crc32(checkpoint.encode()):08x}-{batch_id:09d}"
