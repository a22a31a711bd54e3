"""Entities updated by key: only files that hold a touched key are written again.

Layout under ``<root>/<name>``: data files below ``files/commit=<id>/``, and per version one manifest under ``manifests`` that
names the live files with their row counts and key ranges. A version is published by creating its manifest, which fails
where that version exists already: of two writers that began at the same version the second is refused and may
start again. Readers keep the version they opened. Files of refused or broken writers are named by no manifest; ``vacuum``
removes what the last versions do not need.

An update reads the key column of the files whose range can hold a key, joins it with the keys to find the touched files,
and rewrites those. Lists of file names pass through the driver, as in every file scan; rows do not.

Defined cases: a null in an update is a value; a null key matches no stored row and is inserted as a new row; keys
that occur twice in an update are refused; an empty update publishes nothing; a table without rows keeps its schema.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from strokelake.operators.keyed import measured

#: Keys up to this number are compared with the files' key ranges one by one, more by their own range.
LISTED_KEYS = 1000


class ConcurrentUpdate(RuntimeError):
    """Another writer has published the version that this one was about to publish."""


class KeyedTable:
    """One version of an entity; updates return the next version."""

    def __init__(self, spark: SparkSession, root: str, name: str, version: int, manifest: dict):
        self.spark, self.root, self.name, self.version = spark, root.rstrip("/"), name, version
        self.keys: list[str] = manifest["keys"]
        self.partitions: list[str] = manifest["partitions"]
        self.schema = StructType.fromJson(manifest["schema"])
        self.files: list[dict] = manifest["files"]

    # ---- versions -----------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, df: DataFrame, root: str, name: str, keys: Sequence[str], partitions: Sequence[str] = ()) -> KeyedTable:
        """The first version, from the rows of ``df``; rows stay in the order of their keys so that files have narrow ranges."""
        manifest = {"keys": list(keys), "partitions": list(partitions), "schema": df.schema.jsonValue(), "files": []}
        table = cls(df.sparkSession, root, name, 0, manifest)
        return table._published(table._written(df.repartitionByRange(*keys).sortWithinPartitions(*keys)), [])

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str, version: int | None = None) -> KeyedTable:
        """The newest version, or a given one."""
        folder = f"{root.rstrip('/')}/{name}/manifests"
        known = _listed(spark, folder)
        if not known:
            raise FileNotFoundError(f"no version of {name} under {root}")
        version = max(known) if version is None else version
        return cls(spark, root, name, version, json.loads(_text(spark, f"{folder}/{version:012d}.json")))

    @property
    def folder(self) -> str:
        return f"{self.root}/{self.name}"

    def read(self) -> DataFrame:
        return self._rows(self.files)

    def read_partition(self, **values: str) -> DataFrame:
        """Rows of one partition, by the text of its partition columns; files of the others are not opened."""
        parts = [f"/{name}={value}/" for name, value in values.items()]
        return self._rows([f for f in self.files if all(p in f["path"] for p in parts)])

    def _rows(self, files: list[dict], *more) -> DataFrame:
        columns = [F.col(c) for c in self.schema.names]
        if not files:
            return self.spark.createDataFrame([], self.schema).select(*columns, *[F.lit(None).cast("string").alias("_file") for _ in more])
        base = f"{self.folder}/files"
        found = self.spark.read.schema(self.schema).option("basePath", base).parquet(*[f"{base}/{f['path']}" for f in files])
        return found.select(*columns, *more)

    def _written(self, df: DataFrame) -> list[dict]:
        """Write rows as new files; their entries for the manifest, from one scan of the keys just written."""
        commit = f"commit={uuid.uuid4().hex}"
        base = f"{self.folder}/files"
        df.select(*self.schema.names).write.partitionBy(*self.partitions).parquet(f"{base}/{commit}")
        key = F.col(self.keys[0])
        back = self.spark.read.schema(self.schema).option("basePath", base).parquet(f"{base}/{commit}")
        got = back.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"), F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high"))
        return [{"path": r.path[r.path.index(commit) :], "rows": r.rows, "low": r.low, "high": r.high} for r in got.collect()]

    def _published(self, added: list[dict], removed: list[str]) -> KeyedTable:
        gone = set(removed)
        files = [f for f in self.files if f["path"] not in gone] + sorted(added, key=lambda f: f["path"])
        manifest = {"keys": self.keys, "partitions": self.partitions, "schema": self.schema.jsonValue(), "files": files}
        _create(self.spark, f"{self.folder}/manifests/{self.version + 1:012d}.json", json.dumps(manifest))
        return KeyedTable(self.spark, self.root, self.name, self.version + 1, manifest)

    # ---- updates ------------------------------------------------------------------------------------------------

    def _touched(self, ids: DataFrame) -> list[dict]:
        """Files that hold one of the keys; ``ids`` has the key columns."""
        key = self.keys[0]
        files = self.files
        kind = self.schema[key].dataType
        few = ids.select(key).distinct().limit(LISTED_KEYS + 1).collect()  # bounded: only prunes files by their ranges
        if len(few) <= LISTED_KEYS:
            spans = [(r[0], r[0]) for r in few if r[0] is not None]
        else:
            spans = [tuple(ids.agg(F.min(key), F.max(key)).first())]
        if kind.typeName() in ("long", "integer", "short", "byte"):
            files = [f for f in files if f["low"] is not None and any(int(f["low"]) <= b and a <= int(f["high"]) for a, b in spans)]
        elif kind.typeName() == "string":
            files = [f for f in files if f["low"] is not None and any(f["low"] <= b and a <= f["high"] for a, b in spans)]
        if not files or not few:
            return []
        stored = self._rows(files, F.col("_metadata.file_path").alias("_file")).select(*self.keys, "_file")
        held = stored.join(ids.select(*self.keys), self.keys, "left_semi").select("_file").distinct()
        paths = {r[0][r[0].index("commit=") :] for r in held.collect()}
        return [f for f in files if f["path"] in paths]

    def upsert(self, updates: DataFrame, columns: Sequence[str], insert: bool = False) -> KeyedTable:
        """Replace ``columns`` where a key matches; the other columns stay. ``insert`` adds the rows of new keys."""
        twice = updates.dropna(subset=self.keys).groupBy(*self.keys).count().where("count > 1")
        if not twice.isEmpty():
            raise ValueError("an update holds one key more than once")
        updates = measured(updates)
        touched = self._touched(updates)
        old = self._rows(touched)
        new = updates.select(*self.keys, F.struct(*columns).alias("_new"))
        joined = old.join(new, self.keys, "left")
        rows = joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in self.schema.names])
        if insert:
            fresh = updates.join(old.select(*self.keys), self.keys, "left_anti")
            rows = rows.unionByName(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]))
        elif not touched:
            return self
        return self._replaced(touched, rows)

    def delete(self, ids: DataFrame) -> KeyedTable:
        ids = measured(ids.select(*self.keys).distinct())
        touched = self._touched(ids)
        return self._replaced(touched, self._rows(touched).join(ids, self.keys, "left_anti")) if touched else self

    def change(self, ids: DataFrame, edit: Callable[[DataFrame], DataFrame]) -> KeyedTable:
        """Apply ``edit`` to the rows of the given keys (same columns in and out); the other rows of touched files are copied."""
        ids = measured(ids.select(*self.keys).distinct().withColumn("_hit", F.lit(True)))
        touched = self._touched(ids)
        if not touched:
            return self
        rows = self._rows(touched).join(ids, self.keys, "left")
        changed = edit(rows.where("_hit").drop("_hit")).select(*self.schema.names)
        return self._replaced(touched, changed.unionByName(rows.where("_hit IS NULL").select(*self.schema.names)))

    def append(self, rows: DataFrame) -> KeyedTable:
        return self._published(self._written(rows), [])

    def _replaced(self, touched: list[dict], rows: DataFrame) -> KeyedTable:
        """New files for the touched ones: as many, cut by key again, so that their ranges stay narrow."""
        tidy = rows.repartitionByRange(max(1, len(touched)), *self.keys).sortWithinPartitions(*self.keys)
        added = self._written(tidy)
        if not added and not touched:
            return self
        return self._published(added, [f["path"] for f in touched])

    def vacuum(self, keep: int = 2) -> int:
        """Delete data files that none of the last ``keep`` versions names, of commits that this version knows to be over.

        Run it while no writer is active: files of an unpublished commit look like those of a broken one.
        """
        folder = f"{self.folder}/manifests"
        versions = sorted(_listed(self.spark, folder))[-keep:]
        needed = {f["path"] for v in versions for f in KeyedTable.open(self.spark, self.root, self.name, v).files}
        fs, path = _fs(self.spark, self.folder)
        base = f"{self.folder}/files"
        removed, found = 0, fs.listFiles(path(base), True) if fs.exists(path(base)) else None
        while found is not None and found.hasNext():
            at = found.next().getPath()
            name = at.toString()
            if name.endswith(".parquet") and name[name.index("commit=") :] not in needed:
                removed += bool(fs.delete(at, False))
        for v in set(_listed(self.spark, folder)) - set(versions):
            fs.delete(path(f"{folder}/{v:012d}.json"), False)
        return removed


# ---- files through Spark's own file systems ---------------------------------------------------------------------------


def _fs(spark: SparkSession, at: str):
    """The file system of a path, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(at).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make


def _listed(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return []
    return [int(s.getPath().getName()[:12]) for s in fs.listStatus(path(folder)) if s.getPath().getName()[:12].isdigit() and s.getLen() > 0]


def _text(spark: SparkSession, at: str) -> str:
    return spark.read.text(at, wholetext=True).first()[0]


def _create(spark: SparkSession, at: str, text: str) -> None:
    """Create a file that must not exist yet. The claim is the creation, so two writers cannot both succeed."""
    fs, path = _fs(spark, at)
    if fs.exists(path(at)):
        raise ConcurrentUpdate(at)
    try:
        out = fs.create(path(at), False)
    except Exception as error:
        if "exists" in str(error):
            raise ConcurrentUpdate(at) from error
        raise
    out.write(bytearray(text.encode()))
    out.close()
