"""Files, images, snapshots and streams."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokelake.operators import ingest, lifecycle, ml, raster
from strokelake.session import scratch_path
from strokelake.sources import files, sinks
from strokelake.streaming import jobs
from strokelake.streaming.known_hashes import KnownHashes


def png(pixels):
    """A PNG from rows of (r, g, b) or (r, g, b, a)."""
    h, w, n = len(pixels), len(pixels[0]), len(pixels[0][0])
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_to_pixels(spark, tmp_path):
    (tmp_path / "a_COPY.png").write_bytes(png([[(255, 10, 20), (0, 0, 0)], [(255, 255, 255), (1, 2, 3)]]))
    (tmp_path / "b.png").write_bytes(png([[(0, 0, 0, 0), (0, 0, 0, 255)]]))
    images = files.scan_images(spark, str(tmp_path)).withColumn("drawing_id", F.col("name"))
    got = {(r["drawing_id"], r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in raster.explode_pixels(images).collect()}
    assert got[("a_COPY", 0, 0)] == (255, 10, 20) and got[("a_COPY", 1, 1)] == (1, 2, 3)
    assert got[("b", 0, 0)] == (255, 255, 255) and got[("b", 1, 0)] == (0, 0, 0)
    named = files.scan_files(spark, str(tmp_path), "*.png", ["COPY"])
    assert [r["filename"] for r in named.collect()] == ["a_COPY.png"]


def test_model_folder(spark, tmp_path):
    (tmp_path / "model_Total_Score_20240101_120000.pth").write_bytes(b"x" * 2048)
    (tmp_path / "model_MMSE_20240102_120000.pth").write_bytes(b"x")
    (tmp_path / "model_MMSE_20240102_120000_metadata.json").write_text(json.dumps({"target_feature": "MMSE"}))
    got = {r["feature"]: r for r in files.list_models(spark, str(tmp_path)).collect()}
    assert got["MMSE"]["has_metadata"] and not got["Total_Score"]["has_metadata"]
    meta = files.read_model_metadata(spark, str(tmp_path), "target_feature string").collect()
    assert [tuple(r) for r in meta] == [("model_MMSE_20240102_120000", "MMSE")]


def test_augmented_pairs(spark, tmp_path):
    side = tmp_path / "train"
    side.mkdir()
    for name in ("a", "b"):
        (side / f"{name}.json").write_text('{"target_value": 1}')
    (side / "a.png").write_bytes(b"x")
    assert [r["stem"] for r in files.read_augmented_pairs(spark, str(tmp_path), "train").collect()] == ["a"]


@pytest.mark.parametrize("text,sep", [("Patient;Task;Total_Score\nPC1;COPY;3\n", ";"), ("Patient,Task,Total_Score\nPC1,COPY,3\n", ","), ("Patient\nPC1\n", ",")])
def test_label_file_delimiter(spark, tmp_path, text, sep):
    path = tmp_path / "labels.csv"
    path.write_text(text)
    assert files.detect_delimiter(spark, str(path)) == sep
    assert files.read_labels_csv(spark, str(path)).first()["Patient"] == "PC1"


def test_line_numbers_over_split_files(spark, tmp_path):
    """Three files, cut into many blocks while reading: the numbers follow the file names and the lines in them."""
    folder, want = tmp_path / "labels", []
    folder.mkdir()
    for name, n in (("a.csv", 900), ("b.csv", 5), ("c.csv", 400)):
        lines = [f"P{name[0]}{i},COPY,{i}" for i in range(n)]
        (folder / name).write_text("\n".join(["Patient,Task,Total_Score", *lines]) + "\n")
        want += [x.split(",")[0] for x in lines]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = files.read_labels_csv(spark, str(folder)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["Patient"] for r in got] == want and [r["line_no"] for r in got] == list(range(1, len(want) + 1))


def test_linear_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x[:, 2] = 5.0  # constant
    y = x[:, 0] * 2 - x[:, 1] + 7 + rng.normal(size=400) * 0.1
    rows = [(a.tolist(), float(b)) for a, b in zip(x, y)] + [(None, 1.0), ([1.0, 2.0, 5.0], None)]
    frame = spark.createDataFrame(rows, "features array<double>, target double").repartition(5)
    fit = ml.fit_linear(frame, regularise=0.0)
    design = np.c_[x[:, :2], np.ones(400)]
    assert np.allclose([*fit.coefficients[:2], fit.intercept + 5 * fit.coefficients[2]], np.linalg.lstsq(design, y, rcond=None)[0], atol=1e-8)
    assert fit.rows == 400
    with pytest.raises(ValueError):
        ml.fit_linear(frame.limit(0))


def test_last_label_line_wins(rows):
    drawings = rows([(1, "PC1", "COPY", '{"Quality": 2}'), (2, "pc1", "copy", None)], "drawing_id bigint, patient_id string, task_type string, features_data string")
    lines = rows([(1, "pc1", "Copy", "5", ""), (2, "PC1", "COPY", "7", "x"), (3, "", "COPY", "1", ""), (4, "PC9", "COPY", "1", "")],
                 "line_no bigint, Patient string, Task string, Total_Score string, Data_Quality string")
    updated, report = ingest.apply_label_csv(drawings, lines)
    got = {r["drawing_id"]: r["features_data"] for r in updated.collect()}
    assert json.loads(got[1]) == {"Quality": 2, "Total_Score": 7.0} and got[2] is None
    assert [r["status"] for r in report.orderBy("line_no").collect()] == ["updated", "updated", "skipped", "skipped"]
    assert ingest.csv_report_counts(report).first()["lines_with_errors"] == 1


def test_snapshot_may_read_and_replace_itself(spark, tmp_path):
    root = str(tmp_path)
    sinks.publish_snapshot(spark.range(5).withColumnRenamed("id", "test_id"), root, "cases")
    old = sinks.read_snapshot(spark, root, "cases")
    sinks.publish_snapshot(lifecycle.delete_by_key(old, spark.range(2).withColumnRenamed("id", "test_id"), "test_id"), root, "cases")
    assert sinks.read_snapshot(spark, root, "cases").count() == 3
    with pytest.raises(ValueError):
        sinks.reset_tables(spark, root, "yes")


def test_ingest_stream_run_twice_adds_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(20).selectExpr("id", "concat('t', id % 7) AS text", "timestamp_seconds(id) AS at").write.parquet(source)
    schema = spark.read.parquet(source).schema
    target = str(tmp_path / "out")
    for run in ("one", "two"):
        stream = jobs.ingest_stream(jobs.file_stream(spark, source, schema), "text", "text")
        jobs.start_ingest(stream, target, str(tmp_path / run), ("at", "id"), {"availableNow": True}).awaitTermination()
    got = KnownHashes(spark, target).rows()
    assert got.count() == got.select("image_hash").distinct().count() == 7


def hashed(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long").withColumn("image_hash", F.sha2((F.col("id") % 100_000).cast("string"), 256))


def test_lookups_follow_the_batch(spark, tmp_path):
    store = KnownHashes(spark, str(tmp_path / "store"))
    store.add(hashed(spark, range(3000)), "one", ["id"])
    store.add(hashed(spark, range(2900, 4000)), "two", ["id"])
    assert store.rows().count() == 4000

    def opened(ids):
        tagged = store.tagged(hashed(spark, ids))
        maybe = store.maybe_known(tagged)
        return len(store._read("filters", "block long, bits long", [r[0] for r in tagged.select("prefix").distinct().collect()]).inputFiles()), store.stored_hashes(maybe).inputFiles(), maybe.count()

    filters, hashes, maybe = opened([7])
    assert filters <= 2 and len(hashes) <= 2 and maybe == 1
    filters, hashes, maybe = opened(range(50_000, 50_040))  # new content: the filters rule nearly all of it out
    assert filters <= 80 and maybe <= 4 and len(hashes) <= 8
    assert len(opened(range(3000))[1]) > 200
    assert {r.id for r in store.fresh(store.tagged(hashed(spark, [5, 3950, 4000, 104_000]))).collect()} == {4000, 104_000}


def test_commits_repeat_and_compact(spark, tmp_path, monkeypatch):
    store = KnownHashes(spark, str(tmp_path / "store"), digits=1, blocks=16)
    store.add(hashed(spark, [1, 2, 3, 100_001]), "a", ["id"])
    store.add(hashed(spark, [1, 2, 3, 100_001]), "a", ["id"])  # the same batch again
    with monkeypatch.context() as m:
        m.setattr(KnownHashes, "_mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.add(hashed(spark, [3, 4]), "b", ["id"])
    assert sorted(r.id for r in store.rows().collect()) == [1, 2, 3]
    store.add(hashed(spark, [4, 5]), "c", ["id"])
    assert store.compact() == "base-000000001" and store.compact() is None
    store.add(hashed(spark, [5, 6]), "d", ["id"])
    assert store.compact() == "base-000000002"
    store.add(hashed(spark, [1, 4, 6, 7]).unionByName(spark.createDataFrame([(9, None)], "id long, image_hash string")), "e", ["id"])
    assert sorted(r.id for r in store.rows().collect()) == [1, 2, 3, 4, 5, 6, 7]
    with pytest.raises(Exception, match="not a hash"):
        store.add(spark.createDataFrame([(1, "xyz")], "id long, image_hash string"), "f", ["id"])


def test_scratch_is_under_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
