"""Sources and sinks on real files."""

import base64
import hashlib
import os

from pyspark.sql import functions as F

from trackframe.sources import files

PNG = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==")


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.mp4", "a", "talk", 60, 30.0, "hello"), ("b.mp4", "b", None, 1, 60.0, "")], "file string, source_sample string, motion string, frames int, fps double, transcript string")
    files.write_manifest(files.manifest_columns(rows, "frames", "fps"), str(tmp_path / "m"))
    back = {r.file: r for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert (back["a.mp4"].seconds, back["a.mp4"].expected_frames_at_25fps, back["b.mp4"].seconds, back["b.mp4"].expected_frames_at_25fps) == (2.0, 50, 0.02, 1)
    (tmp_path / "m.json").write_text('[{"file": "a", "frames": 3, "fps": 25.0},\n {"file": "b"}]')
    assert [(r.file, r.frames) for r in files.read_manifest(spark, str(tmp_path / "m.json")).orderBy("file").collect()] == [("a", 3), ("b", None)]


def test_transcripts_stills_and_description(spark, tmp_path):
    for name, content in (("one.txt", "  hello\nworld \n"), ("two.txt", "")):
        (tmp_path / name).write_text(content)
    got = {r.stem: r.transcript for r in files.read_transcripts(spark, str(tmp_path / "*.txt")).collect()}
    assert got["one"] == "hello\nworld"
    os.makedirs(tmp_path / "i")
    (tmp_path / "i" / "a.png").write_bytes(PNG)
    (tmp_path / "i" / "b.png").write_bytes(b"no image")
    stills = files.read_stills(spark, str(tmp_path / "i")).collect()
    assert sorted((r.path[-5:], r.valid) for r in stills if r.path) == [("a.png", True), ("b.png", False)]
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    (row,) = files.describe(spark, str(tmp_path / "p")).collect()
    assert row.rows == 10 and row.bytes > 0


def test_integrity_and_retention_of_real_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"abd")
    os.utime(tmp_path / "a.bin", (1000, 1000))
    listed = spark.read.format("binaryFile").load(str(tmp_path / "*.bin")).withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    sha = hashlib.sha256(b"abc").hexdigest()
    catalog = spark.createDataFrame([("a.bin", sha.upper()), ("b.bin", sha), ("c.bin", sha)], "name string, sha256 string")
    got = files.integrity(catalog, listed, "name", "sha256", F.col("content"))
    assert {r.name: r.status for r in got.collect()} == {"a.bin": "present", "b.bin": "corrupt", "c.bin": "missing"}
    old = files.expired(listed.drop("content"), F.unix_timestamp("modificationTime"), F.unix_timestamp(F.current_timestamp()), 900)
    assert [r.name for r in old.collect()] == ["a.bin"]
    assert files.expired(listed, F.unix_timestamp("modificationTime"), F.unix_timestamp(F.current_timestamp()), -1).count() == 2


def test_admission(spark):
    rows = [("video/mp4; x=1", 5), ("", 5), (None, 0), ("text/html", 0), ("VIDEO/MP4 ", 11)]
    got = spark.createDataFrame(rows, "c string, n int").select(files.admission(F.col("c"), F.col("n"), ["video/mp4"], 10)).collect()
    assert [r[0] for r in got] == [200, 200, 400, 415, 413]
    names = spark.createDataFrame([("a.MOV",), ("a.exe",), (None,), ("x.tar/y",)], "n string").select(files.suffix(F.col("n"))).collect()
    assert [r[0] for r in names] == [".mov", ".mp4", ".mp4", ".mp4"]


def test_key_rewrites_need_the_marker(spark):
    keys = spark.createDataFrame([("module.a.x",), ("b.y",)], "key string")
    rules = [("module.a.", "enc."), ("module.", "")]
    assert [r.new_key for r in files.rewrite_keys(keys, "key", rules, "module.").orderBy("key").collect()] == ["b.y", "enc.x"]
    assert [r.new_key for r in files.rewrite_keys(keys, "key", rules, "zzz").orderBy("key").collect()] == ["b.y", "module.a.x"]


def test_files_in_folders_are_read_by_few_tasks(spark, tmp_path):
    """However many small files there are, the driver plans no task for every few of them."""
    texts = [f" text {i} \n" if i % 5 else "" for i in range(1500)]
    rows = spark.createDataFrame([(f"a.{i}.txt", t) for i, t in enumerate(texts)] + [(None, "x"), ("y", None)], "name string, text string")
    assert files.write_files(rows, f"{tmp_path}/in", "name", "text", 64) == 1500
    got = files.read_transcripts(spark, f"{tmp_path}/in", 64)
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, got.collect())) == sorted((f"a.{i}", t.strip()) for i, t in enumerate(texts))
