"""Files and manifests: admission, integrity, retention, metadata, sinks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
import pyarrow.parquet
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe import schemas

# Suffixes of files that are taken.
ALLOWED_SUFFIXES = (".mp4", ".mov", ".webm", ".mkv", ".avi")
MAX_UPLOAD = 200 << 20


def admission(content_type: Column, size: Column, allowed: list[str], max_bytes: int = MAX_UPLOAD) -> Column:
    """HTTP-like status: 415 for a type that is not allowed, 400 empty, 413 too large, 200 else.

    Parameters after ``;`` and case are ignored; a blank type passes.
    """
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return F.when((kind != "") & ~kind.isin(allowed), 415).when(size == 0, 400).when(size > max_bytes, 413).otherwise(200)


def suffix(name: Column, allowed: tuple[str, ...] = ALLOWED_SUFFIXES, fallback: str = ".mp4") -> Column:
    found = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"(\.[^./]+)$", 1)
    return F.when(found.isin(*allowed), found).otherwise(F.lit(fallback))


def integrity(catalog: DataFrame, files: DataFrame, key: str, expected: str, content: Column) -> DataFrame:
    """The catalogue with ``status`` present, missing or corrupt by the SHA-256 of ``content``."""
    sums = files.select(key, F.sha2(content, 256).alias("_sum"))
    status = F.when(F.col("_sum").isNull(), "missing").when(F.col("_sum") == F.lower(expected), "present").otherwise("corrupt")
    return catalog.join(sums, key, "left").withColumn("status", status).drop("_sum")


def expired(files: DataFrame, modified: Column, asof: Column, max_age: float) -> DataFrame:
    """Files modified more than ``max_age`` seconds before ``asof``; -1 takes those of this moment too."""
    return files.where(modified < asof - max_age)


def normalise_clip(width: Column, height: Column, rotation: Column, stream_duration: Column, container_duration: Column, fps: Column) -> Column:
    """(width, height, rotation, duration_s, fps): upright dimensions, first known duration, 0 where nothing is known."""
    turn = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(360))
    turned = turn.isin(90, 270)
    return F.struct(
        F.when(turned, height).otherwise(width).alias("width"),
        F.when(turned, width).otherwise(height).alias("height"),
        turn.alias("rotation"),
        F.coalesce(stream_duration, container_duration, F.lit(0.0)).alias("duration_s"),
        F.coalesce(fps, F.lit(0.0)).alias("fps"),
    )


def manifest_columns(rows: DataFrame, frames: str, fps: str) -> DataFrame:
    """Adds ``seconds`` (2 digits) and ``expected_frames_at_25fps`` (at least 1)."""
    seconds = F.col(frames) / F.col(fps)
    return rows.withColumn("seconds", F.bround(seconds, 2)).withColumn("expected_frames_at_25fps", F.greatest(F.lit(1), (seconds * 25).cast("int")))


def read_manifest(spark: SparkSession, path: str, schema: str = schemas.MANIFEST, lines: bool = False) -> DataFrame:
    """A JSON array of flat objects, or (``lines``) one object a line, as ``write_manifest`` writes."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI (local, ``hdfs``, ``s3a``, ``gs``), and its path there."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else f"file://{path}")


def write_files(rows: DataFrame, path: str, name: str, content: str, folders: int = 1) -> int:
    """Write each row's ``content`` (text or bytes) to a file of its ``name`` in a shared folder, by the tasks; the number of files.

    A task that runs again writes the same files. Rows without a name or content are left out. With several ``folders`` the files are
    dealt by their names to so many numbered ones, which tasks can list side by side.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = folder(path)
        at.create_dir(root, recursive=True)
        made = set()
        for batch in batches:
            for own, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if folders > 1:
                    part = zlib.crc32(own.encode()) % folders
                    if part not in made:
                        at.create_dir(f"{root}/{part}", recursive=True)
                        made.add(part)
                    own = f"{part}/{own}"
                with at.open_output_stream(f"{root}/{own}") as out:
                    out.write(value)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    picked = rows.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).where("name IS NOT NULL AND content IS NOT NULL")
    return picked.mapInArrow(written, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_transcripts(spark: SparkSession, path: str, folders: int = 1) -> DataFrame:
    """(stem, transcript) of whole text files.

    Of ``folders`` that ``write_files`` made, tasks list and read the files: the driver, which would list them all and plan a task for
    every few small files, sees none of them.
    """
    if folders > 1:
        rows = spark.range(0, folders, 1, min(folders, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_contents(path), "file string, content binary")
        rows = rows.select("file", F.col("content").cast("string").alias("value"))
    else:
        rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return rows.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("transcript"))


def _contents(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(file, content) of the files in the numbered folders of a batch, some 16 MB or 1,000 files at once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = folder(path)
        held: list[tuple[str, bytes]] = []
        size = 0
        for part in (x for batch in batches for x in batch["id"].to_pylist()):
            for info in at.get_file_info(fs.FileSelector(f"{root}/{part}", allow_not_found=True)):
                if not info.is_file:
                    continue
                with at.open_input_stream(info.path) as f:
                    held.append((info.base_name, f.read()))
                size += len(held[-1][1])
                if size > 16 << 20 or len(held) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.string(), pa.binary()), strict=True)], ["file", "content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.string(), pa.binary()), strict=True)], ["file", "content"])

    return read


def read_stills(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, valid, data) of JPEG and PNG files; undecodable ones are kept, not valid."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    valid = (F.col("nChannels") > 0) & (F.col("height") > 0)
    return rows.select(F.col("origin").alias("path"), "width", "height", valid.alias("valid"), F.when(valid, F.col("data")).alias("data"))


def describe(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, bytes) of a Parquet dataset."""
    rows = spark.read.parquet(path).select("_metadata.file_name", "_metadata.file_size")
    return rows.groupBy(F.col("file_name").alias("file")).agg(F.count("*").alias("rows"), F.max("file_size").alias("bytes"))


def systematic_sample(rows: DataFrame, position: str, total: int, wanted: int, columns: int) -> DataFrame:
    """Every max(1, total // wanted)-th row, the first ``wanted``, with its place on a sheet of ``columns``."""
    step = max(1, total // wanted)
    taken = rows.where((F.col(position) % step == 0) & (F.col(position) < step * wanted))
    nth = F.floor(F.col(position) / step)
    return taken.withColumn("sheet_row", F.floor(nth / columns).cast("long")).withColumn("sheet_column", F.pmod(nth, F.lit(columns)).cast("long"))


def rewrite_keys(keys: DataFrame, key: str, rules: list[tuple[str, str]], marker: str) -> DataFrame:
    """Adds ``new_key``: the first rule whose prefix fits rewrites it; no key changes unless one has ``marker``."""
    marked = keys.where(F.col(key).startswith(marker)).limit(1).count() > 0
    out = F.col(key)
    for old, new in reversed(rules if marked else []):
        out = F.when(F.col(key).startswith(old), F.concat(F.lit(new), F.substr(F.col(key), F.lit(len(old) + 1)))).otherwise(out)
    return keys.withColumn("new_key", out)


def compare_keys(present: DataFrame, required: DataFrame, key: str, ignorable: tuple[str, ...] = ()) -> DataFrame:
    """(key, status): loaded, unexpected, missing or ignorable."""
    both = present.select(key).distinct().withColumn("_p", F.lit(True)).join(required.select(key).distinct().withColumn("_r", F.lit(True)), key, "full_outer")
    fine = F.lit(False)
    for prefix in ignorable:
        fine = fine | F.col(key).startswith(prefix)
    status = F.when(F.col("_p") & F.col("_r"), "loaded").when(F.col("_p"), "unexpected").when(fine, "ignorable").otherwise("missing")
    return both.select(key, status.alias("status"))


#: So many known keys at most are named in an error.
NAMED_KEYS = 50


def look_up(rows: DataFrame, catalog: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the catalogue's ``value``; an unknown key gets an ``error`` that lists the known ones, the first ``NAMED_KEYS`` of them."""
    known = catalog.select(F.col(key).alias("k")).where("k is not null").distinct().orderBy("k").limit(NAMED_KEYS + 1).collect()
    named = ", ".join(str(r["k"]) for r in known[:NAMED_KEYS]) + ", ..." * (len(known) > NAMED_KEYS)
    joined = rows.join(F.broadcast(catalog.select(key, value)) if catalog.limit(10_001).count() <= 10_000 else catalog.select(key, value), key, "left")
    error = F.when(F.col(value).isNull(), F.concat(F.lit("Unknown key '"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"'. Known: {named}")))
    return joined.withColumn("error", error)


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """The rows of ``required`` whose ``key`` is not among ``present``."""
    return required.join(present.select(key).distinct(), key, "left_anti")


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, columns, row_groups, rows, bytes) of every file of a Parquet dataset, by its footer; tasks read the footers."""
    names = spark.createDataFrame([(f,) for f in spark.read.parquet(path).inputFiles()], "file string")

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name in batch["file"]:
                fs, own = pyarrow.fs.FileSystem.from_uri(name)
                with fs.open_input_file(own) as f:
                    found = pyarrow.parquet.ParquetFile(f).metadata
                    out.append((name.rsplit("/", 1)[-1], found.num_columns, found.num_row_groups, found.num_rows, f.size()))
            yield pd.DataFrame(out, columns=["file", "columns", "row_groups", "rows", "bytes"])

    return names.repartition(max(1, min(names.count(), spark.sparkContext.defaultParallelism))).mapInPandas(footers, "file string, columns int, row_groups int, rows long, bytes long")


def still_counts(stills: DataFrame) -> DataFrame:
    """(decoded, rejected) of what ``read_stills`` gives."""
    return stills.agg(F.count_if("valid").alias("decoded"), F.count_if(~F.col("valid")).alias("rejected"))
