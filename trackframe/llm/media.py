"""Media columns: archives of 8-bit images behind a custom Spark data source.

``MediaArchives`` writes each row's payload as a member of a ZIP archive (a
grey PNG of 64 samples a line, lossless) and reads archive folders back:

* planning lists the archives and cuts each into byte ranges; no file is opened;
* a task reads the archive's directory from its end, takes the members whose
  header lies in its range and streams them as Arrow batches;
* a member is fetched by its own offset and, if that fails, fetched again by
  itself; one that stays unreadable becomes a row with ``error``.

A task reads the members of a range in blocks of neighbours, and only a member that
fails there is fetched alone. The writer begins a new archive at ``ARCHIVE_BYTES``,
so that the directory each range has to read stays short. Every committed write
adds a list of its archives, which names the lists that it replaces, if any; what
is in no list (of repeated or lost attempts) is not read.
"""

from __future__ import annotations

import json
import os
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from trackframe.llm.common import shared_dir, small_batches

LINE = 64
BATCH_BYTES = 8 << 20
SPLIT_BYTES = 32 << 20
ARCHIVE_BYTES = 128 << 20
SCHEMA = "id bigint, n_bytes bigint, media binary, payload binary, archive string, member_offset bigint, attempts int, error string"
#: A member's own header: 30 bytes, and its name and extra field, which have two length bytes each.
HEAD_BYTES = 30 + 2 * 0xFFFF
#: Hadoop's names of schemes that the file systems here know by another.
ALIASES = {"s3a": "s3", "s3n": "s3"}
PNG_START = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    """``raw`` and bytes 0 up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % LINE or (0 if raw else LINE))


def to_png(payload: bytes) -> bytes:
    """A payload of whole lines as an 8-bit grey image."""
    lines = len(payload) // LINE
    samples = np.zeros((lines, LINE + 1), np.uint8)  # each line begins with filter 0
    samples[:, 1:] = np.frombuffer(payload, np.uint8).reshape(lines, LINE)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", LINE, lines, 8, 0, 0, 0, 0)
    return PNG_START + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(samples.tobytes(), 5)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; ValueError if it is damaged."""
    if media[:8] != PNG_START:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    samples = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if samples[:, 0].any():
        raise ValueError("only filter 0 is read")
    return samples[:, 1:].tobytes()


@dataclass
class ByteRange(InputPartition):
    archive: str
    size: int
    start: int
    end: int

    def __init__(self, archive: str, size: int, start: int, end: int):
        self.archive, self.size, self.start, self.end = archive, size, start, end


@dataclass
class Archives(WriterCommitMessage):
    names_and_sizes: list[tuple[str, int]]


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI or local path; Hadoop's names of a scheme count as the plain one."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), os.path.abspath(path)
    scheme, rest = path.split(":", 1)
    try:
        return pa.fs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"media archives can't be kept under {scheme}: ({e}); name another folder by ``path``") from e


class Writer(DataSourceWriter):
    """Archives of up to some ``archive_bytes``; members are stored as they are, being compressed."""

    def __init__(self, path: str, overwrite: bool = False, archive_bytes: int = ARCHIVE_BYTES):
        self.path, self.overwrite, self.archive_bytes = path, overwrite, archive_bytes

    def write(self, iterator: Iterator) -> Archives:
        fs, root = store(self.path)
        fs.create_dir(root, recursive=True)
        rows, made = iter(iterator), []
        row = next(rows, None)
        while row is not None:
            name, members = f"media-{uuid.uuid4().hex}.zip", 0
            with fs.open_output_stream(f"{root}/{name}") as raw_out:
                out = _Unseekable(raw_out)
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    while row is not None and (not members or out.size < self.archive_bytes):
                        raw = (row.text or "").encode("utf-8")
                        info = zipfile.ZipInfo(f"{members}.png")
                        info.comment = json.dumps([row.id, len(raw)]).encode()
                        archive.writestr(info, to_png(pad(raw)))
                        members += 1
                        row = next(rows, None)
            made.append((name, out.size))
        return Archives(made)

    def commit(self, messages: list[Archives | None]) -> None:
        fs, root = store(self.path)
        fs.create_dir(root, recursive=True)
        before = _lists(fs, root)
        own = {"archives": [x for m in messages if m for x in m.names_and_sizes], "replaces": sorted(before) if self.overwrite else []}
        with fs.open_output_stream(f"{root}/archives-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(own).encode())
        for name in own["replaces"]:  # the new list is in force; what is left after a failure here is not read
            for archive, _ in before[name]["archives"]:
                fs.delete_file(f"{root}/{archive}")
            fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Archives | None]) -> None:
        fs, root = store(self.path)
        for name, _ in (x for m in messages if m for x in m.names_and_sizes):
            if fs.get_file_info(f"{root}/{name}").type != pa.fs.FileType.NotFound:
                fs.delete_file(f"{root}/{name}")


def _lists(fs: pa.fs.FileSystem, root: str) -> dict[str, dict]:
    """The lists of archives in force, by file name."""
    found = {}
    for f in fs.get_file_info(pa.fs.FileSelector(root)):
        if f.base_name.startswith("archives-") and f.extension == "json":
            with fs.open_input_stream(f.path) as names:
                found[f.base_name] = json.loads(names.read())
    replaced = {name for x in found.values() for name in x["replaces"]}
    return {name: x for name, x in found.items() if name not in replaced}


class _Unseekable:
    """Lets ``zipfile`` write to a stream that cannot seek."""

    def __init__(self, out):
        self.out, self.size = out, 0

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.tries = int(options.get("attempts", 3))

    def partitions(self) -> list[ByteRange]:
        fs, root = store(self.path)
        lists = _lists(fs, root)
        if lists:
            files = [(f"{root}/{name}", size) for x in lists.values() for name, size in x["archives"]]
        else:  # a folder of other archives
            files = [(f.path, f.size) for f in fs.get_file_info(pa.fs.FileSelector(root)) if f.extension == "zip"]
        ranges = [ByteRange(p, n, at, min(at + self.split, n)) for p, n in files for at in range(0, n, self.split)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = store(self.path)
        rows, held = [], 0
        for group in _neighbours(self._directory(fs, partition)):
            block = self._block(fs, partition.archive, group)
            for info in group:
                row = self._member(fs, partition.archive, info, block)
                rows.append(row)
                held += len(row[2] or b"") + len(row[3] or b"")
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _again(self, work):
        """``work(n)`` of the n-th try, tried again after errors: (result, attempts, error)."""
        for n in range(1, self.tries + 1):
            try:
                return work(n), n, None
            except (OSError, ValueError, zlib.error, zipfile.BadZipFile, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * (n < self.tries))
        return None, self.tries, error

    def _directory(self, fs: pa.fs.FileSystem, partition: ByteRange) -> list[zipfile.ZipInfo]:
        def entries(_):
            with fs.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as archive:
                return [x for x in archive.infolist() if partition.start <= x.header_offset < partition.end]

        found, _, error = self._again(entries)
        if error:
            raise OSError(f"{partition.archive}: {error}")
        return sorted(found, key=lambda x: x.header_offset)

    def _block(self, fs: pa.fs.FileSystem, archive: str, group: list[zipfile.ZipInfo]) -> tuple[int, bytes]:
        """Where neighbouring members begin, and their bytes; none if they can't be read at once."""
        first, last = group[0].header_offset, group[-1]
        try:
            with fs.open_input_file(archive) as f:
                return first, f.read_at(last.header_offset + HEAD_BYTES + last.compress_size - first, first)
        except OSError:
            return first, b""

    def _member(self, fs: pa.fs.FileSystem, archive: str, info: zipfile.ZipInfo, block: tuple[int, bytes]) -> tuple:
        key, n_bytes = json.loads(info.comment or b"[null, null]")

        def fetch(attempt: int):
            raw, at = block[1], info.header_offset - block[0]
            if attempt > 1 or not raw:
                with fs.open_input_file(archive) as f:
                    raw, at = f.read_at(HEAD_BYTES + info.compress_size, info.header_offset), 0
            name, extra = struct.unpack("<HH", raw[at + 26 : at + 30])
            start = at + 30 + name + extra
            media = raw[start : start + info.compress_size]
            if raw[at : at + 4] != b"PK\x03\x04" or zlib.crc32(media) != info.CRC:
                raise ValueError("damaged member")
            return media, from_png(media)

        got, attempts, error = self._again(fetch)
        media, payload = got or (None, None)
        return key, n_bytes, media, payload, archive, info.header_offset, attempts, error


def _neighbours(members: list[zipfile.ZipInfo]) -> Iterator[list[zipfile.ZipInfo]]:
    """Members in groups that span at most some ``BATCH_BYTES`` of the archive."""
    group: list[zipfile.ZipInfo] = []
    for x in members:
        if group and x.header_offset + x.compress_size - group[0].header_offset > BATCH_BYTES:
            yield group
            group = []
        group.append(x)
    if group:
        yield group


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class MediaArchives(DataSource):
    """``format("media_archives")``: a folder of ZIP archives of PNG members."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, int(self.options.get("archivebytes", ARCHIVE_BYTES)))


def store_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "append", **options) -> None:
    """Store every text (null: empty) as UTF-8, padded, in archives under ``path``. Other columns are left out; ids are whole numbers, or strings of them.

    ``mode`` append adds to what is there, overwrite replaces it.
    """
    small_batches(docs.sparkSession)
    docs.sparkSession.dataSource.register(MediaArchives)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows.write.format("media_archives").options(**options).mode(mode).save(path)


def read_media(spark, path: str, **options) -> DataFrame:
    """The members under ``path``; unreadable ones have ``error`` and null media and payload."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(path)


def features(media: DataFrame) -> DataFrame:
    """Rows of ``read_media`` with digests and ``feature``: mean, deviation, entropy and change of the samples.

    Equal payloads have equal values. Unreadable members have nulls and keep their error.
    """

    @F.pandas_udf("tail_crc32 long, feature string")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payloads in batches:
            yield pd.DataFrame([_measured(p) for p in payloads], columns=["tail_crc32", "feature"]).astype({"tail_crc32": "Int64"})

    own = media.withColumn("measured", measure("payload"))
    return own.select(
        "id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        "measured.tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "measured.feature",
        "attempts",
        "error",
    )


def _measured(payload: bytes | None) -> tuple[int | None, str | None]:
    if payload is None:
        return None, None
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    change = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    mean, deviation = float(samples.mean()), float(samples.std())
    return zlib.crc32(payload[-LINE:]), f"mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};change={change:.4f};lines={len(samples) // LINE}"


def media_features(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts of ``docs`` (under the shared folder if no ``path`` is given), read them back and measure them.

    One row for each row of ``docs``; null texts are empty, repeated rows and
    null ids stay, an empty table gives an empty result.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    store_texts(docs, path, id_col, text_col)
    return features(read_media(docs.sparkSession, path))

