"""Media columns: exact round trips, byte ranges, members that fail."""

import hashlib
import os
import zlib

import pytest

from trackframe.llm import media
from trackframe.llm.queries import op2_media_columns


def test_padding_and_image_round_trip():
    for raw in [b"", b"a", b"a" * 63, b"a" * 64, b"a" * 65, os.urandom(5000)]:
        padded = media.pad(raw)
        assert len(padded) % 64 == 0 and padded and padded.rstrip(b"\0") == raw.rstrip(b"\0") and len(padded) - len(raw) <= 64
        assert media.from_png(media.to_png(padded)) == padded
    with pytest.raises(ValueError):
        media.from_png(media.to_png(media.pad(b"x"))[:-20] + b"\0" * 20)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op2_media_columns(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_png(padded)).hexdigest() and r.error is None


def test_ranges_nulls_repeats_and_damaged_members(spark, tmp_path):
    rows = [(i, os.urandom(3000).hex(), "x") for i in range(40)] + [(99, "long " * 300_000, "x")] + [(5, None, "y"), (5, "", "y"), (None, "same", "z"), (7, "same", "z")]
    docs = spark.createDataFrame(rows, "id2 long, text string, payload string").withColumnRenamed("id2", "doc_id").coalesce(2)
    media.store_texts(docs, str(tmp_path))
    got = media.read_media(spark, str(tmp_path), splitBytes=10_000).collect()
    assert sorted((r.id if r.id is not None else -1, bytes(r.payload)) for r in got) == sorted((i if i is not None else -1, media.pad((t or "").encode())) for i, t, _ in rows)
    same = [r for r in media.features(media.read_media(spark, str(tmp_path))).collect() if r.n_bytes == 4]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1 and len(same) == 2

    victim = next(r for r in got if r.id == 20)
    with open(victim.archive, "r+b") as f:  # only this member is lost
        f.seek(victim.member_offset + 200)
        f.write(b"\xff" * 50)
    after = media.features(media.read_media(spark, str(tmp_path), attempts=2)).collect()
    assert len(after) == len(rows)
    assert [(r.id, r.attempts, r.payload_sha256) for r in after if r.error] == [(20, 2, None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert media.media_features(docs).count() == 0


def test_members_are_retried_by_themselves(tmp_path, monkeypatch):
    writer = media.Writer(str(tmp_path))
    row = type("Row", (), {"id": 3, "text": "abc"})()
    writer.commit([writer.write(iter([row])), None])
    reader = media.Reader({"path": str(tmp_path)})
    fails, plain = iter([True, False]), media.from_png

    def flaky(raw):
        if next(fails):
            raise OSError("lost")
        return plain(raw)

    monkeypatch.setattr(media, "from_png", flaky)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [(r["id"], r["attempts"], r["error"]) for b in batches for r in b.to_pylist()] == [(3, 2, None)]


def test_appends_add_and_overwrites_replace(spark, tmp_path):
    docs = lambda a, b: spark.createDataFrame([(i, f"text {i} " * 40) for i in range(a, b)], "doc_id long, text string")
    ids = lambda: sorted(r.id for r in media.read_media(spark, str(tmp_path)).collect())
    archives = lambda: [x for x in os.listdir(tmp_path) if x.endswith(".zip")]
    media.store_texts(docs(0, 30), str(tmp_path), archiveBytes=500)
    assert len(archives()) > 8
    media.store_texts(docs(30, 40), str(tmp_path))
    assert ids() == list(range(40))
    media.Writer(str(tmp_path)).write(iter([]))
    with open(tmp_path / "media-lost.zip", "wb") as f:  # of an attempt that was not committed
        f.write(b"PK")
    media.store_texts(docs(5, 8), str(tmp_path), mode="overwrite")
    assert ids() == [5, 6, 7]
    media.store_texts(docs(0, 0), str(tmp_path), mode="overwrite")
    assert ids() == [] and archives() == ["media-lost.zip"]


def test_other_file_systems():
    with pytest.raises(ValueError, match="another folder"):
        media.store("nosuch://a/b")
    fs, root = media.store("s3a://bucket/a?region=x")
    assert fs.type_name == "s3" and root == "bucket/a"


def test_foreign_archives_with_long_headers(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        for i in range(5):
            info = zipfile.ZipInfo("n" * 3000 + f"{i}.png")
            info.extra = b"\x99\x99" + (2000).to_bytes(2, "little") + bytes(2000)
            archive.writestr(info, media.to_png(media.pad(bytes([65 + i]))))
    reader = media.Reader({"path": str(tmp_path), "splitbytes": "7000"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["payload"][:1] for r in rows] == [b"A", b"B", b"C", b"D", b"E"] and not any(r["error"] for r in rows)
