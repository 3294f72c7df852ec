"""WARC derivatives: response records to linked metadata and plain-text conversion records.

Every response yields two records that refer to it (``WARC-Refers-To`` with its
target and date) and name each other (``WARC-Concurrent-To``). The metadata
record keeps the source's identifiers, digests and HTTP headers and lists title,
language and links; the conversion record is the page's text. All of it is
column expressions, so Spark runs it as one map without Python or shuffle.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from trackframe.llm.common import let
from trackframe.llm.media import store

CRLF = "\r\n"
SOFTWARE = "trackframe"

# What HTML calls block elements, elements whose content is no text, and named characters.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
HIDDEN = ("script", "style", "noscript", "template")
NAMED = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "euro": "€"}

#: Comments and elements whose content is no text, to their end or that of the page.
NO_TEXT = "(?s)<(?:!--.*?(?:-->|\\z)|" + "|".join(rf"(?i:{tag})\b[^<>]*>.*?(?:</(?i:{tag})\s*>|\z)" for tag in HIDDEN) + ")"
BLOCK = rf"(?i)</?({BLOCKS})\b[^<>]*>"
TAG = r"<[A-Za-z/!?][^<>]*>"
TITLE = r"(?i)<title[^<>]*>([^<]*)"
LANGUAGE = r"(?i)<html[^<>]*\slang=[\"']?([A-Za-z-]+)"
LINK = r"(?i)<a\s[^<>]*?href=[\"']([^\"'<>]*)[\"']"
#: Blanks that are not one space.
BLANKS = r"[\x20\t\x0B\f\r\x{A0}]{2,}|[\t\x0B\f\r\x{A0}]"


def _numeric(piece: Column, pattern: str, base: int) -> Column:
    """A piece that begins with a numeric reference, decoded; null if it stands for no character."""
    digits = F.regexp_extract(piece, pattern, 1)
    code = F.conv(digits, base, 10).cast("long")
    char = F.decode(F.unhex(F.lpad(F.conv(digits, base, 16), 8, "0")), "UTF-32")
    legal = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(legal, F.concat(char, F.substr(piece, F.char_length(F.regexp_extract(piece, pattern, 0)) + 1)))


def unescape(text: Column) -> Column:
    """Decode decimal, hexadecimal and the listed named character references, each once."""
    decimal, hexadecimal = r"\A#([0-9]{1,7});", r"\A#[xX]([0-9a-fA-F]{1,6});"

    def decoded(piece: Column) -> Column:
        number = F.when(F.rlike(piece, F.lit(decimal)), _numeric(piece, decimal, 10)).when(F.rlike(piece, F.lit(hexadecimal)), _numeric(piece, hexadecimal, 16))
        out = F.when(F.startswith(piece, F.lit("#")), number)
        for name, char in {"amp": "&", **NAMED}.items():
            out = out.when(F.startswith(piece, F.lit(f"{name};")), F.concat(F.lit(char), F.substr(piece, F.lit(len(name) + 2))))
        return F.coalesce(out, F.concat(F.lit("&"), piece))

    def joined(pieces: Column) -> Column:
        return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), decoded), ""))

    return _if_any(text, ["&"], lambda t: let(F.split(t, "&"), joined))


def _if_any(text: Column, marks: list[str], change: Callable[[Column], Column]) -> Column:
    """``change`` of a text that has one of ``marks``; looking for a mark costs far less than a replacement."""

    def looked(t: Column) -> Column:
        found = F.contains(t, F.lit(marks[0]))
        for mark in marks[1:]:
            found = found | F.contains(t, F.lit(mark))
        return F.when(found, change(t)).otherwise(t)

    return let(text, looked)


def plain_text(html: Column) -> Column:
    """The text of a page: no comments, scripts or tags, a line for each block, single blanks."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, NO_TEXT, ""), BLOCK, "\n"), TAG, "")
    text = unescape(text)
    text = _if_any(text, ["  ", "\t", "\x0b", "\f", "\r", "\xa0"], lambda t: F.regexp_replace(t, BLANKS, " "))
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    """A name-based ``<urn:uuid:...>``: the same source gives the same identifier."""
    h = F.md5(F.concat_ws(" ", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records (id, record_id, target_uri, date, http_headers, payload, digests) of fetched pages."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF * 2))
    return pages.select(
        F.col(id_col).alias("id"),
        record_id(F.lit("response"), F.col(id_col).cast("string"), F.col(url_col), F.sha2(html, 256)).alias("record_id"),
        F.col(url_col).alias("target_uri"),
        F.lit(date).alias("date"),
        head.alias("http_headers"),
        html.alias("payload"),
        digest(html).alias("payload_digest"),
        digest(F.concat(head, html)).alias("block_digest"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two rows, metadata and conversion, for each response record.

    Columns: id, record_type, record_id, refers_to, concurrent_to, target_uri,
    date, content_type, content_length, block_digest, source_payload_digest,
    headers, body. A null target leaves its header lines out; a null or empty
    payload gives an empty conversion; repeated responses give repeated records.
    An empty table gives no rows.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    payload = F.coalesce("payload", F.lit(""))
    one_line = lambda text: F.trim(F.regexp_replace(text, r"\s+", " "))
    links = F.transform(F.regexp_extract_all(payload, F.lit(LINK), F.lit(1)), lambda x: line("outlink", one_line(unescape(x))))
    http = F.transform(F.filter(F.split("http_headers", CRLF), lambda x: x != ""), lambda x: line("source-http-header", x))
    fields = F.array_join(
        F.concat(
            F.array(
                line("source-record-id", F.col("record_id")),
                line("source-payload-digest", F.col("payload_digest")),
                line("source-block-digest", F.col("block_digest")),
                line("title", one_line(unescape(F.regexp_extract(payload, TITLE, 1)))),
                line("language", F.lower(F.regexp_extract(payload, LANGUAGE, 1))),
            ),
            http,
            links,
        ),
        CRLF,
    )
    # the digests below read each body several times, so it is made once, in its own row
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("body")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(payload).alias("body")),
    )
    rows = source.select("id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("payload_digest").alias("source_payload_digest"), F.explode(kinds).alias("k"))
    rows = rows.select("*", "k.*").drop("k")
    other = F.when(F.col("record_type") == "metadata", "conversion").otherwise("metadata")
    rows = rows.select(
        "id",
        "record_type",
        record_id(F.col("record_type"), F.col("refers_to")).alias("record_id"),
        "refers_to",
        record_id(other, F.col("refers_to")).alias("concurrent_to"),
        "target_uri",
        "date",
        "content_type",
        F.octet_length("body").cast("long").alias("content_length"),
        digest(F.col("body")).alias("block_digest"),
        "source_payload_digest",
        "body",
    )
    headers = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("date")),
        line("WARC-Concurrent-To", F.col("concurrent_to")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
    )
    return rows.select(*rows.columns[:-1], headers.alias("headers"), "body")


class _WarcWriter(DataSourceWriter):
    """One file for each task, every record a gzip member of its own, a ``warcinfo`` record first.

    Files of committed tasks get their names at the end, so that lost attempts leave none.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> "_Written":
        fs, root = store(self.path)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        name, info = f"part-{uuid.uuid4().hex}.warc.gz", f"software: {SOFTWARE}{CRLF}format: WARC File Format 1.1{CRLF}".encode()
        with fs.open_output_stream(f"{root}/_temporary/{name}", compression=None) as out:
            when = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
            head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {when}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(info)}"]
            out.write(_member(CRLF.join(head), info))
            for row in iterator:
                out.write(_member(row.headers, (row.body or "").encode("utf-8")))
        return _Written(name)

    def commit(self, messages: list["_Written | None"]) -> None:
        fs, root = store(self.path)
        for m in messages:
            if m:
                fs.move(f"{root}/_temporary/{m.name}", f"{root}/{m.name}")
        if fs.get_file_info(f"{root}/_temporary").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary")

    def abort(self, messages: list["_Written | None"]) -> None:
        fs, root = store(self.path)
        if fs.get_file_info(f"{root}/_temporary").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary")


@dataclass
class _Written(WriterCommitMessage):
    name: str


def _member(headers: str, body: bytes) -> bytes:
    return gzip.compress(headers.encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


class WarcFiles(DataSource):
    """``format("warc_files")``: writes (headers, body) rows; the folder must be of one writer at a time."""

    @classmethod
    def name(cls) -> str:
        return "warc_files"

    def schema(self) -> str:
        return "headers string, body string"

    def writer(self, schema, overwrite: bool) -> _WarcWriter:
        return _WarcWriter(self.options["path"])


def write_warc(records: DataFrame, path: str, once: bool = True) -> None:
    """Write records as ``.warc.gz`` files under ``path``.

    Repeated responses have records of one identifier, which a set of files may
    hold once only; ``once`` drops the repetitions.
    """
    records.sparkSession.dataSource.register(WarcFiles)
    rows = records.dropDuplicates(["record_id"]) if once else records
    rows.select("headers", "body").write.format("warc_files").mode("append").save(path)
