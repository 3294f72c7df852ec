"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and in how many documents.

Two tokenizers cut a text's bytes differently. Offsets where tokens of both end cut
both sequences into *groups*; two tokens whose bytes overlap are *linked*. How
often a pair of ids is linked is kept in inverted bitmaps: documents are numbered within blocks
of ``BLOCK``, and for each block and pair there is one compressed bitmap of the documents that hold the pair,
and one more for each binary digit of how often beyond the first (*multiplicity planes*). Bitmaps of a
pair in different blocks are disjoint, so their union's population is the sum of theirs: document counts
are popcounts of the first plane, link counts those of all planes times their digit's
weight, and no row ever holds a pair's documents of the whole corpus. Once
counts are known, the same bitmaps carry them back to the documents of their block.

The work of cutting is done once for each distinct *segment*: neither tokenizer joins a character
that is no white space to a space after it, so a text falls apart before such spaces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackframe.llm.common import materialize, small_batches
from trackframe.llm.tokens import encoder

#: Documents of a block at most; a bitmap of all of them takes ``BLOCK // 8`` bytes, and shorter lists of places are kept as such.
BLOCK = 2048
#: A block is closed once its documents have so many segments, so long documents make small blocks.
BLOCK_SEGMENTS = 1_000_000
#: Distinct segments that a worker remembers between blocks.
MEMO = 300_000
#: Most repeats of a segment in one sort key.
REPEATS = (1 << 20) - 1

_APART = re.compile(r"(?<=\S)(?= )")
_UNUSUAL = re.compile(r"\s ")


def segments(text: str) -> list[str]:
    """A space and the text, cut before each space that follows no white space; each without its first space.

    >>> segments("a b  c")
    ['a', 'b', ' c']
    """
    text = " " + text
    if _UNUSUAL.search(text) is None:
        return text[1:].split(" ")
    return [s[1:] for s in _APART.split(text)]


class Vocabularies:
    """The two tokenizers, the bytes of their tokens and the spelling of their ids."""

    def __init__(self, ranks: str, pattern: str, pieces: str) -> None:
        self.a = encoder(ranks, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        a_bytes = [self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.bare = self.b.piece_to_id("▁")
        self.a_length, self.b_length = (np.array([len(x) for x in xs], np.int64) for xs in (a_bytes, self.b_bytes))
        spelled = lambda n, end: [f"{i}{e}" for e in (",", end) for i in range(n)]
        self.a_spelled, self.b_spelled = np.array(spelled(len(a_bytes), "|"), object), np.array(spelled(len(names), ";"), object)

    def cut(self, keys: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """The ids of segments by both tokenizers; False for those whose bytes the second one does not keep, which get none."""
        a = [self.a.encode_ordinary(" " + k) for k in keys]
        b = self.b.encode(keys, num_threads=1)
        kept = np.ones(len(keys), bool)
        for i, k in enumerate(keys):
            if not k:
                b[i] = [self.bare]  # the tokenizer adds no space to nothing
            if b"".join([self.b_bytes[x] for x in b[i]]) != (" " + k).encode():
                a[i], b[i], kept[i] = [], [], False
        return a, b, kept


@lru_cache(maxsize=1)
def vocabularies(ranks: str, pattern: str, pieces: str) -> Vocabularies:
    return Vocabularies(ranks, pattern, pieces)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in ids], np.int64)
    return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0]``, ... ``starts[0] + counts[0] - 1``, ``starts[1]``, ..."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


class Segments(dict):
    """Numbers of segments; ``learn`` aligns those that are new."""

    def __init__(self, words: Vocabularies) -> None:
        super().__init__()
        self.words, self.new = words, []
        self.kept, self.spelled = np.empty(0, bool), np.empty(0, object)
        #: Of each segment: tokens of both, groups, links.
        self.sizes = np.empty((0, 4), np.int64)
        self.first, self.links = np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def learn(self) -> None:
        words, keys, self.new = self.words, self.new, []
        if not keys:
            return
        a_ids, b_ids, kept = words.cut(keys)
        (a, n_a), (b, n_b) = _flat(a_ids), _flat(b_ids)
        a_end, b_end = np.cumsum(words.a_length[a]), np.cumsum(words.b_length[b])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        # each token's group, and where both sequences stand when they are written group by group
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        a_last, b_last = np.isin(a_end, common, assume_unique=True), np.isin(b_end, common, assume_unique=True)
        a_upto, b_upto = np.searchsorted(a_end, common, "right"), np.searchsorted(b_end, common, "right")
        written = np.empty(a.size + b.size, object)
        written[np.arange(a.size) + np.concatenate([[0], b_upto])[a_group]] = words.a_spelled[a + a_last * words.a_length.size]
        written[np.arange(b.size) + a_upto[b_group]] = words.b_spelled[b + b_last * words.b_length.size]
        ends = np.cumsum(n_a + n_b).tolist()
        spelled = np.empty(len(keys), object)
        spelled[:] = ["".join(written[s:e]) for s, e in zip([0, *ends], ends, strict=False)]
        # the tokens that overlap one of the first tokenizer follow each other
        low = np.searchsorted(b_end, a_end - words.a_length[a], "right")
        n = np.searchsorted(b_end - words.b_length[b], a_end) - low
        links = (np.repeat(a, n) << 32) | b[_ranges(low, n)]
        segment = np.repeat(np.arange(len(keys)), n_a)
        tally = lambda weights: np.bincount(segment, weights, len(keys)).astype(np.int64)
        sizes = np.stack([n_a, n_b, tally(a_last.astype(float)), tally(n.astype(float))], 1)
        first = self.links.size + np.cumsum(sizes[:, 3]) - sizes[:, 3]
        self.kept, self.spelled = np.concatenate([self.kept, kept]), np.concatenate([self.spelled, spelled])
        self.sizes, self.first = np.concatenate([self.sizes, sizes]), np.concatenate([self.first, first])
        self.links = np.concatenate([self.links, links])


def _bitmaps(pair: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The compressed bitmap of each pair's places, from entries in order of both: a list of 16-bit places where that is shorter."""
    at = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(at, append=pair.size)
    dense = n * 2 >= BLOCK // 8
    size = np.where(dense, BLOCK // 8, n * 2)
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(int(offsets[-1]) // 2, "<u2")
    in_dense = np.repeat(dense, n)
    data[_ranges(offsets[:-1][~dense] // 2, n[~dense])] = place[~in_dense]
    wide = np.flatnonzero(dense)
    for some in np.array_split(wide, max(1, wide.size // 1000)):
        bits = np.zeros((some.size, BLOCK), bool)
        bits[np.repeat(np.arange(some.size), n[some]), place[_ranges(at[some], n[some])]] = True
        data[_ranges(offsets[some] // 2, np.full(some.size, BLOCK // 16))] = np.packbits(bits, axis=1).reshape(-1).view("<u2")
    return pair[at], pa.Array.from_buffers(pa.binary(), n.size, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


class _Block:
    """The documents of a block: their segments first, then their rows and their pairs' bitmaps."""

    def __init__(self, number: int) -> None:
        self.number, self.ids, self.found, self.segments = number, [], [], 0

    def add(self, row_id: object, text: str | None, known: Segments) -> None:
        keys = segments(text) if text else []
        self.ids.append(row_id)
        self.found.append(np.fromiter(map(known.__getitem__, keys), np.int32, len(keys)))
        self.segments += len(keys)

    def rows(self, known: Segments, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        known.learn()
        sizes, shas = np.zeros((len(self.ids), 4), np.int64), [""] * len(self.ids)
        entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for place, found in enumerate(self.found):
            if found.size and known.kept[found].all():
                shas[place] = hashlib.sha256("".join(known.spelled[found])[:-1].encode()).hexdigest()
                which, times = np.unique(found, return_counts=True)
                sizes[place] = times @ known.sizes[which]
                entries.append((which, times, np.full(which.size, place)))
        k = len(self.ids)
        documents = dict(zip(("n_a", "n_b", "n_groups", "n_links"), sizes.T, strict=True)) | {"id": self.ids, "place": np.arange(k), "groups_sha256": shas, "block": np.full(k, self.number)}
        yield _batch(schema, k, documents)
        if not entries:
            return
        which, times, place = (np.concatenate(x) for x in zip(*entries, strict=True))
        while (more := times > REPEATS).any():  # what does not fit a sort key is several entries
            which, place, times = np.concatenate([which, which[more]]), np.concatenate([place, place[more]]), np.concatenate([np.minimum(times, REPEATS), times[more] - REPEATS])
        n = known.sizes[which, 3]
        links = known.links[_ranges(known.first[which], n)]
        pairs = np.unique(links)
        pair = np.searchsorted(pairs, links)
        keys = ((pair * BLOCK + np.repeat(place, n)) << 20) | np.repeat(times, n)
        keys.sort()
        first = np.flatnonzero(np.diff(keys >> 20, prepend=-1))
        beyond = np.add.reduceat(keys & REPEATS, first) - 1
        pair, place = np.divmod(keys[first] >> 20, BLOCK)
        for plane in range(int(beyond.max()).bit_length() + 1):
            some = beyond >> (plane - 1) & 1 > 0 if plane else np.ones(pair.size, bool)
            if some.any():
                which, bits = _bitmaps(pair[some], place[some])
                k, codes = which.size, pairs[which]
                yield _batch(schema, k, {"block": np.full(k, self.number), "a": codes >> 32, "b": codes & 0xFFFFFFFF, "plane": np.full(k, plane), "bits": bits})


def _batch(schema: pa.Schema, rows: int, columns: dict[str, object]) -> pa.RecordBatch:
    """Rows that have some of a table's columns."""
    make = lambda f: (x if isinstance(x := columns[f.name], pa.Array) else pa.array(x)).cast(f.type) if f.name in columns else pa.nulls(rows, f.type)
    return pa.RecordBatch.from_arrays([make(f) for f in schema], schema=schema)


def postings(docs: DataFrame, ranks: str, pattern: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One table of documents (block, place, id, sizes, groups_sha256) and bitmaps (block, a, b, plane, bits), written to the shared folder.

    A block's rows come from one task, so a task that runs again replaces them all.
    """
    small_batches(docs.sparkSession)
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    schema = f"block long, place int, id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, plane int, bits binary"

    def invert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabularies(ranks, pattern, pieces)
        known, number = Segments(words), TaskContext.get().partitionId() << 32
        block, arrow = _Block(number), None
        for batch in batches:
            arrow = arrow or pa.schema([_FIELDS.get(n) or pa.field(n, batch.schema.field(0).type) for n in names])
            for row_id, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                block.add(row_id.as_py(), text, known)
                if len(block.ids) == BLOCK or block.segments >= BLOCK_SEGMENTS:
                    yield from block.rows(known, arrow)
                    block = _Block(block.number + 1)
                    known = Segments(words) if len(known) > MEMO else known
        if block.ids:
            yield from block.rows(known, arrow)

    names = StructType.fromDDL(schema).fieldNames()
    return materialize(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(invert, schema), "postings")


_FIELDS = {n: pa.field(n, t) for t, ns in ((pa.int64(), "block n_a n_b n_groups n_links"), (pa.int32(), "place a b plane"), (pa.string(), "groups_sha256"), (pa.binary(), "bits")) for n in ns.split()}


def pair_counts(written: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best) of every pair of ids that ``postings`` holds: documents and occurrences, and whether
    no other pair of its ``a`` is in more documents (ties are all best). The best counts are a row for each id of a vocabulary: they are broadcast."""
    bits = F.col("bits")
    held = F.when(F.length(bits) < BLOCK // 8, F.length(bits) / 2).otherwise(F.bitmap_count(bits)).cast("long")
    weight = F.expr("CASE WHEN plane = 0 THEN 1L ELSE shiftleft(1L, plane - 1) END")
    planes = written.where("a IS NOT NULL").select("a", "b", "plane", held.alias("held"), (held * weight).alias("times"))
    counts = planes.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, F.col("held"))).alias("n_docs"), F.sum("times").alias("n_links"))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("most")).alias("best"))


def _returned(rows: pd.DataFrame) -> pd.DataFrame:
    """The scores that a block's bitmaps carry to its documents."""
    out = np.zeros((BLOCK, 2), np.int64)
    times = np.where(rows["plane"] > 0, np.int64(1) << np.maximum(rows["plane"].to_numpy(np.int64) - 1, 0), 1)
    scores = np.stack([times * rows["best"].to_numpy(np.int64), times * rows["n_docs"].to_numpy(np.int64)], 1)
    size = np.fromiter(map(len, rows["bits"]), np.int64, len(rows))
    short = size < BLOCK // 8
    places = np.frombuffer(b"".join(rows["bits"][short]), "<u2")
    np.add.at(out, places, np.repeat(scores[short], size[short] // 2, axis=0))
    for some in np.array_split(np.flatnonzero(~short), max(1, int((~short).sum()) // 1000)):
        bits = np.unpackbits(np.frombuffer(b"".join(rows["bits"].to_numpy()[some]), np.uint8)).reshape(-1, BLOCK)
        out += bits.T.astype(np.int64) @ scores[some]
    reached = np.flatnonzero(out[:, 1])
    return pd.DataFrame({"block": rows["block"].iloc[0], "place": reached, "n_best": out[reached, 0], "count_sum": out[reached, 1]})


def align(docs: DataFrame, ranks: str, pattern: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row's whole text.

    ``ranks`` and ``pattern`` make the first tokenizer, which reads a space and the text; ``pieces`` is the
    model file of the second, which adds that space. Strings of special tokens are ordinary text. ``n_best`` counts links whose pair is in
    most documents of all pairs of its first id, ``count_sum`` adds up the documents of each link's pair.

    Null and empty texts, and texts whose bytes the second tokenizer does not keep, have zeros and an empty digest. Each row
    counts as a document: null ids and repeated rows stay. Other columns are ignored; an empty table gives no rows.
    A block holds at most 2,048 documents, or one of any length; memory follows its distinct pairs.
    """
    written = postings(docs, ranks, pattern, pieces, id_col, text_col)
    scored = written.where("a IS NOT NULL").select("block", "a", "b", "plane", "bits").join(pair_counts(written).drop("n_links"), ["a", "b"])
    scores = scored.groupBy("block").applyInPandas(_returned, "block long, place int, n_best long, count_sum long")
    found = written.where("place IS NOT NULL").select("block", "place", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(scores, ["block", "place"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
