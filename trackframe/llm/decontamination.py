"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: its 0 positions are ignored, so a
substituted word there does not hide the match. Seeds of the benchmark and of the
training texts are joined on (mask, hash); each hit names a diagonal (training
position minus benchmark position), and along it the aligned words are compared:
a stretch of ``min_overlap`` words, or of the whole item if that is shorter, with
at least ``similarity`` equal words is a leak. Leaks of one item that share words of the text are one.

The join is a hash join. A benchmark whose words, bytes and items stay under
``BROADCAST_WORDS``, ``BROADCAST_BYTES`` and ``BROADCAST_ITEMS`` (counted first) is
sent to the tasks and no text is shuffled; a larger one is joined by a shuffle of
the seeds, and the texts, written once with row numbers, are joined once with each pair of
a text and an item. Both give the same rows: the switch is one of cost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import join_unique, materialize, small_batches, without_ids

#: By number of words: masks of which one at least hits, wherever a fifth of the words is substituted (a test tries all
#: places). With fewer than 5 words none may be.
MASKS = {
    5: ("1111", "11011", "11101", "10111"),
    6: ("1111", "11011"),
    7: ("111011", "11111", "110111"),
    10: ("111011", "11111", "11010011"),
    11: ("111011", "11111", "111101"),
} | {n: ("111011", "11111") for n in (8, 9, 12, 13, 14, 15)}
MIN_OVERLAP = 15
SIMILARITY = 0.8
#: A benchmark of up to so many words (some 100 MB of index at most) is broadcast.
BROADCAST_WORDS = 2_000_000
BROADCAST_BYTES, BROADCAST_ITEMS = 64 << 20, 500_000
#: So many hits of one text are looked up at a time.
HITS_AT_ONCE = 1 << 20
LEAK = "doc_start long, item_start long, n_words long, n_equal long, similarity double"

_WORD = re.compile(r"\w+")


class _Hashes(dict):
    """Word -> 64-bit hash, forgotten when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words (runs of letters, digits and underscores) of a text (null: empty)."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def masks_for(n_words: int, min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY) -> tuple[str, ...]:
    """Masks of which one at least hits every leak of an item of so many words."""
    need = min(n_words, min_overlap)
    if need < 1:
        return ()
    substituted = need - math.ceil(similarity * need - 1e-9)
    if not substituted:
        return ("1" * need,)
    if need in MASKS and substituted <= need // 5:
        return MASKS[need]
    # so many substitutions leave a run of this length at least
    return ("1" * max(1, math.ceil((need - substituted) / (substituted + 1))),)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every placement of a mask."""
    n = len(words) - len(mask) + 1
    if n < 1:
        return np.empty(0, np.uint64)
    value = np.full(n, len(mask), np.uint64)
    for i, used in enumerate(mask):
        if used == "1":
            value = (value ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
    return value


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY) -> tuple | None:
    """(doc_start, item_start, n_words, n_equal, similarity) of the leak along a diagonal, or None."""
    first, last = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    need = min(len(item), min_overlap)
    if last - first < need or not need:
        return None
    equal = item[first:last] == doc[first + diagonal : last + diagonal]
    total = np.concatenate(([0], np.cumsum(equal)))
    good = np.flatnonzero(total[need:] - total[:-need] >= similarity * need - 1e-9)
    if not len(good):
        return None
    a, b = int(good[0]), int(good[-1]) + need
    while not equal[a]:
        a += 1
    while not equal[b - 1]:
        b -= 1
    n, same = b - a, int(total[b] - total[a])
    return first + a + diagonal, first + a, n, same, same / n


def stretches(doc: np.ndarray, item: np.ndarray, diagonals: Iterable[int], min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY) -> list[tuple]:
    """One leak for each stretch of a text: those of different diagonals that share words of the text are one, and the one with most equal words
    stands for them (of several the first in the text, then in the item). So a text that repeats what an item repeats has as many leaks as it has stretches."""
    found = sorted(leak for x in diagonals if (leak := overlap(doc, item, x, min_overlap, similarity)))
    out: list[tuple] = []
    reached = -1
    for leak in found:
        if leak[0] >= reached:
            out.append(leak)
        elif leak[3] > out[-1][3]:
            out[-1] = leak
        reached = max(reached, leak[0] + leak[2])
    return out


class Index:
    """The benchmark's seeds: a bit table that most words fail, then sorted hashes."""

    def __init__(self, items: list[tuple[int, str | None]], min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY):
        self.items = [(key, word_hashes(text)) for key, text in items]
        by_mask: dict[str, list] = {}
        for n, (_, words) in enumerate(self.items):
            for mask in masks_for(len(words), min_overlap, similarity):
                found = seeds(words, mask)
                by_mask.setdefault(mask, []).append((found, np.full(len(found), n), np.arange(len(found))))
        self.masks = {}
        for mask, parts in by_mask.items():
            hashes, owner, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            bits = np.uint64(max(12, int(len(hashes) * 16).bit_length()))
            table = np.zeros(1 << int(bits), bool)
            table[hashes >> (np.uint64(64) - bits)] = True
            self.masks[mask] = (np.uint64(64) - bits, table, hashes[order], owner[order], at[order])

    def leaks(self, text: str | None, min_overlap: int, similarity: float) -> list[tuple]:
        """(item_id, ...) of every stretch of a text that is a leak."""
        words, found = word_hashes(text), np.empty(0, np.int64)
        for mask, (shift, table, hashes, owner, at) in self.masks.items():
            own = seeds(words, mask)
            maybe = np.flatnonzero(table[own >> shift])
            low, high = (np.searchsorted(hashes, own[maybe], side) for side in ("left", "right"))
            maybe, low, high = maybe[high > low], low[high > low], high[high > low]
            # a seed that many items hold, or a text that repeats one, is taken in pieces: memory holds the distinct diagonals only
            cuts = np.flatnonzero(np.diff(np.cumsum(high - low) // HITS_AT_ONCE)) + 1
            for position, a, n in zip(np.split(maybe, cuts), np.split(low, cuts), np.split(high - low, cuts), strict=True):
                i = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                found = np.union1d(found, (owner[i] << 32) + np.repeat(position, n) - at[i] + (1 << 31))
        owners, diagonals = found >> 32, (found & 0xFFFFFFFF) - (1 << 31)
        firsts = np.flatnonzero(np.diff(owners, prepend=-1)).tolist()
        out = []
        for a, b in zip(firsts, [*firsts[1:], owners.size][: len(firsts)], strict=True):
            key, item = self.items[owners[a]]
            out += [(key, *leak) for leak in stretches(words, item, diagonals[a:b].tolist(), min_overlap, similarity)]
        return out


@lru_cache(maxsize=2)
def _index(items: tuple, min_overlap: int, similarity: float) -> Index:
    return Index(list(items), min_overlap, similarity)


def _broadcast_hits(docs: DataFrame, items: tuple, item_kind: str, min_overlap: int, similarity: float) -> DataFrame:
    shared, schema = docs.sparkSession.sparkContext.broadcast(items), _hits(docs, item_kind)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(shared.value, min_overlap, similarity)
        for batch in batches:
            rows = [(key, *leak) for key, text in zip(batch["id"], batch["text"], strict=True) for leak in index.leaks(text, min_overlap, similarity)]
            yield _frame(rows, schema)

    return docs.mapInPandas(search, schema)


def _hits(docs: DataFrame, item_kind: str) -> str:
    """The schema of leaks; ids keep their kind."""
    return f"id {dict(docs.dtypes)['id']}, item_id {item_kind}, {LEAK}"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    fields = [x.split() for x in schema.split(", ")]
    own = pd.DataFrame(rows, columns=[name for name, _ in fields])
    return own.astype({name: "Int64" for name, kind in fields[:2] if kind == "bigint"})


def _id(df: DataFrame, name: str) -> Column:
    """An id column: whole numbers as longs, everything else as strings."""
    whole = dict(df.select(F.col(name).alias("id")).dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    return F.col(name).cast("long" if whole else "string").alias("id")


def _seed_rows(texts: DataFrame, masks_of: Callable[[int], tuple[str, ...]]) -> DataFrame:
    """(id, mask, hash, position) by the masks for a text's number of words."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, n = [], 0
            for key, text in zip(batch["id"], batch["text"], strict=True):
                words = word_hashes(text)
                for mask in masks_of(len(words)):
                    found = seeds(words, mask)
                    parts.append((np.full(len(found), key), np.full(len(found), mask), found.view(np.int64), np.arange(len(found))))
                    n += len(found)
                if n >= HITS_AT_ONCE:
                    yield frame(parts)
                    parts, n = [], 0
            yield frame(parts)

    def frame(parts: list[tuple]) -> pd.DataFrame:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [[]] * 4
        return pd.DataFrame(dict(zip(("id", "mask", "hash", "position"), columns, strict=True)))

    return texts.mapInPandas(emit, "id long, mask string, hash long, position long")


def _numbered(texts: DataFrame, label: str) -> DataFrame:
    """(key, id, text): ``id`` becomes a row number, ``key`` is the old one. Written, so that every reading has the same numbers."""
    return materialize(texts.select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("key"), "text"), label)


def _shuffled_hits(docs: DataFrame, items: DataFrame, min_overlap: int, similarity: float) -> DataFrame:
    """The same rows by a shuffle join on row numbers, so ids may be null or repeated."""
    docs, items = _numbered(docs, "documents"), _numbered(items, "benchmark")
    wanted = materialize(_seed_rows(items.select("id", "text"), lambda n: masks_for(n, min_overlap, similarity)), "benchmark-seeds")
    masks = tuple(r.mask for r in wanted.select("mask").distinct().collect())  # those by which any item is sought
    wanted = wanted.select(F.col("id").alias("item_id"), "mask", "hash", F.col("position").alias("item_at"))
    hits = _seed_rows(docs.select("id", "text"), lambda _: masks).join(wanted, ["mask", "hash"])
    # a pair's diagonals are at most as many as its words
    pairs = hits.groupBy("id", "item_id").agg(F.collect_set(F.col("position") - F.col("item_at")).alias("diagonals"))
    pairs = materialize(pairs, "benchmark-pairs")
    counted = lambda side, texts: texts.join(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")), side)
    sought = items.select(F.col("id").alias("item_id"), F.col("text").alias("item"))
    # each text goes once to each of its pairs; those of most pairs by a bounded broadcast
    pairs = join_unique(join_unique(pairs, counted("id", docs.select("id", "text")), "id"), counted("item_id", sought), "item_id")

    schema = f"id bigint, item_id bigint, {LEAK}"

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.itertuples(index=False):
                rows += [(x.id, x.item_id, *leak) for leak in stretches(word_hashes(x.text), word_hashes(x.item), map(int, x.diagonals), min_overlap, similarity)]
            yield _frame(rows, schema)

    found = pairs.select("id", "item_id", "diagonals", "text", "item").mapInPandas(verify, schema)
    found = found.join(docs.select("id", "key"), "id").join(items.select(F.col("id").alias("item_id"), F.col("key").alias("item_key")), "item_id")
    return found.select(F.col("key").alias("id"), F.col("item_key").alias("item_id"), "doc_start", "item_start", "n_words", "n_equal", "similarity")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_overlap: int = MIN_OVERLAP,
    similarity: float = SIMILARITY,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """(id, item_id, doc_start, item_start, n_words, n_equal, similarity): one row for each leaked stretch of a text and item, that of most equal words.

    Starts count words. Null and empty texts and items leak nothing; rows and
    items with a null id are searched too; ids are whole numbers (given back as
    longs) or strings. Repeated rows give repeated leaks, several items or places
    give several rows. Other columns of either table are ignored. An empty table
    on either side gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(_id(docs, id_col), F.col(text_col).alias("text"))
    items = benchmark.select(_id(benchmark, item_col), F.col(item_text_col).alias("text")).where("text is not null")
    n_words: Column = F.size(F.split("text", r"\W+")) + F.size(F.split("text", r"[^\x00-\x7f]"))
    total, size, n = items.agg(F.sum(n_words), F.sum(F.octet_length("text")), F.count("*")).first()
    if (total or 0) <= broadcast_words and (size or 0) <= BROADCAST_BYTES and n <= BROADCAST_ITEMS:
        return _broadcast_hits(docs, tuple((r.id, r.text) for r in items.collect()), dict(items.dtypes)["id"], min_overlap, similarity)
    return _shuffled_hits(docs, items, min_overlap, similarity)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those rows that leak a benchmark item; other rows and all columns stay."""
    return without_ids(docs, leaks(docs, benchmark, id_col, **options).select("id"), id_col)
