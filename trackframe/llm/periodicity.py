"""Periodic runs of words by recompression.

A text's word numbers are compressed level by level: *blocks* (a symbol repeated next to itself) become one symbol with
its count, then *pairs* of symbols from the two halves of the alphabet become one. Each level is a shorter sequence
over the same words, and equal stretches of words are cut alike on every level but at their edges: a grammar, kept
as run-length levels. How far two places agree (``Grammar.extend``) is found by climbing the levels
while both stand on borders and going down again where symbols differ: a few comparisons a level, and no suffix array.

Runs come from a *harmonic grid*: a run of period ``p`` makes the words equal to those ``p`` later over at least
``g = max(shortest - p, (repeats - 1) * p)`` places in a row, so one of the multiples of ``g`` lies there. Each grid place
whose word equals that ``p`` later is extended both ways by the grammar; the sum of n / g over all periods is n log n.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import small_batches

#: Texts are compressed together up to so many words, or one text of any length.
TOGETHER = 200_000
#: Grid places that are looked at in one step.
STEP = 1 << 20


class Grammar:
    """Levels of a sequence of symbols (non-negative numbers), all of them over places of the first.

    ``symbols[k]`` are level k's; ``starts[k]`` their first places, and the length; ``index[k]`` tells which symbol begins at a place of
    the level below (-1: none does). ``copies[k]``: whether level k + 1 joins repeats (blocks) or else pairs.
    """

    def __init__(self, sequence: np.ndarray) -> None:
        symbols, starts, mix = sequence.astype(np.int64), np.arange(sequence.size + 1), 1
        self.symbols, self.starts, self.below, self.copies = [symbols], [starts], [], []
        while symbols.size > 1:
            first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
            if first.size < symbols.size:
                count = np.diff(first, append=symbols.size)
                symbols, starts = self._level(symbols[first] << 32 | count, first, symbols.size, True)
            else:
                left = self._left(symbols, mix)
                pair = left[:-1] & ~left[1:]
                first = np.flatnonzero(np.concatenate([[True], ~pair]))
                paired = np.append(pair, False)[first]
                after = np.where(paired, symbols[np.minimum(first + 1, symbols.size - 1)] + 1, 0)
                if first.size < symbols.size:
                    symbols, starts = self._level(symbols[first] << 32 | after, first, symbols.size, False)
                mix += 1

    @staticmethod
    def _left(symbols: np.ndarray, mix: int) -> np.ndarray:
        """Which places have symbols of the alphabet's left half: halves by a hash, the way round that joins more pairs."""
        hashed = (symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(mix)) * np.uint64(0xD6E8FEB86659FD93)
        left = hashed >> np.uint64(63) == 0
        return left if (left[:-1] & ~left[1:]).sum() >= (~left[:-1] & left[1:]).sum() else ~left

    def _level(self, made: np.ndarray, first: np.ndarray, size: int, copies: bool) -> tuple[np.ndarray, np.ndarray]:
        """Add the level of symbols that begin at ``first``; ``made`` names each by what it stands for."""
        names = np.unique(made)
        symbols = np.searchsorted(names, made)
        below = np.append(first, size)
        starts = self.starts[-1][below]
        self.symbols.append(symbols)
        self.starts.append(starts)
        self.below.append(below)
        self.copies.append(copies)
        return symbols, starts

    def extend(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols from places ``i`` and ``j`` on (or before them, going back) are equal, for i < j."""
        side = _Side(self, forward)
        at = [i, j] if forward else [i - 1, j - 1]
        reached, open_ = np.zeros(i.size, np.int64), np.arange(i.size)
        # places as numbers of symbols of the level; going back, of symbols that end there
        x, y = at
        top, stopped = len(self.symbols) - 1, np.full(i.size, -1)
        ends_x, ends_y = np.zeros(i.size, np.int64), np.zeros(i.size, np.int64)
        for k in range(top):
            x, y, same = side.to_border(k, x, y)
            stop = ~same
            ends_x[open_[stop]], ends_y[open_[stop]], stopped[open_[stop]] = x[stop], y[stop], k
            open_, x, y = open_[same], x[same], y[same]
            x, y = side.up(k, x), side.up(k, y)
        ends_x[open_], ends_y[open_], stopped[open_] = x, y, top
        order = np.argsort(-stopped, kind="stable")
        level_of = stopped[order]
        x, y, k, n = np.empty(0, np.int64), np.empty(0, np.int64), top, 0
        while k >= 0:
            more = np.searchsorted(-level_of, -k, "right")
            x, y, n = np.concatenate([x, ends_x[order[n:more]]]), np.concatenate([y, ends_y[order[n:more]]]), more
            x, y = side.along(k, x, y)
            if k:
                x, y = side.down(k, x), side.down(k, y)
            k -= 1
        reached[order] = (x - at[0][order]) if forward else (at[0][order] - x)
        return reached


class _Side:
    """Steps along the levels of a grammar, one way. A place is the number of the next symbol to be compared."""

    def __init__(self, grammar: Grammar, forward: bool) -> None:
        self.g, self.step = grammar, 1 if forward else -1

    def _equal(self, k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = self.g.symbols[k]
        inside = (y < s.size) if self.step > 0 else (x >= 0)
        return inside & (s[np.clip(x, 0, s.size - 1)] == s[np.clip(y, 0, s.size - 1)])

    def _border(self, k: int, x: np.ndarray) -> np.ndarray:
        """Whether a symbol of level k + 1 begins (going back: ends) at the place."""
        border = self._borders(k)
        return border[x if self.step > 0 else x + 1]

    def _borders(self, k: int) -> np.ndarray:
        border = np.zeros(self.g.symbols[k].size + 1, bool)
        border[self.g.below[k]] = True
        return border

    def _left_over(self, k: int, x: np.ndarray) -> np.ndarray:
        """Symbols from the place to the end (going back: the beginning) of its symbol of level k + 1."""
        below = self.g.below[k]
        if self.step > 0:
            return below[np.searchsorted(below, x, "right")] - x
        return x + 1 - below[np.searchsorted(below, x, "right") - 1]

    def to_border(self, k: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward until both stand on borders of level k + 1; False where symbols differ before."""
        x, y = x.copy(), y.copy()
        off = ~(self._border(k, x) & self._border(k, y))
        same = np.ones(x.size, bool)
        if off.any():
            a, b = x[off], y[off]
            equal = self._equal(k, a, b)
            n = equal.astype(np.int64)
            if self.g.copies[k] and equal.any():
                n[equal] = np.minimum(self._left_over(k, a[equal]), self._left_over(k, b[equal]))
            a, b = a + self.step * n, b + self.step * n
            x[off], y[off] = a, b
            same[off] = equal & self._border(k, a) & self._border(k, b)
        return x, y, same

    def along(self, k: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward over what is equal: within a level that is to be joined by blocks, the repeats of one symbol; else a symbol or two."""
        copies = k < len(self.g.copies) and self.g.copies[k]
        while (equal := self._equal(k, x, y)).any():
            n = equal.astype(np.int64)
            if copies:
                n[equal] = np.minimum(self._left_over(k, x[equal]), self._left_over(k, y[equal]))
            x, y = x + self.step * n, y + self.step * n
        return x, y

    def up(self, k: int, x: np.ndarray) -> np.ndarray:
        below = self.g.below[k]
        return np.searchsorted(below, x) if self.step > 0 else np.searchsorted(below, x + 1) - 1

    def down(self, k: int, x: np.ndarray) -> np.ndarray:
        below = self.g.below[k - 1]
        return below[x] if self.step > 0 else below[x + 1] - 1


def _grid(sequence: np.ndarray, last: np.ndarray, sizes: np.ndarray, shortest: int, repeats: int) -> np.ndarray:
    """(place, period) of the grid places that may lie in a run: the words there and around equal those a period later."""
    found = [np.empty((2, 0), np.int64)]
    longest = int(sizes[0]) // repeats if sizes.size and sizes[0] >= shortest else 0
    for period in range(1, longest + 1):
        reach = int(np.searchsorted(-sizes, -max(shortest, repeats * period), "right"))  # only the first texts are long enough
        step = max(shortest - period, (repeats - 1) * period)
        later, end = sequence[period:], int(last[reach - 1]) - period
        places = np.arange(0, end, step)
        places = places[sequence[places] == later[places]]
        # of the ``step`` equal places in a row, half or more lie on one side of the grid's
        before = after = np.ones(places.size, bool)
        for d in range(1, min(4, (step + 1) // 2)):
            if not places.size:
                break
            low, high = np.maximum(places - d, 0), np.minimum(places + d, later.size - 1)
            before, after = before & (sequence[low] == later[low]), after & (sequence[high] == later[high])
        places = places[before | after]
        if places.size:
            found.append(np.stack([places, np.full(places.size, period)]))
    return np.concatenate(found, 1)


def find_runs(numbers: np.ndarray, sizes: np.ndarray, shortest: int, repeats: int) -> np.ndarray:
    """(text, start, length, period) of all runs, by text, start and period.

    ``numbers`` are the words of texts one after the other, texts of more words first; ``sizes`` their lengths. Each text is
    followed by a symbol that occurs once, so no stretch of equal words leaves it. Texts without a grid place that may lie in a run are not compressed.
    """
    firsts = np.cumsum(sizes + 1) - sizes - 1
    last = firsts + sizes
    sequence = np.empty(int(sizes.sum()) + sizes.size, np.int64)
    inside = np.ones(sequence.size, bool)
    inside[last] = False
    sequence[last] = np.arange(sizes.size)
    sequence[inside] = numbers + sizes.size
    places, periods = _grid(sequence, last, sizes, shortest, repeats)
    text = np.searchsorted(firsts, places, "right") - 1
    own = places + periods < last[text]
    places, periods, text = places[own], periods[own], text[own]
    if not places.size:
        return np.empty((0, 4), np.int64)
    of, which = np.unique(text, return_inverse=True)
    moved = np.cumsum(sizes[of] + 1) - sizes[of] - 1  # where these texts begin if no others are there
    grammar = Grammar(np.concatenate([sequence[firsts[t] : last[t] + 1] for t in of]))
    places, found = places - firsts[text] + moved[which], []
    for some in np.array_split(np.arange(places.size), places.size // STEP + 1):
        i, period = places[some], periods[some]
        back = grammar.extend(i, i + period, False)
        length = grammar.extend(i, i + period, True) + back + period
        long = length >= np.maximum(shortest, repeats * period)
        found.append(np.stack([of[which[some]], i - back - moved[which[some]], length, period])[:, long])
    text, start, length, period = np.concatenate(found, 1)
    order = np.lexsort([period, length, start, text])
    text, start, length, period = text[order], start[order], length[order], period[order]
    # a multiple of a stretch's smallest period has the same stretch: the smallest is the run
    change = lambda x: np.diff(x, prepend=-1) != 0
    smallest = change(text) | change(start) | change(length)
    runs = np.stack([text, start, length, period], 1)[smallest]
    return runs[np.lexsort([runs[:, 3], runs[:, 1], runs[:, 0]])]


def words(text: str | None) -> list[bytes]:
    """The words of a text: what lies between spaces and the characters 9 to 13 (null: none)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _summary(found: np.ndarray, own: list[bytes]) -> tuple[object, ...]:
    """The row of a text from its runs (start, length, period) in order."""
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found.tolist()).encode()).hexdigest()
    if not len(found):
        return 0, None, None, None, None, listed, hashlib.sha256(b" ".join(own)).hexdigest()
    best = found[0].tolist()
    for run in found[1:].tolist():
        if run[1] * best[2] > best[1] * run[2] or (run[1] * best[2] == best[1] * run[2] and (run[0], run[2]) < (best[0], best[2])):
            best = run
    change = np.zeros(len(own) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    collapsed = hashlib.sha256(b" ".join([own[i] for i in kept.tolist()])).hexdigest()
    return len(found), *best, 1000 * best[1] // best[2], listed, collapsed


_COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _rows(texts: list[list[bytes]], shortest: int, repeats: int) -> list[tuple[object, ...]]:
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for i in order for w in texts[i]), np.int64, int(sizes.sum()))
    found = find_runs(flat, sizes, shortest, repeats)
    cuts = np.searchsorted(found[:, 0], np.arange(sizes.size + 1))
    rows: list[tuple[object, ...]] = [()] * len(texts)
    for k, i in enumerate(order):
        rows[i] = _summary(found[cuts[k] : cuts[k + 1], 1:], texts[i])
    return rows


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = 24,
    repeats: int = 3,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row's whole text; a map without shuffle.

    A run is a stretch of words of smallest period q and of at least ``max(shortest, repeats * q)`` words that no
    neighbouring word extends. start, length, period and exponent_milli (1000 times length by period, rounded down) are those of the run with the
    greatest length by period; of several the first, then that of the smallest period; null without a run. ``runs_sha256`` lists all runs,
    ``collapsed_sha256`` the words that are left when each run keeps its first period only. ``rewrite`` may change the words of
    a row first; it gets the row's id.

    Null and empty texts have no words and no run. Null ids and repeated rows stay; other columns are ignored; an
    empty table gives no rows. Texts of any length are one sequence: some 100 bytes a word.
    """
    small_batches(docs.sparkSession)
    schema = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    key = "id" if rewrite else "text"

    @F.pandas_udf(schema)
    def runs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            out: list[tuple[object, ...]] = []
            some: list[list[bytes]] = []
            n = 0
            for row_id, text in zip(ids, texts, strict=True):
                own = words(text)
                some.append(rewrite(row_id, own) if rewrite else own)
                n += len(own)
                if n >= TOGETHER:
                    out += _rows(some, shortest, repeats)
                    some, n = [], 0
            out += _rows(some, shortest, repeats)
            frame = pd.DataFrame(out, columns=_COLUMNS)
            numbers = _COLUMNS[:5]
            yield frame.astype(dict.fromkeys(numbers, "Int64"))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("id", runs(F.col(key).cast("string"), "text").alias("r")).select("id", "r.*")


def plant(row_id: object, own: list[bytes]) -> list[bytes]:
    """The words of a document of the given tables, which have few runs of their own: a tenth, by the checksum of the id, is made
    periodic from one word on. A null id leaves its words."""
    if row_id is None or not own:
        return own
    h = zlib.crc32(str(row_id).encode())
    if h % 10:
        return own
    g, n = h // 10, len(own)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = own[a : a + p]
    return own[:a] + (once * ((n - a) // len(once) + 1))[: n - a]
