"""Transcript text: normalisation, tokens, edit distance, error rates."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from trackframe.functions.lets import let


@F.pandas_udf(StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition, for which Spark has no function. ASCII texts, which it leaves as they are, stay out of the Python worker."""
    other = F.rlike(text, F.lit(r"[^\x00-\x7F]"))
    return F.when(other, _composed(F.when(other, text))).otherwise(text)


def normalise(text: Column, compose: bool = True) -> Column:
    """Lower case; letters, digits, underscores and apostrophes; single blanks. ``compose`` applies NFKC first."""
    text = F.lower(nfkc(text) if compose else text)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s']", " "), r"(?U)\s+", " "))


def words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


#: Up to this product of lengths the built-in distance, a table of that many cells, is used; beyond, bits.
CELLS = 1 << 18


def distance_bits(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences, a column of the table as the bits of two whole numbers: its rises and its falls.

    What both begin or end with costs nothing; the rest costs one step of a few operations on
    numbers of the shorter one's length for each symbol of the longer one.
    """
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    high -= low
    end = 0
    while end < high and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    size = len(a) // 8 + 1
    masks = {}
    for x, own in places.items():
        bits = bytearray(size)
        for i in own:
            bits[i >> 3] |= 1 << (i & 7)
        masks[x] = int.from_bytes(bits, "little")
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rise, fall, distance = full, 0, len(a)
    for x in b:
        same = masks.get(x, 0)
        diagonal = (((same & rise) + rise) ^ rise) | same | fall
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = (up << 1 | 1) & full, down << 1 & full
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
    return distance


@F.pandas_udf(LongType())
def _long_distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else distance_bits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def _either(short: Column, built_in: Column, a: Column, b: Column) -> Column:
    """The built-in distance of short pairs; only long ones go to the Python worker."""
    return F.when(short, built_in.cast("long")).otherwise(_long_distance(F.when(~short, a), F.when(~short, b)))


def edit_distance(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance of two word arrays without nulls. Of short ones distinct words become single characters for the built-in function."""
    known = F.array_distinct(F.concat(reference, hypothesis))
    char = lambda i: F.decode(F.unhex(F.lpad(F.hex((i + 0x4DFF).cast("long")), 8, "0")), "UTF-32")
    spelled = lambda k, ws: F.array_join(F.transform(ws, lambda w: char(F.array_position(k, w))), "")
    # so few words that their numbers end before the surrogates
    short = (F.size(reference).cast("long") * F.size(hypothesis) <= CELLS) & (F.size(reference) + F.size(hypothesis) <= 20_000)
    built_in = F.when(short, let(known, lambda k: F.levenshtein(spelled(k, reference), spelled(k, hypothesis))))
    return _either(short, built_in, reference, hypothesis)


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """(errors, total) of normalised texts; a null hypothesis is empty, so all its reference's words are deleted."""
    a, b = words(reference), words(F.coalesce(hypothesis, F.lit("")))
    return F.struct(edit_distance(a, b).alias("errors"), F.size(a).cast("long").alias("total"))


def character_errors(reference: Column, hypothesis: Column) -> Column:
    """(errors, total) in characters, blanks removed."""
    a, b = (F.replace(F.coalesce(x, F.lit("")), F.lit(" "), F.lit("")) for x in (reference, hypothesis))
    short = F.char_length(a).cast("long") * F.char_length(b) <= CELLS
    return F.struct(_either(short, F.when(short, F.levenshtein(a, b)), a, b).alias("errors"), F.char_length(a).cast("long").alias("total"))


def rate(errors: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(errors.cast("double"), total.cast("double")), F.lit(0.0))


def rate_text(errors: Column, total: Column) -> Column:
    """``12.5% (1/8)``."""
    return F.format_string("%.1f%% (%d/%d)", rate(errors, total) * 100, errors, total)


def sentence_case(text: Column) -> Column:
    low = F.lower(text)
    return F.concat(F.upper(F.left(low, F.lit(1))), F.substr(low, F.lit(2)))


def detokenise(ids: Column, vocabulary: Column, ignored: int = -1) -> Column:
    """Pieces of ids (from 0) joined; word marks to blanks, end and blank pieces dropped."""
    pieces = F.transform(F.filter(ids, lambda i: i != ignored), lambda i: F.element_at(vocabulary, i + 1))
    text = F.array_join(pieces, "")
    for piece, becomes in (("<space>", " "), ("▁", " "), ("<eos>", ""), ("<blank>", "")):
        text = F.replace(text, F.lit(piece), F.lit(becomes))
    return F.trim(text)


def strip_special(ids: Column, eos: Column) -> Column:
    """Without one leading and all trailing ``eos``."""
    led = F.when(F.get(ids, F.lit(0)) == eos, F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)
    last = lambda a: F.aggregate(F.transform(a, lambda x, i: F.when(x != eos, i + 1).otherwise(0)), F.lit(0), lambda m, i: F.greatest(m, i))
    return let(led, lambda a: F.slice(a, F.lit(1), last(a)))


def piece_ids(pieces: Column, ids: Column, unknown: str = "<unk>") -> Column:
    """Ids of pieces by a map piece -> id, with that of ``unknown`` for others."""
    return F.transform(pieces, lambda p: F.coalesce(F.try_element_at(ids, p), F.try_element_at(ids, F.lit(unknown))))


def unit_line(line: Column) -> Column:
    """(piece, token_id) of a line of a units file: its first and last fields; null for a blank line."""
    fields = F.split(F.trim(line), r"\s+")
    return F.when(F.trim(line) != "", F.struct(fields[0].alias("piece"), F.element_at(fields, -1).cast("int").alias("token_id")))
