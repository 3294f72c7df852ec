"""Vector best-fit packing of token pieces into sequences.

A piece needs three resources of a sequence: tokens, one place among its
documents, and attention cost (its length squared). All three follow from the
length, so pieces of one length are interchangeable: the packing needs only how
many pieces each length has, at most ``max_tokens`` numbers whatever the input.

``plan_bins`` fills one sequence at a time: among the lengths that fit under
every residual capacity it takes the one with the largest weighted dot product
with the residual, or the one that leaves the smallest weighted residual norm.
The same filling is repeated as often as the counts allow, so the plan is a short
list of (filling, repetitions). Spark ranks the pieces within their length, by
windows over bounded buckets, and the rank gives a piece its sequence and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import materialize, quoted, small_batches
from trackframe.llm.tokens import ids_of

#: About as many rows of one length are ranked together.
BUCKET_ROWS = 1_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and how the best-fit score weighs the three resources."""

    max_tokens: int = 1024
    max_documents: int = 1024
    max_cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    rule: str = "norm"  # or "dot"


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first have ``limit``."""
    first = n % limit or min(n, limit)
    return [(0, first)] + [(at, limit) for at in range(first, n, limit)] if n else []


def token_pieces(
    docs: DataFrame, path: str, pattern: str, end_id: int = 2, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
    added: tuple[tuple[str, int], ...] = (),
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]) of every text's ids and ``end_id``.

    A null or empty text has the one id ``end_id``. Only texts of more than
    ``limit`` ids are cut; their first piece may be shorter. ``added`` are the
    vocabulary's added tokens (``tokens.added_tokens``). A map without shuffle.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                ids = np.append(ids_of(text, path, pattern, added), np.uint32(end_id)).astype("<u4")
                key = None if pd.isna(key) else key
                for i, (start, n) in enumerate(cut(len(ids), limit)):
                    own = ids[start : start + n]
                    rows.append((key, i, start, n, zlib.crc32(own.tobytes())) + ((own.astype(np.int64),) if with_ids else ()))
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            yield out.astype({"id": "Int64"}) if kind == "bigint" else out

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(pieces, schema)


def plan_bins(counts: dict[int, int], capacity: Capacity) -> list[tuple[dict[int, int], int]]:
    """[({length: pieces in a sequence}, sequences so filled)] that places all ``counts`` pieces."""
    lengths = np.array(sorted((n for n, k in counts.items() if k), reverse=True), np.int64)
    if len(lengths) and (lengths[0] > capacity.max_tokens or lengths[0] ** 2 > capacity.max_cost or capacity.max_documents < 1):
        raise ValueError(f"a piece of {lengths[0]} tokens doesn't fit")
    left = np.array([counts[n] for n in lengths.tolist()], np.int64)
    limits = np.array([capacity.max_tokens, capacity.max_documents, capacity.max_cost], np.float64)
    needs = np.stack([lengths, np.ones_like(lengths), lengths**2], 1) / limits
    weights, plan = np.array(capacity.weights), []
    while left.any():
        residual, taken = np.ones(3), np.zeros_like(left)
        while True:
            fits = (left > taken) & (needs <= residual + 1e-12).all(1)
            if not fits.any():
                break
            if capacity.rule == "dot":
                score = (needs * residual) @ weights
            else:
                score = -((residual - needs) ** 2) @ weights
            best = int(np.argmax(np.where(fits, score, -np.inf)))
            taken[best] += 1
            residual = residual - needs[best]
        used = taken > 0
        times = int((left[used] // taken[used]).min())
        left -= times * taken
        plan.append(({int(n): int(k) for n, k in zip(lengths[used], taken[used], strict=True)}, times))
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in a sequence, first offset), by length and rank."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for n, k in filling.items():
            rows.append((n, ranks.get(n, 0), sequence, k, offset))
            ranks[n] = ranks.get(n, 0) + times * k
            offset += n * k
        sequence += times
    return np.array(sorted(rows) or np.empty((0, 5)), np.int64).reshape(-1, 5)


def _ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(row, length, rank): each of ``pieces`` as a struct, so that no name can clash, and its rank, gapless from 0 within its length; the buckets of a length follow its own count."""
    buckets = F.lit([1 + counts.get(n, 0) // BUCKET_ROWS for n in range(max(counts, default=0) + 1)])
    order = [F.col("row")[c] for c in ("id", "piece", "start", "ids_crc32")]
    rows = pieces.select(F.struct(*map(quoted, pieces.columns)).alias("row"), "length")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.get(buckets, F.col("length").cast("int"))))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))
    return rows.withColumn("own", own).join(firsts, ["length", "bucket"]).select("row", "length", (F.col("first") + F.col("own") - 1).alias("rank"))


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    Pieces of a sequence lie gapless from offset 0 and keep every capacity.
    Null ids and repeated rows are packed like others; an empty table gives an
    empty result. Raises ValueError if a piece alone exceeds a capacity.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_tokens rows
    places = _places(plan_bins(counts, capacity))
    key = (places[:, 0] << 44) | places[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = places[np.searchsorted(key, (length << 44) | rank, "right") - 1]
        nth = rank - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 2] + nth // at[:, 3], "offset": at[:, 4] + nth % at[:, 3] * length})

    ranked = _ranked(pieces, counts)
    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select("row.*", "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 2, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text", added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Cut the texts of ``docs`` into pieces and pack them; see ``token_pieces`` and ``pack``."""
    pieces = token_pieces(docs, path, pattern, end_id, capacity.max_tokens, id_col, text_col, added=added)
    return pack(materialize(pieces, "pieces"), capacity)


def sequences(packed: DataFrame, ids: Column | str = "ids") -> DataFrame:
    """(sequence_id, ids, document_starts) of packed pieces that carry their ids."""
    row = F.struct("offset", F.col(ids).alias("ids") if isinstance(ids, str) else ids.alias("ids"))
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.offset").alias("document_starts"))
