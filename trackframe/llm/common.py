"""What the training-data operators share: tables, the shared folder, text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch that goes to a Python worker; whole texts are long,
#: so a batch is kept far below Spark's default of 10,000 rows.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (as in tests) a
    folder of this process is taken; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="trackframe-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor. ``remove`` deletes
    them; what a result still reads stays, as Spark's own checkpoints do.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(written: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` gave, once nothing reads it any more."""
    spark, folders = written.sparkSession, {f.rsplit("/", 1)[0] for f in written.inputFiles()}
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a key of each row: its Parquet file (as a hash) and its place there, the same at every reading.

    A table that is no plain Parquet scan is written first.
    """
    key = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string")).alias(name)
    try:
        return docs.select("*", key)
    except AnalysisException:
        return materialize(docs, "rows").select("*", key)


def quoted(name: str) -> str:
    """A column's name for ``select``, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it none of the table's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: So many ids at most (some 65 MB, if they are row keys) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str, keep: bool = False) -> DataFrame:
    """``docs`` without the rows of ``ids`` (one column), or (``keep``) only those; null ids match none."""
    ids = materialize(ids.toDF(id_col).where(F.col(id_col).isNotNull()).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, id_col, "left_semi" if keep else "left_anti")


#: So many bitmaps at most (4 KB each, 32 MB) are broadcast.
BROADCAST_BITMAPS = 8_192


def without_rows(docs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` (of ``with_row_key``) is in ``rows`` (one column).

    The driver gets no key, but one bit a row: a bitmap for each 32,768 places of a file. Where there are more than
    ``BROADCAST_BITMAPS`` of them (very many files), ``without_ids`` does it; ``rows`` is then read again.
    """
    place = F.substring_index(key, ":", -1).cast("long")
    at = {"file": F.substring_index(key, ":", 1), "bucket": F.bitmap_bucket_number(place + 1), "bit": F.bitmap_bit_position(place + 1)}
    bitmaps = rows.toDF(key).where(F.col(key).isNotNull()).select(*(c.alias(n) for n, c in at.items()))
    bitmaps = materialize(bitmaps.groupBy("file", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmaps")
    if bitmaps.count() > BROADCAST_BITMAPS:
        return without_ids(docs, rows, key).select(*map(quoted, docs.columns))
    names = {n: free_name(docs, n) for n in (*at, "bits")}
    given = F.broadcast(bitmaps.select(*(F.col(n).alias(names[n]) for n in bitmaps.columns)))
    found = docs.select("*", *(c.alias(names[n]) for n, c in at.items())).join(given, [names["file"], names["bucket"]], "left")
    byte = F.conv(F.hex(F.substring(names["bits"], F.floor(F.col(names["bit"]) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    dropped = byte.bitwiseAND(F.pow(F.lit(2), F.col(names["bit"]) % 8).cast("int")) != 0
    return found.where(~F.coalesce(dropped, F.lit(False))).select(*map(quoted, docs.columns))


#: At most so many keys count as heavy in ``join_unique``, whatever the size of the input.
HEAVY_KEYS = 10_000
#: Of so few rows in all, the keys (no more of them, a few MB) are broadcast whole.
FEW_ROWS = 50_000


#: So many rows of a key, or one in ``FAIR`` of all, are no burden to the task that gets them.
LIGHT_ROWS, FAIR = 256, 1000


def light(most: int, total: int) -> bool:
    """Whether a table of ``total`` rows, with ``most`` at a key, can be dealt by that key as it is."""
    return most <= max(LIGHT_ROWS, total // FAIR)


def join_unique(rows: DataFrame, one: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``one``, which has one row for each key and, in ``n``, how many of ``rows`` hold that key.

    A key that holds more than its share (one in ``HEAVY_KEYS``) of ``total`` (if not given, the sum of ``n``) goes by
    a broadcast of at most ``HEAVY_KEYS`` rows, so no task gets all rows of such a key; the others by a shuffle. If ``total``
    is not given and no key weighs, one shuffle join does, which the driver plans in a fraction of the memory. ``n`` is dropped.
    """
    most = None
    if total is None:
        total, most = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if total <= FEW_ROWS:
        return rows.join(F.broadcast(one.drop("n")), key)
    if most is not None and light(most, total):
        return rows.join(one.drop("n"), key)
    share = max(1, total // HEAVY_KEYS)
    heavy = F.broadcast(one.where(F.col("n") > share).drop("n"))
    few = rows.join(heavy, key)
    rest = rows.join(heavy.select(key), key, "left_anti").join(one.where(F.col("n") <= share).drop("n"), key)
    return few.unionByName(rest)


def spread(df: DataFrame) -> DataFrame:
    """A small table over at least as many partitions as there are cores, for work that multiplies its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once for each row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefixes(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` (a sum, a maximum) over the first 0, 1, 2, ... entries of a non-empty array of longs; over none it is 0.

    Works in chunks, so an array of n entries costs n * 512 copies and not n * n.
    """
    chunk, zero = 512, F.lit(0).cast("long")
    add = lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x)))
    cut = lambda a: F.transform(F.sequence(F.lit(1), F.size(a), F.lit(chunk)), lambda i: F.slice(a, i, chunk))

    def chunked(chunks: Column) -> Column:
        totals = F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, zero, step)), F.array(zero), add)
        inner = let(totals, lambda t: F.zip_with(chunks, F.slice(t, F.lit(1), F.size(chunks)), lambda c, b: F.slice(F.aggregate(c, F.array(b), add), F.lit(2), F.size(c))))
        return F.concat(F.array(zero), F.flatten(inner))

    return let(cut(values), chunked)


def prefix_sums(lengths: Column) -> Column:
    """Sums of the first 0, 1, 2, ... entries of a non-empty array of longs."""
    return prefixes(lengths, lambda a, x: a + x)


def apart(spans: Column, others: Column) -> Column:
    """Of ``others`` (structs with start and end, in order and apart from each other) those that overlap none of ``spans``.

    One pass over both in the order of the text, so a long text with many of either costs no more than its length.
    """
    event = lambda at, late, reach: F.struct(at.alias("at"), F.lit(late).alias("late"), reach.alias("reach"))
    # an entry of ``others`` stands before a span that begins where it ends; they keep their order
    events = F.array_sort(F.concat(F.transform(spans, lambda x: event(x["start"], 1, x["end"])), F.transform(others, lambda x: event(x["end"], 0, x["start"]))))

    def free(es: Column) -> Column:
        reached = prefixes(F.transform(es, lambda e: F.when(e["late"] == 1, e["reach"]).otherwise(F.lit(0).cast("long"))), lambda a, x: F.greatest(a, x))
        seen = F.zip_with(es, F.slice(reached, F.lit(1), F.size(es)), lambda e, r: F.when(e["late"] == 0, r <= e["reach"]))
        return F.filter(seen, lambda x: x.isNotNull())

    kept = F.filter(F.zip_with(others, let(events, free), lambda x, ok: F.struct(x.alias("x"), ok.alias("ok"))), lambda p: p["ok"])
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), F.transform(kept, lambda p: p["x"])).otherwise(others)


#: Code points of a block of a text.
BLOCK = 2048


def blocks(text: Column) -> Column:
    """A text in pieces of ``BLOCK`` code points, so that ``part`` need not count them from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to before ``end`` of a text that ``blocks`` cut."""
    number = lambda at: F.floor(at / BLOCK).cast("int")
    block = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    inner = lambda v: F.substring(block(v["first"]), v["skip"], (end - start).cast("int"))

    def across(v: Column) -> Column:
        middle = F.array_join(F.slice(pieces, v["first"] + 2, v["last"] - v["first"] - 1), "")
        return F.concat(F.substring(block(v["first"]), v["skip"], F.lit(BLOCK)), middle, F.substring(block(v["last"]), F.lit(1), (end % BLOCK).cast("int")))

    at = F.struct(number(start).alias("first"), number(end).alias("last"), (start % BLOCK + 1).cast("int").alias("skip"))
    return let(at, lambda v: F.when(v["first"] == v["last"], inner(v)).otherwise(across(v)))


SPAN = "array<struct<start:bigint,end:bigint,match:string,part:string,before:string,after:string>>"


def regex_spans(text: Column, pattern: str, group: int = 0, context: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as an array of structs.

    Each has ``start`` and ``end`` (code points, end exclusive), ``match``,
    ``part`` (the text of ``group``) and, of the text between it and its
    neighbours, up to ``context`` characters ``before`` and ``after``, without words
    that do not lie in them as a whole. The pieces between the matches, which
    ``split`` gives, locate them. A text without a match costs one pass.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def ends(piece: Column, side: Callable, cut: str) -> Column:
        """The end of a piece that is next to a match; one more character shows whether its outermost word is whole."""
        if not context:
            return F.lit("")
        return let(side(piece, F.lit(context + 1)), lambda p: F.when(F.char_length(p) > context, F.regexp_replace(p, cut, "")).otherwise(p))

    def located(v: Column) -> Column:
        lengths = F.flatten(F.zip_with(F.slice(v["pieces"], F.lit(1), F.size(v["found"])), v["found"], lambda p, m: F.array(F.char_length(p).cast("long"), F.char_length(m).cast("long"))))
        return let(
            prefix_sums(lengths),
            lambda at: F.transform(
                F.sequence(F.lit(1), F.size(v["found"])),
                lambda i: F.struct(
                    F.element_at(at, i * 2).alias("start"),
                    F.element_at(at, i * 2 + 1).alias("end"),
                    F.element_at(v["found"], i).alias("match"),
                    F.element_at(v["part"], i).alias("part"),
                    ends(F.element_at(v["pieces"], i), F.right, r"\A\S*").alias("before"),
                    ends(F.element_at(v["pieces"], i + 1), F.left, r"\S*\z").alias("after"),
                ),
            ),
        )

    all_three = F.struct(found.alias("found"), (part if group else found).alias("part"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(F.rlike(text, F.lit(pattern)), let(all_three, located)).otherwise(F.array().cast(SPAN))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of spans (structs start, rank, kind, end) by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def as_spans(found: Column, rank: int, kind: str) -> Column:
    """Matches of ``regex_spans`` as spans of one kind."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))
