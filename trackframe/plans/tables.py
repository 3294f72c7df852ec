"""The given tables in the roles that the operators take."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions.timing import seconds
from trackframe.params import Segmenting

#: Events lie hours apart, so lengths are scaled: thresholds on ``value``, a day, two hours, four days.
EVENT_PARAMS = Segmenting(start=50.0, stop=25.0, hangover=86400.0, min_length=7200.0, max_length=345600.0)
WEEK = 7 * 86400.0


def folder_of(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share: under ``spark.checkpoint.dir``, or of this process in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='trackframe-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream for each user; errors are frames that missed their subject."""
    aperture = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stream_id"), seconds(F.col("ts")).alias("t"), "value", "event_type", aperture.alias("aperture"))


#: The same in DuckDB.
EVENTS_SQL = "events_ AS (SELECT event_id, user_id AS stream_id, epoch_us(ts) / 1e6 AS t, value, event_type, CASE WHEN event_type <> 'error' THEN value END AS aperture FROM events)"


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream for each label; the first eight numbers are four points."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("stream_id"),
        F.col("vec_id"),
        F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("points"),
    )


KEYPOINTS_SQL = "keypoints AS (SELECT label AS stream_id, vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS points FROM embeddings)"
