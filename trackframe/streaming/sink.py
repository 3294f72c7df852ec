"""A sink for results that has each of them once: a streaming data source that commits by trigger.

Tasks write Parquet files under names of their own; they count only when the trigger's commit record lists them. A trigger's
record is written once: a trigger that runs again after a restart finds it and leaves its own files out. ``committed``
reads what the records list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from trackframe.sources.files import folder

FORMAT = "trackframe-results"


@dataclass
class Written(WriterCommitMessage):
    """The files of a task."""

    files: list[str]


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        at, root = folder(self.path)
        at.create_dir(f"{root}/data", recursive=True)
        name, writer, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                writer = writer or pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=at)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer:
                writer.close()
        return Written([name] if rows else [])

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        at, root = folder(self.path)
        at.create_dir(f"{root}/commits", recursive=True)
        record = f"{root}/commits/{batchId}.json"
        if at.get_file_info(record).type != fs.FileType.NotFound:
            self._remove(messages)  # this trigger has been committed before
            return
        draft = f"{root}/.{batchId}-{uuid.uuid4().hex}"
        with at.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": batchId, "files": [f for m in messages if m for f in m.files]}).encode())
        at.move(draft, record)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._remove(messages)

    def _remove(self, messages: list[Written | None]) -> None:
        at, root = folder(self.path)
        for name in (f for m in messages if m for f in m.files):
            at.delete_file(f"{root}/data/{name}")


class Results(DataSource):
    """``writeStream.format(FORMAT).option("path", folder)``; the folder is shared by driver and executors."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Results)


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed triggers, with ``batch``. Files that no record lists, of tasks that were lost, are left out."""
    records = spark.read.schema("batch long, files array<string>").json(f"{path}/commits")
    listed = records.select("batch", F.explode("files").alias("_file"))
    rows = spark.read.schema(schema).parquet(f"{path}/data").withColumn("_file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return rows.join(listed, "_file").drop("_file")
