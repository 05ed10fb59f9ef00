"""Keyed upserts from streams of files: each micro-batch makes a new version of a table, of the buckets that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.catalog import Catalog


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A folder's files as a stream; each is read once, as the checkpoint remembers."""
    reader = spark.readStream.format(kind).schema(schema)
    if kind == "csv":
        reader = reader.option("header", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def upsert_stream(stream: DataFrame, catalog: Catalog, table: str, key: list[str], checkpoint: str, order_by: list[str] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True) -> StreamingQuery:
    """Start a query that upserts each micro-batch into a table of the catalog.

    A batch may come again after a failure; an upsert by key with an order then gives the same table. Of a table that the
    catalog deals by this key only the buckets that a batch touches are read and written.
    """
    spec = catalog.spec(table)
    key = spec.check_upsert_key(key)

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows = rows.persist()
        try:
            catalog.upsert(table, rows, key, order_by)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tumbling_counts(events: DataFrame, time: str, by: str, width: str = "10 minutes", late: str | None = None) -> DataFrame:
    """Events by window and kind; with `late`, a watermark bounds the state of a stream."""
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), by, "n")
