"""Incremental ingest: each new file of a group becomes part of a keyed table once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.errors import StorageError
from tablewright.sources.files import ORDER_COLUMNS, csv_options, with_file_block
from tablewright.sources.ingest import IngestResult, ingest_frame
from tablewright.sources.store import TableStore


def csv_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the CSV files of a folder, each read once, oldest first. Every row keeps its
    file and block, and a micro-batch numbers the rows in them, so the first of several rows with
    one key is the first in (file, row) order. What the batch reader refuses fails the micro-batch, and so
    does a file whose header lists the columns in another order: a stream has one schema for all files."""
    reader = spark.readStream.options(**csv_options()).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_file_block(reader.csv(folder))


def ingest_batch(
    store: TableStore, table: str, batch: DataFrame, batch_id: int, stream: str, method: str | None = None
) -> IngestResult | None:
    """Ingest one micro-batch. A batch the table already holds is passed over, so a restart after
    a failure between the write and the stream's own commit changes nothing."""
    rows = store.rows(table)
    latest = rows.latest()
    done = dict(latest.notes.get("streams", {})) if latest else {}
    if done.get(stream, -1) >= batch_id:
        return None
    order = None
    if ORDER_COLUMNS[0] in batch.columns:
        batch = batch.select("*", F.monotonically_increasing_id().alias(ORDER_COLUMNS[2]))
        order = [F.col(name) for name in ORDER_COLUMNS]
    result = ingest_frame(store, table, batch, method, order=order, streams={**done, stream: batch_id})
    if not result.ok:
        raise StorageError(f"batch {batch_id} of stream {stream!r}: {result.error or result.diff}")
    return result


def stream_into(
    store: TableStore,
    table: str,
    source: DataFrame,
    stream: str,
    checkpoint: str,
    method: str | None = None,
) -> StreamingQuery:
    """Start a query that ingests everything available and stops.

    Stateless steps (filters, date ranges, renames, computed columns, joins to a static table)
    can be applied to ``source`` before; key checks and validations run per micro-batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(store, table, batch, batch_id, stream, method)

    return (
        source.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .queryName(stream)
        .start()
    )
