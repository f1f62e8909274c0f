"""Structured Streaming forms of the refresh loop and the +/- events
(SURVEY T1-T3).

A trigger writes what it changed, beside the newest version of the snapshot
table (``sources.pending``); ``read_snapshot`` shows both as one table. A
replayed micro-batch changes nothing, and maintenance and streams can share a
table. A query with a fresh checkpoint is a new stream: what it reads is
applied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.pending import add_events, add_rows

# Fixed value: refresh interval of the live inventory view.
REFRESH_INTERVAL = "30 seconds"

# Length of a time slot of events, in seconds (or units of a numeric order).
SLOT_SECONDS = 86_400


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A growing folder of files as a stream (new files = new rows)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def _trigger(writer, interval: str | None):
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)


def _query_id(batch: DataFrame) -> str:
    """Id of the streaming query a micro-batch belongs to; it lives in the checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


# Triggers after which the changed rows are folded into a new version.
FOLD_EVERY = 20


def _keyed_sink(root: str, name: str, key: str, fold_every: int, keep_versions: int | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        add_rows(batch, root, name, key, fold_every, keep_versions)
    return write


def _keyed_query(result: DataFrame, root: str, name: str, key: str, checkpoint: str, interval: str | None, fold_every: int,
                 keep_versions: int | None) -> StreamingQuery:
    """Update mode: a trigger brings the rows of the keys it changed, each
    with its whole value, so that a replay writes the same values again."""
    writer = (result.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
              .foreachBatch(_keyed_sink(root, name, key, fold_every, keep_versions)))
    return _trigger(writer, interval).start()


def stream_summary(stream: DataFrame, key: str, value: str, root: str, name: str, checkpoint: str,
                   total_name: str = "total", interval: str | None = REFRESH_INTERVAL,
                   keep_versions: int | None = None, fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """Keep ``sum(value)`` per key fresh as rows arrive. Every trigger
    writes the changed keys; every ``fold_every`` triggers they are folded
    into a new version, of which the newest ``keep_versions`` (2) are kept.
    ``interval=None`` processes what is there now and stops (tests, backfills)."""
    summary = stream.groupBy(F.col(f"`{key}`")).agg(F.coalesce(F.sum(F.col(f"`{value}`")), F.lit(0)).alias(total_name))
    return _keyed_query(summary, root, name, key, checkpoint, interval, fold_every, keep_versions)


def stream_net_quantity(events: DataFrame, root: str, name: str, checkpoint: str, id_col: str = "row_id",
                        delta_col: str = "delta", interval: str | None = REFRESH_INTERVAL,
                        keep_versions: int | None = None, fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """Net quantity change per row id from an event stream (net only;
    the delete-at-zero rule needs order, see ``stream_apply_events``). Written
    as in ``stream_summary``: a trigger writes the ids it changed."""
    net = events.groupBy(F.col(id_col)).agg(F.sum(F.col(delta_col)).cast("bigint").alias("net"))
    return _keyed_query(net, root, name, id_col, checkpoint, interval, fold_every, keep_versions)


def stream_apply_events(events: DataFrame, root: str, name: str, checkpoint: str,
                        order_cols: Sequence[str] = ("ts", "event_id"), id_col: str = "RowID",
                        interval: str | None = REFRESH_INTERVAL, qty: str = "Quantity", event_id_col: str = "row_id",
                        delta_col: str = "delta", slot_width: int = SLOT_SECONDS) -> StreamingQuery:
    """Apply quantity events to the inventory snapshot with the
    delete-at-zero rule (I5).

    Events may come in any order, over any number of micro-batches: the state
    is the newest version with all events since in the order of
    ``order_cols``, as one batch would give it. A micro-batch logs its events
    and sums up anew only the (id, time slot) pairs that it touches; the
    inventory is not rewritten. ``fold_pending`` or a maintenance run makes a
    version of it, before which no later event can act.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        add_events(batch, _query_id(batch), batch_id, root, name, order_cols, id_col, qty, event_id_col, delta_col, slot_width)

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return _trigger(writer, interval).start()


def run_available(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query to finish; re-raise its error."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
