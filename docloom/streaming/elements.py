"""Streams of documents and elements.

The extraction of a document depends on nothing but its row, so the batch operators run unchanged on
a stream; only redelivered rows need state, which a watermark bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.extraction import extract_lines


def stream_elements(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Elements of a stream of documents, a stateless transformation."""
    return extract_lines(documents, doc_id, text)


def drop_redelivered(elements: DataFrame, delay: str = "7 days", arrived: str = "ingested_at") -> DataFrame:
    """A stream of elements with those delivered again within ``delay`` left out; state older than that is dropped."""
    return elements.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["doc_id", "element_id"])


def arrivals(elements: DataFrame, window: str = "1 day", delay: str = "7 days", arrived: str = "ingested_at") -> DataFrame:
    """Elements and characters by upload day of arrival; a window closes once the watermark has passed it."""
    return elements.withWatermark(arrived, delay).groupBy(F.window(arrived, window), "element_type").agg(F.count(F.lit(1)).alias("elements"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("characters"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A query that writes what is there as Parquet and ends; started again, it goes on from its checkpoint."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A query that gives every micro-batch to a batch operator, for operators that aggregate over documents."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
