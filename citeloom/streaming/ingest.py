"""New papers as a stream: entities are extracted without state and put into a table by batches; event counts by windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.entities import _found


def stream_entities(papers: DataFrame, vocabulary: list[tuple[int, str, str]]) -> DataFrame:
    """doc_id, entity of vocabulary terms in a stream's titles; no state is kept."""
    return papers.select("doc_id", F.explode(F.transform(_found(F.col("title"), vocabulary), lambda e: e["entity"])).alias("entity"))


def upsert_entities(stream: DataFrame, path: str, checkpoint: str):
    """Write each batch of (doc_id, entity) to its own folder under path: a batch that is replayed replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """event_type, window start, n: tumbling windows that close when the watermark passes them."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
