"""Incremental ingestion as a stream. An extension: batch ingestion rebuilds everything, this keeps chunks up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.entities import Dictionary
from ..operators import enrich, graph, parsing
from ..options import Options
from ..sources.tables import Tables


def page_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """(path, text, modified) of Markdown files as they arrive."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_a_batch).schema("value string").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def latest_pages(pages: DataFrame) -> DataFrame:
    """(path, text): of pages that come twice in a batch, the one modified last (of equals the greater text)."""
    name = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    last = pages.groupBy(name.alias("name")).agg(F.max(F.struct("modified", "text", "path")).alias("p"))
    return last.select("p.path", "p.text")


def ingest(spark: SparkSession, folder: str, home: str, checkpoint: str, options: Options | None = None, dictionary: Dictionary | None = None, once: bool = True) -> StreamingQuery:
    """Parses, chunks and enriches arriving pages into the tables chunks and graph_links of home/index, page by page: what a
    page had before goes, whatever the new one has. Both tables change in one version, and only the buckets of the batch's
    pages are read and written. A batch that is tried again after a failure gives the same tables."""
    options, dictionary = options or Options(), dictionary or Dictionary()
    tables = Tables(spark, f"{home.rstrip('/')}/index")

    def put(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        docs = parsing.parse_pages(latest_pages(batch))
        pages = docs.select("document_id")
        docs = docs.join(parsing.clean_lines(docs), "document_id")
        chunks = enrich.enrich(parsing.chunk(docs, options), dictionary)
        with tables.change() as change:
            change.upsert("chunks", chunks, "document_id", pages)
            new = change.read("chunks").join(pages, "document_id", "left_semi")
            change.upsert("graph_links", graph.links(new), "document_id", pages)

    writer = page_stream(spark, folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latency_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and event type: count and mean value of an event stream (ts, event_type, value), late rows bounded."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select("window.start", "event_type", "n", "mean_value")
