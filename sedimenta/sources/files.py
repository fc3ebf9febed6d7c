"""Page folders, chunk files and index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, document_id string, page_id string, source_url string, title string, heading_path array<string>, text string, chunk_type string, metadata struct<doc_family: string, products: array<string>, interfaces: array<string>, os_tags: array<string>, language_tags: array<string>, components: array<string>, api_symbols: array<string>, entity_terms: array<string>, heading_path_text: string, chunk_type: string>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every Markdown file in folder."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; no such file means no chunks, a malformed line an error."""
    return spark.read.schema(CHUNKS).option("mode", "FAILFAST").json(path) if exists(spark, path) else spark.createDataFrame([], CHUNKS)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def manifest(documents: DataFrame, chunks: DataFrame, vector_size: int) -> DataFrame:
    """One row: how many documents and chunks, and the length of the vectors."""
    n = lambda rows, name: rows.agg(F.count("*").alias(name))
    return n(documents, "documents").crossJoin(n(chunks, "chunks")).select("documents", "chunks", F.lit(vector_size).alias("vector_size"))
