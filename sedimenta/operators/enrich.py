"""Chunk metadata from entity dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entities import FIELDS, Dictionary, entities, family, terms
from ..functions.text import symbols


def enrich(chunks: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Adds the column metadata. C code counts as language c; among the entity terms only if the text names another
    language too, as the tag joins a list that must exist."""
    heading = F.array_join("heading_path", " ")
    rows = chunks.withColumn("e", entities(F.concat_ws(" ", F.col("title"), heading, F.col("text")), dictionary))
    low = F.lower("text")
    is_c = (F.col("chunk_type") == "code") & ~F.array_contains("e.language_tags", "python") & (F.contains(low, F.lit("functionlist->")) | F.contains(low, F.lit("ck_")))
    with_c = F.array_distinct(F.concat("e.language_tags", F.array(F.lit("c"))))
    tags = F.when(is_c, with_c).otherwise(F.col("e.language_tags"))
    named = F.struct(*[(F.when(is_c & (F.size("e.language_tags") > 0), with_c).otherwise(F.col("e.language_tags")) if f == "language_tags" else F.col(f"e.{f}")).alias(f) for f in FIELDS])
    values = {f: F.col(f"e.{f}") for f in FIELDS} | {"language_tags": tags, "api_symbols": F.array_distinct(F.concat("e.api_symbols", symbols(heading)))}
    metadata = F.struct(family(F.col("title")).alias("doc_family"), *[values[f].alias(f) for f in FIELDS], terms(named).alias("entity_terms"), F.array_join("heading_path", " > ").alias("heading_path_text"), F.col("chunk_type").alias("chunk_type"))
    return rows.withColumn("metadata", metadata).drop("e")


def search_text():
    """What a chunk is found by: title, headings, text, symbols and entity terms."""
    return F.concat_ws("\n", F.col("title"), F.array_join("heading_path", " "), F.col("text"), F.array_join("metadata.api_symbols", " "), F.array_join("metadata.entity_terms", " "))


def tags(metadata: str = "metadata"):
    """The values of a chunk's fields as field:value, by which filters admit it."""
    return F.flatten(F.array(*[_named(F.col(f"{metadata}.{f}"), f) for f in FIELDS]))


def must(filters: str = "filters"):
    """Filters as lists of tags; a chunk needs one of each. Fields that name nothing ask for nothing."""
    return F.filter(F.array(*[_named(F.col(f"{filters}.{f}"), f) for f in FIELDS]), lambda x: F.size(x) > 0)


def _named(values, field: str):
    return F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), lambda v: F.concat(F.lit(f"{field}:"), v))


def payload(chunks: DataFrame) -> DataFrame:
    """Chunks with their metadata as columns, as a vector store keeps them."""
    return chunks.select(*[c for c in chunks.columns if c != "metadata"], *[f"metadata.{f}" for f in chunks.schema["metadata"].dataType.names if f not in chunks.columns])
