"""Fusion of candidate lists by weighted reciprocal ranks, boosts, and the cuts around reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entities import matches
from ..functions.text import tokens, trim_space
from .analysis import any_of
from .joins import join_small

# Weight and offset of each source by mode, boosts, and the markers of reference questions.
DENSE = {"reference": (0.6, 75), "graph_first": (0.8, 65), None: (1.0, 60)}
SPARSE = {"reference": (2.0, 35), "graph_first": (0.9, 55), "mixed": (1.1, 55), None: (1.0, 60)}
GRAPH = {"graph_first": (1.6, 30), "mixed": (1.1, 40), None: (0.0, 1)}
OVERLAP = {"api_symbols": 0.35, "components": 0.14, "products": 0.1, "interfaces": 0.08, "os_tags": 0.05, "language_tags": 0.05}
OVERLAP_CAP = 3
REFERENCE_MARKERS = ("функц", "вызов", "синтаксис", "параметр", "назначение", "примечание", "возвращаем", "пример", "объект", "подпис", "проверк", "ключ", "reference")
REFERENCE_TYPE, TITLE_START, TITLE_BONUS, IN_HEADING, IN_TEXT, SECTION = 0.35, "функции ", 0.08, 0.35, 0.2, 0.03
SECTION_QUESTIONS = ("какие разделы", "описание функции", "какие секции")
SECTIONS = ("синтаксис", "параметры", "назначение", "примечание", "возвращаемые значения", "пример")
RETRIEVAL_MODES = ("dense", "bm25", "graph", "hybrid")


def known_retrieval(value: Column) -> Column:
    low = F.lower(trim_space(F.coalesce(value, F.lit("hybrid"))))
    return F.when(low.isin(*RETRIEVAL_MODES), low).otherwise("hybrid")


def graph_mode(query_mode: Column, retrieval: Column) -> Column:
    return F.when(retrieval == "graph", "graph_first").otherwise(query_mode)


def is_reference(rewritten: Column, found: Column) -> Column:
    return F.array_contains(found["interfaces"], "pkcs11") & any_of(F.lower(rewritten), REFERENCE_MARKERS)


def rank_score(rank: Column, table: dict, mode: Column, reference: Column) -> Column:
    part = lambda key: F.lit(table[key][0]) / (F.lit(table[key][1]) + rank)
    out = part(None)
    for key in table:
        if key not in (None, "reference"):
            out = F.when(mode == key, part(key)).otherwise(out)
    return F.when(reference, part("reference")).otherwise(out) if "reference" in table else out


def contributions(source: Column, rank: Column, score: Column, mode: Column, reference: Column, graph_mode_: Column, graph_weight: float) -> Column:
    """What a hit adds to its chunk's fused score; a graph hit also adds a share of its own score."""
    never = F.lit(False)
    return F.when(source == "dense", rank_score(rank, DENSE, mode, reference)).when(source == "sparse", rank_score(rank, SPARSE, mode, reference)).otherwise(rank_score(rank, GRAPH, graph_mode_, never) + score * graph_weight)


def overlap_boost(metadata: Column, found: Column) -> Column:
    out = F.lit(0.0)
    for f, w in OVERLAP.items():
        out = out + F.least(F.size(F.array_intersect(found[f], metadata[f])), F.lit(OVERLAP_CAP)) * w
    return out


def reference_boost(title: Column, heading_path: Column, text: Column, chunk_type: Column, found: Column, rewritten: Column) -> Column:
    heading, low = F.lower(F.array_join(heading_path, " ")), F.lower(text)
    out = F.when(chunk_type == "reference", REFERENCE_TYPE).otherwise(0.0) + F.when(F.lower(title).startswith(TITLE_START), TITLE_BONUS).otherwise(0.0)
    out = out + F.aggregate(found["api_symbols"], F.lit(0.0).cast("double"), lambda a, s: a + F.when(F.contains(heading, F.lower(s)), F.lit(IN_HEADING)).when(F.contains(text, s), F.lit(IN_TEXT)).otherwise(0.0))
    present = sum((F.contains(low, F.lit(s)).cast("int") for s in SECTIONS[1:]), F.contains(low, F.lit(SECTIONS[0])).cast("int"))
    return out + F.when(any_of(F.lower(rewritten), SECTION_QUESTIONS), present * SECTION).otherwise(0.0)


def overlap_rerank(query: Column, text: Column) -> Column:
    """The offline reranker: the share of distinct query tokens that the text has."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, tokens(text))) / F.size(asked), 6)).otherwise(0.0)


def fuse(hits: DataFrame, queries: DataFrame, chunks: DataFrame, options, retrieval: str = "hybrid", rerank=overlap_rerank) -> DataFrame:
    """(qid, chunk_id, dense_score, sparse_score, graph_score, fused_score, rerank_score, rank, final) of the reranked hits.

    hits: (qid, chunk_id, source, rank, score), written, as they are read twice; a hit whose chunk is missing keeps its rank but goes. queries is analysed.
    Candidates are gathered by one union and grouping. Filters apply after fusion, before the cut. Ties go by dense
    rank, then sparse, then graph; those of reranking by the order before it. rerank gives a Column of two."""
    q = queries.select("qid", "rewritten_query", "entities", "filters", "query_mode", is_reference(F.col("rewritten_query"), F.col("entities")).alias("reference"))
    mode = F.col("query_mode")
    one = join_small(hits, q.select("qid", "query_mode", "reference"), "qid", options.broadcast_rows)
    one = one.withColumn("part", contributions(F.col("source"), F.col("rank"), F.col("score"), mode, F.col("reference"), graph_mode(mode, F.lit(retrieval)), options.graph_fusion_weight))
    of = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    fused = one.groupBy("qid", "chunk_id").agg(*[F.coalesce(of(s, "score"), F.lit(0.0)).alias(f"{s}_score") for s in ("dense", "sparse", "graph")], F.sum("part").alias("fused_score"), F.coalesce(of("dense", "rank"), of("sparse", "rank") + 1_000_000, of("graph", "rank") + 2_000_000).alias("met"))
    # Candidates are few a query; they come to the chunks.
    rows = join_small(chunks.select("chunk_id", "title", "heading_path", "text", "chunk_type", "metadata", "source_url"), fused, "chunk_id", options.broadcast_rows).join(q.drop("query_mode"), "qid")
    if retrieval == "hybrid":
        boost = overlap_boost(F.col("metadata"), F.col("entities")) + F.when(F.col("reference"), reference_boost(F.col("title"), F.col("heading_path"), F.col("text"), F.col("chunk_type"), F.col("entities"), F.col("rewritten_query"))).otherwise(0.0)
        rows = rows.withColumn("fused_score", F.col("fused_score") + boost)
    rows = rows.where(matches(F.col("metadata"), F.col("filters")))
    before = Window.partitionBy("qid").orderBy(F.round("fused_score", 6).desc(), "met", "chunk_id")
    rows = rows.withColumn("place", F.row_number().over(before)).where(F.col("place") <= options.rerank_candidate_count)
    rows = rows.withColumn("rerank_score", rerank(F.col("rewritten_query"), F.col("text")))
    after = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "place")
    rows = rows.withColumn("rank", F.row_number().over(after))
    return rows.withColumn("final", F.col("rank") <= options.final_context_count).select("qid", "chunk_id", "title", "heading_path", "text", "source_url", "chunk_type", "dense_score", "sparse_score", "graph_score", "fused_score", "rerank_score", "rank", "final")
