"""Answers and citations from ranked chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet, trim_space
from .joins import join_small

# Sentences and labels of answers.
REFUSAL = "В доступном контексте нет данных, достаточных для точного ответа."
NO_DOCUMENTS = "Релевантные документы не найдены. BM25 baseline не использует LLM и возвращает только найденные текстовые совпадения."
REWRITTEN, MODE, FACTS, SOURCE = "Переписанный запрос: ", "Режим поиска: ", "Graph facts:", "Источник: "
NOT_GENERATED = "Ниже собран релевантный контекст без генерации через OpenRouter, потому что провайдер не настроен."
BASELINE_HEAD = ("Режим: BM25 baseline без LLM", "Единица поиска: целый документ", "", "Найденные документы:", "")
CUT = 1200


def _listed(rows: DataFrame, text) -> DataFrame:
    return rows.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("x")))), lambda s: s["x"]).alias("listed"))


def citations(ranked: DataFrame) -> DataFrame:
    """(qid, citations) of the final chunks, in rank order."""
    return _listed(ranked.where("final"), F.struct("source_url", "title", "heading_path", "chunk_id")).withColumnRenamed("listed", "citations")


def fallback(queries: DataFrame, ranked: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(qid, answer) without a text generator: the final chunks as a numbered list, or a refusal if there are none."""
    n = F.col("rank").cast("string")
    entry = F.concat(n, F.lit(". "), "title", F.lit(" / "), F.array_join("heading_path", " > "), F.lit("\n"), trim_space(F.substring("text", 1, CUT)), F.lit("\n" + SOURCE), "source_url", F.lit("\n"))
    rows = queries.join(_listed(ranked.where("final"), entry), "qid", "left")
    rows = rows.join(facts, "qid", "left") if facts is not None else rows.withColumn("facts", F.expr("cast(null as array<string>)"))
    graph = F.when(F.size("facts") > 0, F.concat(F.lit(FACTS + "\n"), F.array_join(F.transform("facts", lambda f: F.concat(F.lit("- "), f)), "\n"), F.lit("\n\n"))).otherwise("")
    whole = F.concat(F.lit(REWRITTEN), "rewritten_query", F.lit("\n" + MODE), "query_mode", F.lit("\n\n"), graph, F.lit(NOT_GENERATED + "\n\n"), F.array_join("listed", "\n"))
    return rows.select("qid", F.when(F.coalesce(F.size("listed"), F.lit(0)) <= 0, REFUSAL).otherwise(trim_space(whole)).alias("answer"))


def prompt(queries: DataFrame, ranked: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, prompt) for a text generator: numbered sources after the question, its analysis and the graph facts."""
    entry = F.concat(F.lit("[Источник "), F.col("rank").cast("string"), F.lit("]\nURL: "), "source_url", F.lit("\nЗаголовок: "), "title", F.lit("\nРаздел: "), F.array_join("heading_path", " > "), F.lit("\n"), "text")
    rows = queries.join(_listed(ranked.where("final"), entry), "qid").join(facts, "qid", "left")
    graph = F.when(F.size("facts") > 0, F.concat(F.lit(FACTS + "\n"), F.array_join(F.transform("facts", lambda f: F.concat(F.lit("- "), f)), "\n"), F.lit("\n\n"))).otherwise("")
    return rows.select("qid", F.concat(F.lit("Запрос пользователя: "), "question", F.lit("\n" + REWRITTEN), "rewritten_query", F.lit("\n" + MODE), "query_mode", F.lit("\nФильтры: "), F.to_json("filters"), F.lit("\n\n"), graph, F.lit("Контекст:\n\n"), F.array_join("listed", "\n\n")).alias("prompt"))


def baseline(queries: DataFrame, hits: DataFrame, docs: DataFrame, limit: int = 200_000) -> DataFrame:
    """(qid, answer) of the document baseline: hits (qid, id, rank), written, as titles and snippets. The hits come to the
    documents if they are at most `limit`."""
    rows = join_small(docs.select("id", "title", "text", "source_url"), hits.select("qid", "id", "rank"), "id", limit).join(queries.select("qid", "question"), "qid")
    entry = F.concat(F.col("rank").cast("string"), F.lit(". "), "title", F.lit("\n"), snippet(F.col("text"), F.col("question")), F.lit("\n" + SOURCE), "source_url", F.lit("\n"))
    found = queries.join(_listed(rows, entry), "qid", "left")
    head = F.concat(F.lit("Запрос: "), "question", F.lit("\n" + "\n".join(BASELINE_HEAD) + "\n"))
    return found.select("qid", F.when(F.col("listed").isNull(), NO_DOCUMENTS).otherwise(trim_space(F.concat(head, F.array_join("listed", "\n")))).alias("answer"))


#: What a response says of each retrieved chunk.
RETRIEVED = ("chunk_id", "title", "heading_path", "source_url", "chunk_type", "dense_score", "sparse_score", "graph_score", "fused_score", "rerank_score", "text")


def response(asked: DataFrame, answers: DataFrame, ranked: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, question, rewritten_query, filters, query_mode, routing_confidence, routing_reason, answer, graph_facts,
    citations, retrieved_chunks, sources, ranked_sources), a row for each question. Lists are in order of rank and never null:
    citations, chunks and sources (each once) of the final chunks, ranked_sources of all that were reranked. A question's
    chunks are bounded by the options' counts."""
    rows = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "final", F.struct(*RETRIEVED).alias("c")))).alias("all"))
    of = lambda rows, make: F.transform(rows, lambda r: make(r["c"]))
    cited = lambda c: F.struct(*[c[f].alias(f) for f in ("source_url", "title", "heading_path", "chunk_id")])
    final = F.filter("all", lambda r: r["final"])
    rows = rows.select("qid", of(final, cited).alias("citations"), of(final, lambda c: c).alias("retrieved_chunks"), F.array_distinct(of(final, lambda c: c["source_url"])).alias("sources"), of(F.col("all"), lambda c: c["source_url"]).alias("ranked_sources"))
    out = asked.select("qid", "question", "rewritten_query", "filters", "query_mode", "routing_confidence", "routing_reason").join(answers, "qid").join(facts.withColumnRenamed("facts", "graph_facts"), "qid", "left").join(rows, "qid", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)) for c in ("graph_facts", *rows.columns[1:])})
