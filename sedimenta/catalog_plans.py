"""Queries of whole plans: analysis, fusion, hybrid search, answers, evaluation and the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as c
from .catalog import CORPUS, OPTIONS, query, table
from .functions import entities as ent
from .operators import analysis, answer, dense, enrich, evaluate, fusion, graph, sparse
from .operators.joins import join_small
from .plans import engine
from .sources import store
from .sources.scratch import written

# ---- analysis

_ENDINGS = ("", " где описана архитектура", " C_Sign", " архитектура и связь", " какие разделы pkcs#11 генерации пары ключей", " какой порт python", " --help")
_ASKED = "qs AS (SELECT item_id AS qid, text || ['" + "', '".join(_ENDINGS) + "'][item_id % 7 + 1] AS t, item_id % 7 AS k FROM benchmark)"
_MAJOR = f"qe AS (SELECT DISTINCT qid, field, tag FROM qs, (VALUES {c._dictionary_rows()}) AS v(field, label, tag, w) WHERE contains(lower(t), label))"


@query("query_analysis", f"""WITH {_ASKED}, {_MAJOR}, mj AS (SELECT qid, count(*) AS n FROM qe WHERE field IN ('products', 'interfaces', 'components', 'os_tags') GROUP BY qid)
SELECT qid, CASE WHEN k IN (1, 2, 4, 5, 6) THEN 'classic' WHEN k = 3 AND coalesce(n, 0) >= 2 THEN 'graph_first' ELSE 'classic' END AS query_mode,
CASE k WHEN 1 THEN 'routing' WHEN 5 THEN 'factoid' ELSE 'general' END AS intent, k = 5 AS needs_code,
CASE WHEN k IN (1, 2, 4, 5, 6) THEN 1.0::DOUBLE END AS routing_confidence, CASE WHEN k IN (1, 2, 4, 5, 6) THEN 'forced_classic' ELSE 'heuristic_fallback' END AS routing_reason,
CASE k WHEN 2 THEN 'C_Sign' WHEN 4 THEN 'C_GenerateKeyPair' ELSE '' END AS api_symbols FROM qs LEFT JOIN mj USING (qid)""")
def query_analysis(spark, d):
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("item_id") % 7 + 1).cast("int"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat("text", ending).alias("question"))
    return analysis.analyze(rows, CORPUS).select("qid", "query_mode", "intent", "needs_code", "routing_confidence", "routing_reason", c.joined("entities.api_symbols").alias("api_symbols"))


_ROUTED = (("mixed", "0.6", "mixed"), ("mixed", "0.5", "classic"), ("graph_first", "0.75", "graph_first"), ("graph_first", "0.7", "classic"), (" Classic ", "1", "classic"), ("bad", "9", "graph_first"), ("graph_first", "x", "classic"), ("graph_first", "7", "graph_first"))


@query("routed_analysis", "SELECT item_id AS qid, [" + ", ".join(f"'{w}'" for *_, w in _ROUTED) + """][item_id % 8 + 1] AS query_mode, 'ios,linux,windows' AS os_tags, 'why' || item_id AS routing_reason FROM benchmark""")
def routed_analysis(spark, d):
    """What a router says counts by its confidence; its filters join those of the question."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("архитектура linux и windows "), F.col("item_id").cast("string")).alias("question"))
    said = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in _ROUTED]), (F.col("qid") % 8 + 1).cast("int"))
    none = F.expr("cast(array() as array<string>)")
    filters = F.struct(*[(F.array(F.lit("ios")) if f == "os_tags" else none).alias(f) for f in ent.FIELDS])
    routed = rows.select("qid", said(0).alias("mode"), said(1).alias("confidence"), F.lit(None).cast("string").alias("rewritten"), F.concat(F.lit("why"), F.col("qid").cast("string")).alias("reason"), filters.alias("filters"))
    found = analysis.analyze(rows, ent.Dictionary(), routed=routed)
    return found.select("qid", "query_mode", c.joined("filters.os_tags").alias("os_tags"), "routing_reason")


# ---- fusion

_ORDER = {t: i for i, t in enumerate(dict.fromkeys(t for f in ent.FIELDS[:-1] for t in CORPUS.aliases.get(f, {}).values()))}
_TAG_ORDER = ", ".join(f"('{t}', {i})" for t, i in _ORDER.items())
_QE = f"qe AS (SELECT DISTINCT item_id AS qid, field, tag FROM benchmark, (VALUES {c._dictionary_rows()}) AS v(field, label, tag, w) WHERE contains(lower(text), label))"
_REWRITTEN = f"rw AS (SELECT item_id AS qid, text AS question, text || coalesce(' ' || string_agg(tag, ' ' ORDER BY o), '') AS rew, ['classic', 'mixed', 'graph_first'][item_id % 3 + 1] AS mode FROM benchmark LEFT JOIN (SELECT DISTINCT qid, tag, o FROM qe JOIN (VALUES {_TAG_ORDER}) AS o(tag, o) USING (tag)) e ON e.qid = item_id GROUP BY item_id, text)"
_FITS = """ex AS (SELECT qid, count(DISTINCT field) AS need FROM qe GROUP BY qid),
got AS (SELECT qid, chunk_id, count(DISTINCT field) AS have FROM qe JOIN m USING (field, tag) GROUP BY ALL),
ok AS (SELECT rw.qid, ch0.chunk_id FROM rw CROSS JOIN chunks ch0 LEFT JOIN ex ON ex.qid = rw.qid LEFT JOIN got ON got.qid = rw.qid AND got.chunk_id = ch0.chunk_id WHERE coalesce(have, 0) = coalesce(need, 0))"""
_CHUNK_TEXT = "ct AS (SELECT chunk_id AS doc_id, source || chr(10) || chr(10) || text || chr(10) || coalesce((SELECT string_agg(tag, ' ') FROM m WHERE m.chunk_id = chunks.chunk_id AND field = 'api_symbols'), '') || chr(10) || coalesce((SELECT string_agg(DISTINCT tag, ' ') FROM m WHERE m.chunk_id = chunks.chunk_id), '') AS text FROM chunks)"
_SPARSE = f"""{_CHUNK_TEXT}, {c.BM25_SQL.format(tokens=c.TOKENS_SQL.format('text'), docs='ct')},
q AS (SELECT qid, unnest({c.TOKENS_SQL.format('rew')}) AS term FROM rw), {c.SCORE_SQL},
sh AS (SELECT s.qid, s.doc_id AS chunk_id, score, row_number() OVER (PARTITION BY s.qid ORDER BY round(score, 6) DESC, s.doc_id) AS rank FROM s JOIN ok ON ok.qid = s.qid AND ok.chunk_id = s.doc_id WHERE score > 0 QUALIFY rank <= 20)"""
_EMBED = "SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS dim, sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM (SELECT {0} AS k, unnest({1}) AS t FROM {2}) GROUP BY ALL"
_DENSE = f"""ve AS ({_EMBED.format('chunk_id', c.TOKENS_SQL.format('text'), 'chunks')}), vn AS (SELECT k, sqrt(sum(x * x)) AS n FROM ve GROUP BY k),
qv AS ({_EMBED.format('qid', c.TOKENS_SQL.format('rew'), 'rw')}), qn AS (SELECT k, sqrt(sum(x * x)) AS n FROM qv GROUP BY k),
dots AS (SELECT qv.k AS qid, ve.k AS chunk_id, sum(qv.x * ve.x) AS dot FROM qv JOIN ve USING (dim) GROUP BY ALL),
dl AS (SELECT ok.qid, ok.chunk_id, coalesce(dot, 0) / (qn.n * vn.n) AS score FROM ok JOIN vn ON vn.k = ok.chunk_id JOIN qn ON qn.k = ok.qid LEFT JOIN dots ON dots.qid = ok.qid AND dots.chunk_id = ok.chunk_id WHERE vn.n > 0 AND qn.n > 0),
nn AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS ordinal FROM chunks),
dh AS (SELECT qid, dl.chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, ordinal) AS rank FROM dl JOIN nn USING (chunk_id) QUALIFY rank <= 20)"""
_HITS = "hits AS (SELECT qid, chunk_id, 'dense' AS src, rank, score FROM dh UNION ALL SELECT qid, chunk_id, 'sparse', rank, score FROM sh UNION ALL SELECT qid, chunk_id, 'graph', rank, score FROM gh)"
_ALL = f"WITH {c.GRAPH_SQL}, {c.EDGES_SQL}, {c.NEAR_SQL}, {c.SEEDS_SQL}, {c.GSEARCH_SQL}, {_QE}, {_REWRITTEN}, {_FITS}, {_SPARSE}, {_DENSE}, {_HITS}"


def _analysed(spark, d):
    asked = analysis.analyze(c._questions(spark, d), CORPUS)
    return written(asked.withColumn("query_mode", F.element_at(F.array(*map(F.lit, ("classic", "mixed", "graph_first"))), (F.col("qid") % 3 + 1).cast("int"))), "questions")


def _hits(spark, d):
    chunks, asked, embedder = written(c._enriched(spark, d), "chunks"), _analysed(spark, d), dense.HashEmbedder()
    # Vectors and the graph are read once each, so they aren't written; postings are read three times.
    vectors = chunks.select("chunk_id", dense.embed(F.col("text"), embedder).alias("v"), enrich.tags().alias("tags"))
    postings = written(sparse.tokenised(chunks, "chunk_id", enrich.search_text(), enrich.tags().alias("tags")), "postings")
    tables = graph.nodes(chunks), graph.edges(chunks), graph.links(chunks)
    return chunks, asked, written(engine.candidates(asked, chunks, vectors, postings, *tables, embedder, OPTIONS, "hybrid"), "hits")


@query("candidate_lists", f"{_ALL} SELECT qid, chunk_id, src AS source, rank::INT AS rank, round(score, 4) AS score FROM hits")
def candidate_lists(spark, d):
    return _hits(spark, d)[2].select("qid", "chunk_id", "source", "rank", F.round("score", 4).alias("score"))


def _rrf(mode: str):
    reference = mode == "reference"
    dense_w, dense_k = fusion.DENSE.get(mode, fusion.DENSE[None])
    sparse_w, sparse_k = fusion.SPARSE.get(mode, fusion.SPARSE[None])
    graph_w, graph_k = fusion.GRAPH.get("graph_first" if reference else mode, fusion.GRAPH[None])
    sql = f"{_ALL} SELECT qid, chunk_id, round(sum(CASE src WHEN 'dense' THEN {dense_w} / ({dense_k} + rank) WHEN 'sparse' THEN {sparse_w} / ({sparse_k} + rank) ELSE {graph_w} / ({graph_k} + rank) + score * 0.4 END)::DOUBLE, 6) AS fused_score FROM hits GROUP BY ALL"

    @query(f"rrf_fusion_{mode}", sql)
    def run(spark, d):
        hits = _hits(spark, d)[2]
        kind = F.lit("graph_first" if reference else mode)
        part = fusion.contributions(F.col("source"), F.col("rank"), F.col("score"), kind, F.lit(reference), kind, OPTIONS.graph_fusion_weight)
        return hits.groupBy("qid", "chunk_id").agg(F.round(F.sum(part), 6).alias("fused_score"))


for _mode in ("classic", "graph_first", "mixed", "reference"):
    _rrf(_mode)

_BOOST_W = "CASE field WHEN 'components' THEN 0.14 WHEN 'products' THEN 0.1 WHEN 'interfaces' THEN 0.08 ELSE 0.05 END"
_BOOSTS = f"bo AS (SELECT qid, chunk_id, sum(least(n, 3) * w)::DOUBLE AS boost FROM (SELECT qid, chunk_id, field, count(*) AS n, {_BOOST_W} AS w FROM qe JOIN m USING (field, tag) GROUP BY ALL) GROUP BY ALL)"


@query("entity_boost", f"{_ALL}, {_BOOSTS} SELECT DISTINCT h.qid, h.chunk_id, round(coalesce(boost, 0), 6) AS boost FROM hits h LEFT JOIN bo ON bo.qid = h.qid AND bo.chunk_id = h.chunk_id")
def entity_boost(spark, d):
    chunks, asked, hits = _hits(spark, d)
    rows = join_small(chunks.select("chunk_id", "metadata"), hits.select("qid", "chunk_id").distinct(), "chunk_id", OPTIONS.broadcast_rows).join(asked.select("qid", "entities"), "qid")
    return rows.select("qid", "chunk_id", F.round(fusion.overlap_boost(F.col("metadata"), F.col("entities")), 6).alias("boost"))


@query("reference_boost", f"""WITH {c.CHUNKS_SQL} SELECT chunk_id, round((CASE WHEN n % 2 = 0 THEN 0.35 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.08 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 0.35 WHEN contains(text, 'the') THEN 0.2 ELSE 0 END
+ CASE WHEN doc_id % 2 = 0 THEN 0.06 ELSE 0 END)::DOUBLE, 6) AS boost FROM chunks""")
def reference_boost(spark, d):
    rows = c._doc_chunks(spark, d)
    none = F.expr("cast(array() as array<string>)")
    found = F.struct(*[(F.array(F.lit("the")) if f == "api_symbols" else none).alias(f) for f in ent.FIELDS])
    title = F.when(F.col("document_id") % 3 == 0, "Функции подписи").otherwise("Прочее")
    heading = F.when(F.col("document_id") % 5 == 0, F.array(F.lit("THE heading"))).otherwise(F.array(F.lit("x")))
    kind = F.when(F.substring("chunk_id", -1, 1).cast("int") % 2 == 0, "reference").otherwise("prose")
    asked = F.when(F.col("document_id") % 2 == 0, "какие разделы").otherwise("что")
    # Two section names that the check for the text finds, whatever the text holds.
    text = F.concat("text", F.lit(" Синтаксис Пример"))
    return rows.select("chunk_id", F.round(fusion.reference_boost(title, heading, text, kind, found, asked), 6).alias("boost"))


_RANKED = f"""{_ALL}, {_BOOSTS},
fu AS (SELECT qid, chunk_id, sum(CASE src WHEN 'dense' THEN CASE mode WHEN 'graph_first' THEN 0.8 / (65 + rank) ELSE 1.0 / (60 + rank) END WHEN 'sparse' THEN CASE mode WHEN 'graph_first' THEN 0.9 / (55 + rank) WHEN 'mixed' THEN 1.1 / (55 + rank) ELSE 1.0 / (60 + rank) END
  ELSE CASE mode WHEN 'graph_first' THEN 1.6 / (30 + rank) WHEN 'mixed' THEN 1.1 / (40 + rank) ELSE 0 END + score * 0.4 END)::DOUBLE AS f, coalesce(max(rank) FILTER (src = 'dense'), max(rank) FILTER (src = 'sparse') + 1000000, max(rank) FILTER (src = 'graph') + 2000000) AS met FROM hits JOIN rw USING (qid) GROUP BY ALL),
fb AS (SELECT fu.qid, fu.chunk_id, f + coalesce(boost, 0) AS f, met FROM fu JOIN ok ON ok.qid = fu.qid AND ok.chunk_id = fu.chunk_id LEFT JOIN bo ON bo.qid = fu.qid AND bo.chunk_id = fu.chunk_id),
cut AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(f, 6) DESC, met, chunk_id) AS place FROM fb QUALIFY place <= 20),
rr AS (SELECT cut.*, source, text, rew, round(len(list_intersect(list_distinct({c.TOKENS_SQL.format('rew')}), {c.TOKENS_SQL.format('text')})) / len(list_distinct({c.TOKENS_SQL.format('rew')})), 6) AS rerank FROM cut JOIN chunks USING (chunk_id) JOIN rw USING (qid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, place) AS rank FROM rr)"""


def _ranked(spark, d):
    chunks, asked, hits = _hits(spark, d)
    return asked, fusion.fuse(hits, asked, chunks, OPTIONS)


@query("hybrid_search", f"{_RANKED} SELECT qid, chunk_id, round(f, 4) AS fused_score, round(rerank, 4) AS rerank_score, rank::INT AS rank FROM ranked")
def hybrid_search(spark, d):
    return _ranked(spark, d)[1].select("qid", "chunk_id", F.round("fused_score", 4).alias("fused_score"), F.round("rerank_score", 4).alias("rerank_score"), "rank")


@query("citations_answer", f"""{_RANKED}, fin AS (SELECT qid, string_agg(rank || '. ' || source || ' / ' || chr(10) || trim(substr(text, 1, 1200), E' \\n\\t') || chr(10) || 'Источник: ' || source || chr(10), chr(10) ORDER BY rank) AS l, string_agg(chunk_id, ',' ORDER BY rank) AS cited FROM ranked WHERE rank <= 5 GROUP BY qid)
SELECT rw.qid, coalesce(cited, '') AS cited, md5(CASE WHEN l IS NULL THEN '{answer.REFUSAL}' ELSE trim('Переписанный запрос: ' || rew || chr(10) || 'Режим поиска: ' || mode || chr(10) || chr(10) || '{answer.NOT_GENERATED}' || chr(10) || chr(10) || l, E' \\n\\t') END) AS answer_md5 FROM rw LEFT JOIN fin USING (qid)""")
def citations_answer(spark, d):
    asked, ranked = _ranked(spark, d)
    ranked = written(ranked, "ranked")
    out = asked.select("qid").join(answer.citations(ranked), "qid", "left").join(answer.fallback(asked, ranked), "qid")
    return out.select("qid", F.coalesce(F.array_join(F.transform("citations", lambda x: x["chunk_id"]), ","), F.lit("")).alias("cited"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


_RESPONSE = f"""{_RANKED}, res AS (SELECT qid, string_agg(chunk_id || ':' || round(f, 4)::DECIMAL(9, 4) || ':' || rerank::DECIMAL(9, 6), ',' ORDER BY rank) FILTER (rank <= 5) AS retrieved, count(*) AS n_ranked FROM ranked GROUP BY qid)
SELECT rw.qid, mode AS query_mode, md5(rew) AS rewritten_md5, coalesce(retrieved, '') AS retrieved, coalesce(n_ranked, 0)::INT AS n_ranked, (SELECT count(DISTINCT field) FROM qe WHERE qe.qid = rw.qid)::INT AS n_filters FROM rw LEFT JOIN res USING (qid)"""


@query("query_response", _RESPONSE)
def query_response(spark, d):
    asked, ranked = _ranked(spark, d)
    ranked, facts = written(ranked, "ranked"), spark.createDataFrame([], "qid long, facts array<string>")
    out = answer.response(asked, answer.fallback(asked, ranked), ranked, facts)
    score = lambda x, p: F.format_string(f"%.{p}f", x)
    listed = F.transform("retrieved_chunks", lambda x: F.concat_ws(":", x["chunk_id"], score(F.round(x["fused_score"], 4), 4), score(x["rerank_score"], 6)))
    n_filters = sum((F.size(f"filters.{f}") > 0).cast("int") for f in ent.FIELDS)
    return out.select("qid", "query_mode", F.md5(F.col("rewritten_query").cast("binary")).alias("rewritten_md5"), F.array_join(listed, ",").alias("retrieved"), F.size("ranked_sources").alias("n_ranked"), n_filters.alias("n_filters"))


# ---- question sets from a corpus

@query("routing_cases", "SELECT 'routing-' || page_id AS case_key, 'Где описано «' || page_id % 7 || '»?' AS question, 'Это описано на странице «' || page_id % 7 || '».' AS reference_answer, CASE WHEN page_id % 3 = 0 THEN url ELSE url || '?pageId=' || page_id END AS source, 'routing,page_' || CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE page_id::VARCHAR END AS tags FROM pages")
def routing_cases(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit("?pageId="), F.col("page_id").cast("string")))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("document_id"), (F.col("page_id") % 7).cast("string").alias("title"), url.alias("source_url"))
    return store.routing_cases(pages).select("case_key", "question", "reference_answer", F.element_at("required_sources", 1).alias("source"), F.array_join("tags", ",").alias("tags"))


@query("reworded_cases", """WITH q AS (SELECT 'case-' || (n_nationkey % 7) AS case_key, n_name, row_number() OVER (PARTITION BY n_nationkey % 7 ORDER BY n_nationkey DESC) AS n FROM nation)
SELECT item_id, 'case-' || (item_id % 9) AS case_key, 'nation-' || n_name || ',hard,b' || item_id % 2 || ',page_unknown' AS tags, 'n' || item_id AS notes FROM benchmark JOIN q ON q.case_key = 'case-' || (item_id % 9) WHERE n = 1""")
def reworded_cases(spark, d):
    key = F.concat(F.lit("case-"), (F.col("item_id") % 9).cast("string"))
    cases = table(spark, d, "benchmark").select("item_id", key.alias("case_key"), F.col("text").alias("question"), F.concat(F.lit("b"), (F.col("item_id") % 2).cast("string")).alias("bucket"), F.concat(F.lit("n"), F.col("item_id").cast("string")).alias("notes"))
    questions = _set_questions(spark, d).withColumn("tags", F.array(F.concat(F.lit("nation-"), "question"))).withColumn("required_sources", F.expr("cast(array() as array<string>)"))
    return store.reworded(questions, cases, "hard").select("item_id", "case_key", F.array_join("tags", ",").alias("tags"), "notes")


@query("checked_questions", """SELECT n_nationkey AS position, CASE n_nationkey % 3 WHEN 0 THEN 'key ' || n_nationkey WHEN 1 THEN 'id' || n_nationkey ELSE 'case-' || n_nationkey END AS case_key, n_name AS question, 0 AS n_tags, false AS expected_refusal FROM nation""")
def checked_questions(spark, d):
    k = F.col("n_nationkey")
    none = F.lit(None)
    rows = table(spark, d, "nation").select(F.when(k % 3 == 1, F.concat(F.lit("id"), k.cast("string"))).alias("id"), F.when(k % 3 == 0, F.concat(F.lit(" key "), k.cast("string"), F.lit(" "))).when(k % 3 == 2, "").alias("case_key"), k.cast("int").alias("position"), F.concat(F.lit("  "), "n_name").alias("question"), none.cast("boolean").alias("expected_refusal"), none.cast("array<array<string>>").alias("required_any"), *[none.cast("array<string>").alias(x) for x in store.LISTS])
    return store.checked(rows).select("position", "case_key", "question", F.size("tags").alias("n_tags"), "expected_refusal")


# ---- evaluation: user turns are questions of cases, the assistant's answers what is judged

_CASES_SQL = """cs AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer, u.conv_id % 3 = 0 AS expected_refusal, u.conv_id % 5 AS k, u.turn % 4 AS j, string_split(u.text, ' ') AS w
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
_N = lambda x: c._FOLD.format(x)
_CHECKS_SQL = f"""{_CASES_SQL}, n AS (SELECT *, {_N('answer')} AS a, {_N('w[1]')} AS t1, {_N('w[2]')} AS t2 FROM cs),
ch AS (SELECT conv_id, turn, k, j, expected_refusal, question,
 k = 1 AS exact_a, CASE WHEN k = 1 THEN a = {_N("answer || '!'")} ELSE true END AS exact_p,
 k <> 2 AS terms_a, k = 2 OR contains(a, t1) AS terms_p,
 k = 3 AS any_a, k <> 3 OR contains(a, t1) OR contains(a, coalesce(t2, t1)) AS any_p,
 k = 4 AS forb_a, k <> 4 OR NOT contains(a, t1) AS forb_p,
 j < 2 AS cite_a, j <> 1 AS cite_p,
 (contains(a, 'нет данных') OR contains(a, 'не найден')) = expected_refusal AS ref_p FROM n),
sc AS (SELECT *, round((exact_a AND exact_p)::INT + (terms_a AND terms_p)::INT + (any_a AND any_p)::INT + (forb_a AND forb_p)::INT + (cite_a AND cite_p)::INT + ref_p::INT, 4) / (exact_a::INT + terms_a::INT + any_a::INT + forb_a::INT + cite_a::INT + 1) AS s,
 (NOT exact_a OR exact_p) AND (NOT terms_a OR terms_p) AND (NOT any_a OR any_p) AND (NOT forb_a OR forb_p) AND (NOT cite_a OR cite_p) AND ref_p AS passed FROM ch)"""


def _results(spark, d):
    t = table(spark, d, "conversations")
    u = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    w, k, j = F.split("question", " "), F.col("conv_id") % 5, F.col("turn") % 4
    first, second = F.element_at(w, 1), F.coalesce(F.get(w, F.lit(1)), F.element_at(w, 1))
    rows = u.join(a, ["conv_id", "turn"]).withColumns({
        "exact_answer": F.when(k == 1, F.concat("answer", F.lit("!"))), "required_terms": F.when(k != 2, F.array(first)), "required_any": F.when(k == 3, F.array(F.array(first, second))), "forbidden_terms": F.when(k == 4, F.array(first)),
        "required_sources": F.when(j == 0, F.array(F.lit("http://a/"))).when(j == 1, F.array(F.lit("http://a"), F.lit("http://z"))), "cited": F.array(F.lit("HTTP://A"), F.lit("http://b/")), "expected_refusal": F.col("conv_id") % 3 == 0,
        "tags": F.when(k == 0, F.expr("cast(array() as array<string>)")).when(k == 1, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.concat(F.lit("k"), k.cast("string")))), "latency_ms": F.length("answer").cast("double"),
        "ranked": F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("http://s"), ((F.col("conv_id") * 7 + i * 5) % 13).cast("string"), F.lit("/"))), "wanted": F.when(j < 3, F.transform(F.sequence(F.lit(0), j.cast("int")), lambda i: F.concat(F.lit("HTTP://S"), ((F.col("turn") + i) % 13).cast("string")))),
    })
    return evaluate.check_cases(rows).withColumn("metrics", evaluate.ranking_metrics(F.col("wanted"), F.col("ranked")))


@query("case_checks", f"WITH {_CHECKS_SQL} SELECT conv_id, turn, exact_p AS exact_match, terms_p AS required_terms, any_p AS required_any, forb_p AS forbidden_terms, cite_p AS citations, ref_p AS refusal, round(s, 4) AS score, passed FROM sc")
def case_checks(spark, d):
    return _results(spark, d).select("conv_id", "turn", *[F.col(f"checks.{n}.passed").alias(n) for n in evaluate.CHECKS], "score", "passed")


@query("check_metrics", f"""WITH {_CHECKS_SQL}, l AS (SELECT unnest([{{'c': 'exact_match', 'a': exact_a, 'p': exact_p}}, {{'c': 'required_terms', 'a': terms_a, 'p': terms_p}}, {{'c': 'required_any', 'a': any_a, 'p': any_p}}, {{'c': 'forbidden_terms', 'a': forb_a, 'p': forb_p}}, {{'c': 'citations', 'a': cite_a, 'p': cite_p}}, {{'c': 'refusal', 'a': true, 'p': ref_p}}]) AS x FROM sc)
SELECT x.c AS "check", count(*) FILTER (x.a) AS applicable, count(*) FILTER (x.a AND x.p) AS passed, round(count(*) FILTER (x.a AND x.p) / nullif(count(*) FILTER (x.a), 0), 4) AS rate FROM l GROUP BY 1""")
def check_metrics(spark, d):
    return evaluate.check_metrics(_results(spark, d))


_METRICS_SQL = """mt AS (SELECT conv_id, turn, CASE WHEN j < 3 THEN list_transform(range(0, j + 1), lambda i: 'http://s' || ((turn + i) % 13)) END AS wanted,
 list_transform(range(0, 10), lambda i: 'http://s' || ((conv_id * 7 + i * 5) % 13)) AS found FROM cs),
mp AS (SELECT *, list_filter(list_transform(range(1, 11), lambda i: CASE WHEN list_contains(wanted, found[i]) THEN i END), lambda p: p IS NOT NULL) AS places FROM mt),
mr AS (SELECT conv_id, turn, wanted IS NOT NULL AS applicable, round(len(list_filter(places, lambda p: p <= 5)) / len(wanted), 4) AS recall, CASE WHEN wanted IS NOT NULL THEN round(coalesce(1 / list_min(places), 0), 4) END AS mrr,
 CASE WHEN wanted IS NOT NULL THEN round(coalesce(list_sum(list_transform(places, lambda p: 1 / log2(p + 1))), 0) / list_sum(list_transform(range(1, len(wanted) + 1), lambda p: 1 / log2(p + 1))), 4) END AS ndcg FROM mp)"""


@query("ir_metrics", f"WITH {_CASES_SQL}, {_METRICS_SQL} SELECT * FROM mr")
def ir_metrics(spark, d):
    return _results(spark, d).select("conv_id", "turn", "metrics.*")


@query("run_summary", f"""WITH {_CHECKS_SQL}, {_METRICS_SQL} SELECT count(*) AS total_cases, count(*) FILTER (passed) AS passed_cases, round(avg(passed::INT), 4) AS pass_rate, round(avg(round(s, 4)), 4) AS average_score,
round(avg(length(answer)), 2) AS average_latency_ms, round(quantile_cont(length(answer)::DOUBLE, 0.95), 2) AS p95_latency_ms, count(*) FILTER (applicable) AS ranked_cases, round(avg(recall), 4) AS recall_at_5, round(avg(mrr), 4) AS mrr_at_10, round(avg(ndcg), 4) AS ndcg_at_10
FROM sc JOIN mr USING (conv_id, turn) JOIN cs USING (conv_id, turn)""")
def run_summary(spark, d):
    return evaluate.summary(_results(spark, d))


@query("per_tag_summary", f"WITH {_CHECKS_SQL}, tg AS (SELECT unnest(CASE k WHEN 0 THEN ['untagged'] WHEN 1 THEN ['x', 'x'] ELSE ['x', 'k' || k] END) AS tag, passed, round(s, 4) AS s FROM sc) SELECT tag, count(*) AS total, count(*) FILTER (passed) AS passed, round(avg(passed::INT), 4) AS pass_rate, round(avg(s), 4) AS average_score FROM tg GROUP BY tag")
def per_tag_summary(spark, d):
    return evaluate.per_tag(_results(spark, d))


# ---- the store: regions are question sets, nations questions, orders runs, lineitems their cases

def _sets(spark, d):
    return table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.make_timestamp(F.lit(2024), F.lit(1), F.col("r_regionkey") + 1, F.lit(0), F.lit(0), F.lit(0)).alias("created_at"), F.make_timestamp(F.lit(2024), F.lit(2), 9 - F.col("r_regionkey"), F.lit(0), F.lit(0), F.lit(0)).alias("updated_at"))


def _set_questions(spark, d):
    return table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("set_id"), F.col("n_nationkey").alias("position"), F.concat(F.lit("case-"), (F.col("n_nationkey") % 7).cast("string")).alias("case_key"), F.col("n_name").alias("question"), F.lit("").alias("notes"), F.expr("cast(array() as array<string>)").alias("tags"))


def _runs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 5).cast("string").alias("set_id"), F.when(F.col("o_orderstatus") == "F", "bm25").alias("retrieval_mode"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("average_score"), F.lit("{}").alias("summary"))


_RUNS_SQL = "rn AS (SELECT o_orderkey::VARCHAR AS id, (o_custkey % 5)::VARCHAR AS set_id, CASE WHEN o_orderstatus = 'F' THEN 'bm25' ELSE 'hybrid' END AS retrieval_mode, o_orderdate AS created_at, o_totalprice AS average_score FROM orders)"


@query("list_question_sets", f"WITH {_RUNS_SQL}, q AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1), r AS (SELECT set_id, max(created_at) AS last FROM rn GROUP BY 1) SELECT r_regionkey::VARCHAR AS id, r_name AS name, coalesce(n, 0) AS question_count, strftime(last, '%Y-%m-%d') AS last_run FROM region LEFT JOIN q ON n_regionkey = r_regionkey LEFT JOIN r ON set_id = r_regionkey::VARCHAR")
def list_question_sets(spark, d):
    return store.list_sets(_sets(spark, d), _set_questions(spark, d), _runs(spark, d)).select("id", "name", "question_count", F.date_format("last_run_at", "yyyy-MM-dd").alias("last_run"))


@query("question_set_detail", "SELECT r_regionkey::VARCHAR AS id, r_name AS name, coalesce((SELECT string_agg(n_name, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey), '') AS questions FROM region")
def question_set_detail(spark, d):
    rows = store.set_detail(_sets(spark, d), _set_questions(spark, d))
    return rows.select("id", "name", F.coalesce(F.array_join(F.transform("questions", lambda q: q["question"]), ","), F.lit("")).alias("questions"))


@query("list_runs", f"WITH {_RUNS_SQL} SELECT id, set_id, retrieval_mode FROM rn WHERE set_id = '2' ORDER BY created_at DESC, id LIMIT 100")
def list_runs(spark, d):
    return store.list_runs(_runs(spark, d), "2").select("id", "set_id", "retrieval_mode")


@query("latest_run", f"WITH {_RUNS_SQL} SELECT id, set_id, retrieval_mode FROM rn ORDER BY created_at DESC, id LIMIT 1")
def latest_run(spark, d):
    return store.list_runs(_runs(spark, d), limit=1).select("id", "set_id", "retrieval_mode")


@query("run_detail", "SELECT l_orderkey::VARCHAR AS id, count(*)::INT AS n_cases, string_agg(l_partkey || ':' || (l_returnflag = 'N'), ',' ORDER BY l_linenumber, l_partkey, l_returnflag = 'N', l_tax) AS cases FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def run_detail(spark, d):
    cases = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").alias("case_order"), F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("case_key"), (F.col("l_returnflag") == "N").alias("passed"), F.col("l_tax").alias("score"), F.lit("").alias("evaluation"))
    rows = store.run_detail(_runs(spark, d), cases).where("cases is not null")
    return rows.select("id", F.size("cases").alias("n_cases"), F.array_join(F.transform("cases", lambda x: F.concat(F.regexp_replace(x["case_key"], "^0+(?!$)", ""), F.lit(":"), x["passed"].cast("string"))), ",").alias("cases"))


@query("seed_if_absent", "SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def seed_if_absent(spark, d):
    seeds = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return store.absent(seeds, _sets(spark, d))


@query("research_cases", "WITH q AS (SELECT 'case-' || (n_nationkey % 7) AS case_key, n_regionkey::VARCHAR AS set_id, row_number() OVER (PARTITION BY n_nationkey % 7 ORDER BY n_nationkey DESC) AS n FROM nation) SELECT item_id, q.case_key, set_id FROM benchmark JOIN q ON q.case_key = 'case-' || (item_id % 9) WHERE n = 1")
def research_cases(spark, d):
    cases = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("case-"), (F.col("item_id") % 9).cast("string")).alias("case_key"), F.col("text").alias("question"))
    return store.research_cases(cases, _set_questions(spark, d)).select("item_id", "case_key", "set_id")
