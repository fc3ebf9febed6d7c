"""The engine: ingest pages into indexes, answer batches of questions, evaluate question sets."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entities import FIELDS, Dictionary
from ..functions.scalar import uuid5
from ..functions.text import clean_inline
from ..operators import analysis, answer, dense, enrich, evaluate, fusion, graph, parsing, sparse
from ..operators.joins import join_small
from ..options import Options
from ..sources import files
from ..sources.scratch import discard_scratch, written
from ..sources.store import Store, routing_cases
from ..sources.tables import Tables

#: The set of routing questions that start() makes of an index, and how many it has at most (a set is read as one batch).
ROUTING_SET, ROUTING_CASES = "routing", 1000
MODES = ("dense", "bm25", "bm25_baseline", "graph", "hybrid")


class MissingIndex(RuntimeError):
    """A query came before ingestion."""


class NotFound(LookupError):
    """No such question set or run."""


def _tagged(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    return rows if "tags" in rows.columns else rows.join(chunks.select(F.col("chunk_id").alias("id"), enrich.tags().alias("tags")), "id", "left")


def candidates(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None, postings: DataFrame | None, nodes: DataFrame, edges: DataFrame, links: DataFrame, embedder, options: Options, retrieval: str) -> DataFrame:
    """(qid, chunk_id, source, rank, score) of the lists that the retrieval mode asks for. Dense and sparse lists are
    filtered before their cut, the graph's isn't. vectors: (chunk_id, v[, tags]); postings: tokenised() by chunk_id[, tags].
    Where they lack the chunks' tags these are joined."""
    parts, queries = [], queries.withColumn("must", enrich.must())
    if retrieval in ("dense", "hybrid"):
        asked = queries.select("qid", dense.embed(F.col("rewritten_query"), embedder).alias("v"), "must")
        hits = dense.search(_tagged(vectors.withColumnRenamed("chunk_id", "id"), chunks), asked, options.dense_candidate_count)
        parts.append(hits.select("qid", F.col("id").alias("chunk_id"), F.lit("dense").alias("source"), "rank", "score"))
    if retrieval in ("bm25", "hybrid"):
        hits = sparse.bm25(_tagged(postings, chunks), queries, options.sparse_candidate_count, "rewritten_query", limit=options.broadcast_rows)
        parts.append(hits.select("qid", F.col("id").alias("chunk_id"), F.lit("sparse").alias("source"), "rank", "score"))
    if retrieval in ("graph", "hybrid") and options.graph_enabled:
        asked = queries.withColumn("query_mode", fusion.graph_mode(F.col("query_mode"), F.lit(retrieval)))
        parts.append(graph.search(asked, nodes, edges, links, options).select("qid", "chunk_id", F.lit("graph").alias("source"), "rank", "score"))
    return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], "qid long, chunk_id string, source string, rank int, score double")


class Engine:
    """Indexes live in tables under `home`. Providers are pluggable; the defaults need no network."""

    def __init__(self, spark: SparkSession, home: str, options: Options | None = None, dictionary: Dictionary | None = None, embedder=None, reranker=None, generator=None, router=None):
        self.spark, self.home = spark, home.rstrip("/")
        self.options, self.dictionary = options or Options(), dictionary or Dictionary()
        self.embedder, self.reranker = embedder or dense.HashEmbedder(), reranker or fusion.overlap_rerank
        self.generator, self.router = generator, router
        self.tables, self.store = Tables(spark, f"{self.home}/index"), Store(spark, f"{self.home}/store")

    def _table(self, name: str) -> DataFrame:
        held = self.tables.read(name)
        if held is None:
            raise MissingIndex(f"no table {name}; ingest first")
        return held

    def ingest(self, folder: str) -> dict:
        """Pages to documents, chunks, vectors, postings and graph, all in one version: searches see the old index or the
        new one. All tables are replaced, vectors by key."""
        docs = parsing.parse_pages(files.read_pages(self.spark, folder))
        docs = docs.join(parsing.clean_lines(docs), "document_id")
        with self.tables.change() as change:
            docs = change.replace("documents", docs)
            chunks = change.replace("chunks", enrich.enrich(parsing.chunk(docs, self.options), self.dictionary))
            change.upsert("vectors", self._vectors(chunks), "id")
            change.replace("postings", sparse.tokenised(chunks, "chunk_id", enrich.search_text(), enrich.tags().alias("tags")))
            self._put_graph(change, chunks)
            kept = change.replace("manifest", files.manifest(docs, chunks, self.embedder.dims))
        kept.write.mode("overwrite").json(f"{self.home}/manifest")
        return self.manifest()

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        v = dense.embed(F.col("text"), self.embedder, self.options.embed_batch)
        return enrich.payload(chunks).select(uuid5("url", F.col("chunk_id")).alias("id"), "*", v.alias("v"))

    def _put_graph(self, change, chunks: DataFrame) -> None:
        if self.options.graph_enabled:
            for name, make in (("graph_nodes", graph.nodes), ("graph_edges", graph.edges), ("graph_links", graph.links)):
                change.replace(name, make(chunks))

    def ensure_vectors(self) -> bool:
        """Makes an empty table of vectors where there is none. ValueError if there are vectors of another length."""
        held = self.tables.read("vectors")
        if held is None:
            chunks = self.spark.createDataFrame([], files.CHUNKS)
            with self.tables.change() as change:
                change.replace("vectors", self._vectors(chunks), "id")
            return True
        dims = held.select(F.size("v").alias("n")).first()
        if dims and dims.n != self.embedder.dims:
            raise ValueError(f"the stored vectors have {dims.n} dimensions, the embedder's {self.embedder.dims}")
        return False

    def ensure_graph(self) -> bool:
        """Builds the graph from the stored chunks where it is missing; nothing if it is there, off, or no chunk is."""
        if not self.options.graph_enabled or self.tables.has("graph_nodes", "graph_edges", "graph_links") or not self.tables.has("chunks"):
            return False
        chunks = self._table("chunks")
        if chunks.isEmpty():
            return False
        with self.tables.change() as change:
            self._put_graph(change, chunks)
        return True

    def start(self, question_sets=(), folder: str | None = None) -> dict:
        """What a service does when it comes up: ingests if the options ask for it, ensures vectors and graph, and seeds the
        question sets that aren't there: the given ones and, of an index, one routing question for every document."""
        done = {"ingested": bool(folder) and self.bootstrap(folder), "vectors": self.ensure_vectors(), "graph": self.ensure_graph()}
        sets = list(question_sets)
        if self.tables.has("documents"):
            fields = ("case_key", "question", "reference_answer", "required_sources", "tags")
            cases = self.store.read("question_sets").where(F.col("id") == ROUTING_SET).isEmpty() and routing_cases(self._table("documents")).limit(ROUTING_CASES).collect()
            sets += [{"id": ROUTING_SET, "name": "Routing", "questions": [{f: r[f] for f in fields} for r in cases]}] if cases else []
        return done | {"seeded": self.store.seed(sets)}

    def refresh(self) -> int:
        """Deletes what searches have written in the shared folder, for when their results are saved; gives the number of
        tables. The next search reads the latest version of every table anyway."""
        return discard_scratch(self.spark)

    def manifest(self) -> dict:
        return self._table("manifest").first().asDict()

    def ready(self) -> bool:
        return self.tables.has("manifest", "chunks")

    def bootstrap(self, folder: str) -> bool:
        """Ingests if the options ask for it and there is no index."""
        if self.options.auto_ingest_on_start and not self.ready():
            self.ingest(folder)
            return True
        return False

    def health(self) -> dict:
        configured = lambda p: p is not None and getattr(p, "is_configured", True)
        return {"status": "ok", "index_ready": self.ready(), "embedder": self.embedder.name} | {n: configured(getattr(self, n)) for n in ("generator", "router", "reranker")}

    def analyze(self, queries: DataFrame) -> DataFrame:
        """queries: (qid, question); a question has three characters or more."""
        bad = F.raise_error("a question needs at least three characters")
        queries = queries.withColumn("question", F.when(F.length("question") >= 3, F.col("question")).otherwise(bad.cast("string")))
        routed = self.router(queries) if self.router else None
        return analysis.analyze(queries, self.dictionary, routed=routed)

    def search(self, queries: DataFrame, retrieval: str = "hybrid") -> tuple[DataFrame, DataFrame, DataFrame]:
        """(analysed queries, ranked chunks, facts)."""
        if retrieval not in MODES[:2] + MODES[3:]:
            retrieval = "hybrid"
        # Written, as plans below use the analysed questions several times and their expressions are large.
        asked, chunks = written(self.analyze(queries), "questions"), self._table("chunks")
        use_graph = self.options.graph_enabled and retrieval in ("graph", "hybrid")
        nodes, edges, links = (self._table(f"graph_{t}") if use_graph else None for t in ("nodes", "edges", "links"))
        vectors = self._table("vectors").select("chunk_id", "v") if retrieval in ("dense", "hybrid") else None
        postings = self._table("postings") if retrieval in ("bm25", "hybrid") else None
        # Vectors of chunks that are gone stay in their table; a hit without a chunk goes.
        hits = written(candidates(asked, chunks, vectors, postings, nodes, edges, links, self.embedder, self.options, retrieval), "hits")
        ranked = fusion.fuse(hits, asked, chunks, self.options, retrieval, self.reranker)
        by_graph = asked.withColumn("query_mode", fusion.graph_mode(F.col("query_mode"), F.lit(retrieval)))
        facts = graph.facts(by_graph, nodes, edges, self.options) if use_graph else self.spark.createDataFrame([], "qid long, facts array<string>")
        return asked, ranked, facts

    def query(self, queries: DataFrame, retrieval: str = "hybrid") -> DataFrame:
        """A row for each of (qid, question): original and rewritten query, filters, query and retrieval mode, routing,
        answer, graph facts, citations, retrieved chunks with their scores in order of rank, and the sources of these."""
        if retrieval == "bm25_baseline":
            return self._baseline(queries)
        asked, ranked, facts = self.search(queries, retrieval)
        # Answers, citations and the response read them; the search runs once.
        ranked, facts = written(ranked, "ranked"), written(facts, "facts")
        answers = self.generator(answer.prompt(asked, ranked, facts)) if self.generator else None
        plain = answer.fallback(asked, ranked, facts)
        if answers is not None:
            made = answers.select("qid", F.col("answer").alias("made"))
            plain = plain.join(made, "qid", "left").select("qid", F.coalesce("made", "answer").alias("answer"))
        return answer.response(asked, plain, ranked, facts).withColumn("retrieval_mode", fusion.known_retrieval(F.lit(retrieval)))

    def _baseline(self, queries: DataFrame) -> DataFrame:
        docs = self._table("documents").select(F.col("document_id").alias("id"), "title", F.col("clean_markdown").alias("text"), "source_url")
        postings = written(sparse.tokenised(docs, "id", F.concat_ws("\n\n", clean_inline(F.col("title")), "text")), "postings")
        hits = written(sparse.bm25(postings, queries, self.options.final_context_count, limit=self.options.broadcast_rows), "best")
        zero, none = F.lit(0.0), F.expr("cast(array() as array<string>)")
        ranked = join_small(docs, hits, "id", self.options.broadcast_rows).select("qid", F.col("id").alias("chunk_id"), "title", none.alias("heading_path"), "text", "source_url", F.lit("document").alias("chunk_type"), zero.alias("dense_score"), F.col("score").alias("sparse_score"), zero.alias("graph_score"), F.col("score").alias("fused_score"), zero.alias("rerank_score"), "rank", F.lit(True).alias("final"))
        asked = queries.select("qid", "question", F.col("question").alias("rewritten_query"), F.struct(*[none.alias(f) for f in FIELDS]).alias("filters"), F.lit("classic").alias("query_mode"), F.lit(None).cast("double").alias("routing_confidence"), F.lit(None).cast("string").alias("routing_reason"))
        facts = self.spark.createDataFrame([], "qid long, facts array<string>")
        return answer.response(asked, answer.baseline(queries, hits, docs, self.options.broadcast_rows), ranked, facts).withColumn("retrieval_mode", F.lit("bm25_baseline"))

    def evaluate(self, set_id: str, retrieval: str = "hybrid") -> str:
        """Runs a question set as one batch and saves the run; gives its id. Latency is the batch's time a case."""
        sets = self.store.read("question_sets").where(F.col("id") == set_id).collect()
        if not sets:
            raise NotFound(f"no question set {set_id}")
        cases = self.store.read("questions").where(F.col("set_id") == set_id).withColumn("qid", F.col("position").cast("long"))
        n = cases.count()
        if not n:
            raise ValueError("the question set has no questions")
        began = time.perf_counter()
        with self.tables.change() as change:
            found = change.replace("last_run", self.query(cases.select("qid", "question"), retrieval))
        self.refresh()
        each = (time.perf_counter() - began) * 1000 / n
        rows = cases.join(found.drop("question"), "qid").withColumn("cited", F.transform("citations", lambda c: c["source_url"])).withColumn("latency_ms", F.round(F.lit(each), 2))
        rows = evaluate.check_cases(rows).withColumn("metrics", evaluate.ranking_metrics(F.col("required_sources"), F.coalesce("ranked_sources", F.expr("cast(array() as array<string>)")), self.options.recall_k, self.options.ranking_k))
        rows = rows.withColumnRenamed("id", "question_id").withColumn("case_order", F.col("position"))
        return self.store.save_run(set_id, sets[0].name, retrieval, evaluate.summary(rows), rows)
