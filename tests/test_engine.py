import json
import os
import subprocess
import sys

import pytest
from sedimenta.functions.entities import Dictionary
from sedimenta.options import Options
from pyspark.errors import PySparkException
from sedimenta.operators import dense
from sedimenta.plans import providers
from sedimenta.plans.engine import Engine, MissingIndex, NotFound
from sedimenta.sources.store import Store, page_url, question
from sedimenta.sources.tables import Tables
from sedimenta.streaming import ingest as stream

PAGES = {
    "pageId_1": "[Архитектура стенда](https://w.example/v.action?pageId=1)\nCreated by [A](http://a), last modified on [Jan 1]\n# Общее\nСервер linux связан с windows через pcsc.\n# Порты\nnginx слушает порт 443 на linux.",
    "pageId_2": "[Функции подписи](https://w.example/v.action?pageId=2)\n## C_Sign()\n### Синтаксис\nвызов C_Sign создает подпись\n## C_Verify()\nпроверяет подпись",
    "pageId_3": "[Таблица](https://w.example/v.action?pageId=3)\nкоротко\n| имя | порт |\n|---|---|\n| ldap | 389 |\n| apache | 80 |",
}
QUESTIONS = [{"case_key": "port", "question": "какой порт у ldap", "required_terms": ["389"], "required_sources": ["https://w.example/v.action?pageId=3"], "tags": ["factoid"]}, {"case_key": "sign", "question": "вызов C_Sign", "required_sources": ["https://w.example/v.action?pageId=2/"]}, {"question": "архитектура linux windows"}]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    for name, text in PAGES.items():
        (folder / f"{name}.md").write_text(text)
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('home')}", Options(), Dictionary())
    with pytest.raises(MissingIndex):
        e.search(spark.createDataFrame([(1, "что там")], "qid long, question string"))
    e.pages = f"file://{folder}"
    assert e.ingest(e.pages)["documents"] == 3
    return e


@pytest.mark.parametrize("mode,page", [("bm25", "3"), ("hybrid", "3"), ("dense", "3"), ("bm25_baseline", "3")])
def test_query(engine, spark, mode, page):
    asked = spark.createDataFrame([(1, "порт ldap 389"), (2, "нечто иное zzz")], "qid long, question string")
    got = {r.qid: r for r in engine.query(asked, mode).collect()}
    assert got[1].ranked_sources[0].endswith(f"pageId={page}") and "389" in got[1].answer and got[1].citations[0].source_url == got[1].ranked_sources[0]
    if mode == "bm25_baseline":
        assert "не найден" in got[2].answer


def test_graph(engine, spark):
    asked = spark.createDataFrame([(1, "linux и windows и pcsc")], "qid long, question string")
    row = engine.query(asked, "graph").first()
    assert row.ranked_sources[0].endswith("pageId=1") and "->" in row.answer


def test_providers(engine, spark):
    def complete(system, user):
        if "JSON" in system:
            return '{"query_mode": "graph_first", "confidence": 0.9, "reason": "relation", "filters": {"os_tags": ["linux", ""], "products": "x"}}' if "linux" in user else "no json"
        if "ldap" in user:
            raise RuntimeError("down")
        return "made up"

    e = Engine(spark, engine.home, generator=providers.generator(complete), router=providers.router(complete))
    asked = spark.createDataFrame([(1, "архитектура linux и windows"), (2, "порт ldap 389")], "qid long, question string")
    seen = {r.qid: r for r in e.analyze(asked).collect()}
    assert seen[1].query_mode == "graph_first" and seen[1].routing_reason == "relation" and seen[2].routing_reason == "heuristic_fallback"
    got = {r.qid: r.answer for r in e.query(asked, "bm25").collect()}
    assert got[1] == "made up" and got[2].startswith("Переписанный запрос")
    with pytest.raises(PySparkException, match="three characters"):
        e.analyze(spark.createDataFrame([(1, "ab")], "qid long, question string")).collect()


def test_ingest_again_changes_nothing(engine):
    before = engine._table("vectors").count()
    assert {"chunk_id", "text", "doc_family", "api_symbols", "v"} <= set(engine._table("vectors").columns)
    assert engine.ingest(engine.pages)["chunks"] == before == engine._table("vectors").count()
    assert engine.health()["index_ready"] and not engine.bootstrap(engine.pages)


def test_evaluate(engine):
    with pytest.raises(NotFound):
        engine.evaluate("none")
    set_id = engine.store.create_set({"name": " My set ", "questions": QUESTIONS})
    for mode in ("hybrid", "bm25_baseline"):
        run = engine.evaluate(set_id, mode)
        row = engine.store.read("runs").where(f"id = '{run}'").first()
        assert row.total_cases == 3 and row.retrieval_mode == mode and json.loads(row.summary)["recall_at_5"] > 0
        assert [c.case_key for c in engine.store.read("run_cases").where(f"run_id = '{run}'").orderBy("case_order").collect()] == ["port", "sign", "case-3"]


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.seed([{"id": "a", "name": "A", "questions": QUESTIONS}, {"id": " ", "name": "no"}]) == ["a"] and s.seed([{"id": "a", "name": "B"}]) == []
    assert s.update_set("a", {"name": "C", "questions": QUESTIONS[:1]}) and not s.update_set("b", {"name": "x"})
    assert s.read("questions").count() == 1 and s.read("question_sets").first().name == "C"
    for bad in ([{"question": " "}], [{"question": "q", "case_key": "k"}] * 2):
        with pytest.raises(ValueError):
            s.create_set({"name": "x", "questions": bad})
    with pytest.raises(ValueError):
        s.create_set({"name": " "})
    t = Store(spark, f"file://{tmp_path}/t")
    (tmp_path / "seed.jsonl").write_text('{"id": "k1", "question": "q1"}\n\n{"case_key": "k2", "question": "q2", "required_any": [["a"]]}\n')
    assert t.seed_from_jsonl(f"file://{tmp_path}/seed.jsonl") and not t.seed_from_jsonl(f"file://{tmp_path}/seed.jsonl")
    assert [r.case_key for r in t.read("questions").orderBy("position").collect()] == ["k1", "k2"]


def test_stream(engine, spark, tmp_path):
    (tmp_path / "in").mkdir()
    home = f"file://{tmp_path}/home"
    read = lambda name, *columns: sorted(map(tuple, Tables(spark, f"{home}/index").read(name).select(*columns).collect()))
    for name, text in list(PAGES.items())[:2]:
        (tmp_path / "in" / f"{name}.md").write_text(text)
    run = lambda: stream.ingest(spark, f"file://{tmp_path}/in", home, f"file://{tmp_path}/check").awaitTermination()
    run()
    first = len(read("chunks", "chunk_id"))
    (tmp_path / "in" / "pageId_3.md").write_text(PAGES["pageId_3"])
    run()
    assert len(read("chunks", "chunk_id")) > first
    whole = engine._table("chunks").select("chunk_id", "text")
    assert read("chunks", "chunk_id", "text") == sorted(map(tuple, whole.collect())) and ("pageId_1",) in read("graph_links", "document_id")
    # A page comes twice in one batch, and again without entities; another without blocks.
    for folder, body in (("a", "old text on linux"), ("b", "nothing known")):
        (tmp_path / "in" / folder).mkdir()
        (tmp_path / "in" / folder / "pageId_1.md").write_text(PAGES["pageId_1"].split("\n")[0] + "\n" + body)
        os.utime(tmp_path / "in" / folder / "pageId_1.md", (2e9, 2e9 + (folder == "b")))
    (tmp_path / "in" / "a" / "pageId_2.md").write_text(PAGES["pageId_2"].split("\n")[0])
    stream.ingest(spark, f"file://{tmp_path}/in/*", home, f"file://{tmp_path}/check2").awaitTermination()
    now = read("chunks", "document_id", "text")
    assert [t for d, t in now if d == "pageId_1"] == ["nothing known"] and not [t for d, t in now if d == "pageId_2"] and [t for d, t in now if d == "pageId_3"]
    assert not {("pageId_1",), ("pageId_2",)} & set(read("graph_links", "document_id"))


def test_start_and_upkeep(engine, spark):
    e = Engine(spark, engine.home)
    with e.tables.change() as change:
        change.state.pop("graph_edges")
    assert not e.tables.has("graph_edges") and e.ensure_graph() and not e.ensure_graph() and e.tables.has("graph_edges")
    sets = [{"id": "mine", "name": "Mine", "questions": [question("k", "какой порт у ldap", "389", sources=[page_url(3, "w.example")], required_terms=["389"], tags=["x"])]}]
    done = e.start(sets)
    assert done == {"ingested": False, "vectors": False, "graph": False, "seeded": ["mine", "routing"]} and e.start(sets)["seeded"] == []
    cases = {r.case_key: r for r in e.store.read("questions").where("set_id = 'routing'").collect()}
    assert len(cases) == 3 and cases["routing-pageId_3"].tags == ["routing", "page_3"] and "Таблица" in cases["routing-pageId_3"].question
    run_id = e.evaluate("routing", "bm25")
    run = e.store.read("runs").where(f"id = '{run_id}'").first()
    assert run.total_cases == 3 and json.loads(run.summary)["recall_at_5"] > 0.5
    assert e.search(spark.createDataFrame([(1, "порт ldap")], "qid long, question string")) and e.refresh() > 0 and e.refresh() == 0
    with pytest.raises(ValueError, match="dimensions"):
        Engine(spark, engine.home, embedder=dense.HashEmbedder(8)).ensure_vectors()


def test_vectors_are_made_where_there_are_none(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/new")
    assert e.ensure_vectors() and not e.ensure_vectors() and e.tables.read("vectors").count() == 0 and not e.ensure_graph()


def test_response_and_reranker(engine, spark):
    def score(query, texts):
        return [float(len(t)) for t in texts]

    e = Engine(spark, engine.home, reranker=providers.reranker(score, 2))
    row = e.query(spark.createDataFrame([(1, "порт nginx 443 linux")], "qid long, question string")).first()
    chunks = row.retrieved_chunks
    assert [c.rerank_score for c in chunks] == sorted([float(len(c.text)) for c in chunks], reverse=True) and chunks
    assert row.rewritten_query.startswith(row.question) and row.filters.os_tags == ["linux"] and row.query_mode == "classic" and row.routing_reason and row.graph_facts == []
    assert [c.chunk_id for c in row.citations] == [c.chunk_id for c in chunks] and row.sources == list(dict.fromkeys(c.source_url for c in chunks)) and row.retrieval_mode == "hybrid"
    assert e.health()["reranker"] and not Engine(spark, engine.home, generator=providers.generator(print, is_configured=False)).health()["generator"]
    bad = Engine(spark, engine.home, reranker=providers.reranker(lambda q, t: []))
    with pytest.raises(PySparkException, match="scores for"):
        bad.query(spark.createDataFrame([(1, "порт ldap")], "qid long, question string")).collect()


def test_options():
    o = Options.from_env(env={"SEDIMENTA_GRAPH_ENABLED": "off", "SEDIMENTA_FINAL_CONTEXT_COUNT": "3"})
    assert not o.graph_enabled and o.final_context_count == 3
    with pytest.raises(ValueError):
        Options.from_env(env={"SEDIMENTA_EMBED_BATCH": "x"})


def test_nothing_else_needs_the_training_data_operators():
    code = "import sys; sys.modules['sedimenta.llm'] = None; import __spark_entry__ as e; assert e.llm_catalog is None and 'hybrid_search' in e.queries() and 'pipeline' not in e.queries(); import sedimenta.cli, sedimenta.streaming.ingest"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=sys.path[0] or ".")
