import numpy as np
import pytest
from pyspark.sql import functions as F
from sedimenta.functions.entities import FIELDS, Dictionary
from sedimenta.operators import analysis, answer, dense, evaluate, fusion, sparse
from sedimenta.options import Options

def none():
    return F.expr("cast(array() as array<string>)")


def struct(**values):
    return F.struct(*[(F.array(*map(F.lit, values[f])) if values.get(f) else none()).alias(f) for f in FIELDS])


def analysed(spark, *questions, routed=None):
    rows = spark.createDataFrame(list(enumerate(questions)), "qid long, question string")
    return {r.qid: r for r in analysis.analyze(rows, Dictionary(), routed=routed).collect()}


def test_routing(spark):
    got = analysed(spark, "где описана настройка", "какой порт у ldap", "вызов C_Sign", "архитектура linux и windows", "просто linux", "описание функции генерации пары ключей pkcs11", "флаг --x", "пример кода")
    assert [(got[i].query_mode, got[i].intent, got[i].routing_reason) for i in range(8)] == [("classic", "routing", "forced_classic"), ("classic", "factoid", "forced_classic"), ("classic", "general", "forced_classic"), ("graph_first", "general", "heuristic_fallback"), ("classic", "general", "heuristic_fallback"), ("classic", "api_reference", "forced_classic"), ("classic", "general", "forced_classic"), ("classic", "general", "heuristic_fallback")]
    assert got[5].entities.api_symbols == ["C_GenerateKeyPair"] and got[5].entities.interfaces == ["pkcs11"]
    assert got[5].rewritten_query.startswith("описание функции генерации пары ключей pkcs11 pkcs11 C_GenerateKeyPair C_GenerateKeyPair() Синтаксис") and got[5].rewritten_query.endswith("reference")
    assert got[7].needs_code and got[0].routing_confidence == 1.0 and got[3].routing_confidence is None


@pytest.mark.parametrize("mode,confidence,want", [("mixed", "0.6", "mixed"), ("mixed", "0.5", "classic"), ("graph_first", "0.75", "graph_first"), ("graph_first", "0.7", "classic"), (" Classic ", "1", "classic"), ("bad", "9", "graph_first"), ("graph_first", "x", "classic"), ("graph_first", "7", "graph_first")])
def test_router_needs_confidence(spark, mode, confidence, want):
    routed = spark.createDataFrame([(0, mode, confidence, None, "why")], "qid long, mode string, confidence string, rewritten string, reason string").withColumn("filters", struct(os_tags=["ios"]))
    row = analysed(spark, "архитектура linux и windows", routed=routed)[0]
    assert row.query_mode == want and row.filters.os_tags == ["ios", "windows", "linux"] and row.routing_reason == "why" and 0 <= row.routing_confidence <= 1


def test_bm25_by_hand(spark):
    texts = ["common a b", "common a a a", "common c", "", "common d e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    held = sparse.tokenised(docs, "id", F.col("text"))
    asked = spark.createDataFrame([(1, "a a common"), (2, "zzz")], "qid long, question string")
    got = {r.id: r.score for r in sparse.bm25(held, asked, 10).collect()}
    split = [t.split() for t in texts]
    n, avg = 5, sum(map(len, split)) / 5
    df = {t: sum(t in s for s in split) for s in split for t in s}
    raw = {t: np.log(n - d + 0.5) - np.log(d + 0.5) for t, d in df.items()}
    idf = {t: r if r >= 0 else 0.25 * np.mean(list(raw.values())) for t, r in raw.items()}
    score = lambda s: sum(idf[t] * s.count(t) * 2.5 / (s.count(t) + 1.5 * (0.25 + 0.75 * len(s) / avg)) for t in ("a", "a", "common"))
    want = {i: score(s) for i, s in enumerate(split) if score(s) > 0}
    assert got == pytest.approx(want)
    small = {r.id: r.score for r in sparse.bm25(held, asked, 10, limit=0).collect()}
    assert small == pytest.approx(want)
    only = sparse.bm25(held, asked, 1, allowed=spark.createDataFrame([(1, 0)], "qid long, id long")).collect()
    assert [(r.id, r.rank) for r in only] == [(0, 1)] and only[0].score == pytest.approx(want[0])


def test_cosine_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERIES", 3)
    monkeypatch.setattr(dense, "ROWS", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    x[7] = x[3]
    data = [(i, v.tolist(), str(i % 2)) for i, v in enumerate(x)] + [(90, None, "0"), (91, [0.0] * 5, "0"), (92, [], "0")]
    rows = spark.createDataFrame(data, "id long, v array<double>, g string")
    asked = rows.where("id < 10").withColumnRenamed("id", "qid")
    for group in (False, True):
        got = {(r.qid, r["rank"]): (r.id, r.score) for r in dense.cosine_topk(rows, asked, 4, group).collect()}
        named = dense.cosine_topk(rows.withColumn("id", F.format_string("%04d", "id")), asked, 4, group).collect()
        assert {(r.qid, r["rank"]): (int(r.id), r.score) for r in named} == got
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        for q in range(10):
            best = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(40) if not group or i % 2 == q % 2)[:4]
            assert [got[q, k + 1][0] for k in range(4)] == [i for _, i in best]
    assert dense.cosine_topk(rows.where("false"), asked, 4).count() == 0


def test_embedding_shrinks_what_is_too_long(spark):
    class Short(dense.HashEmbedder):
        def embed(self, texts):
            if any(len(t) > 400 for t in texts):
                raise ValueError("too long")
            return super().embed(texts)

    rows = spark.createDataFrame([("a b",), ("x " * 500,), (" ",), (None,)], "t string")
    got = [r.v for r in rows.select(dense.embed(F.col("t"), Short(8), 2).alias("v")).collect()]
    assert all(len(v) == 8 for v in got) and sum(x * x for x in got[0]) == pytest.approx(1) and sum(x * x for x in got[1]) == pytest.approx(1)


def chunks(spark, n=4):
    rows = [(f"c{i}", "t", ["h"], f"token{i} shared", "prose", f"http://s{i % 2}") for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, title string, heading_path array<string>, text string, chunk_type string, source_url string").withColumn("metadata", F.when(F.col("chunk_id") == "c3", struct(os_tags=["linux"])).otherwise(struct()))


def test_fusion_ties_gaps_and_filters(spark):
    queries = spark.createDataFrame([(1, "shared token2"), (2, "shared")], "qid long, rewritten_query string").withColumn("entities", struct()).withColumn("filters", F.when(F.col("qid") == 2, struct(os_tags=["linux"])).otherwise(struct())).withColumn("query_mode", F.lit("classic"))
    hits = [(1, "c1", "sparse", 1, 3.0), (1, "c0", "dense", 1, 0.9), (1, "gone", "dense", 2, 0.8), (1, "c2", "dense", 3, 0.7), (2, "c0", "dense", 1, 0.9), (2, "c3", "dense", 2, 0.5)]
    for order in (hits, hits[::-1]):
        found = fusion.fuse(spark.createDataFrame(order, "qid long, chunk_id string, source string, rank int, score double"), queries, chunks(spark), Options()).collect()
        one = sorted((r for r in found if r.qid == 1), key=lambda r: r["rank"])
        # c2 reranks first; c0 and c1 tie in both scores, dense goes first; the missing chunk keeps its rank
        assert [r.chunk_id for r in one] == ["c2", "c0", "c1"] and one[0].fused_score == pytest.approx(1 / 63) and one[1].fused_score == pytest.approx(1 / 61)
        assert [r.chunk_id for r in found if r.qid == 2] == ["c3"]


def test_answers(spark):
    queries = spark.createDataFrame([(1, "q?", "q? more", "classic"), (2, "z", "z", "classic")], "qid long, question string, rewritten_query string, query_mode string")
    ranked = chunks(spark, 2).withColumn("qid", F.lit(1)).withColumn("rank", F.substring("chunk_id", 2, 1).cast("int") + 1).withColumn("final", F.lit(True))
    facts = spark.createDataFrame([(1, ["a -> b"])], "qid long, facts array<string>")
    got = {r.qid: r.answer for r in answer.fallback(queries, ranked, facts).collect()}
    assert got[2] == answer.REFUSAL
    assert got[1] == f"Переписанный запрос: q? more\nРежим поиска: classic\n\nGraph facts:\n- a -> b\n\n{answer.NOT_GENERATED}\n\n1. t / h\ntoken0 shared\nИсточник: http://s0\n\n2. t / h\ntoken1 shared\nИсточник: http://s1"
    cited = answer.citations(ranked).first().citations
    assert [c.chunk_id for c in cited] == ["c0", "c1"]


def test_checks(spark):
    rows = [(1, "Нет данных.", ["x"], None, "", False, ["http://a"], ["http://A/"], None), (2, "The «Answer», yes", ["answer"], [["no", "yes"]], None, False, None, [], ["bad"]), (3, "", None, None, "", False, ["http://q"], [], None), (4, "bad", None, [["x"]], None, None, None, None, ["BAD"])]
    cases = spark.createDataFrame(rows, "id int, answer string, required_terms array<string>, required_any array<array<string>>, exact_answer string, expected_refusal boolean, required_sources array<string>, cited array<string>, forbidden_terms array<string>")
    got = {r.id: r for r in evaluate.check_cases(cases).collect()}
    assert got[1].actual_refusal and not got[1].checks.refusal.passed and got[1].checks.citations.passed and not got[1].checks.exact_match.passed and got[1].score == 0.25
    assert got[2].passed and got[2].score == 1.0 and not got[2].checks.exact_match.applicable
    assert got[3].checks.exact_match.passed and got[3].missing_sources == ["http://q"] and not got[3].passed
    assert got[4].unexpected_forbidden_terms == ["BAD"] and got[4].missing_required_groups == [["x"]]


def test_ranking_metrics(spark):
    ask = lambda want, got: spark.range(1).select(evaluate.ranking_metrics(F.array(*map(F.lit, want)) if want else none(), F.array(*map(F.lit, got)) if got else none()).alias("m")).first().m
    m = ask(["http://A/", "http://b"], ["http://x", "http://a", "HTTP://A/", "http://b"])
    assert (m.applicable, m.recall, m.mrr) == (True, 1.0, 0.5) and m.ndcg == pytest.approx(round((1 / np.log2(3) + 1 / np.log2(4)) / (1 + 1 / np.log2(3)), 4))
    assert ask([], ["http://x"]).applicable is False and ask(["http://a"], []).mrr == 0.0 and ask([" "], ["x"]).ndcg is None


def test_empty_summary(spark):
    none = spark.createDataFrame([], "passed boolean, score double, latency_ms double, metrics struct<applicable: boolean, recall: double, mrr: double, ndcg: double>, tags array<string>")
    row = evaluate.summary(none).first()
    assert (row.total_cases, row.passed_cases, row.pass_rate, row.p95_latency_ms, row.recall_at_5) == (0, 0, 0.0, 0.0, None)
    assert evaluate.per_tag(none).count() == 0
