"""Searches that keep the best rows where these lie, against brute force; nothing large is written or shuffled."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sedimenta.functions.entities import FIELDS, Dictionary
from sedimenta.operators import answer, dense, enrich, graph, ranking, sparse
from sedimenta.options import Options
from sedimenta.plans import engine

WORDS = "a b c d e f g h i j".split()


def test_bm25_is_the_same_in_any_parts(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 9))), ["x", "y", "z"][: i % 4]) for i in range(60)]
    held = sparse.tokenised(spark.createDataFrame(docs, "id long, text string, tags array<string>"), "id", F.col("text"), "tags").repartition(3)
    must = {0: None, 1: [["x"]], 2: [["x", "z"], ["y"]], 3: [["none"]], 4: []}
    asked = [(q, " ".join(rng.choice(WORDS, 4)), must[q % 5]) for q in range(20)]
    queries = spark.createDataFrame(asked, "qid long, question string, must array<array<string>>")
    n, split = len(docs), [t.split() for _, t, _ in docs]
    avg = sum(map(len, split)) / n
    raw = {w: np.log(n - d + 0.5) - np.log(d + 0.5) for w in WORDS for d in [sum(w in s for s in split)]}
    idf = {w: r if r >= 0 else 0.25 * np.mean(list(raw.values())) for w, r in raw.items()}
    want = {}
    for q, text, need in asked:
        scores = [(-round(sum(idf[w] * s.count(w) * 2.5 / (s.count(w) + 1.5 * (0.25 + 0.75 * len(s) / avg)) for w in text.split()), 6), i) for i, s in enumerate(split) if all(set(x) & set(docs[i][2]) for x in need or [])]
        want |= {(q, k + 1): i for k, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:3])}
    for limit in (200_000, 7, 0):
        got = {(r.qid, r["rank"]): r.id for r in sparse.bm25(held, queries, 3, limit=limit).collect()}
        assert got == want


def test_bm25_shuffles_only_the_best(spark):
    docs = sparse.tokenised(spark.createDataFrame([(i, f"a b w{i}") for i in range(500)], "id long, text string"), "id", F.col("text"))
    hits = sparse.bm25(docs, spark.createDataFrame([(q, "a b") for q in range(50)], "qid long, question string"), 2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Join" not in plan and hits.count() == 100


def test_dense_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 5))
    x[9] = x[3]
    data = [(f"{i:02d}", v.tolist(), [f"t{i % 3}"]) for i, v in enumerate(x)] + [("90", None, ["t0"]), ("91", [0.0] * 5, ["t0"]), ("92", [], ["t0"])]
    rows = spark.createDataFrame(data, "id string, v array<double>, tags array<string>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist(), [["t1", "t2"]] if i % 2 else None) for i in range(10)] + [(10, None, None)], "qid long, v array<double>, must array<array<string>>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(q, k + 1): f"{i:02d}" for q in range(10) for k, (_, i) in enumerate(sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(50) if not q % 2 or i % 3)[:4])}
    for size in (ranking.QUERIES, 3):
        monkeypatch.setattr(ranking, "QUERIES", size)
        assert {(r.qid, r["rank"]): r.id for r in dense.search(rows, asked, 4).collect()} == want
    assert dense.search(rows, asked.where("false"), 4).count() == 0 and dense.search(rows.where("false"), asked, 4).count() == 0


def test_gate_and_best():
    gate = ranking.Gate([None, [], [["a", "b"]], [["a"], ["c"]]])
    rows = pa.RecordBatch.from_arrays([pa.array([["a"], ["c", "a", "zz"], [], None, ["b", "b"]], pa.list_(pa.string()))], ["tags"])
    assert gate(rows).tolist() == [[True, True, True, False], [True, True, True, True], [True, True, False, False], [True, True, False, False], [True, True, True, False]]
    assert ranking.Gate([None, []])(rows) is None
    best, rng = ranking.Best(3, ["q", "r"]), np.random.default_rng(2)
    scores = rng.integers(0, 5, (40_000, 2)).astype(float)
    for a in range(0, 40_000, 1000):
        best.meet(scores[a : a + 1000], scores[a : a + 1000] > 0, np.arange(a, a + 1000))
    (got,) = best.rows(pa.int64(), pa.string())
    for i, q in enumerate("qr"):
        assert [r["id"] for r in got.to_pylist() if r["qid"] == q] == np.lexsort((np.arange(40_000), -scores[:, i]))[:3].tolist()


def test_whole_runs():
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], ["d"]) for x in (list("aab"), list("bb"), [], list("bcc"), list("d"))]
    assert ["".join(b.column("d").to_pylist()) for b in ranking.whole_runs(batches, "d")] == ["aa", "bbb" + "b", "cc", "d"]


@pytest.fixture
def corpus(spark):
    words = ("linux", "windows", "pcsc", "ldap", "apache", "nothing")
    rows = [(f"d{i // 3}-{i % 3}", f"d{i // 3}", "p", "http://s", "t", [""], f"{words[i % 6]} and {words[i * i % 5]}", "prose") for i in range(240)]
    found = spark.createDataFrame(rows, "chunk_id string, document_id string, page_id string, source_url string, title string, heading_path array<string>, text string, chunk_type string")
    return enrich.enrich(found, Dictionary())


def test_candidates_write_no_row_for_a_query_and_chunk(spark, corpus, monkeypatch):
    from sedimenta.operators import analysis

    asked = analysis.analyze(spark.createDataFrame([(q, f"{a} {b}") for q, (a, b) in enumerate([(a, b) for a in ("linux", "windows", "pcsc", "ldap") for b in ("apache", "linux", "word", "pcsc")])], "qid long, question string"), Dictionary()).withColumn("query_mode", F.lit("mixed"))
    sizes, write = {}, engine.written

    def counted(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    for module in (engine, graph, sparse, dense):
        monkeypatch.setattr(module, "written", counted)
    postings = sparse.tokenised(corpus, "chunk_id", enrich.search_text())
    vectors = corpus.select("chunk_id", dense.embed(F.col("text"), dense.HashEmbedder()).alias("v"))
    options = Options(dense_candidate_count=2, sparse_candidate_count=2, graph_candidate_count=2)
    hits = engine.candidates(asked, corpus, vectors, postings, graph.nodes(corpus), graph.edges(corpus), graph.links(corpus), dense.HashEmbedder(), options, "hybrid")
    rows = hits.collect()
    assert {r.source for r in rows} == {"dense", "sparse", "graph"} and sizes and max(sizes.values()) < 240
    tags = {r.chunk_id: {t for f in FIELDS for t in (f"{f}:{v}" for v in r.metadata[f])} for r in corpus.collect()}
    need = {r.qid: [{f"{f}:{v}" for v in r.filters[f]} for f in FIELDS if r.filters[f]] for r in asked.collect()}
    assert all(x & tags[r.chunk_id] for r in rows if r.source != "graph" for x in need[r.qid])


def test_graph_search_is_the_same_in_any_parts(spark, corpus, monkeypatch):
    struct = lambda words: F.struct(*[F.array(*[F.lit(w) for w in words.get(f, [])]).cast("array<string>").alias(f) for f in FIELDS])
    queries = spark.createDataFrame([(1, "mixed"), (2, "graph_first"), (3, "classic")], "qid long, query_mode string").withColumn("entities", F.when(F.col("qid") == 1, struct({"os_tags": ["linux"]})).otherwise(struct({"os_tags": ["windows"], "components": ["ldap"]})))
    edges, links, nodes = graph.edges(corpus), graph.links(corpus), graph.nodes(corpus)
    seeds = graph.seeds(queries, nodes)
    gains = graph.expand(seeds, edges, Options()).collect()
    mass, exact = {}, set()
    for s in seeds.collect():
        mass[s.qid, s.node_id] = mass.get((s.qid, s.node_id), 0) + s.seed_weight
        exact.add((s.qid, s.node_id))
    for g in gains:
        mass[g.qid, g.neighbour] = mass.get((g.qid, g.neighbour), 0) + g.gain
    held = links.collect()
    want = {}
    for q in (1, 2):
        met = [(x, mass[q, x.node_id]) for x in held if (q, x.node_id) in mass]
        around = {}
        for x, m in met:
            around[x.document_id] = around.get(x.document_id, 0) + m * 0.3
        score = {}
        for chunk in {(x.document_id, x.chunk_id) for x, _ in met}:
            own = [(m * x.weight, (q, x.node_id) in exact) for x, m in met if x.chunk_id == chunk[1]]
            n = sum(e for _, e in own)
            score[chunk[1]] = round(round((sum(s for s, _ in own) + around[chunk[0]] * 0.3 + (min(n, 4) * 0.2 if n > 1 else 0)) * (1.15 if q == 2 else 1), 8), 4)
        want |= {(q, k + 1): (c, pytest.approx(-s, abs=2e-4)) for k, (s, c) in enumerate(sorted((-s, c) for c, s in score.items())[:7])}
    for limit, cells in ((200_000, ranking.CELLS), (1, 10)):
        monkeypatch.setattr(ranking, "CELLS", cells)
        got = {(r.qid, r["rank"]): (r.chunk_id, r.score) for r in graph.search(queries, nodes, edges, links, Options(broadcast_rows=limit), 7).collect()}
        assert got == want


def test_few_hits_come_to_the_texts(spark):
    docs = spark.createDataFrame([(i, "t", f"word{i} text", "u") for i in range(100)], "id long, title string, text string, source_url string")
    plan = answer.baseline(spark.createDataFrame([(1, "word7 text")], "qid long, question string"), spark.createDataFrame([(1, 7, 1)], "qid long, id long, rank int"), docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [id" in plan and "SortMergeJoin [id" not in plan
