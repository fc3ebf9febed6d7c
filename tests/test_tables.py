import pytest
from pyspark.sql import functions as F
from sedimenta.sources import tables
from sedimenta.sources.tables import Conflict, Tables


@pytest.fixture
def held(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/t")


def put(spark, rows, schema="k string, v int"):
    return spark.createDataFrame(rows, schema)


def rows(held, name="a"):
    return sorted(map(tuple, held.read(name).collect()))


def test_changes_are_one_version(spark, held):
    assert held.read("a") is None and held.versions() == []
    with held.change() as c:
        c.replace("a", put(spark, [("x", 1), ("y", 2), ("x", 3)]), "k", 4)
        c.append("log", put(spark, [("first", 1)]))
        assert not held.has("a")
    assert held.has("a", "log") and held.versions() == [1] and rows(held) == [("x", 1), ("x", 3), ("y", 2)]
    with pytest.raises(RuntimeError, match="boom"), held.change() as c:
        c.replace("a", put(spark, []), "k")
        raise RuntimeError("boom")
    assert held.versions() == [1] and len(rows(held)) == 3


def test_upsert_touches_its_buckets(spark, held):
    many = put(spark, [(f"k{i}", i) for i in range(40)])
    with held.change() as c:
        c.upsert("a", many, "k", buckets=16)
    before = held.state()[1]["a"]["parts"]
    for _ in range(2):  # again changes nothing
        with held.change() as c:
            c.upsert("a", put(spark, [("k1", 100), ("k1", 101), ("new", 7)]), "k", put(spark, [("k1", 0), ("k2", 0), ("new", 0)]))
        want = sorted([(f"k{i}", i) for i in range(40) if i not in (1, 2)] + [("k1", 100), ("k1", 101), ("new", 7)])
        assert rows(held) == want
    after = held.state()[1]["a"]["parts"]
    assert sum(before[b] != after.get(b) for b in before) <= 3 and held.read("a", 1).count() == 40
    with held.change() as c:
        c.upsert("a", put(spark, []), "k", put(spark, [(f"k{i}", 0) for i in range(40)] + [("new", 0)]))
    assert rows(held) == []
    with pytest.raises(ValueError, match="has the key k"), held.change() as c:
        c.upsert("a", many, "v")


def test_a_job_that_dies_changes_nothing(spark, held):
    with held.change() as c:
        c.replace("a", put(spark, [("x", 1)]), "k")
    c = held.change()
    c.upsert("a", put(spark, [("x", 2), ("y", 3)]), "k")  # written, never committed: as if the driver died here
    assert rows(held) == [("x", 1)]
    with held.change() as again:
        again.upsert("a", put(spark, [("x", 2), ("y", 3)]), "k")
    assert rows(held) == [("x", 2), ("y", 3)]
    with pytest.raises(Conflict):
        c._commit()
    assert rows(held) == [("x", 2), ("y", 3)] and held.versions() == [1, 2]


def test_append_and_discard(spark, held, monkeypatch):
    monkeypatch.setattr(tables, "FOLDERS", 3)
    monkeypatch.setattr(tables, "VERSIONS", 2)
    for i in range(5):
        with held.change() as c:
            c.append("a", put(spark, [(f"k{i}", i)]) if i < 4 else put(spark, [("k4", 4, True)], "k string, v int, w boolean"))
    assert len(held.state()[1]["a"]["parts"][""]) == 2 and held.read("a").where("w").count() == 1
    assert held.read("a").select(F.sum("v")).first()[0] == 10
    assert held.discard() == 0 and held.versions() == [4, 5]
    assert held.discard(older_than=-10) == 3 and held.read("a").count() == 5 and held.read("a", 4).count() == 4


def test_sets_without_questions_or_runs(spark):
    from sedimenta.sources import store

    sets = spark.createDataFrame([("a", "A", "2024-01-01", "2024-01-02"), ("b", "B", "2024-01-01", "2024-01-03")], "id string, name string, created_at string, updated_at string")
    questions = spark.createDataFrame([("a", 2, "k2", "second"), ("a", 1, "k1", "first")], "set_id string, position int, case_key string, question string")
    runs = spark.createDataFrame([], "set_id string, created_at string")
    assert [(r.id, r.question_count, r.last_run_at) for r in store.list_sets(sets, questions, runs).collect()] == [("b", 0, None), ("a", 2, None)]
    detail = {r.id: r.questions for r in store.set_detail(sets, questions).collect()}
    assert [q.question for q in detail["a"]] == ["first", "second"] and detail["b"] is None


def test_checked_questions(spark):
    from sedimenta.sources import store

    s = store.Store(spark, "file:///nowhere")
    row = s._question_rows("s", [{"question": " q ", "id": 7, "tags": None}, {"question": "r", "case_key": " k "}, {"question": "t"}]).orderBy("position").collect()
    assert [(r.case_key, r.question, r.tags, r.expected_refusal) for r in row] == [("7", "q", [], False), ("k", "r", [], False), ("case-3", "t", [], False)]
    for items, message in (([{"question": "q"}, {"question": " "}], "question 2 lacks"), ([{"question": "q", "case_key": " "}], "question 1 lacks"), ([{"question": "q", "case_key": "k"}, {"question": "r", "id": "k"}], "2 questions share the key 'k'")):
        with pytest.raises(ValueError, match=message):
            s._question_rows("s", items)
