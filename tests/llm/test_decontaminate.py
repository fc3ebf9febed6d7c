import re

import pytest
from conftest_path import documents, prose
from sedimenta.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(dc.UPPER, dc.LOWER)))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (at := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[at]
        out.append((doc_id, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


BASE = documents()[0][1].split()
ITEMS = [(1, " ".join(BASE[20:60])), (2, "One, TWO three"), (3, None), (4, ""), (5, prose(77, 13)), (6, prose(78, 30)), (7, " ".join(BASE[50:62])), (None, " ".join(BASE[100:120])), (1, " ".join(BASE[20:60])), (8, "To to to to to to to to to to to to to to"), (9, "ñandú")]
ROWS = documents() + [(300, f"{prose(1000, 8)} {prose(77, 13).upper()}, {prose(1001, 300)}"), (301, f"x {' '.join(prose(78, 30).split()[4:16])} y"), (302, f"x {' '.join(prose(78, 30).split()[4:17])} y")]


@pytest.mark.parametrize("limit", [dc.BROADCAST_ROWS, 0])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", limit)
    docs = spark.createDataFrame([(*r[:2], 1, 2, 3) for r in ROWS], "doc_id long, text string, w int, fp int, mark int")
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, w int")
    found = [(r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in dc.contamination(docs, items).collect()]
    assert sorted(found, key=str) == brute(ROWS, ITEMS)


def test_empty_tables_and_cleaning(spark, messy, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.contamination(empty, items).count() == 0
    assert dc.contamination(messy, items.where("false")).where("n_hit > 0").count() == 0
    kept = dc.clean(messy, items)
    hit = [r[0] for r in brute(documents(), ITEMS) if r[2]]
    assert kept.columns == messy.columns and kept.count() == len(documents()) - len(hit) and 1 in hit


def test_a_long_text_with_one_passage_goes(spark):
    passage = prose(78, 30).split()[:13]
    rows = [(1, " ".join([*prose(1000, 500).split(), *passage, *prose(1001, 500).split()])), (2, " ".join([*prose(1002, 500).split(), *passage[:12], *prose(1003, 500).split()]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(6, prose(78, 30))], "item_id long, text string")
    assert [r.contaminated for r in dc.contamination(docs, items).orderBy("doc_id").collect()] == [False, False]
    assert [r.doc_id for r in dc.clean(docs, items).collect()] == [2]


def test_no_python_in_the_plan(spark, messy):
    plan = dc.contamination(messy, spark.createDataFrame(ITEMS, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
