import hashlib

import pytest
from conftest_path import documents, prose
from sedimenta.llm import substring_dedup as sd


def brute(rows):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in split:
        for i in range(len(w) - 49) if d is not None else ():
            g = tuple(w[i : i + 50])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 49) if d is not None else ():
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    rows = sd.repeats(docs).collect()
    sha = lambda r: hashlib.sha256(r.kept.encode()).hexdigest() if r.kept is not None else bytes(r.sha).hex()
    return sorted(((r.doc_id, r.n_words, r.n_removed, sha(r)) for r in rows), key=str)


def overlapping():
    a, b, c = (prose(i, n).split() for i, n in ((201, 200), (202, 120), (203, 49)))
    texts = [a, b + a[40:100], a[100:149] + b[:50], c + c, b[20:90] + ["x"] + b[10:60], a[0:120] + b, ["r"] * 130, ["r"] * 55 + a[3:60], a[:50], a[1:50]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("starts,common", [(3, 4), (150, 4), (150, 0)])
def test_equals_brute_force(spark, monkeypatch, messy, starts, common):
    monkeypatch.setattr(sd, "STARTS", starts)
    monkeypatch.setattr(sd, "COMMON", common)
    assert found(messy) == brute(documents())
    rows = overlapping()
    for order in (rows, [(20 - i, t) for i, t in rows]):
        assert found(spark.createDataFrame(order, "doc_id long, text string")) == brute(order)


def test_kept_texts(spark, messy, empty):
    assert found(empty) == []
    docs = spark.createDataFrame([(*r, len(r[1])) for r in overlapping()], "doc_id long, text string, n_chars long")
    kept = {r.doc_id: r for r in sd.without_repeats(docs).collect()}
    for d, n, gone, sha in brute(overlapping()):
        if n == gone and n:
            assert d not in kept
        elif gone:
            assert hashlib.sha256(kept[d].text.encode()).hexdigest() == sha and kept[d].n_chars == len(kept[d].text)
        else:
            assert kept[d].text == overlapping()[d][1]
    assert sd.without_repeats(messy).columns == messy.columns
    assert {r.doc_id for r in sd.without_repeats(messy).collect()} >= {1, 8, 9, 10, 11, None}


def test_a_phrase_of_many_passages_deals_few_segments(spark, monkeypatch):
    """40 passages share a phrase, each in two documents: buckets get their own passages, not all that have the phrase."""
    monkeypatch.setattr(sd, "BUCKET", 3000)
    monkeypatch.setattr(sd, "COMMON", 4)
    phrase = prose(1, 30)
    rows = [(i, f"{prose(300 + i % 40, 40)} {phrase} {prose(400 + i % 40, 40)} {prose(500 + i, 5)}") for i in range(80)]
    dealt, held = [], sd.dealt_segments

    def seen(*a):  # the tables behind it go with the call
        out = held(*a)
        dealt.extend(out.collect())
        return out

    monkeypatch.setattr(sd, "dealt_segments", seen)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert len(dealt) <= 80 and len({r.bucket for r in dealt}) > 10
