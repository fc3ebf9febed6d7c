import random

import numpy as np
import pytest
from conftest_path import documents
from sedimenta.llm import language_id as li


def corpus():
    parts = {"en": ["the", "and", "ing", "tion", "with", "er"], "fr": ["eau", "être", "que", "ment", "ç", "oi"], "de": ["sch", "ung", "ein", "ü", "cht", "der"]}
    rng, rows = random.Random(4), []
    for i in range(240):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 40))), lang))
    return rows


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    found = li.identify(docs, li.train(docs.where(~li.held_out()))).join(docs.where(li.held_out()), "doc_id").collect()
    assert len(found) > 30 and sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_rows(spark, messy, empty):
    prototypes = li.train(messy)
    rows = li.identify(messy, prototypes).collect()
    assert len(rows) == len(documents())
    by = {r.doc_id: r for r in rows}
    for i in (8, 9, 10, 13):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[1].lang_pred in prototypes and li.identify(empty, prototypes).count() == 0
    assert li.train(empty) == {} and {r.lang_pred for r in li.identify(messy, {}).collect()} == {"und"}
    kept = {r.doc_id for r in li.keep_known(messy, prototypes).collect()}
    assert not kept & {8, 9, 10, 13} and {1, 2, 3, 4, 5}.issubset(kept)


def test_bundle_is_the_sum_of_bound_vectors():
    p = li.Profiles()
    codes = next(p.codes("abc"))
    space = lambda i, s: p.placed[i][s].astype(int)
    grams = [(0, 1, 2), (1, 2, 3), (2, 3, 0)]
    want = sum(space(0, a) * space(1, b) * space(2, c) for a, b, c in grams)
    assert (p.bundle([0], [codes], 1)[0] == want).all()


def test_slabs_change_nothing(monkeypatch):
    p = li.Profiles()
    texts = ["the quick brown fox " * 50, "a" * 129, "x" + " " * 200 + "y", "!" * 64 + "ab" + "?" * 64, "é" * 64, "ab cd" * 13 + "  ", "." * 300, ""]
    whole = [np.concatenate([*p.codes(t), []]).tolist() for t in texts]
    for slab in (1, 2, 7, 64):
        monkeypatch.setattr(li, "SLAB", slab)
        assert [np.concatenate([*p.codes(t), []]).tolist() for t in texts] == whole
    assert len(whole[0]) == 999 and whole[6] == whole[7] == []


def brute_profile(p, text):
    """The bundle of a text's n-grams, one at a time."""
    symbols = [0]
    for c in text or "":
        s = int(p.table[ord(c)])
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    out = np.zeros(li.DIMENSIONS, np.int64)
    for i in range(len(symbols) - li.GRAM + 1):
        bound = np.ones(li.DIMENSIONS, np.int64)
        for j in range(li.GRAM):
            bound *= np.roll(p.placed[li.GRAM - 1][symbols[i + j]].astype(np.int64), li.GRAM - 1 - j)
        out += bound
    return out


def test_equals_brute_force(spark):
    p, rows = li.Profiles(), corpus()[:60] + [(900, "", "en"), (901, None, "en"), (902, "12 !", "de"), (903, "Ünïcödé 中文 straße", "de"), (904, "a", "fr"), (905, "wort", None)]
    want = {lang: sum(brute_profile(p, t) for _, t, x in rows if x == lang and t) for lang in ("de", "en", "fr")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = li.train(docs)
    assert list(got) == ["de", "en", "fr"] and all((got[k] == want[k]).all() for k in got)
    found = {r.doc_id: r for r in li.identify(docs, got).collect()}
    for i, t, _ in rows:
        x = brute_profile(p, t).astype(float)
        cosines = {k: x @ v / (np.linalg.norm(x) * np.linalg.norm(v)) for k, v in want.items()} if x.any() else {}
        best = max(cosines, key=lambda k: cosines[k]) if cosines else "und"
        assert found[i].lang_pred == best and found[i].score == pytest.approx(max(0, cosines.get(best, 0)))


def test_equal_cosines_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "same words here", "xx"), (2, "same words here", "aa"), (3, "same words", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in li.identify(docs, li.train(docs)).collect()} == {"aa"}


def test_long_texts_in_an_unlearned_language_go(spark):
    rng = random.Random(9)
    alien = lambda n: " ".join("".join(rng.choices(["zx", "qw", "vk", "jy", "pp", "a"], k=3)) for _ in range(n))
    rows = corpus() + [(1000 + i, alien(40), None) for i in range(5)] + [(2000, "the with", None), (2001, "der sch", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = li.train(docs)
    bounds = li.score_bounds(docs, prototypes)
    assert bounds[:3] == [li.LEAST] * 3 and bounds[7] > 3 * li.LEAST
    kept = {r.doc_id for r in li.keep_known(docs, prototypes, bounds).collect()}
    assert kept == {r[0] for r in rows} - set(range(1000, 1005))
    assert li.score_bounds(docs.where("false"), {}) == [li.LEAST] * 32


def test_bounds_come_from_all_labelled_texts(spark):
    rng, words = random.Random(11), ["the", "and", "ing", "tion", "with", "er", "zz"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice((4, 9, 20)))), "en") for i in range(16_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = li.train(docs)
    scores = {}
    for r in li.identify(docs, prototypes).collect():
        scores.setdefault(len(rows[r.doc_id][1]).bit_length() - 1, []).append(r.score)
    bounds = li.score_bounds(docs, prototypes)
    many = [k for k in scores if len(scores[k]) >= li.ENOUGH]
    assert len(many) >= 3 and all(bounds[k] == pytest.approx(max(li.LEAST, li.SHARE * min(scores[k])), rel=1e-9) for k in many)
