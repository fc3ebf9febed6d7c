from collections import defaultdict

import pytest
from conftest_path import documents, prose
from sedimenta.llm import jaccard_join as jj


def brute(rows):
    """class and links of every row by comparing all pairs of word shingle sets."""
    sets = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w and doc_id is not None else set())
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(int)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(rows[i][0]), top(rows[j][0])))
                root[y] = x
    return sorted(((r[0] is not None, r[0]), r[0] if r[0] is None else top(r[0]), links[i]) for i, r in enumerate(rows))


def found(docs):
    return sorted(((r.doc_id is not None, r.doc_id), r.class_id, r.n_links) for r in jj.join(docs).collect())


key = lambda x: (x[0][0], x[0][1] or 0, x[2])


def test_equals_brute_force(messy):
    assert sorted(found(messy), key=key) == sorted(brute(documents()), key=key)


@pytest.mark.parametrize("block", [2, 64])
def test_large_group_over_many_blocks(spark, monkeypatch, block):
    base, rows = prose(1, 120).split(), []
    for i in range(60):
        w = list(base)
        w[(7 * i) % 120] = f"edit{i}"
        if i % 3 == 0:
            w[(11 * i + 40) % 120] = "other"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(50 + i, 120)) for i in range(20)] + [(200 + i, rows[5][1]) for i in range(10)]
    monkeypatch.setattr(jj, "BLOCK_DOCS", block)
    assert sorted(found(spark.createDataFrame(rows, "doc_id long, text string")), key=key) == sorted(brute(rows), key=key)


def test_texts_that_share_an_id_link_each(spark):
    a, b = prose(1, 100), prose(2, 100)
    edit = lambda t: " ".join(["changed", *t.split()[1:]])
    rows = [(1, a), (1, b), (1, b), (2, edit(a)), (3, edit(b)), (4, prose(3, 100))]
    assert sorted(found(spark.createDataFrame(rows, "doc_id long, text string")), key=key) == sorted(brute(rows), key=key)
    kept = jj.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b), (4, prose(3, 100))])


def test_blocks_are_packed_whole_and_small():
    base, sets = prose(1, 400).split(), []
    for i in range(200):
        w = list(base)
        w[2 * i] = f"edit{i}"
        sets.append((i, 1000 + i, 1, jj.shingles(" ".join(w), jj.WordHashes())))
    block = jj.Block.of(sets)
    packed = block.pack()
    again = jj.Block.unpack(packed)
    for name in ("uids", "ids", "copies", "signatures", "universe", "sizes", "places"):
        assert (getattr(again, name) == getattr(block, name)).all()
    assert len(packed) < 0.2 * sum(len(s) * 8 for *_, s in sets)


def test_empty_and_kept(messy, empty):
    assert found(empty) == []
    kept = [r.doc_id for r in jj.one_of_each(messy).select("doc_id").collect()]
    assert kept.count(1) == 1 and 2 not in kept and 3 not in kept and kept.count(17) == 1 and kept.count(None) == 2 and 8 in kept
    assert jj.one_of_each(messy).columns == messy.columns


def test_pruning_keeps_what_can_reach_the_threshold():
    for n in (36, 180):
        least = jj.least_matches(n)
        assert 0 < least < 0.8 * n
        assert jj.least_matches(n, tolerance=1e-3) >= least
