import math
from collections import defaultdict

import numpy as np
import pytest
from sedimenta.llm import embedding_dedup as ed


def rows():
    rng, out = np.random.default_rng(3), []
    for i in range(300):
        v = rng.normal(size=16)
        out.append((i, v.tolist(), i % 3))
        if i % 5 == 0:
            out.append((1000 + i, (v + rng.normal(size=16) * 0.1).tolist(), i % 3))
        if i % 10 == 0:
            out.append((2000 + i, v.tolist(), i % 3))
            out.append((3000 + i, (v * 7).tolist(), (i + 1) % 3))
    centre = rng.normal(size=16)
    out += [(5000 + i, (centre + rng.normal(size=16) * 0.05).tolist(), 1) for i in range(80)]
    nan, inf = float("nan"), float("inf")
    out += [(6000, None, 1), (6001, [0.0] * 16, 1), (6002, [nan] * 16, 1), (6003, [inf] + [1.0] * 15, 1), (6004, [None] + [1.0] * 15, 1), (6005, [1.0], 1), (6006, [], 1)]
    out += [(6007, centre.tolist(), None), (6008, [1.0] * 16, 2), (6008, [1.0] * 16, 2), (6009, [1e-30] * 16, 2), (6010, [1e30] * 16, 2)]
    return out + [(None, centre.tolist(), 1)]


def brute(data):
    ok = lambda r: r[0] is not None and r[2] is not None and r[1] and len(r[1]) == 16 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    unit = [np.array(r[1]) / np.abs(r[1]).max() / np.linalg.norm(np.array(r[1]) / np.abs(r[1]).max()) if ok(r) else None for r in data]
    root, links = {r[0]: r[0] for r in data}, defaultdict(int)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(unit):
        for j in range(i):
            if a is not None and unit[j] is not None and data[i][2] == data[j][2] and a @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(data[i][0]), top(data[j][0])))
                root[y] = x
    return sorted(((r[0], links[i], None if r[0] is None else top(r[0])) for i, r in enumerate(data)), key=str)


def found(spark, data):
    docs = spark.createDataFrame([(*r, 1, "x") for r in data], "vec_id long, embedding array<double>, label int, list int, first string")
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(docs).collect()), key=str)


@pytest.mark.parametrize("block", [16, 1024])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "MEMBERS", block)
    monkeypatch.setattr(ed, "VISITORS", 2 * block)
    assert found(spark, rows()) == brute(rows())


def test_odd_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1), (2, [0.0, 0.0], 1)]) == [(1, 0, 1), (2, 0, 2)]
    assert found(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 2)]) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_every_length_is_compared(spark):
    short = [(10, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.1], 1), (13, [1.0, 0.0], 2), (14, [1.0], 1)]
    long_ = [(i, [float(i == j) for j in range(4)], 1) for i in range(4)] + [(4, [1.0, 0.1, 0.0, 0.0], 1), (5, [0.0, 0.0, 1.0, 0.1], 1)]
    want = [(0, 1, 0), (1, 0, 1), (2, 1, 2), (3, 0, 3), (4, 1, 0), (5, 1, 2), (10, 2, 10), (11, 2, 10), (12, 2, 10), (13, 0, 13), (14, 0, 14)]
    assert found(spark, short + long_) == sorted(want, key=str)


def test_very_long_vectors_and_shared_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 4000))
    x[1] = x[0] + 0.1 * x[1]
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9, [1.0, 0.0], 1), (9, [0.0, 1.0], 1), (10, [1.0, 0.01], 1), (11, [0.01, 1.0], 1), (12, [-0.0, 1.0], 1)]
    assert found(spark, data) == [(0, 1, 0), (1, 1, 0), (10, 1, 9), (11, 2, 9), (12, 2, 9), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (9, 1, 9), (9, 2, 9)]


def near_copies(n, dims=64, seed=1):
    """n vectors in as many directions, a quarter of them with a copy at a cosine of 0.93 to 0.99."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    aside = rng.normal(size=(n // 4, dims))
    aside -= (aside * x[: n // 4]).sum(1)[:, None] * x[: n // 4]
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    c = rng.uniform(0.9301, 0.99, n // 4)[:, None]
    return np.concatenate([x, c * x[: n // 4] + np.sqrt(1 - c * c) * aside])


def test_exact_bounds_lose_nothing():
    x = near_copies(2000, 16)
    index = ed.Index(x[:1500].copy(), 40, 0.93, math.inf)
    own, visits = index.visits(x)
    codes, square, miss = index.code(x, own)
    pairs = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    assert len(pairs) >= 500
    for i, j in pairs:
        i, j = (i, j) if own[i] <= own[j] else (j, i)
        assert own[j] in visits[i] and index.near(x[j : j + 1].astype(np.float32), own[[i]], codes[[i]], square[[i]], miss[[i]])[0, 0]


def test_recall(spark):
    """All rows indexed, default probes, against brute force."""
    x = near_copies(3000)
    docs = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    links = (np.triu(x @ x.T >= 0.93, 1).sum(), sum(r.n_links for r in ed.near_duplicates(docs).collect()) / 2)
    assert 0.99 * links[0] <= links[1] <= links[0]
