import random

from sedimenta.llm import common


def brute(edges):
    root = {}
    for e in edges:
        for x in e:
            root.setdefault(x, x)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    return {x: top(x) for x in root}


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1001 + i) for i in range(200)]
    loose = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(160)]
    edges = [e for e in chain + star + loose if e[0] != e[1]]
    rows = [e if rng.random() < 0.5 else e[::-1] for e in edges] + [edges[0], (5, 5), (None, 3), (7, None)]
    found = common.components(spark.createDataFrame(rows, "u long, v long"), "test")
    got = [(r.node, r.component) for r in found.collect()]
    assert len(got) == len({n for n, _ in got}) and dict(got) == brute(edges)
    assert common.components(spark.createDataFrame([], "u long, v long"), "test").count() == 0


def test_rolling_tells_runs_apart():
    import numpy as np

    words = np.array([hash(str(i)) & (2**64 - 1) for i in (1, 2, 3, 1, 2, 3, 2, 1, 3)], np.uint64)
    for k in (1, 2, 3, 5, 8):
        h = common.rolling(words, k)
        runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        assert len(h) == len(runs) and all((h[i] == h[j]) == (runs[i] == runs[j]) for i in range(len(h)) for j in range(len(h)))
    assert len(common.rolling(words, 10)) == 0 and (common.rolling(words, 3, 1) != common.rolling(words, 3, 0)).all()
