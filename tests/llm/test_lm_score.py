import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_path import documents, prose
from pyspark.sql import functions as F
from sedimenta.llm import lm_score as lm

ROWS = [r[:2] for r in documents() if r[0] not in (4, 19)]


def brute(rows, train):
    """Baseline by counting, context-tree weighting by recursion over the whole tree."""
    raw = [lm.raw_bytes(t) for _, t in rows]
    words, grams = Counter(), Counter()
    for r, learn in zip(raw, train, strict=True):
        if learn:
            words.update([*r.split(), "end"])
            y = b"\xff" * lm.DEPTH + r + b"\xff"
            grams.update(y[i - lm.DEPTH : i + 1] for i in range(lm.DEPTH, len(y)))
    total, kinds = sum(words.values()), len(words)
    nodes, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for g, n in grams.items():
        for k in range(8):
            node = (1 << k) | (g[-1] >> (8 - k))
            for d in range(lm.DEPTH + 1):
                c = g[lm.DEPTH - d : lm.DEPTH]
                nodes[c, node][g[-1] >> (7 - k) & 1] += n
                if d:
                    children[c[1:], node].add(c)
    own = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo = {}

    def weighted(c, node):
        if (c, node) not in memo:
            e = own(*nodes[c, node])
            memo[c, node] = e if len(c) == lm.DEPTH else np.logaddexp(e, sum(weighted(x, node) for x in children[c, node])) - math.log(2)
        return memo[c, node]

    def one(c, node):
        p = None
        for d in range(lm.DEPTH, -1, -1):
            x = c[lm.DEPTH - d :]
            a, b = nodes.get((x, node), (0, 0))
            kt = (b + 0.5) / (a + b + 1)
            if p is None:
                p = kt
                continue
            stop = 1 / (1 + math.exp(np.clip(sum(weighted(y, node) for y in children.get((x, node), ())) - own(a, b), -700, 700)))
            p = stop * kt + (1 - stop) * p
        return p

    out = []
    for (doc_id, _), r in zip(rows, raw, strict=True):
        toks = [*r.split(), "end"]
        base = sum(math.log10((words[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in toks)
        y, s = b"\xff" * lm.DEPTH + r + b"\xff", 0.0
        for i in range(lm.DEPTH, len(y)):
            for k in range(8):
                p = one(y[i - lm.DEPTH : i], (1 << k) | (y[i] >> (8 - k)))
                s += math.log10(p if y[i] >> (7 - k) & 1 else 1 - p)
        out.append((doc_id, len(toks), sum(words[t] > 0 for t in toks), total, base, s))
    return out


def close(a, b):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], round(r[4], 4))
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert tuple(x[:4]) == tuple(y[:4])
        assert x[4] == pytest.approx(y[4], rel=1e-6, abs=1e-6) and x[5] == pytest.approx(y[5], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    rows = ROWS[:16] + [(900 + i, prose(i, 20, 30)) for i in range(6)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, kind int")
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    close([tuple(r)[:6] for r in lm.score(docs, train).collect()], brute(rows, [r[0] is None or r[0] % 3 != 0 for r in rows]))


def test_odd_rows(spark, messy, empty):
    rows = lm.score(messy, ~lm.held_out()).collect()
    assert len(rows) == len(documents()) and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (8, 9, 10)} == {1}
    assert all(r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (r.n_bytes + 1)) for r in rows) and {r.n_bytes for r in rows if r.doc_id == 19} == {50_000}
    assert lm.score(empty, ~lm.held_out()).count() == 0
    alone = lm.score(messy, F.lit(False)).where("doc_id = 11").first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and alone.score == pytest.approx(8 * 14 * math.log10(0.5))


def test_log_gamma_beyond_the_table():
    n = np.array([0.0, 5, lm._TABLE - 1, lm._TABLE, 10**6, 10**9])
    assert lm._log_gamma(n, lm._HALF, 0.5) == pytest.approx([math.lgamma(x + 0.5) for x in n], rel=1e-12)


def test_entries_a_few_at_a_time(spark, monkeypatch):
    """Long and repetitive texts too, against the recursion, in small pieces of the byte table."""
    rows = [(0, "x" * 20_000), (1, "ab" * 3000 + "c"), (2, prose(1, 400, 30)), (3, prose(2, 100, 30)), (4, "x" * 50 + " ab")]
    monkeypatch.setattr(lm, "AT_ONCE", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    close([tuple(r)[:6] for r in lm.score(docs, F.col("doc_id") != 3).collect()], brute(rows, [r[0] != 3 for r in rows]))


def test_hot_table():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(-(2**62), 2**62, 5000), np.arange(-3, 3000)]))
    values = rng.normal(size=len(keys))
    for n in (0, 1, len(keys)):
        hit, value = lm.Hot(keys[:n], values[:n]).find(keys)
        assert not hit[n:].any() and hit[:n].mean() > 0.95 if n else not hit.any()
        assert (value[hit] == values[hit]).all() and (value[~hit] == 0).all()
