"""Ranking of rows where they lie: a batch of queries goes to the rows, and each task keeps the k best rows of each query."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that one pass over the rows serves; cells (tokens, or rows times queries, and weights met) that a task works on
#: at once, for the memory of workers.
QUERIES, CELLS = 2048, 200_000


def parts(rows: DataFrame, limit: int) -> list[Column]:
    """Conditions that deal rows, (qid, ...), into parts of about `limit` rows and QUERIES queries; a query's rows stay
    together. One part if they are no more than that."""
    size = rows.agg(F.count("*").alias("n"), F.count_distinct("qid").alias("queries")).first()
    n = max(1, -(-size.n // max(limit, 1)), -(-size.queries // QUERIES))
    return [F.pmod(F.xxhash64("qid"), F.lit(n)) == i for i in range(n)] if n > 1 else [F.lit(True)]


class Weights:
    """What each query gives to each term, by term: from rows (qid, term, value, ...)."""

    def __init__(self, rows: list[tuple], ids: list | None = None):
        self.ids = list(dict.fromkeys(r[0] for r in rows)) if ids is None else ids
        self.terms = sorted({r[1] for r in rows})
        place, at = {q: i for i, q in enumerate(self.ids)}, {t: i for i, t in enumerate(self.terms)}
        rows = sorted((at[r[1]], place[r[0]], *r[2:]) for r in rows)
        self.counts = np.bincount(np.array([r[0] for r in rows], np.int64), minlength=len(self.terms))
        self.starts = np.cumsum(self.counts) - self.counts
        self.query = np.array([r[1] for r in rows], np.int64)
        self.values = [np.array(v, np.float64) for v in list(zip(*rows, strict=True))[2:]] if rows else []

    def meet(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, place): for each of the entries with these term codes, the places of its term's weights."""
        n = self.counts[codes]
        before = np.cumsum(n) - n
        return np.repeat(np.arange(len(codes)), n), np.arange(n.sum()) - np.repeat(before - self.starts[codes], n)


def sums(row: np.ndarray, query: np.ndarray, values: np.ndarray, rows: int, queries: int) -> np.ndarray:
    return np.bincount(row * queries + query, values, rows * queries).reshape(rows, queries)


def spans(costs: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of neighbours whose costs come to CELLS at most, or of a single one."""
    ends, at = np.cumsum(costs), 0
    while at < len(costs):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        yield at, last
        at = last


def few(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of CELLS values of a column of lists."""
    for batch in batches:
        for first, last in spans(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 1):
            yield batch.slice(first, last - first)


def codes(column, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the values of a column of lists that are known; code is the place among the known."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    found = pc.fill_null(pc.index_in(column.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    return row[found >= 0], found[found >= 0].astype(np.int64)


class Gate:
    """Which rows may be returned for which query. must: for each query, lists of tags of which a row needs one each."""

    def __init__(self, must: list[list[list[str]] | None]):
        ways: dict[tuple, int] = {}
        self.of = np.array([ways.setdefault(tuple(sorted(tuple(sorted(set(any_of))) for any_of in m or [])), len(ways)) for m in must], np.int64)
        self.tags = sorted({t for way in ways for any_of in way for t in any_of})
        at = {t: i for i, t in enumerate(self.tags)}
        self.ways = [[{at[t] for t in any_of} for any_of in way] for way in ways]
        self.known, self.seen = pa.array(self.tags, pa.string()), {}

    def _passed(self, have: tuple) -> np.ndarray:
        if have not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[have] = np.array([all(not any_of.isdisjoint(have) for any_of in way) for way in self.ways], bool)
        return self.seen[have]

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray | None:
        """Rows by queries; None if all rows may be returned for all."""
        if not self.tags and not any(self.ways):
            return None
        row, code = codes(batch.column("tags"), self.known)
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        code = code.tolist()
        return np.stack([self._passed(tuple(code[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])[:, self.of] if batch.num_rows else np.empty((0, len(self.of)), bool)


class Best:
    """The k rows with the highest score of each query, over the pieces in which rows come. Scores are rounded before
    they rank; ties go by id."""

    def __init__(self, k: int, ids: list, rounded=lambda x: np.round(x, 6)):
        self.k, self.ids, self.rounded = k, ids, rounded
        self.cut, self.held, self.n = np.full(len(ids), -np.inf), [], 0

    def meet(self, scores: np.ndarray, there: np.ndarray, ids: np.ndarray) -> None:
        """scores, and which of them count: rows by queries."""
        key, k = np.where(there, self.rounded(scores), -np.inf), self.k
        good = there & (key >= self.cut)
        if len(ids) > k and np.count_nonzero(good) > 2 * k * len(self.ids):
            good &= key >= np.partition(key, len(ids) - k, axis=0)[len(ids) - k]
        row, q = np.nonzero(good)
        if len(row):
            new = ids[row]
            self.held.append((q, new.astype(str) if new.dtype == object else new, key[row, q], scores[row, q]))
            self.n += len(row)
        if self.n > max(4 * k * len(self.ids), 50_000):
            self._keep()

    def _keep(self) -> None:
        q, ids, key, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -key, q))
        q, ids, key, score = q[order], ids[order], key[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.cut[q[place == self.k - 1]] = key[place == self.k - 1]
        top = place < self.k
        self.held, self.n = [(q[top], ids[top], key[top], score[top])], int(top.sum())

    def rows(self, id_type: pa.DataType, qid_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._keep()
            q, ids, _, score = self.held[0]
            yield pa.RecordBatch.from_arrays([pa.array([self.ids[i] for i in q.tolist()], qid_type), pa.array(ids.tolist(), id_type), pa.array(score)], ["qid", "id", "score"])


def whole_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches that end where the value of a column changes; rows come sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(key).to_numpy(zero_copy_only=False)
        first = bool(rest) and rest[-1].column(key)[-1].as_py() != x[0]
        changed = np.flatnonzero(x[1:] != x[:-1]) + 1
        last = int(changed[-1]) if len(changed) else 0
        if first or last:
            done = [*rest, *([batch.slice(0, last)] if last else [])]
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
