"""Embedding near-dedup by product quantisation.

Vectors are scaled to length one and put in the inverted list of the nearest coarse centroid; what is left (the residual)
is coded by subspace, one byte each. Centroids and codebooks are fitted on a bounded sample; every vector is indexed, once.

1. visit: a vector visits, as its codes, its own list and each later list whose border with its own is near enough. In a
   list, the members' inner products with all codewords make tables, and distances to visitors come from lookups
   (asymmetric: member as it is, visitor coded). A pair stays if this distance less the visitor's coding error is within
   the link distance; that bound is exact. Members and visitors with such a pair survive.
2. rerank: only survivors get their full vectors; the cosine in double precision decides.

What may be lost is a link whose vectors lie in lists that don't visit each other. A difference of the link distance in a
random direction has a component across a border of about distance / sqrt(dimensions); SURE of these are allowed for.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, runs, small_batches, tidied, written

COSINE = 0.93
#: Lists: LISTS times the root of the largest label's vectors, one for every PER_LIST sample vectors at most. The sample:
#: SAMPLE vectors or more, up to MOST and to SAMPLE_BYTES.
LISTS, PER_LIST, SAMPLE, MOST, SAMPLE_BYTES = 2, 8, 8192, 1 << 16, 32 << 20
#: Bytes of a code, codes in each subspace, rounds of fitting.
SUBSPACES, CODES, ROUNDS, SEED = 16, 256, 8, 7
#: Standard deviations of a random difference's component across a border that visits allow for.
SURE = 3.0
#: Members and visitors aimed at in a block of a list.
MEMBERS, VISITORS = 1024, 4096
#: What single precision may add to a distance.
SLACK = 1e-3


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


def _fit(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Lloyd's rounds from distinct sample points."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _fit_lists(x: np.ndarray, k: int, rng) -> np.ndarray:
    """k centres or so, in two levels, so that the work grows with k ** 1.5 and not k ** 2."""
    top = _fit(x, max(1, round(k**0.5)), rng)
    at = _nearest(x, top)
    parts = [x[at == j] for j in range(len(top))]
    return np.concatenate([_fit(p, max(1, round(k * len(p) / len(x))), rng) for p in parts if len(p)])


class Index:
    """Coarse centroids and codebooks of vectors of length one."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float, sure: float = SURE):
        rng = np.random.default_rng(SEED)
        self.dims = sample.shape[1]
        self.reach = np.sqrt(2 - 2 * cosine)
        self.across = self.reach * min(1.0, sure / self.dims**0.5)
        self.parts = np.array_split(np.arange(self.dims), min(SUBSPACES, self.dims))
        self.lists = _fit_lists(sample, max(1, min(lists, len(sample) // PER_LIST)), rng)
        rest = sample - self.lists[_nearest(sample, self.lists)]
        self.books = [_fit(rest[:, p].copy(), CODES, rng) for p in self.parts]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The own list of each vector, and the lists it visits: its own and the later ones that are near enough.

        Of two lists only the earlier's vectors visit, so a pair is met once. The border of two lists lies at
        (d - d_own) / (2 * gap) from a vector, d being squared distances from the centroids and gap theirs."""
        own, out, squares = np.empty(len(x), np.int64), [], (self.lists**2).sum(1)
        for at in range(0, len(x), 512):
            some = x[at : at + 512]
            d = squares - 2 * some @ self.lists.T
            mine = own[at : at + 512] = d.argmin(1)
            gaps = np.sqrt(np.maximum(squares[mine, None] + squares - 2 * self.lists[mine] @ self.lists.T, 0))
            near = d - d[np.arange(len(some)), mine][:, None] <= 2 * gaps * self.across + SLACK
            near &= np.arange(len(self.lists)) >= mine[:, None]
            out += [np.flatnonzero(n).astype(np.int32) for n in near]
        return own, out

    def code(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the vectors, the squared length of what they decode to, and how far that is from the vector."""
        rest = x - self.lists[own]
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        decoded = self.lists[own].copy()
        for p, b, c in zip(self.parts, self.books, codes.T, strict=True):
            decoded[:, p] += b[c]
        return codes, (decoded**2).sum(1), np.sqrt(((x - decoded) ** 2).sum(1))

    def near(self, members: np.ndarray, own: np.ndarray, codes: np.ndarray, square: np.ndarray, miss: np.ndarray) -> np.ndarray:
        """For every member (as it is) and visitor (coded), whether they may be within reach: by table lookup."""
        homes, at = np.unique(own, return_inverse=True)
        inner = (members @ self.lists[homes].T.astype(np.float32))[:, at]
        for p, b, c in zip(self.parts, self.books, codes.T, strict=True):
            inner += (members[:, p] @ b.T.astype(np.float32))[:, c]
        return 1 + square - 2 * inner <= (self.reach + miss + SLACK) ** 2


def _matrix(column, dims: int, kind=np.float64) -> np.ndarray:
    """An Arrow column of lists or binaries of dims numbers as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dims)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _indexed(groups: DataFrame, index: Index) -> DataFrame:
    """(uid, label, list, visits, x, codes, square, miss): every vector's place in the index."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("v"), index.dims))
                own, visits = index.visits(x)
                codes, square, miss = index.code(x, own)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, visits)]), pa.int32()), pa.array(np.concatenate(visits)))
                rows = [batch.column("uid"), batch.column("label"), pa.array(own, pa.int32()), lists, pa.array([r.tobytes() for r in x.astype(np.float32)]), pa.array([r.tobytes() for r in codes]), pa.array(square, pa.float32()), pa.array(miss, pa.float32())]
                yield pa.RecordBatch.from_arrays(rows, ["uid", "label", "list", "visits", "x", "codes", "square", "miss"])

    kinds = "uid long, label string, list int, visits array<int>, x binary, codes binary, square float, miss float"
    return written(small_batches(groups.select("uid", "label", "v")).mapInArrow(run, kinds), "vector-index")


CELL = ["label", "list", "base", "ask"]


def _survivors(held: DataFrame, index: Index) -> DataFrame:
    """(label, list, base, ask, role, home, uid): members (role 0) and visitors (role 1) of a block with a pair that may
    be within reach. home: the visitor's own list is this one. Lists are dealt out by blocks of members and visitors, so
    a hot list is many tasks; each task gives one row a vector, never pairs."""
    visits = held.select("label", F.explode("visits").alias("at"), "uid", F.col("list").alias("own"), "codes", "square", "miss").withColumnRenamed("at", "list")
    members = held.groupBy("label", "list").agg(F.count("*").alias("members"))
    sizes = visits.groupBy("label", "list").agg(F.count("*").alias("visitors")).join(members, ["label", "list"])
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = written(sizes.select("label", "list", blocks("members", MEMBERS).alias("bases"), blocks("visitors", VISITORS).alias("asks")), "vector-blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    base = held.select("label", "list", "uid", "x").join(sizes, ["label", "list"]).select("label", "list", spot("bases").alias("base"), each("asks").alias("ask"), F.lit(0).alias("role"), "uid", none("int").alias("own"), F.col("x").alias("data"), none("float").alias("square"), none("float").alias("miss"))
    ask = visits.join(sizes, ["label", "list"]).select("label", "list", each("bases").alias("base"), spot("asks").alias("ask"), F.lit(1).alias("role"), "uid", "own", F.col("codes").alias("data"), "square", "miss")
    dealt = base.union(ask).repartition(*CELL).sortWithinPartitions(*CELL, "role", "uid")

    def run(batches):
        for (label, at, first, second), rows in runs(batches, 4):
            role = rows["role"].to_numpy()
            a, b = rows.slice(0, n := int((role == 0).sum())), rows.slice(n)
            if not len(a) or not len(b):
                continue
            x, codes = _matrix(a["data"], index.dims, np.float32), _matrix(b["data"], len(index.parts), np.uint8)
            own, one, two = b["own"].to_numpy(), a["uid"].to_numpy(), b["uid"].to_numpy()
            home, met = own == at, np.zeros((2, max(len(a), len(b))), bool)
            for i in range(0, len(a), 256):
                near = index.near(x[i : i + 256], own, codes, b["square"].to_numpy(), b["miss"].to_numpy())
                near &= ~home | (one[i : i + 256, None] < two)
                met[0, i : i + 256][: len(near)] |= near.any(1)
                met[1, : len(b)] |= near.any(0)
            kept = np.flatnonzero(met[0, : len(a)]), np.flatnonzero(met[1, : len(b)])
            n = sum(map(len, kept))
            if n:
                out = [pa.array([label] * n, pa.string()), *(pa.array(np.full(n, v, np.int32)) for v in (at, first, second)), pa.array(np.repeat([0, 1], [len(k) for k in kept]).astype(np.int32)), pa.array(np.concatenate([np.zeros(len(kept[0]), bool), home[kept[1]]])), pa.array(np.concatenate([one[kept[0]], two[kept[1]]]))]
                yield pa.RecordBatch.from_arrays(out, [*CELL, "role", "home", "uid"])

    return written(small_batches(dealt).mapInArrow(run, "label string, list int, base int, ask int, role int, home boolean, uid long"), "vector-survivors")


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that the links (a, b) of n nodes lead to, for each node."""
    low = np.arange(n)
    while True:
        after = low.copy()
        np.minimum.at(after, a, low[b])
        np.minimum.at(after, b, low[a])
        after = after[after]
        if (after == low).all():
            return low
        low = after


def _reranked(survivors: DataFrame, groups: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(uid, links, first, to) of every block's vectors with links; to is the smallest id they lead to in the block."""
    rows = survivors.join(groups.select("uid", "first", "copies", "v"), "uid").select(*CELL, "role", "home", "uid", "first", "copies", "v")
    rows = rows.repartition(*CELL).sortWithinPartitions(*CELL, "role", "uid")

    def run(batches):
        for _, block in runs(batches, 4):
            n = int((block["role"].to_numpy() == 0).sum())
            uid, first, copies, home = (block[c].to_numpy() for c in ("uid", "first", "copies", "home"))
            x, pairs = _unit(_matrix(block["v"], dims)), []
            for i in range(0, n, 256):
                linked = x[i : min(n, i + 256)] @ x[n:].T >= cosine
                linked &= ~home[n:].astype(bool) | (uid[i : min(n, i + 256), None] < uid[n:])
                a, b = np.nonzero(linked)
                pairs.append((a + i, b + n))
            a, b = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.empty(0, int),) * 2
            if not len(a):
                continue
            # A vector may be a member and a visitor here: one node. Nodes by their ids, so that the smallest comes first.
            order, at = np.unique(np.stack([first, uid], 1), axis=0, return_inverse=True)
            a, b, weight = at.ravel()[a], at.ravel()[b], np.zeros(len(order), np.int64)
            weight[at.ravel()] = copies
            links = np.bincount(a, weight[b], len(order)) + np.bincount(b, weight[a], len(order))
            some, low = np.flatnonzero(links), _least(a, b, len(order))
            yield pa.RecordBatch.from_arrays([pa.array(order[some, 1]), pa.array(links[some].astype(np.int64)), pa.array(order[some, 0]), pa.array(order[low[some], 0])], ["uid", "links", "first", "to"])

    return written(small_batches(rows).mapInArrow(run, "uid long, links long, first long, to long"), "vector-links")


def _met(groups: DataFrame, dims: int, n: int, most: int, cosine: float, sure: float) -> DataFrame:
    """(uid, links, first, to) of the groups: n vectors of length dims, `most` of them in the largest label."""
    lists = int(LISTS * most**0.5) + 1
    wanted = max(1, min(max(SAMPLE, PER_LIST * lists), MOST, SAMPLE_BYTES // (4 * dims)))
    cut = (1 << 30) if n <= wanted else (1 << 30) * wanted // n
    mark = F.xxhash64("v")
    sample = groups.where(F.pmod(mark, F.lit(1 << 30)) < cut).select("v", mark.alias("mark"), "uid").toArrow()  # about `wanted` vectors
    x = _unit(_matrix(sample["v"], dims))[np.lexsort((sample["uid"].to_numpy(), sample["mark"].to_numpy()))]
    index = Index(x, lists, cosine, sure)
    return _reranked(_survivors(_indexed(groups, index), index), groups, dims, cosine)


@tidied
def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, sure: float = SURE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors link if their labels are equal and not null, their lengths equal, and their cosine, in double precision, is
    at least `cosine`. Vectors that are null, zero, or hold null or non-finite components link with nothing; they are
    their own component and kept. Each length has an index of its own. Equal vectors count one by one but are compared
    once. Rows with a null id link with nothing and have a null component. Rows that share an id count each; their
    components join. n_links counts other rows. Other columns aren't read.

    `sure` says how many lists are probed; infinity probes by an exact bound, and no link is lost.
    """
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    bad = "coalesce(exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')), true) or coalesce(forall(v, x -> x = 0), true)"
    v = v.withColumn("whole", ~F.expr(bad) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).withColumn("v", F.expr("transform(v, x -> x + 0.0D)"))  # -0.0 counts as 0.0
    # Equal vectors of a label are one: the smallest id, with how many there are. 128 bits of hash lead back to it.
    v = written(v.withColumns({f"same{i}": F.when(F.col("whole"), F.xxhash64(F.lit(i), "label", "v")) for i in (1, 2)}), "vectors")
    groups = v.where("whole").groupBy("same1", "same2", "label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    groups = written(groups.withColumn("uid", F.monotonically_increasing_id()), "vector-groups")
    # Lengths are few; each is worked through alone. One with no label of two groups has nothing to compare.
    sizes = groups.groupBy(F.size("v").alias("dims"), "label").agg(F.count("*").alias("n")).groupBy("dims").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("most > 1").orderBy("dims").collect()
    parts = [_met(groups.where(F.size("v") == r.dims), r.dims, r.n, r.most, cosine, sure) for r in sizes]
    met = reduce(DataFrame.union, parts, v.where("false").select(*[F.lit(0).cast("long").alias(c) for c in ("uid", "links", "first", "to")]))
    links = met.groupBy("uid").agg(F.sum("links").alias("links"))
    classes = components(met.where("first <> to").select(F.col("first").alias("u"), F.col("to").alias("v")), "vectors")
    found = groups.select("same1", "same2", "uid", "first", "copies").join(links, "uid", "left").join(classes.withColumnRenamed("node", "first"), "first", "left")
    found = written(found.select(F.col("same1").alias("of1"), F.col("same2").alias("of2"), "first", "copies", "links", "component"), "vector-classes")
    out = v.select("vec_id", "same1", "same2").join(found, (F.col("same1") == F.col("of1")) & (F.col("same2") == F.col("of2")), "left")
    n_links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    component = F.coalesce("component", "first", "vec_id")
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS c FROM v UNION SELECT l.v, r.c FROM r JOIN l ON r.u = l.u WHERE r.c < l.v),
c AS (SELECT u, min(c) AS c FROM r GROUP BY u)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.u = v.vec_id) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN c ON c.u = v.vec_id
"""
