"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents with equal shingle sets collapse into one representative. Representatives that share a MinHash band are
candidates. They are not paired up as rows: each goes into a block with others of its largest shared bucket. A block is
packed once: its MinHash values, and its shingle sets as places in the list of all its shingles, which for a block of near
copies is hardly longer than one set. Pairs of blocks that share a bucket are compared block against block. Inside, MinHash values are compared a few at a time; a pair
is dropped once the posterior probability that its similarity reaches the threshold, given the matches so far and a
uniform prior, falls below TOLERANCE. The rest are verified on the whole shingle sets. A block pair gives a row for
each document that has links, so what is written grows with the documents, not with the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, components, map_rows, mix64, rolling, runs, slices, small_batches, tidied, written

WORDS, THRESHOLD = 5, Fraction(4, 5)
#: MinHash bands and values in each: a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^36 < 1e-6.
BANDS, ROWS = 36, 5
#: Values compared before each look at the posterior, and the probability below which a pair is dropped.
STEP, TOLERANCE = 36, 1e-9
#: Documents and shingles aimed at in a block.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 400_000

_SEEDS = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_MULTIPLY, _ADD = _SEEDS[: BANDS * ROWS] | np.uint64(1), _SEEDS[BANDS * ROWS :]


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of WORDS words; fewer words, but not none, are one run."""
    h = hashes((text or "").encode().split())
    return np.unique(rolling(h, min(WORDS, len(h)), len(h) if len(h) < WORDS else 0)) if len(h) else h


def signature(found: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 4096):
        x = found[at : at + 4096]
        out = np.minimum(out, ((_MULTIPLY[:, None] * x + _ADD[:, None]) >> np.uint64(32)).min(1).astype(np.uint32))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = rolling_rows(sig.reshape(BANDS, ROWS).astype(np.uint64))
    return mix64(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def rolling_rows(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for i in range(x.shape[1]):
        out = mix64(out + x[:, i])
    return out


def set_digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def least_matches(n: int, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches among n MinHash values with which P(similarity >= threshold) is at least tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail at t is the lower tail of a binomial.
    """
    t, tail = float(threshold), 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n + 1


class Block:
    """The documents of a block: uids, doc_ids, copies, MinHash values, and shingle sets as places in `universe`."""

    def __init__(self, uids, ids, copies, signatures, universe, sizes, places):
        self.uids, self.ids, self.copies, self.signatures = uids, ids, copies, signatures
        self.universe, self.sizes, self.places = universe, sizes, places

    @classmethod
    def of(cls, documents: list[tuple[int, int, int, np.ndarray]]) -> Block:
        """From (uid, doc_id, copies, shingles)."""
        uids, ids, copies, sets = zip(*documents, strict=True)
        universe, places = np.unique(np.concatenate(sets), return_inverse=True)
        return cls(*(np.array(x, np.int64) for x in (uids, ids, copies)), np.stack([signature(x) for x in sets]), universe, np.array([len(x) for x in sets], np.int64), places.astype(np.int64))

    def pack(self) -> bytes:
        """MinHash values by column and places as steps: near copies repeat there, and pack well."""
        steps = np.diff(self.places, prepend=0).astype(np.int32)
        parts = [self.uids, self.ids, self.copies, self.signatures.T, self.universe, self.sizes, steps]
        head = np.array([len(self.uids), len(self.universe), len(steps)], np.int64)
        return zstandard.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in (head, *parts)), 1)

    @classmethod
    def unpack(cls, packed: bytes) -> Block:
        raw, at = zstandard.decompress(packed), 24
        n, kinds, steps = np.frombuffer(raw, np.int64, 3).tolist()
        parts = []
        for kind, count in ((np.int64, n), (np.int64, n), (np.int64, n), (np.uint32, n * BANDS * ROWS), (np.uint64, kinds), (np.int64, n), (np.int32, steps)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        signatures = np.ascontiguousarray(parts[3].reshape(BANDS * ROWS, n).T)
        return cls(*parts[:3], signatures, parts[4], parts[5], np.cumsum(parts[6], dtype=np.int64))


def linked(one: Block, other: Block | None, threshold: Fraction) -> Iterator[tuple[int, int, int, int]]:
    """(uid, doc_id, links weighted by copies, smallest doc_id linked within the blocks) of documents with links. Those of one
    block are compared with those of the other, or among themselves if there is no other."""
    steps = [(n, least_matches(n, threshold)) for n in range(STEP, BANDS * ROWS + 1, STEP)]
    blocks = [one] if other is None else [one, other]
    uids, ids, weights, sizes, signatures = (np.concatenate([getattr(b, x) for b in blocks]) for x in ("uids", "ids", "copies", "sizes", "signatures"))
    universe = one.universe if other is None else np.union1d(one.universe, other.universe)
    place = np.concatenate([np.searchsorted(universe, b.universe)[b.places] for b in blocks])
    n, split = len(uids), len(one.uids)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    places = [place[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    here, counts, root, names = np.zeros(len(universe), bool), np.zeros(n, np.int64), list(range(n)), ids.tolist()
    up, down = threshold.numerator, threshold.denominator

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n if other is None else split):
        rest = np.arange(i + 1 if other is None else split, n)
        # a similarity of t needs sizes within a factor of t
        rest = rest[(sizes[rest] * down >= sizes[i] * up) & (sizes[i] * down >= sizes[rest] * up)]
        matches, before = np.zeros(len(rest), np.int64), 0
        for upto, least in steps:
            if not len(rest):
                break
            matches += (signatures[rest, before:upto] == signatures[i, before:upto]).sum(1)
            alive = matches >= least
            rest, matches, before = rest[alive], matches[alive], upto
        if not len(rest):
            continue
        here[places[i]] = True
        ends = np.concatenate(([0], np.cumsum(sizes[rest])[:-1]))
        common = np.add.reduceat(here[np.concatenate([places[j] for j in rest])].astype(np.int64), ends)
        here[places[i]] = False
        found = rest[common * down >= (sizes[i] + sizes[rest] - common) * up]
        if len(found):
            counts[i] += weights[found].sum()
            counts[found] += weights[i]
            for j in found.tolist():
                a, b = top(i), top(j)
                if a != b:
                    a, b = (a, b) if names[a] <= names[b] else (b, a)
                    root[b] = a
    for i in np.flatnonzero(counts).tolist():
        yield int(uids[i]), names[i], int(counts[i]), names[top(i)]


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, size, bands) of every row; a text without words has size 0 and no bands."""

    def make():
        hashes = WordHashes()

        def step(columns):
            sets = [shingles(t, hashes) if i is not None else np.empty(0, np.uint64) for i, t in zip(*columns, strict=True)]
            return [columns[0], [set_digest(s) for s in sets], [len(s) for s in sets], [band_keys(signature(s)) if len(s) else [] for s in sets]]

        return step

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, digest binary, size int, bands array<long>")


def packed(texts: DataFrame) -> DataFrame:
    """(block, packed) from rows (block, uid, doc_id, copies, digest, text), several texts to a uid perhaps, of which that
    with the digest counts. A block is one row; its documents and shingles are bounded as far as single texts are."""
    dealt = texts.select("block", "uid", "doc_id", "copies", "digest", "text").repartition("block").sortWithinPartitions("block", "uid")

    def run(batches):
        hashes, now, held, seen = WordHashes(), None, [], set()

        def pack():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([Block.of(held).pack()], pa.binary())], ["block", "packed"])

        for columns in slices(batches):
            for block, uid, doc_id, copies, digest, text in zip(*columns, strict=True):
                if block != now:
                    if held:
                        yield pack()
                    now, held, seen = block, [], set()
                found = shingles(text, hashes)
                if uid not in seen and set_digest(found) == digest:
                    seen.add(uid)
                    held.append((uid, doc_id, copies, found))
        if held:
            yield pack()

    return small_batches(dealt).mapInArrow(run, "block long, packed binary")


def compare(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """(uid, doc_id, links, to) from rows (a, b, packed): the one or two blocks of a pair, dealt out and sorted by (a, b)."""
    kinds = pa.schema([(c, pa.int64()) for c in ("uid", "doc_id", "links", "to")])

    def run(batches):
        out = []
        for _, pair in runs(batches, 2):
            out += linked(*[Block.unpack(x) for x in pair["packed"].to_pylist()], *[None] * (2 - len(pair)), threshold)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=kinds)

    return small_batches(rows).mapInArrow(run, "uid long, doc_id long, links long, to long")


@tidied
def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD, rounds: int = 60) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of docs.

    Documents link if the Jaccard similarity of their sets of five-word shingles is at least the threshold. Words are
    runs without ASCII white space, unchanged; a text of one to four words is one shingle; a null or empty text has none
    and links with nothing. n_links counts the other rows linked directly, copies included; class_id is the smallest
    doc_id that links lead to. Rows with a null id link with nothing and have a null class. Rows that share an id count
    each, and their classes join. Other columns aren't read. Whole texts are compared; a very long one makes its block
    larger than aimed at. Classes that take more than `rounds` rounds to come together raise RuntimeError.
    """
    # A row's uid holds from here on, as it is written.
    found = written(sketch(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "jaccard-sketch")
    sets = found.where("size > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "uid")).alias("of"), F.count("*").alias("copies")).where("copies > 1")
    sets = written(sets.select("digest", F.col("of.doc_id").alias("first"), F.col("of.uid").alias("first_uid"), "copies"), "jaccard-copies")
    found = found.join(sets, "digest", "left").withColumns({"first": F.coalesce("first", "doc_id"), "first_uid": F.coalesce("first_uid", "uid"), "copies": F.coalesce("copies", F.lit(1).cast("long"))})
    found = written(found, "jaccard-docs")
    reps = found.where("size > 0 and uid = first_uid").select("uid", "doc_id", "digest", "size", "copies", "bands")
    keys = written(reps.select("uid", "size", F.explode("bands").alias("key")), "jaccard-keys")
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "jaccard-buckets")
    live = written(keys.join(shared, "key"), "jaccard-live")
    # A document's home is its largest bucket; then the largest home among those it shares a bucket with, so that a
    # large group comes together in few homes.
    best = lambda rows, by, *more: rows.groupBy(by).agg(F.max(F.struct("n", "home")).alias("best"), *more).select(by, F.col("best.n").alias("n"), F.col("best.home").alias("home"), *["size"][: len(more)])
    first = written(best(live.withColumnRenamed("key", "home"), "uid"), "jaccard-homes")
    near = written(best(live.select("uid", "key").join(first, "uid"), "key"), "jaccard-homes")
    home = written(best(live.select("uid", "size", "key").join(near, "key"), "uid", F.max("size").alias("size")), "jaccard-homes")
    cells = home.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("cells"))
    member = home.join(written(cells, "jaccard-cells"), "home").select("uid", F.xxhash64("home", F.pmod(F.xxhash64("uid"), "cells")).alias("block"))
    member = written(member, "jaccard-members")
    touched = written(live.select("uid", "key").join(member, "uid").select("key", "block").distinct(), "jaccard-touched")
    pairs = touched.withColumnRenamed("block", "a").join(touched.withColumnRenamed("block", "b"), "key").where("a <= b").select("a", "b").distinct()
    sides = written(pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")), "jaccard-pairs")
    # Without partners in any bucket, a document's text isn't needed again.
    known = written(reps.select("uid", "doc_id", "digest", "copies").join(member, "uid"), "jaccard-known")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(known.hint("merge"), "doc_id")
    blocks = written(packed(texts), "jaccard-blocks")
    rows = sides.join(blocks.hint("merge"), "block").select("a", "b", "packed").repartition("a", "b").sortWithinPartitions("a", "b")
    met = written(compare(rows, threshold), "jaccard-links")
    links = written(met.groupBy(F.col("uid").alias("first_uid")).agg(F.sum("links").alias("links")), "jaccard-counts")
    classes = written(components(met.where("doc_id <> to").select(F.col("doc_id").alias("u"), F.col("to").alias("v")), "jaccard", rounds).withColumnRenamed("node", "first"), "jaccard-classes")
    out = found.select("doc_id", "first", "first_uid", "copies").join(links, "first_uid", "left").join(classes, "first", "left")
    return out.select("doc_id", F.coalesce("component", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class: those with its smallest id, and all rows
    with a null id. Of rows that repeat an id and text, one stays."""
    gone = written(join(docs, id_col, text_col).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct(), "jaccard-gone")
    again = written(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again"), "jaccard-again")
    kept = docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    return kept.join(again, F.col(id_col) == F.col("__again"), "left_anti").unionByName(kept.join(again, F.col(id_col) == F.col("__again"), "left_semi").dropDuplicates([id_col, text_col]))


def op2(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, bit_xor(hash(g)) AS h FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 5 * c >= 4 * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS c FROM d UNION SELECT e.v, r.c FROM r JOIN e ON r.u = e.u WHERE r.c < e.v)
SELECT doc_id, (SELECT min(c) FROM r WHERE r.u = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.u = d.doc_id) AS n_links FROM d
"""
