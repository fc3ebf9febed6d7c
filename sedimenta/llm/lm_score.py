"""Language-model scores by context-tree weighting over bytes, and a smoothed unigram baseline.

A text is its UTF-8 bytes (A to Z lower-cased) and an end byte 0xFF that UTF-8 never has. Every byte is eight binary
decisions; each decision has a tree over the bytes before it, up to DEPTH. A node estimates its decision by
Krichevsky-Trofimov counts; weighting mixes each node's own estimate and its children's half and half, over all depths at
once. With the training counts fixed, the mixture's prediction for a byte is a product of eight weighted sums along one
path, so a model is a table: log10 probability of each (context, byte) that occurs in any document.

The counts of (context, byte) over all training documents are the whole statistics. Nodes of three bytes of context or
more lie within the rows of one triple of last bytes and are worked out there, some triples at a time; sums by their last
two bytes make the level above, sums of these the 256 * 255 nodes of one byte, which go through the driver. The level of
two bytes (at most 255 rows for each pair of bytes that text has) and the HOT most frequent entries of the byte table and
of the word table go to every worker, by files in the shared folder; entries beyond are joined by shuffle, so each text is
scored on all of the model.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Files, WordHashes, qualified, scratch, slices, small_batches, tidied, written

DEPTH, END = 5, 0xFF
#: Entries of each table that every worker holds (at most 64 bytes each); counts a task holds before it passes them on;
#: entries of the byte table that are worked on at once, or a triple's if it has more.
HOT, HELD, AT_ONCE = 1 << 20, 1 << 20, 1 << 18
#: Bytes of texts that are worked on at once: each takes some ten words of eight bytes.
STEP_BYTES = 1 << 19
#: The baseline's pseudo-count.
ALPHA = 0.1
#: The key of the end token among the word hashes.
END_TOKEN = -1
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def raw_bytes(text: str | None) -> bytes:
    return (text or "").encode().translate(_LOWER)


def gram_codes(raw: bytes) -> np.ndarray:
    """For every byte and the end: the DEPTH bytes before it, latest first, then the byte, as one number."""
    x = np.frombuffer(bytes([END]) * DEPTH + raw + bytes([END]), np.uint8).astype(np.uint64)
    n, out = len(raw) + 1, np.zeros(len(raw) + 1, np.uint64)
    for d in range(1, DEPTH + 1):
        out = out << np.uint64(8) | x[DEPTH - d : DEPTH - d + n]
    return out << np.uint64(8) | x[DEPTH:]


def word_keys(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """64-bit hashes of the words (never END_TOKEN)."""
    h = hashes(raw.split()).view(np.int64)
    return np.where(h == END_TOKEN, np.int64(0), h)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def count(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all documents (text, train): kind 0 byte contexts, with n 0 where only held-out texts have
    them; kind 1 words and the end token of training documents. Tasks add up what they hold before they shuffle."""

    def run(batches):
        hashes, held = WordHashes(), {0: [], 1: []}

        def pack(kind):
            keys, n = _sums(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))
            held[kind] = [(keys, n)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])

        for texts, train in slices(batches, STEP_BYTES):
            for learn in (True, False):
                some = [raw_bytes(t) for t, x in zip(texts, train, strict=True) if x == learn]
                if not some:
                    continue
                keys, n = np.unique(np.concatenate([gram_codes(r) for r in some]), return_counts=True)
                held[0].append((keys.view(np.int64), n * learn))
                if learn:
                    keys, n = np.unique(np.concatenate([word_keys(r, hashes) for r in some]), return_counts=True)
                    held[1] += [(keys, n), (np.array([END_TOKEN]), np.array([len(some)]))]
            for kind, parts in held.items():
                if sum(len(k) for k, _ in parts) > HELD:
                    batch = pack(kind)
                    if batch.num_rows > HELD // 2:
                        held[kind] = []
                        yield batch
        for kind, parts in held.items():
            if parts:
                yield pack(kind)

    rows = small_batches(docs.select("text", "train")).mapInArrow(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


_TABLE = 1 << 14
_HALF = np.array([math.lgamma(i + 0.5) for i in range(_TABLE)])
_ONE = np.array([math.lgamma(i + 1.0) for i in range(_TABLE)])


def _log_gamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift): a table for small n, Stirling's series beyond."""
    out = table[np.minimum(n, _TABLE - 1).astype(np.int64)]
    if (n >= _TABLE).any():
        x = np.maximum(n, _TABLE) + shift
        out = np.where(n >= _TABLE, (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3), out)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros, _HALF, 0.5) + _log_gamma(ones, _HALF, 0.5) - math.log(math.pi) - _log_gamma(zeros + ones, _ONE, 1.0)


def _stop(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The posterior weight of a node's own estimate against its children's."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def _mixed(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) - math.log(2)


def levels(codes: np.ndarray, n: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, counts, parents) of depths DEPTH to `least`, keys being context and byte in rising order; parents are places in
    the next level, which drops the oldest byte of the context."""
    out = [(codes, n)]
    for _ in range(DEPTH - least):
        keys, counts = out[-1][:2]
        up, at = np.unique(keys >> np.uint64(16) << np.uint64(8) | (keys & np.uint64(255)), return_inverse=True)
        out[-1] = (keys, counts, at)
        out.append((up, np.bincount(at, counts, len(up))))
    return [*out[:-1], (*out[-1], np.empty(0, np.int64))]


def deep_levels(codes: np.ndarray, n: np.ndarray, least: int):
    """Depths DEPTH to `least` for each of the eight decisions, over sorted entries that share their `least` last bytes.

    Yields (bit of each entry, its weighted probability of a one at depth `least`, its node there, and of the nodes there:
    their context with the decision, zeros, ones, log of the weighted probability). In sorted keys a node's rows lie
    side by side."""
    held = levels(codes, n, least)
    byte = (codes & np.uint64(255)).astype(np.int64)
    for k in range(8):
        shift, last, chance, whole = np.uint64(8 - k), None, None, None
        for keys, counts, parents in held:
            node = keys >> shift
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            set_ = (keys >> np.uint64(7 - k) & np.uint64(1)).astype(np.float64)
            ones = np.add.reduceat(counts * set_, first)
            zeros = np.add.reduceat(counts * (1 - set_), first)
            own, kt = log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
            if last is None:  # the deepest
                row, chance, whole, up = at, kt, own, np.arange(len(first))
            else:
                into = at[last]  # the node here of each node below
                up = into[up]
                below = np.bincount(into, whole, len(first))
                stop = _stop(own, below)
                chance = (stop * kt)[up] + (1 - stop)[up] * chance
                whole = _mixed(own, below)
            last = parents[first] if len(parents) else None
        context = keys[first] >> np.uint64(8) << np.uint64(8)
        decision = np.uint64(1 << k) | (keys[first] & np.uint64(255)) >> shift
        yield byte >> (7 - k) & 1, chance[row], up[row], (context | decision).astype(np.int64), zeros, ones, whole


def top_levels(rows) -> tuple[np.ndarray, np.ndarray]:
    """Depths 1 and 0 from (last byte and decision, zeros, ones, log of the children's weighted probability): the
    chance of a one is a + b * (the chance at depth 2), a and b by last byte and decision."""
    size = 1 << 16
    zeros, ones, below = np.zeros(size), np.zeros(size), np.zeros(size)
    for r in rows:
        zeros[r.node], ones[r.node], below[r.node] = float(r.zeros), float(r.ones), float(r.below)
    own = log_kt(zeros, ones)
    stop, whole = _stop(own, below), _mixed(own, below)
    decision = np.arange(size) & 255
    zeros0, ones0, below0 = (np.bincount(decision, x, 256) for x in (zeros, ones, whole))
    stop0 = _stop(log_kt(zeros0, ones0), below0)
    kt0, kt1 = (ones0 + 0.5) / (zeros0 + ones0 + 1), (ones + 0.5) / (zeros + ones + 1)
    rest = (1 - stop0)[decision]
    return (stop0 * kt0)[decision] + rest * stop * kt1, rest * (1 - stop)


def _node_sums(rows: DataFrame) -> DataFrame:
    """Sums by node. Those of decimals don't hang on the order of rows."""
    return rows.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum(F.col("below").cast("decimal(28,6)")).cast("double").alias("below"))


def _summed(node: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    nodes, at = np.unique(node, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(nodes), *(pa.array(np.bincount(at, x, len(nodes))) for x in columns)], ["node", "zeros", "ones", "below"])


def _upwards(node: np.ndarray) -> np.ndarray:
    """The node with one byte of context less."""
    return node >> 16 << 8 | (node & 255)


def byte_model(counts: DataFrame) -> DataFrame:
    """(key, n, value): log10 of the probability of each context's byte. counts: (key, n)."""
    triple = F.shiftright("key", 8 * (DEPTH - 2))
    dealt = counts.select("key", "n").repartition(triple).sortWithinPartitions("key")

    def entries(batches):
        """Whole triples, AT_ONCE entries or more at a time."""
        keys, n, held = [], [], 0
        for b in batches:
            keys.append(b.column("key").to_numpy().view(np.uint64))
            n.append(b.column("n").to_numpy())
            held += b.num_rows
            if held >= AT_ONCE:
                k, m = np.concatenate(keys), np.concatenate(n)
                cut = int(np.searchsorted(k, k[-1] >> np.uint64(8 * (DEPTH - 2)) << np.uint64(8 * (DEPTH - 2))))
                if cut:
                    yield k[:cut], m[:cut]
                keys, n, held = [k[cut:]], [m[cut:]], len(k) - cut
        if held:
            yield np.concatenate(keys), np.concatenate(n)

    kinds = "node long, zeros double, ones double, below double"

    def up(batches):
        for codes, n in entries(batches):
            for *_, node, zeros, ones, whole in deep_levels(codes, n, 3):
                yield _summed(_upwards(node), zeros, ones, whole)

    two = written(_node_sums(dealt.mapInArrow(up, kinds)), "lm-two")

    def columns(batch):
        return (batch.column(c).to_numpy() for c in ("node", "zeros", "ones", "below"))

    def further(batches):
        for node, zeros, ones, below in (columns(b) for b in batches if b.num_rows):
            yield _summed(_upwards(node), zeros, ones, _mixed(log_kt(zeros, ones), below))

    a, b = top_levels(_node_sums(two.mapInArrow(further, kinds)).collect())  # at most 256 * 255 rows

    def lines(batches):
        for node, zeros, ones, below in (columns(x) for x in batches if x.num_rows):
            stop, one = _stop(log_kt(zeros, ones), below), _upwards(node)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(a[one] + b[one] * stop * (ones + 0.5) / (zeros + ones + 1)), pa.array(b[one] * (1 - stop))], ["node", "a", "b"])

    path = scratch(counts.sparkSession, "lm-lines")
    two.mapInArrow(lines, "node long, a double, b double").write.parquet(path)
    path = qualified(counts.sparkSession, path)

    def down(batches):
        nodes, a2, b2 = read_columns(path, ("node", "a", "b"))
        for codes, n in entries(batches):
            value = np.zeros(len(codes))
            for bit, chance, at, node, *_ in deep_levels(codes, n, 3):
                line = np.searchsorted(nodes, _upwards(node))[at]
                one = a2[line] + b2[line] * chance
                value += np.log10(np.where(bit == 1, one, 1 - one))
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n), pa.array(value)], ["key", "n", "value"])

    return dealt.mapInArrow(down, "key long, n long, value double")


def hot_table(table: DataFrame, name: str) -> str:
    """Writes (key, value) of the entries with the highest n, HOT at most, to the shared folder; gives the folder.

    Entries are cut by eighths of a power of two of n, so no order is needed and nothing passes through the driver but
    the number of entries in each step."""
    step = F.floor(F.log2(F.col("n") + 1) * 8).cast("int")
    sizes = sorted(table.groupBy(step.alias("step")).agg(F.count("*").alias("entries")).collect(), key=lambda r: -r.step)  # at most 8 * 64
    least, held = 1 << 30, 0
    for r in sizes:
        held += r.entries
        if held > HOT:
            break
        least = r.step
    path = scratch(table.sparkSession, name)
    table.where(step >= least).select("key", "value").coalesce(4).write.parquet(path)
    return qualified(table.sparkSession, path)


@lru_cache(maxsize=1)
def read_columns(folder: str, names: tuple[str, ...]) -> list[np.ndarray]:
    """Columns of a table in the shared folder, by rising values of the first."""
    import pyarrow.parquet as pq

    files = Files(folder)
    rows = pq.read_table(files.root, filesystem=files.fs, columns=list(names))
    columns = [rows[c].to_numpy() for c in names]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


class Hot:
    """Values of keys, by a hash table of PROBES places a key. A key that finds none free is left out; who looks it up
    learns that it isn't there and asks the whole model."""

    PROBES = 6

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) - 1).bit_length())
        self.empty = next(x for x in range(-2, -3 - len(keys), -1) if not (keys == x).any())
        self.keys, self.values = np.full(1 << self.bits, self.empty, np.int64), np.zeros(1 << self.bits)
        at = self._place(keys)
        for _ in range(self.PROBES):
            slots, first = np.unique(np.where(self.keys[at] == self.empty, at, -1), return_index=True)
            slots, first = slots[slots >= 0], first[slots >= 0]
            self.keys[slots], self.values[slots] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.keys) - 1)
            if not len(keys):
                break

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is held, its value or 0) of every key."""
        at = self._place(keys)
        there = self.keys[at]
        hit = (there == keys) & (keys != self.empty)
        out = np.where(hit, self.values[at], 0.0)
        rest = np.flatnonzero(~hit & (there != self.empty))
        for _ in range(self.PROBES - 1):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            there = self.keys[at[rest]]
            found = (there == keys[rest]) & (there != self.empty)
            hit[rest[found]] = True
            out[rest[found]] = self.values[at[rest[found]]]
            rest = rest[~found & (there != self.empty)]
        return hit, out


@lru_cache(maxsize=2)
def read_hot(folder: str) -> Hot:
    """The table, once a worker."""
    return Hot(*read_columns.__wrapped__(folder, ("key", "value")))


@tidied
def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row; train is a boolean
    column of docs.

    score is the log10 probability of the text, end included; bits_per_byte the code length that it gives to each of
    n_bytes bytes and the end; base_score the log10 probability of its words and the end token under the smoothed unigram model. A null text is empty: only the end. A null train counts as true. Repeated rows each give a
    row and count as often. Without training texts every decision is even and words are unknown. Other columns aren't
    read. Texts are scored whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    counts = written(count(rows), "lm-counts")
    model = written(byte_model(counts.where("kind = 0")), "lm-bytes")
    tokens, kinds = counts.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    over = tokens + ALPHA * (kinds + 1)
    word_model = counts.where("kind = 1").select("key", "n", F.log10((F.col("n") + ALPHA) / over).alias("value"))
    unknown = math.log10(ALPHA / over)
    hot = [hot_table(model, "lm-hot-bytes"), hot_table(word_model, "lm-hot-words")]

    def run(batches):
        from pyspark import TaskContext

        tables, hashes, uid = [read_hot(h) for h in hot], WordHashes(), TaskContext.get().partitionId() << 33
        names = ["uid", "doc_id", "n_tokens", "n_bytes", "n_known", "base", "score", "kind", "key", "n"]
        for doc_ids, texts, _ in slices(batches, STEP_BYTES):
            size = len(texts)
            raw = [raw_bytes(t) for t in texts]
            sums, known, cold = np.zeros((2, size)), np.zeros(size, np.int64), []
            words = [np.append(word_keys(r, hashes), END_TOKEN) for r in raw]
            for kind, columns in ((0, [gram_codes(r).view(np.int64) for r in raw]), (1, words)):
                flat, owner = np.concatenate(columns), np.repeat(np.arange(size), [len(c) for c in columns])
                hit, value = tables[kind].find(flat)
                sums[kind] = np.bincount(owner, value, size)
                if kind:
                    known = np.bincount(owner[hit], minlength=size)
                flat, owner = flat[~hit], owner[~hit]
                order = np.lexsort((flat, owner))
                flat, owner = flat[order], owner[order]
                first = np.flatnonzero(np.concatenate(([True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])))) if len(flat) else np.empty(0, np.int64)
                cold.append((owner[first], np.full(len(first), kind, np.int32), flat[first], np.diff(np.append(first, len(flat)))))
            rows_ = [pa.array(np.arange(uid, uid + size)), pa.array(doc_ids, kind_of), pa.array([len(w) for w in words], pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(known), pa.array(sums[1]), pa.array(sums[0]), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows_, names)
            of, kind, keys, n = (np.concatenate(x) for x in zip(*cold, strict=True))
            if len(of):
                none = lambda t: pa.nulls(len(of), t)
                yield pa.RecordBatch.from_arrays([pa.array(of + uid), none(kind_of), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()), pa.array(kind), pa.array(keys), pa.array(n)], names)
            uid += size

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType
    kind_of = to_arrow_type(id_type)
    parts = written(small_batches(rows).mapInArrow(run, f"uid long, doc_id {id_type.simpleString()}, n_tokens long, n_bytes long, n_known long, base double, score double, kind int, key long, n long"), "lm-parts")
    cold = parts.where("kind is not null").select("uid", "kind", "key", F.col("n").alias("times"))
    whole = model.select(F.lit(0).alias("kind"), "key", "value").union(word_model.select(F.lit(1), "key", "value"))
    cold = cold.join(whole, ["kind", "key"], "left").select("uid", F.when(F.col("kind") == 0, F.col("value") * F.col("times")).alias("score"), F.when(F.col("kind") == 1, F.coalesce("value", F.lit(unknown)) * F.col("times")).alias("base"), F.when((F.col("kind") == 1) & F.col("value").isNotNull(), F.col("times")).alias("n_known"))
    both = parts.where("kind is null").select("uid", "doc_id", "n_tokens", "n_bytes", "n_known", "base", "score")
    both = both.unionByName(cold, allowMissingColumns=True).groupBy("uid").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_bytes", "n_known", "base", "score")])
    return both.select(F.col("doc_id").alias(id_col), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", "n_bytes", (-F.col("score") / (math.log10(2) * (F.col("n_bytes") + 1))).alias("bits_per_byte"))


def held_out(id_col: str = "doc_id"):
    """True for the tenth of documents that is only scored; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op5(spark, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
