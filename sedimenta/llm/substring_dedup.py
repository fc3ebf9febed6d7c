"""Substring dedup: passages of 50 words or more that an earlier document has are cut from later ones.

1. scan: every document gives a fingerprint of its words and its marks: of each 50-word window, the smallest hash of 8
   consecutive words in it. Equal windows have equal marks. Of documents with the same words only the first goes on.
2. confirm: documents with marks that recur give the 128-bit hashes of the windows behind them; windows of two
   documents or more recur, and the smallest doc_id owns them.
3. compile: the owned windows of a document join into passages, cut into segments of limited length. Phrases of 10
   words every 41 words of a segment make up the automata: any 50-word window of a segment holds one of them whole.
4. stream: documents are dealt out in buckets; each bucket gets the segments whose marks its documents have, compiles
   its own Aho-Corasick automaton, and runs its documents through it. Around each phrase that is met, the document's
   windows are looked up by their 128-bit hashes among those of the segments. A mark of over COMMON segments (a phrase
   that stands in many passages) brings only those whose windows the bucket has. So a bucket holds at most COMMON
   segments for each of its marks and one for each of its windows, whatever the corpus holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, map_rows, rolling, slices, small_batches, tidied, written

SPAN, K = 50, 8
PHRASE, STRIDE = 10, 41
LETTERS = np.uint64(0x7FFFFFFF)
#: Windows that start in one segment; bytes of text in a bucket.
STARTS, BUCKET = 150, 5 << 20
#: Segments of a mark beyond which windows deal them out: a mark lies in up to so many windows, so that with fewer
#: segments these are the fewer rows.
COMMON = SPAN - K + 1


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() cuts at exactly the six ASCII white-space characters."""
    return (text or "").encode().split()


def window_marks(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of K words in each window of SPAN words."""
    h, width = rolling(hashes, K), SPAN - K + 1
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    low, reach = h, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return np.minimum(low[:n], low[width - reach : width - reach + n])


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def make():
        hashes = WordHashes()

        def step(columns):
            n, sums, marks = [], [], []
            for doc_id, text, _ in zip(*columns, strict=True):
                w = words_of(text)
                n.append(len(w))
                sums.append(hashlib.sha256(b" ".join(w)).digest())
                marks.append(np.unique(window_marks(hashes(w))).view(np.int64) if doc_id is not None and len(w) >= SPAN else [])
            return [columns[0], columns[2], n, sums, marks]

        return step

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col)), make, "doc_id long, text_hash long, n_words long, sha binary, marks array<long>")


def confirm(texts: DataFrame) -> DataFrame:
    """(h1, h2, owner) of the windows that recur. texts: (doc_id, text, marks), the marks being those that recur."""

    def run(batches):
        hashes = WordHashes()
        for columns in slices(batches):
            for doc_id, text, marks in zip(*columns, strict=True):
                h = hashes(words_of(text))
                here = np.isin(window_marks(h), np.array(marks, np.int64).view(np.uint64))
                if here.any():
                    pairs = np.unique(np.stack([rolling(h, SPAN, s)[here] for s in (0, 1)], 1).view(np.int64), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), doc_id, np.int64))], ["h1", "h2", "doc_id"])

    rows = small_batches(texts.select("doc_id", "text", "marks")).mapInArrow(run, "h1 long, h2 long, doc_id long")
    return rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("h1", "h2", "owner")


def segments(texts: DataFrame) -> DataFrame:
    """(seg, owner, words, marks) of the passages. texts: (doc_id, text, owned), owned being hashes of owned windows."""

    def run(batches):
        hashes = WordHashes()
        kinds = pa.schema([("seg", pa.string()), ("owner", pa.int64()), ("words", pa.string()), ("marks", pa.list_(pa.int64()))])
        for columns in slices(batches):
            for doc_id, text, owned in zip(*columns, strict=True):
                w = words_of(text)
                h = hashes(w)
                starts = np.flatnonzero(np.isin(rolling(h, SPAN, 0), np.array(owned, np.int64).view(np.uint64)))
                marks, out = window_marks(h), []
                for run_of in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    for at in range(0, len(run_of), STARTS):
                        first, last = int(run_of[at]), int(run_of[min(at + STARTS, len(run_of)) - 1])
                        out.append((f"{doc_id}:{first}:{hash_of(text)}", doc_id, b" ".join(w[first : last + SPAN]).decode(), np.unique(marks[first : last + 1]).view(np.int64).tolist()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return small_batches(texts.select("doc_id", "text", "owned")).mapInArrow(run, "seg string, owner long, words string, marks array<long>")


def marked_windows(rows: DataFrame) -> DataFrame:
    """(key, h1) of each window whose mark is one of the row's. rows: (key, text, marks)."""

    def run(batches):
        hashes = WordHashes()
        for columns in slices(batches):
            for key, text, marks in zip(*columns, strict=True):
                h = hashes(words_of(text))
                here = np.isin(window_marks(h), np.array(marks, np.int64).view(np.uint64))
                found = np.unique(rolling(h, SPAN)[here]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array(found)], ["key", "h1"])

    return small_batches(rows.select("key", "text", "marks")).mapInArrow(run, "key string, h1 long")


def dealt_segments(parts: DataFrame, texts: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """(seg, bucket): which bucket gets which segment. parts: (seg, words, marks), texts: (doc_id, text), marks: those of
    each document (doc_id, marks)."""
    bucket = bucket_of("doc_id", buckets)
    has = written(marks.select("doc_id", bucket, F.explode("marks").alias("mark")), "repeat-doc-marks")
    of = written(parts.select("seg", F.explode("marks").alias("mark")), "repeat-segment-marks")
    common = written(of.groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("mark"), "repeat-common")
    some = of.join(common, "mark", "left_anti").join(has.select("bucket", "mark").distinct(), "mark").select("seg", "bucket")
    # Both sides by window: a window has one owner, and so about one segment.
    own = lambda rows, by: rows.join(common, "mark", "left_semi").groupBy(by).agg(F.collect_set("mark").alias("marks"))  # noqa: E731  of one text
    there = marked_windows(texts.select("doc_id", "text").join(own(has, "doc_id"), "doc_id").select(bucket.cast("string").alias("key"), "text", "marks")).distinct()
    here = marked_windows(parts.select("seg", "words").join(own(of, "seg"), "seg").select(F.col("seg").alias("key"), F.col("words").alias("text"), "marks"))
    rest = here.withColumnRenamed("key", "seg").join(there, "h1").select("seg", F.col("key").cast("int").alias("bucket"))
    return some.union(rest).distinct()


def hash_of(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:12]


class Automaton:
    """The phrases of a bucket's segments with the hashes of their windows: finds the documents' words that they cover."""

    def __init__(self, parts: list[tuple[int, str]], hashes: WordHashes):
        import ahocorasick

        # Letters are 31-bit word hashes: a node a word, not a character. What only shares letters is told apart below.
        self.automaton, words, ends, owners = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE), [], [], []
        for owner, text in parts:
            h = hashes(text.encode().split())
            letters = (h & LETTERS).tolist()
            for at in range(0, len(h) - PHRASE + 1, STRIDE):
                self.automaton.add_word(tuple(letters[at : at + PHRASE]))
            words.append(h)
            owners.append(np.full(len(h), owner))
            ends.append((ends[-1] if ends else 0) + len(h))
        self.empty = not parts
        if self.empty:
            return
        self.automaton.make_automaton()
        # All segments' windows at once, less those that run over the end of a segment.
        one, two = (rolling(np.concatenate(words), SPAN, s) for s in (0, 1))
        owners = np.concatenate(owners)
        inside = np.ones(len(owners), bool)
        for end in ends:
            inside[end - SPAN + 1 : end] = False
        inside = inside[: len(one)]
        order = np.argsort(one[inside], kind="stable")
        self.one, self.two, self.owner = one[inside][order], two[inside][order], owners[: len(one)][inside][order]

    def covered(self, doc_id: int, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        if self.empty or len(h) < SPAN:
            return out
        found = [end for end, _ in self.automaton.iter(tuple((h & LETTERS).tolist()))]
        if not found:
            return out
        places = np.array(found) - PHRASE + 1
        # A window that repeats a segment's holds one of its phrases whole.
        near = np.zeros(len(h) + 1, np.int64)
        np.add.at(near, np.maximum(places - (SPAN - PHRASE), 0), 1)
        np.add.at(near, places + 1, -1)
        starts = np.flatnonzero(np.cumsum(near)[: len(h) - SPAN + 1])
        one, two = rolling(h, SPAN, 0)[starts], rolling(h, SPAN, 1)[starts]
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        starts = starts[(self.one[at] == one) & (self.two[at] == two) & (self.owner[at] < doc_id)]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + SPAN, -1)
        return np.cumsum(cover)[:-1] > 0


def stream(parts: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, sha, n_removed, kept) of the documents that lose words. parts: (bucket, owner, words); texts: (doc_id, text)."""
    rows = parts.select("bucket", F.lit(0).alias("role"), F.col("owner").alias("doc_id"), F.col("words").alias("text"))
    rows = rows.union(texts.select(bucket_of("doc_id", buckets), F.lit(1), "doc_id", "text"))
    rows = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "role")  # a bucket, a task

    def run(batches):
        hashes, now, held, automaton = WordHashes(), None, [], None
        kinds = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("n_removed", pa.int64()), ("kept", pa.string())])
        for columns in slices(batches):
            out = []
            for bucket, role, doc_id, text in zip(*columns, strict=True):
                if bucket != now:
                    now, held, automaton = bucket, [], None
                if role == 0:
                    held.append((doc_id, text))
                    continue
                if automaton is None:
                    automaton, held = Automaton(held, hashes), []
                w = words_of(text)
                gone = automaton.covered(doc_id, hashes(w))
                if gone.any():
                    kept = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
                    out.append((doc_id, hashlib.sha256(b" ".join(w)).digest(), int(gone.sum()), kept.decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return small_batches(rows).mapInArrow(run, "doc_id long, sha binary, n_removed long, kept string")


def bucket_of(col: str, buckets: int):
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int").alias("bucket")


@tidied
def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, sha, n_words, n_removed, kept) for every row of docs; kept is null where nothing goes.

    Words are runs without ASCII white space. A word goes if it lies in a window of 50 words that also starts in a
    document with a smaller doc_id; windows are those of the input. sha is the SHA-256 of the words joined by one space.
    A null or empty text has no words. Rows with a null id lose nothing and make others lose nothing. Rows that share
    an id (with equal texts or not) don't cut each other. Other columns aren't read.
    """
    found = written(scan(docs, id_col, text_col), "repeat-scan")
    twins = written(found.where(f"doc_id is not null and n_words >= {SPAN}").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first"), "repeat-twins")
    found = written(found.join(twins, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first"), "repeat-copies")
    marks = found.where("not copy").select("doc_id", F.explode("marks").alias("mark"))
    again = written(marks.groupBy("mark").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("mark"), "repeat-marks")
    marks = written(marks.join(again, "mark").groupBy("doc_id").agg(F.collect_set("mark").alias("marks")), "repeat-doc-marks")  # of one document
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    texts = written(texts.join(marks, "doc_id").select("doc_id", "text", "marks"), "repeat-texts")
    owned = written(confirm(texts), "repeat-windows").groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("h1").alias("owned"))  # of one document
    parts = written(segments(texts.select("doc_id", "text").join(owned, "doc_id")), "repeat-segments")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET))
    dealt = dealt_segments(parts, texts, marks, buckets)
    cut = written(stream(dealt.join(parts.select("seg", "owner", "words"), "seg"), texts, buckets), "repeat-cuts")
    cut = cut.dropDuplicates(["doc_id", "sha"]).withColumnRenamed("doc_id", "cut_id").withColumnRenamed("sha", "cut_sha").withColumnRenamed("n_removed", "cut_n").withColumnRenamed("kept", "cut_kept")
    out = found.join(cut, (F.col("doc_id") == F.col("cut_id")) & (F.col("sha") == F.col("cut_sha")), "left")
    return out.select("doc_id", "text_hash", "sha", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut_n", F.lit(0))).cast("long").alias("n_removed"), F.when(F.col("copy"), "").otherwise(F.col("cut_kept")).alias("kept"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, less the repeated words: a text that loses words is its kept words joined
    by one space, one that loses all goes. Other texts stay as they are; n_chars, if there is such a column, follows."""
    cut = repeats(docs, id_col, text_col).where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("kept").alias("__kept")).dropDuplicates(["__id", "__hash"])
    out = docs.join(cut, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left").where("__kept is null or __kept <> ''")
    changed = {text_col: F.coalesce("__kept", text_col)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__kept")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    out = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept", 256), F.lower(F.hex("sha"))).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(k)),
f AS (SELECT h, min(doc_id) AS owner FROM g GROUP BY h),
x AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM g JOIN f USING (h) WHERE owner < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN x USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
