"""Benchmark decontamination by winnowing, in DataFrame functions only.

Each text keeps, of every WINDOW consecutive hashes of K words, the smallest (the first of equals). A span of
K + WINDOW - 1 = 13 words that two texts share has the same smallest hash in both, so joining the kept hashes finds every
shared span of 13 words or more. Each hit lines the two texts up; comparing them word by word along that line extends
it to all shared windows and leaves out what only shares a hash. Items of fewer than 13 words are one window each:
for each length that occurs, documents keep the hash of every run of so many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidied, written

SPAN, K = 13, 5
WINDOW = SPAN - K + 1
#: Fingerprints of the benchmark up to which they are broadcast (about 40 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 300_000
#: A fingerprint: 35 bits of hash over 28 bits of place.
PLACE = 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _runs(n: int, kind: int) -> str:
    """SQL: hash and place of every run of n words of the column w."""
    taken = ", ".join(f"get(w, i + {j})" for j in range(n))
    return f"transform(sequence(0, size(w) - {n}), i -> shiftleft(xxhash64({kind}, {taken}) & {(1 << 35) - 1}L, {PLACE}) | i)"


def _fingerprints(rows: DataFrame, short: list[int]) -> DataFrame:
    """Adds fp, the fingerprints of the words w."""
    rows = rows.withColumn("h", F.expr(f"if(size(w) >= {SPAN}, {_runs(K, 0)}, array())"))
    kept = f"array_distinct(if(size(h) > 0, transform(sequence(1, size(h) - {WINDOW - 1}), i -> array_min(slice(h, i, {WINDOW}))), array()))"
    more = [f"if(size(w) >= {n}, {_runs(n, n)}, array())" for n in short]
    return rows.withColumn("fp", F.expr(f"concat({', '.join([kept, *more])})")).drop("h")


@tidied
def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, text_hash, n_words, n_hit, n_items, item_ids, contaminated) for every row of docs.

    Words are runs of letters A to Z (lower-cased), digits and characters beyond ASCII. A null or empty text has
    no words and no hits. A document word is hit if it lies in any occurrence of a window of an item. item_ids: the
    items with such windows, as sorted strings; an item with a null id hits but isn't listed. Rows that repeat an
    id and text get equal results; rows that share only the id (null too) are judged apart. Other columns aren't read.
    """
    items = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w")).where("size(w) > 0").distinct()
    items = written(items.withColumn("item_key", F.xxhash64("item_id", "w")), "benchmark-items")
    short = [r.n for r in items.where(f"size(w) < {SPAN}").selectExpr("size(w) AS n").distinct().orderBy("n").collect()]  # below SPAN
    whole = _fingerprints(items.where(f"size(w) >= {SPAN}"), [])
    parts = [whole] + [items.where(f"size(w) = {n}").withColumn("fp", F.expr(_runs(n, n))) for n in short]
    marks = parts[0].select("item_key", F.size("w").alias("n_item"), F.explode("fp").alias("fp"))
    for p in parts[1:]:
        marks = marks.union(p.select("item_key", F.size("w").alias("n_item"), F.explode("fp").alias("fp")))
    marks = marks.selectExpr("item_key", "n_item", f"shiftright(fp, {PLACE}) AS mark", f"cast(fp & {(1 << PLACE) - 1}L as int) AS item_at")
    # A mark that every document has: it carries the documents themselves through the join.
    marks = written(marks.union(docs.sparkSession.createDataFrame([(None, None, -1, None)], marks.schema)), "benchmark-marks")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    rows = _fingerprints(rows, short).select("doc_id", "text_hash", "w", F.explode(F.expr("concat(array(-1L), fp)")).alias("fp"))
    rows = rows.selectExpr("doc_id", "text_hash", "w", f"shiftright(fp, {PLACE}) AS mark", f"cast(fp & {(1 << PLACE) - 1}L as int) AS at")
    small = marks.count() <= BROADCAST_ROWS
    line = ["doc_id", "text_hash", "item_key", "n_item", "at - item_at AS start"]
    cut = "slice(w, greatest(start, 0) + 1, least(size(w), start + n_item) - greatest(start, 0))"
    if small:
        met = rows.join(F.broadcast(marks), "mark").selectExpr(*line, "w").selectExpr("doc_id", "text_hash", "item_key", "n_item", "start", "if(item_key is null, size(w), null) AS n_words", f"if(item_key is null, null, {cut}) AS part")
        met = written(met, "benchmark-hits")
        base = met.where("item_key is null")
        hits = met.where("item_key is not null").dropDuplicates(["doc_id", "text_hash", "item_key", "start"])
    else:
        # Words don't travel with the fingerprints here; the lined-up documents get theirs by a second join.
        base = written(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.size(words(F.col(text_col))).alias("n_words")), "benchmark-base")
        met = rows.drop("w").join(marks.where("mark >= 0"), "mark").selectExpr(*line).distinct()
        again = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).dropDuplicates(["doc_id", "text_hash"])
        met = met.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "t")
        met = met.join(again, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_hash"))).withColumn("w", words(F.col("text")))
        hits = met.selectExpr("doc_id", "text_hash", "item_key", "n_item", "start", f"{cut} AS part")
    words_of = items.select("item_key", "item_id", F.col("w").alias("item_words"))
    hits = hits.join(F.broadcast(words_of) if small else words_of, "item_key")
    hits = hits.withColumn("same", F.expr("zip_with(slice(item_words, greatest(-start, 0) + 1, size(part)), part, (a, b) -> a = b)")).withColumn("span", F.expr(f"least({SPAN}, n_item)"))
    runs = "filter(sequence(1, size(same) - span + 1), i -> forall(slice(same, i, span), x -> x))"
    hits = hits.selectExpr("doc_id", "text_hash", "item_id", "start", "span", f"if(size(same) >= span, {runs}, array()) AS runs").where("size(runs) > 0")
    hits = written(hits.selectExpr("doc_id", "text_hash", "item_id", "array_distinct(flatten(transform(runs, i -> sequence(greatest(start, 0) + i, greatest(start, 0) + i + span - 1)))) AS places"), "benchmark-spans")
    counts = hits.select("doc_id", "text_hash", F.explode("places").alias("place")).distinct().groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    found = hits.select("doc_id", "text_hash", F.col("item_id").cast("string").alias("item_id")).distinct().groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    both = counts.join(found, counts.doc_id.eqNullSafe(found.doc_id) & (counts.text_hash == found.text_hash)).select(counts.doc_id.alias("hit_doc"), counts.text_hash.alias("hit_text"), "n_hit", "item_ids")
    out = base.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words")).join(both, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_hash") == F.col("hit_text")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("doc_id").alias(id_col), "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs: one passage of a benchmark spoils a
    text however long it is. Null and empty texts stay."""
    bad = contamination(docs, items, id_col, text_col).where("n_hit > 0").select(F.col(id_col).alias("__bad_id"), F.col("text_hash").alias("__bad_text")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad_id")) & (F.xxhash64(text_col) == F.col("__bad_text")), "left_anti")


def op6(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(k) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(k)),
m AS (SELECT doc_id, item_id, dw.n AS n, k FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
