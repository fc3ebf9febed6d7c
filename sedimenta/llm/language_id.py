"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. Shifting (permuting) the vectors of n consecutive letters by their place
and multiplying (binding) them gives the vector of the n-gram; adding (bundling) those of a text gives its profile. A
language's prototype is the bundle of its texts, a text's language that of the prototype with the highest cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, small_batches

#: Dimensions of a profile; letters in an n-gram; symbols: 0 stands for any run of what is no letter, then a to z, and
#: the other letters share the rest.
DIMENSIONS, GRAM, SYMBOLS, SEED = 2048, 3, 128, 20240229
#: Letters that are worked on at once, and n-gram kinds whose vectors are made at once.
SLAB, KINDS = 1 << 19, 2048
UNKNOWN = "und"
#: Where documents are kept or not: the score below which no text counts as in a known language; how much of the lowest score
#: of learned texts of its length (by powers of two) a text needs besides; and how many of them a length needs, else the
#: next shorter length counts.
LEAST, SHARE, ENOUGH = 0.05, 0.9, 30


def symbol_table() -> np.ndarray:
    """The symbol of each code point. Case is folded; letters outside a to z are dealt out by code point."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            o = ord(low[0])
            table[c] = o - 96 if 97 <= o <= 122 else 27 + o % (SYMBOLS - 27)
    return table


class Profiles:
    """Bundles of n-gram vectors of texts."""

    def __init__(self):
        self.table = symbol_table()
        rng = np.random.default_rng(SEED)
        letters = rng.integers(0, 2, (SYMBOLS, DIMENSIONS), np.int8) * 2 - 1
        self.placed = [np.roll(letters, GRAM - 1 - i, axis=1).astype(np.int8) for i in range(GRAM)]
        self.kinds = SYMBOLS**GRAM

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """The bound vectors of n-gram codes."""
        out = np.ones((len(grams), DIMENSIONS), np.int8)
        for i in range(GRAM):
            out *= self.placed[i][grams // SYMBOLS ** (GRAM - 1 - i) % SYMBOLS]
        return out.astype(np.float32)

    def codes(self, text: str):
        """N-gram codes of a text, in slabs, each n-gram once; nothing at all if it has no letter. The text's ends count as
        no letter, and a run of what is no letter as one symbol, over the borders of slabs too."""
        held = np.zeros(1, np.uint8)
        for at in range(0, len(text), SLAB):
            s = self.table[np.frombuffer(text[at : at + SLAB].encode("utf-32-le", "replace"), np.uint32)]
            s = np.concatenate((held, s, [0] * (at + SLAB >= len(text)))).astype(np.int32)
            s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
            n = len(s) - GRAM + 1
            if n > 0:
                yield sum(s[i : i + n] * SYMBOLS ** (GRAM - 1 - i) for i in range(GRAM))
            held = s[max(0, len(s) - GRAM + 1) :]

    def bundle(self, rows: list[int], codes: list[np.ndarray], n: int) -> np.ndarray:
        """Sums of n-gram vectors: row i of the result takes those codes whose entry in rows is i."""
        out = np.zeros((n, DIMENSIONS), np.float64)
        if not codes:
            return out
        flat = np.concatenate(codes)
        owner = np.repeat(np.array(rows), [len(c) for c in codes])
        kinds = np.flatnonzero(np.bincount(flat, minlength=self.kinds))
        place = np.zeros(self.kinds, np.int32)
        place[kinds] = np.arange(len(kinds))
        at = place[flat]
        for first in range(0, len(kinds), KINDS):
            some = kinds[first : first + KINDS]
            here = (at >= first) & (at < first + len(some)) if len(kinds) > KINDS else slice(None)
            counts = np.bincount(owner[here] * len(some) + at[here] - first, minlength=n * len(some)).reshape(n, len(some))
            out += counts.astype(np.float32) @ self.vectors(some)
        return out

    def of(self, texts: list[str | None]):
        """(rows, profiles) over slices of the texts."""
        rows, codes, held, first = [], [], 0, 0
        for i, t in enumerate(texts):
            for c in self.codes(t or ""):
                rows.append(i - first)
                codes.append(c)
                held += len(c)
            if held >= SLAB or i + 1 - first >= 256:
                yield range(first, i + 1), self.bundle(rows, codes, i + 1 - first)
                rows, codes, held, first = [], [], 0, i + 1
        if first < len(texts):
            yield range(first, len(texts)), self.bundle(rows, codes, len(texts) - first)


@lru_cache(maxsize=1)
def worker_profiles() -> Profiles:
    return Profiles()


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of each language: the bundle of all its labelled texts. Rows with a null text or language are left
    out. Sums are of integers, so the result doesn't hang on the order of rows. The driver gets one vector a language."""

    def run(batches):
        profiles, sums = worker_profiles(), {}
        for texts, langs in slices(batches):
            names = sorted(set(langs))
            codes = [(names.index(l), c) for t, l in zip(texts, langs, strict=True) for c in profiles.codes(t)]
            if codes:
                for name, x in zip(names, profiles.bundle(*map(list, zip(*codes, strict=True)), len(names)), strict=True):
                    sums[name] = sums.get(name, 0) + x.astype(np.int64)
        for name, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([x.tolist()], pa.list_(pa.int64()))], ["lang", "profile"])

    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parts = small_batches(rows).mapInArrow(run, "lang string, profile array<long>")
    sums = parts.select("lang", F.posexplode("profile").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages times DIMENSIONS
        out.setdefault(r.lang, np.zeros(DIMENSIONS))[r.at] = r.x
    return {k: v for k, v in sorted(out.items()) if v.any()}


def unit_rows(prototypes: dict[str, np.ndarray]) -> np.ndarray:
    return np.array([x / np.linalg.norm(x) for x in prototypes.values()]).reshape(len(prototypes), DIMENSIONS)


def nearest(x: np.ndarray, names: list[str], rows: np.ndarray) -> tuple[list[str], list[float]]:
    """The language and cosine of each profile."""
    norm = np.sqrt((x * x).sum(1))
    if not names:
        return [UNKNOWN] * len(x), [0.0] * len(x)
    cosines = (x @ rows.T) / np.where(norm, norm, 1)[:, None]
    best = cosines.argmax(1)
    top = cosines[np.arange(len(x)), best]
    return [names[k] if size else UNKNOWN for k, size in zip(best.tolist(), norm.tolist(), strict=True)], np.where(norm > 0, top.clip(0, 1), 0).tolist()


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row; score is the cosine with the prototype, 0 to 1.

    A text that is null, empty or without letters gets `und` and 0; so do all texts if nothing was learned. Of equal
    cosines, the language first in the alphabet wins. Repeated rows, and a null id, each give a row. Other columns
    aren't read. Long texts are worked through in slabs, whole.
    """
    names, rows = list(prototypes), unit_rows(prototypes)

    def make():
        profiles = worker_profiles()

        def step(columns):
            langs, scores = [], []
            for _, x in profiles.of(columns[1]):
                for out, more in zip((langs, scores), nearest(x, names, rows), strict=True):
                    out += more
            return [columns[0], langs, scores]

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, lang_pred string, score double")


def score_bounds(labelled: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang") -> list[float]:
    """The score that keep_known() wants of a text, by the power of two of its length: SHARE of the lowest that a learned
    text of that length has which is told rightly, over all labelled rows. A length with fewer than ENOUGH of them takes
    the bound of the next shorter one, as scores rise with length; without any it is LEAST, and never less. The driver
    gets a row a length."""
    rows = labelled.where((F.length(text_col) > 0) & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    names, units = list(prototypes), unit_rows(prototypes)

    def make():
        profiles = worker_profiles()

        def step(columns):
            texts, langs = columns
            found = [x for _, p in profiles.of(texts) for x in zip(*nearest(p, names, units), strict=True)]
            kept = [(len(t).bit_length() - 1, score) for t, lang, (name, score) in zip(texts, langs, found, strict=True) if lang == name]
            return [[k for k, _ in kept], [x for _, x in kept]]

        return step

    lows = map_rows(rows, make, "length int, score double")
    seen = {r.length: r for r in lows.groupBy("length").agg(F.count("*").alias("n"), F.min("score").alias("low")).collect()}  # at most 32
    out = []
    for length in range(32):
        r = seen.get(length)
        out.append(max(LEAST, SHARE * r.low) if r and r.n >= ENOUGH else out[-1] if out else LEAST)
    return out


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], bounds: list[float] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a learned language: with the score that bounds (of
    score_bounds()) wants for its length, or LEAST without them. Null and letterless texts go. Rows are judged where
    they are; nothing is shuffled."""
    names = list(prototypes)
    bounds = bounds or [LEAST] * 32

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text), bool)
        profiles, at, texts = worker_profiles(), 0, text.tolist()
        for _, x in profiles.of(texts):
            found = zip(texts[at : at + len(x)], *nearest(x, names, rows), strict=True)
            out[at : at + len(x)] = [lang != UNKNOWN and score >= bounds[len(t).bit_length() - 1] for t, lang, score in found]
            at += len(x)
        return pd.Series(out)

    rows = unit_rows(prototypes)
    return small_batches(docs).where(known(F.col(text_col)))


def held_out(id_col: str = "doc_id"):
    """True for the quarter of documents that is not learned from; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
