"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of tokens and of API symbols.
TOKEN = r"[A-Za-zА-Яа-я0-9_./#+-]+"
SYMBOL = r"\b(?:CKR|CKA|CKO|CKM|CKU|CKF)_[A-Z0-9_]+\b|\bC_[A-Za-z0-9_]+\b|\brt[A-Za-z0-9_]+\b"
SPACE = r"(?U)\s"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """Token runs, then lower-cased: the pattern sees the text as it is."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def symbols(text: Column) -> Column:
    """Distinct API symbols in order of appearance; case matters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?U){SYMBOL}"), F.lit(0)))


def clean_inline(text: Column) -> Column:
    """Images go, links keep their label, marks and escapes go, white space becomes single spaces."""
    out = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]+\)", "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    for mark, instead in (("**", ""), ("__", ""), ("`", ""), ("\\#", "#"), ("\\_", "_")):
        out = F.replace(out, F.lit(mark), F.lit(instead))
    return F.trim(F.regexp_replace(out, rf"{SPACE}+", " "))


def squeeze_lines(text: Column) -> Column:
    """At most one blank line in a row, none at the ends."""
    return trim_space(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def comparable(text: Column) -> Column:
    """Text as answers are compared: case, quotes, marks, links and punctuation folded away."""
    out = F.translate(F.lower(text), "ё", "е")
    for pattern, instead in ((r"`+", ""), (r"[*_>#~]", " "), (r"\[[^\]]+\]\([^)]+\)", " "), (r"[“”\"'«»]", " "), (r"[(),.;!?]", " "), (rf"{SPACE}+", " ")):
        out = F.regexp_replace(out, pattern, instead)
    return F.trim(out)


def comparable_source(url: Column) -> Column:
    return F.lower(F.regexp_replace(trim_space(url), r"/+$", ""))


def bind(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def snippet(text: Column, query: Column, window: int = 420) -> Column:
    """The window around the earliest query token of three letters or more; else the first three sentences."""
    asked = F.filter(tokens(query), lambda t: F.length(t) > 2)

    def cut(clean, at):
        start = F.greatest(at - 1 - window // 3, F.lit(0))
        end = F.least(start + window, F.length(clean))
        hit = F.concat(F.when(start > 0, "...").otherwise(""), trim_space(F.substring(clean, start + 1, end - start)), F.when(end < F.length(clean), "...").otherwise(""))
        parts = F.filter(F.transform(F.slice(F.split(clean, rf"(?<=[.!?]){SPACE}+|\n+"), 1, 3), trim_space), lambda s: s != "")
        miss = trim_space(F.substring(F.array_join(parts, " "), 1, window))
        return F.when(clean == "", "").when(at.isNull(), miss).otherwise(hit)

    places = lambda low: F.array_min(F.filter(F.transform(asked, lambda t: F.instr(low, t)), lambda p: p > 0))
    return bind(clean_inline(text), lambda clean: bind(bind(F.lower(clean), places), lambda at: cut(clean, at)))
