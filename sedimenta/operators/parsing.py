"""Markdown pages to documents, documents to typed chunks."""

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, bind, clean_inline, squeeze_lines, trim_space
from .blocks import small_batches

# What marks lines up as titles, authorship, headings, contents and noise.
TITLE = r"^\[(.+?)\]\((https?://[^)\s]+?pageId=(\d+))\)"
CREATED = r"Created by \[(.+?)\]\([^)]+\), (?:(?:last modified by \[[^\]]+\]\([^)]+\) on)|last modified on) \[([^\]]+)\]"
HEADING = r"^(#{1,6})\s+(.*)$"
CONTENTS = r"^-+\s*\d+(?:\.\d+)*\s+\[[^\]]+\]\([^)]+\)\s*$"
FUNCTION = r"^##\s+(C\\?_[A-Za-z0-9_]+\(\))\s*$"
IMAGE_HEADING = r"^#{1,6}\s*!\[[^\]]*\]\([^)]+\)\s*$"
NOISE = ("-", "Loading...", "No labels", "Развернуть/Свернуть все")
NOISE_STARTS = ("Created by ", "###### ![](", "[к содержанию", "[▲▼](")
FUNCTION_TITLE, NOT_FUNCTION_TITLE = "функции ", "pkcs"
FUNCTION_TITLES = ("функции для работы с объектами", "функции создания подписи", "функции проверки подписи", "функции для работы с ключами")
LONG_LEAD, SHORT_LEAD = 120, 100
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

#: Pages whose blocks are Python objects at once.
SCANNED = 64
BLOCKS = "array<struct<kind: string, heading_path: array<string>, text: string, lead: string>>"


def lines(text: Column) -> Column:
    """Lines without their breaks; a break at the end starts no line."""
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})$", ""), LINE_BREAK))


def parse_pages(pages: DataFrame) -> DataFrame:
    """(document_id, page_id, source_url, title, author, last_modified, raw_markdown) from (path, text).

    The first line must be a title link, else the job fails naming the path. Authorship may stand in the first 20
    lines. last_modified stays text."""
    first = trim_space(F.element_at(F.concat(lines(F.col("text")), F.array(F.lit(""))), 1))
    head = F.array_join(F.slice(lines(F.col("text")), 1, 20), "\n")
    bad = F.raise_error(F.concat(F.lit("Cannot parse title line in "), F.col("path"))).cast("string")
    part = lambda i: F.when(first.rlike(TITLE), F.regexp_extract(first, TITLE, i)).otherwise(bad)
    made = lambda i: F.when(head.rlike(CREATED), F.regexp_extract(head, CREATED, i))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return pages.select(stem.alias("document_id"), part(3).alias("page_id"), part(2).alias("source_url"), clean_inline(part(1)).alias("title"), clean_inline(made(1)).alias("author"), made(2).alias("last_modified"), F.col("text").alias("raw_markdown"))


def clean_lines(docs: DataFrame, id_col: str = "document_id", text_col: str = "raw_markdown") -> DataFrame:
    """(id_col, clean_markdown): without the first line, comments and noise; code fences stay as they are.

    A comment heading ends a page even inside a fence. A page's lines stay in its row, so nothing is shuffled."""
    rows = docs.select(id_col, F.transform(F.slice(lines(F.col(text_col)), 2, 1 << 30), lambda x: F.regexp_replace(x, rf"{SPACE}+$", "")).alias("all"))
    rows = rows.withColumn("bare", F.transform("all", trim_space))
    comment = F.array_position(F.transform("bare", lambda b: b.startswith("## ") & F.contains(b, F.lit("Comment"))), True)
    rows = rows.withColumn("upto", F.when(comment > 0, comment - 1).otherwise(F.size("all")).cast("int"))
    # Where fences are: a line lies in one if an odd number of them comes before it.
    rows = rows.withColumn("fences", F.filter(F.transform("bare", lambda b, i: F.when(b.startswith("```"), i)), lambda i: i.isNotNull()))

    def keep(x, i):
        b = F.get("bare", i)
        noise = b.isin(*NOISE) | b.rlike(CONTENTS) | b.rlike(IMAGE_HEADING)
        for start in NOISE_STARTS:
            noise = noise | b.startswith(start)
        inside = F.size(F.filter("fences", lambda f: f < i)) % 2 == 1
        return (i < F.col("upto")) & (b.startswith("```") | inside | ~noise)

    clean = squeeze_lines(F.array_join(F.filter("all", keep), "\n"))
    return rows.select(id_col, F.coalesce(clean, F.lit("")).alias("clean_markdown"))


def _inline(text: str) -> str:
    text = re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", re.sub(r"!\[[^\]]*\]\([^)]+\)", "", text))
    for mark, instead in (("**", ""), ("__", ""), ("`", ""), ("\\#", "#"), ("\\_", "_")):
        text = text.replace(mark, instead)
    return " ".join(text.split())


def _squeeze(rows: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(rows)).strip()


def scan_blocks(markdown: str) -> list[tuple[str, list[str], str, str]]:
    """(kind, heading path, text, lead) of the blocks of a page; a table's lead is the short prose shortly before it."""
    found, path, prose, lead = [], [], [], ""
    # Each line says what it opens; runs of one kind make a block.
    rows, at = markdown.splitlines(), 0
    is_row = lambda s: s.startswith("|") and s.endswith("|")

    def close() -> None:
        nonlocal lead
        if text := _squeeze(prose):
            found.append(("prose", list(path), text, ""))
            lead = text if len(text) <= LONG_LEAD else lead
        prose.clear()

    while at < len(rows):
        bare, end = rows[at].strip(), at + 1
        if heading := re.match(HEADING, bare):
            close()
            path = [*path[: len(heading[1]) - 1], _inline(heading[2])]
        elif bare.startswith("```"):
            close()
            while end < len(rows) and not rows[end].strip().startswith("```"):
                end += 1
            end = min(end + 1, len(rows))
            found.append(("code", list(path), "\n".join(rows[at:end]).strip(), ""))
            lead = ""
        elif is_row(bare):
            close()
            while end < len(rows) and is_row(rows[end].strip()):
                end += 1
            found.append(("table", list(path), "\n".join(rows[at:end]).strip(), lead if len(lead) <= SHORT_LEAD else ""))
            lead = ""
        else:
            prose.append(rows[at])
        at = end
    close()
    return found


def scan_functions(markdown: str) -> list[tuple[str, list[str], str, str]]:
    """A reference block for each function heading of a page, up to the next one."""
    rows = markdown.splitlines()
    starts = [i for i, r in enumerate(rows) if re.match(FUNCTION, r.strip())]
    found = []
    for first, last in itertools.pairwise([*starts, len(rows)]):
        part = rows[first:last]
        name = _inline(re.match(FUNCTION, part[0].strip())[1])
        sections = [_inline(m[2]) for r in part if (m := re.match(HEADING, r.strip())) and len(m[1]) == 3]
        intro = [f"Функция PKCS#11: {name}"] + [f"Разделы: {'; '.join(dict.fromkeys(sections))}"] * bool(sections)
        body = _squeeze([r for r in part if not r.strip().startswith("[к содержанию")])
        found.append(("reference", [name], ("\n".join(intro) + "\n\n" + body).strip(), ""))
    return found


def _scan(markdown: pa.Array, reference: pa.Array) -> pa.Array:
    """Blocks of each page, a few pages at a time: Python objects take many times the text they hold."""
    names, texts = ("kind", "heading_path", "text", "lead"), pa.list_(pa.string())
    kind = pa.list_(pa.struct([(n, texts if n == "heading_path" else pa.string()) for n in names]))
    made = [pa.array([], kind)]
    for at in range(0, len(markdown), SCANNED):
        some = zip(markdown.slice(at, SCANNED).to_pylist(), reference.slice(at, SCANNED).to_pylist(), strict=True)
        made.append(pa.array([[dict(zip(names, b, strict=True)) for b in (scan_functions(m or "") if r else []) + scan_blocks(m or "")] for m, r in some], kind))
    return pa.concat_arrays(made)


def _blocks(markdown: str, reference: Column) -> Column:
    return F.arrow_udf(_scan, BLOCKS)(markdown, reference)


def is_function_page(title: Column) -> Column:
    low = F.lower(title)
    return (low.startswith(FUNCTION_TITLE) & ~F.contains(low, F.lit(NOT_FUNCTION_TITLE))) | low.isin(*FUNCTION_TITLES)


def split_prose(text: Column, target: int, overlap: int) -> Column:
    """Paragraphs packed up to target characters; a longer paragraph becomes overlapping windows."""
    none = F.expr("cast(array() as array<string>)")
    windows = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - overlap), F.lit(target - overlap)), lambda i: trim_space(F.substring(p, i, F.lit(target))))

    def pack(state, p):
        joined = F.when(state["now"] == "", p).otherwise(F.concat(state["now"], F.lit("\n\n"), p))
        closed = F.when(state["now"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["now"])))
        fits, short = F.length(joined) <= target, F.length(p) <= target
        return F.struct(F.when(fits, state["done"]).when(short, closed).otherwise(F.concat(closed, windows(p))).alias("done"), F.when(fits, joined).when(short, p).otherwise("").alias("now"))

    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), trim_space), lambda p: p != "")
    packed = F.aggregate(paragraphs, F.struct(none.alias("done"), F.lit("").alias("now")), pack, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    return F.filter(F.when(F.length(text) <= target, F.array(text)).otherwise(packed), lambda p: trim_space(p) != "")


def split_table(text: Column, rows: int) -> Column:
    """The two header lines with each window of rows; a table of up to rows + 2 lines stays whole."""
    parts = lambda all_: F.transform(F.sequence(F.lit(3), F.greatest(F.size(all_), F.lit(3)), F.lit(rows)), lambda i: F.array_join(F.concat(F.slice(all_, 1, 2), F.slice(all_, i, F.lit(rows))), "\n"))
    return bind(text, lambda t: bind(lines(t), lambda all_: F.when(F.size(all_) <= rows + 2, F.array(t)).otherwise(parts(all_))))


def split_code(text: Column, target: int, window: int = 80, overlap: int = 10) -> Column:
    """Overlapping windows of lines, fenced, of code over target characters."""
    opened = lambda b: F.when(b.startswith("```"), b).otherwise(F.concat(F.lit("```\n"), b))
    fenced = lambda b: F.when(b.endswith("```"), b).otherwise(F.concat(b, F.lit("\n```")))
    part = lambda all_, i: bind(bind(trim_space(F.array_join(F.slice(all_, i, F.lit(window)), "\n")), opened), fenced)
    # Text, lines and windows are each made once a row, however often they are looked at.
    parts = lambda all_: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_) - overlap), F.lit(window - overlap)), lambda i: part(all_, i))
    return bind(text, lambda t: F.when(F.length(t) <= target, F.array(t)).otherwise(bind(lines(t), parts)))


def chunk(docs: DataFrame, options) -> DataFrame:
    """(chunk_id, document_id, page_id, source_url, title, heading_path, text, chunk_type) of cleaned documents.

    Blocks are scanned in Python once a row, a few MB of text at a time; splitting and numbering stay in the row, so nothing
    is shuffled. Function pages give their reference blocks first and then the ordinary ones too."""
    rows = small_batches(docs).withColumn("blocks", _blocks("clean_markdown", F.coalesce(is_function_page(F.col("title")), F.lit(False))))

    def pieces(b):
        table = F.transform(split_table(b["text"], options.table_row_window), lambda t: F.when(b["lead"] == "", t).otherwise(trim_space(F.concat(b["lead"], F.lit("\n\n"), t))))
        texts = F.when(b["kind"] == "prose", split_prose(b["text"], options.chunk_target_chars, options.chunk_overlap_chars)).when(b["kind"] == "table", table).when(b["kind"] == "code", split_code(b["text"], options.chunk_target_chars, options.code_line_window, options.code_line_overlap)).otherwise(F.array(b["text"]))
        return F.transform(texts, lambda t: F.struct(b["heading_path"].alias("heading_path"), t.alias("text"), b["kind"].alias("chunk_type")))

    rows = rows.select("document_id", "page_id", "source_url", "title", F.posexplode(F.flatten(F.transform("blocks", pieces))).alias("at", "piece"))
    return rows.select(F.format_string("%s-%05d", F.col("document_id").cast("string"), F.col("at") + 1).alias("chunk_id"), "document_id", "page_id", "source_url", "title", "piece.heading_path", "piece.text", "piece.chunk_type")
