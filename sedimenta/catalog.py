"""Queries of the retrieval and evaluation operators over the shared tables, and the SQL each must agree with.

documents stand for the corpus (source as title and address), benchmark for questions, embeddings for a vector store,
events for runs. Every query covers its whole tables; limits are only those of top-k operators.
"""

from __future__ import annotations

from uuid import NAMESPACE_URL

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import entities as ent
from .functions import scalar
from .functions import text as txt
from .operators import analysis, answer, dense, enrich, evaluate, fusion, graph, parsing, sparse
from .operators.joins import join_small
from .options import Options
from .sources import files
from .sources.scratch import written

OPTIONS = Options()
#: A dictionary of frequent corpus words, ours, next to the default one: the tables name few products.
CORPUS = ent.Dictionary().add(products={"with": "with", "this": "this"}, interfaces={"pour": "pour", "dans": "dans", "from": "from"}, os_tags={"nicht": "nicht", "sich": "sich"}, components={"para": "para", "that": "that", "which": "which"})

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(c):
    return F.array_join(F.sort_array(c), ",")


# ---- text functions

TOKENS_SQL = "list_transform(regexp_extract_all({0}, '[A-Za-zА-Яа-я0-9_./#+-]+'), lambda t: lower(t))"


@query("tokenize_counts", f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents)")
def tokenize_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", txt.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query("symbols_extract", r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(t, '\b(?:CKR|CKA|CKO|CKM|CKU|CKF)_[A-Z0-9_]+\b|\bC_[A-Za-z0-9_]+\b|\brt[A-Za-z0-9_]+\b'), lambda x: x), ',') AS found
FROM (SELECT p_partkey, p_name || ' C_Sign' || p_size || '() CKR_' || upper(p_brand) || ' rtEngine ckr_no aC_not' AS t FROM part)""")
def symbols_extract(spark, d):
    t = F.concat("p_name", F.lit(" C_Sign"), F.col("p_size").cast("string"), F.lit("() CKR_"), F.upper("p_brand"), F.lit(" rtEngine ckr_no aC_not"))
    return table(spark, d, "part").select("p_partkey", F.array_join(txt.symbols(t), ",").alias("found"))


_MARKED = "'![i](http://x) **' || role || '** [' || role || '](http://y/z) `' || text || '` \\# a\\_b  (x), «q»! '"


def _marked():
    return F.concat(F.lit("![i](http://x) **"), "role", F.lit("** ["), "role", F.lit("](http://y/z) `"), "text", F.lit("` \\# a\\_b  (x), «q»! "))


_CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '!\[[^\]]*\]\([^)]+\)', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '**', ''), '__', ''), '`', ''), '\#', '#'), '\_', '_'), '\s+', ' ', 'g'))"


@query("clean_inline", f"SELECT conv_id, turn, md5({_CLEAN.format(_MARKED)}) AS clean_md5 FROM conversations")
def clean_inline(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(txt.clean_inline(_marked()).cast("binary")).alias("clean_md5"))


_FOLD = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), 'ё', 'е'), '`+', '', 'g'), '[*_>#~]', ' ', 'g'), '\[[^\]]+\]\([^)]+\)', ' ', 'g'), '[“”"''«»]', ' ', 'g'), '[(),.;!?]', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("normalize_text", f"SELECT conv_id, turn, md5({_FOLD.format(_MARKED)}) AS folded_md5 FROM conversations")
def normalize_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(txt.comparable(_marked()).cast("binary")).alias("folded_md5"))


@query("normalize_source", r"SELECT page_id, lower(regexp_replace(trim(' ' || url || '// '), '/+$', '')) AS source FROM pages")
def normalize_source(spark, d):
    return table(spark, d, "pages").select("page_id", txt.comparable_source(F.concat(F.lit(" "), "url", F.lit("// "))).alias("source"))


@query("squeeze_lines", r"SELECT doc_id, md5(trim(regexp_replace(replace(text, '. ', E'.\n\n\n\n'), '\n{3,}', E'\n\n', 'g'), E' \n\t\r')) AS squeezed_md5 FROM documents")
def squeeze_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(txt.squeeze_lines(F.replace("text", F.lit(". "), F.lit(".\n\n\n\n"))).cast("binary")).alias("squeezed_md5"))


@query("page_tag", r"SELECT set_id, CASE WHEN n = '' THEN 'page_unknown' ELSE 'page_' || n END AS tag FROM (SELECT page_id AS set_id, regexp_extract(CASE WHEN page_id % 3 = 0 THEN url ELSE url || '?pageId=' || page_id END, 'pageId=(\d+)', 1) AS n FROM pages)")
def page_tag(spark, d):
    sources = F.array(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit("?pageId="), F.col("page_id").cast("string"))))
    return table(spark, d, "pages").select(F.col("page_id").alias("set_id"), scalar.page_tag(sources).alias("tag"))


@query("uuid5_keys", f"SELECT page_id, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || d[17:17])::INT % 4 + 1] || d[18:20] || '-' || d[21:32] AS id FROM (SELECT page_id, sha1(unhex('{NAMESPACE_URL.hex}') || encode(url)) AS d FROM pages)")
def uuid5_keys(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.uuid5("url", F.col("url")).alias("id"))


@query("retrieval_modes", "SELECT conv_id, turn, CASE WHEN lower(trim(m)) IN ('dense', 'bm25', 'graph', 'hybrid') THEN lower(trim(m)) ELSE 'hybrid' END AS mode FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' BM25 ' WHEN 1 THEN 'Graph' WHEN 2 THEN role END AS m FROM conversations)")
def retrieval_modes(spark, d):
    m = F.when(F.col("turn") % 4 == 0, " BM25 ").when(F.col("turn") % 4 == 1, "Graph").when(F.col("turn") % 4 == 2, F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", fusion.known_retrieval(m).alias("mode"))


# ---- entities and filters

def _dictionary_rows(fields=ent.FIELDS[:-1], weights=None) -> str:
    rows = [(f, a, t) for f in fields for a, t in CORPUS.aliases.get(f, {}).items()]
    return ", ".join(f"('{f}', '{a}', '{t}', {(weights or graph.LINK_WEIGHTS)[f]})" for f, a, t in rows)


_TAGGED = f"SELECT DISTINCT {{0}}, field, tag FROM {{1}}, (VALUES {_dictionary_rows()}) AS v(field, label, tag, w) WHERE contains(lower({{2}}), label)"


def _field_columns() -> str:
    return ", ".join(f"coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (field = '{f}'), '') AS {f}" for f in ent.FIELDS[:-1])


@query("alias_entities", f"WITH t AS ({_TAGGED.format('doc_id', 'documents', 'text')}) SELECT doc_id, {_field_columns()} FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id")
def alias_entities(spark, d):
    rows = table(spark, d, "documents").select("doc_id", ent.entities(F.col("text"), CORPUS).alias("e"))
    return rows.select("doc_id", *[joined(f"e.{f}").alias(f) for f in ent.FIELDS[:-1]])


@query("entity_terms", f"WITH t AS ({_TAGGED.format('doc_id', 'documents', 'text')}), u AS (SELECT DISTINCT doc_id, tag FROM t) SELECT doc_id, count(tag)::INT AS n_terms, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS terms FROM documents LEFT JOIN u USING (doc_id) GROUP BY doc_id")
def entity_terms(spark, d):
    rows = table(spark, d, "documents").select("doc_id", ent.terms(ent.entities(F.col("text"), CORPUS)).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_terms"), joined("t").alias("terms"))


_FAMILY_TITLES = ("Архитектура ", "Обзорная информация ", "Объекты PKCS ", "Хранилища ", "Выбор ", "Стек PC/SC ", "Прочее ")


@query("doc_family", "SELECT page_id, ['architecture', 'product_matrix', 'pkcs11_objects', 'storage', 'recommendations', 'pcsc', 'general'][page_id % 7 + 1] AS family FROM pages")
def doc_family(spark, d):
    title = F.element_at(F.array(*map(F.lit, _FAMILY_TITLES)), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", ent.family(title).alias("family"))


def _doc_chunks(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").cast("string").alias("page_id"), F.col("source").alias("source_url"), F.col("source").alias("title"), txt.squeeze_lines(F.col("text")).alias("clean_markdown"))
    return parsing.chunk(rows, OPTIONS)


def _enriched(spark, d) -> DataFrame:
    return enrich.enrich(_doc_chunks(spark, d), CORPUS)


CHUNKS_SQL = r"""c0 AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), E' \n\t\r') AS t FROM documents),
chunks AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, doc_id || '-' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY i))::VARCHAR, 5, '0') AS chunk_id,
  trim(substr(t, i, 2200), E' \n\t\r') AS text FROM (SELECT *, unnest(CASE WHEN length(t) <= 2200 THEN [1] ELSE range(1, length(t) - 250 + 1, 1950) END) AS i FROM c0 WHERE t <> ''))"""
MENTIONS_SQL = f"m AS (SELECT DISTINCT chunk_id, doc_id, source, field, tag, field || ':' || tag AS node_id, w FROM chunks, (VALUES {_dictionary_rows()}) AS v(field, label, tag, w) WHERE contains(lower(source || '  ' || text), label) UNION ALL SELECT DISTINCT chunk_id, doc_id, source, 'api_symbols', tag, 'api_symbols:' || tag, 1.8 FROM (SELECT *, unnest(regexp_extract_all(source || '  ' || text, '(?:^|[^\\p{{L}}\\p{{N}}_])(rt[A-Za-z0-9_]+)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)) AS tag FROM chunks))"
GRAPH_SQL = f"{CHUNKS_SQL}, {MENTIONS_SQL}"


@query("metadata_filter", f"WITH {GRAPH_SQL} SELECT chunk_id FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM m WHERE field = 'products' AND tag IN ('with', 'this')) AND chunk_id IN (SELECT chunk_id FROM m WHERE field = 'components' AND tag = 'that')")
def metadata_filter(spark, d):
    rows = _enriched(spark, d)
    columns = {f: F.col(f"metadata.{f}") for f in ("products", "components", "os_tags", "chunk_type")}
    return rows.where(ent.matches_values(columns, {"products": ["with", "this"], "components": "that", "os_tags": [], "chunk_type": ["prose", "code"]})).select("chunk_id")


# ---- parsing and chunks

@query("page_header_parse", r"SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, md5(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title_md5 FROM pages")
def page_header_parse(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.md5(F.regexp_extract("html", "<title>([^<]*)</title>", 1).cast("binary")).alias("title_md5"))


def _markdown():
    title = F.concat(F.lit("[t "), "source", F.lit("](https://wiki.example/pages/viewpage.action?pageId="), F.col("doc_id").cast("string"), F.lit(")"))
    return F.concat_ws("\n", title, F.lit("Created by [An Author](http://u), last modified on [Jan 1, 2024]"), F.lit("Loading..."), F.lit("# Top"), "text", F.lit("```\n-\n```"), F.lit("- No labels"), F.lit("- 1.2 [x](y)"), F.lit("## 1 Comment"), F.lit("gone"))


@query("page_documents", "SELECT doc_id::VARCHAR AS document_id, doc_id::VARCHAR AS page_id, 't ' || source AS title, 'An Author' AS author, 'Jan 1, 2024' AS last_modified FROM documents")
def page_documents(spark, d):
    pages = table(spark, d, "documents").select(F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), _markdown().alias("text"))
    return parsing.parse_pages(pages).select("document_id", "page_id", "title", "author", "last_modified")


@query("line_cleanup", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, string_agg(rtrim(line, E' \t\r'), chr(10) ORDER BY pos) AS body FROM l WHERE trim(line) NOT IN ('-', 'Loading...', 'No labels') GROUP BY doc_id)
SELECT doc_id, md5(trim(regexp_replace('# Top' || chr(10) || coalesce(body, '') || chr(10) || '```' || chr(10) || '-' || chr(10) || '```' || chr(10) || '- No labels', '\n{3,}', E'\n\n', 'g'), E' \n\t\r')) AS clean_md5 FROM documents LEFT JOIN k USING (doc_id)""")
def line_cleanup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", _markdown().alias("raw_markdown"))
    return parsing.clean_lines(rows, "doc_id").select("doc_id", F.md5(F.col("clean_markdown").cast("binary")).alias("clean_md5"))


@query("block_extract")
def block_extract(spark, d):
    html = F.col("html")
    for pattern, instead in ((r"(?s)<(script|style|head)\b.*?</\1>", ""), (r"<h(\d)>", "\n## "), (r"</?(p|article|ul|div|h\d)[^>]*>", "\n\n"), (r"<li>", "\n- "), (r"<[^>]+>", "")):
        html = F.regexp_replace(html, pattern, instead)
    rows = table(spark, d, "pages").select(F.col("page_id").alias("document_id"), F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("source_url"), F.lit("Page").alias("title"), txt.squeeze_lines(html).alias("clean_markdown"))
    return parsing.chunk(rows, OPTIONS).select("chunk_id", "chunk_type", F.array_join("heading_path", " > ").alias("heading"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_BLOCK_PAGE = ("Intro ", "\n# ", "\nLead.\n| k | v |\n|---|---|\n| 1 | ", " |\n\n### Deep\n```\ncode ", "\n# no heading\n| no | table |\n```\nTail\n\n\nend ")
_NL = lambda text: "'" + text.replace("\n", "' || chr(10) || '") + "'"


@query("typed_blocks", f"""WITH b AS (SELECT s_suppkey, unnest([
 {{'n': 1, 'kind': 'prose', 'heading': '', 'text': 'Intro ' || s_name}}, {{'n': 2, 'kind': 'prose', 'heading': s_name, 'text': 'Lead.'}},
 {{'n': 3, 'kind': 'table', 'heading': s_name, 'text': {_NL(chr(10).join(("Lead.", "", "| k | v |", "|---|---|", "| 1 | ")))} || s_nationkey || ' |'}},
 {{'n': 4, 'kind': 'code', 'heading': s_name || ' > Deep', 'text': {_NL("```" + chr(10) + "code ")} || s_suppkey || {_NL(chr(10).join(("", "# no heading", "| no | table |", "```")))}}},
 {{'n': 5, 'kind': 'prose', 'heading': s_name || ' > Deep', 'text': {_NL(chr(10).join(("Tail", "", "end ")))} || s_acctbal::INT}}]) AS x FROM supplier)
SELECT s_suppkey || '-' || lpad(x.n::VARCHAR, 5, '0') AS chunk_id, x.kind AS chunk_type, x.heading AS heading, md5(x.text) AS text_md5 FROM b""")
def typed_blocks(spark, d):
    """Pages of every kind of block, to chunks."""
    values = ("s_name", "s_name", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string"), F.rint("s_acctbal").cast("int").cast("string"))
    page = F.concat(*[x for part, value in zip(_BLOCK_PAGE, values, strict=True) for x in (F.lit(part), value)])
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("document_id"), F.col("s_suppkey").cast("string").alias("page_id"), F.col("s_name").alias("source_url"), F.col("s_name").alias("title"), page.alias("clean_markdown"))
    return parsing.chunk(rows, OPTIONS).select("chunk_id", "chunk_type", F.array_join("heading_path", " > ").alias("heading"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_REFERENCE = "'Функция PKCS#11: C_' || {0} || '()' || chr(10) || 'Разделы: Синтаксис; Параметры' || chr(10) || chr(10) || '## C_' || {0} || '()' || chr(10) || '### Синтаксис' || chr(10) || 'вызов ' || s_suppkey || chr(10) || '### Параметры' || chr(10) || 'нет'"


@query("function_pages", f"""WITH b AS (SELECT s_suppkey, unnest([{{'n': 1, 'heading': 'C_Sign()', 'text': {_REFERENCE.format("'Sign'")}}}, {{'n': 2, 'heading': 'C_Verify()', 'text': {_REFERENCE.format("'Verify'")}}}]) AS x FROM supplier)
SELECT s_suppkey || '-' || lpad(x.n::VARCHAR, 5, '0') AS chunk_id, x.heading AS heading, md5(x.text) AS text_md5 FROM b WHERE s_suppkey % 2 = 0""")
def function_pages(spark, d):
    """Reference blocks of pages whose title says so; other pages have none."""
    part = lambda name: F.concat(F.lit(f"## C_{name}()\n### Синтаксис\nвызов "), F.col("s_suppkey").cast("string"), F.lit("\n### Параметры\n[к содержанию](x)\nнет\n"))
    title = F.when(F.col("s_suppkey") % 2 == 0, "Функции подписи").otherwise("Функции PKCS")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("document_id"), F.lit("1").alias("page_id"), F.col("s_name").alias("source_url"), title.alias("title"), F.concat(part("Sign"), part("Verify")).alias("clean_markdown"))
    found = parsing.chunk(rows, OPTIONS).where("chunk_type = 'reference'")
    return found.select("chunk_id", F.array_join("heading_path", " > ").alias("heading"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("prose_windows", f"WITH {CHUNKS_SQL} SELECT doc_id, n::INT AS n, md5(text) AS text_md5 FROM chunks")
def prose_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(parsing.split_prose(txt.squeeze_lines(F.col("text")), OPTIONS.chunk_target_chars, OPTIONS.chunk_overlap_chars)).alias("at", "t"))
    return rows.where("t <> ''").select("doc_id", (F.col("at") + 1).alias("n"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("table_windows", """WITH r AS (SELECT n_regionkey, list('| ' || n_nationkey || ' | ' || n_name || ' |' ORDER BY n_nationkey) AS rows FROM nation GROUP BY 1)
SELECT n_regionkey, md5(array_to_string(['| k | name |', '|---|---|'] || rows[i:i + 2], chr(10))) AS text_md5 FROM r, unnest(range(1, len(rows) + 1, 3)) AS t(i)""")
def table_windows(spark, d):
    line = F.struct("n_nationkey", F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |")).alias("line"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]).alias("rows"))
    text = F.array_join(F.concat(F.array(F.lit("| k | name |"), F.lit("|---|---|")), "rows"), "\n")
    return rows.select("n_regionkey", F.explode(parsing.split_table(text, 3)).alias("t")).select("n_regionkey", F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("code_windows", """WITH s AS (SELECT s_suppkey, list_transform(range(1, 90 + s_suppkey % 100 + 1), lambda i: 'call(' || i || ', ' || s_name || ');') AS body FROM supplier),
l AS (SELECT s_suppkey, ['```c'] || body || ['```'] AS lines FROM s),
w AS (SELECT s_suppkey, i, array_to_string(lines[i:i + 79], chr(10)) AS b FROM l, unnest(range(1, greatest(len(lines) - 10, 1) + 1, 70)) AS t(i)),
o AS (SELECT s_suppkey, i, CASE WHEN starts_with(b, '```') THEN b ELSE '```' || chr(10) || b END AS b FROM w)
SELECT s_suppkey, md5(CASE WHEN ends_with(b, '```') THEN b ELSE b || chr(10) || '```' END) AS text_md5 FROM o""")
def code_windows(spark, d):
    n = F.lit(90) + (F.col("s_suppkey") % 100).cast("int")
    body = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("call("), i.cast("string"), F.lit(", "), F.col("s_name"), F.lit(");")))
    text = F.array_join(F.concat(F.array(F.lit("```c")), body, F.array(F.lit("```"))), "\n")
    # A supplier's row is small and its code is not: dealt out evenly, else a file is one task.
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name").repartition(spark.sparkContext.defaultParallelism)
    return rows.select("s_suppkey", F.explode(parsing.split_code(text, 2200)).alias("t")).select("s_suppkey", F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("chunk_ids", f"WITH {CHUNKS_SQL} SELECT chunk_id, doc_id AS document_id, source AS title, 'prose' AS chunk_type, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM chunks")
def chunk_ids(spark, d):
    return _doc_chunks(spark, d).select("chunk_id", "document_id", "title", "chunk_type", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("vector_payload", f"WITH {CHUNKS_SQL} SELECT chunk_id, doc_id AS document_id, source AS title, 'prose' AS chunk_type, 'general' AS doc_family, '' AS heading_path_text, length(text)::INT AS n_chars FROM chunks")
def vector_payload(spark, d):
    return enrich.payload(_enriched(spark, d)).select("chunk_id", "document_id", "title", "chunk_type", "doc_family", "heading_path_text", F.length("text").alias("n_chars"))


@query("ingest_manifest", f"WITH {CHUNKS_SQL} SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, 64 AS vector_size FROM chunks")
def ingest_manifest(spark, d):
    chunks = written(_doc_chunks(spark, d).select("document_id"), "chunks")
    return files.manifest(chunks.distinct(), chunks, 64)


# ---- sparse retrieval

BM25_SQL = """d AS (SELECT doc_id, {tokens} AS w FROM {docs}),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
tf AS (SELECT doc_id, len AS l, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
_DOC_BM25 = BM25_SQL.format(tokens=TOKENS_SQL.format("text"), docs="documents")
QUERY_SQL = f"q AS (SELECT item_id AS qid, unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark)"
SCORE_SQL = "s AS (SELECT qid, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM q JOIN tf USING (term) JOIN idf USING (term), st GROUP BY ALL)"


def _docs(spark, d, *more):
    """Postings of the documents; an engine reads stored ones, so tokens are found once here too."""
    return written(sparse.tokenised(table(spark, d, "documents"), "doc_id", F.col("text"), *more), "postings")


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


@query("bm25_corpus_stats", f"WITH {_DOC_BM25} SELECT n AS n_docs, round(a, 6) AS avg_len FROM st")
def bm25_corpus_stats(spark, d):
    return sparse.corpus_stats(_docs(spark, d)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("bm25_term_idf", f"WITH {_DOC_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_idf(spark, d):
    docs = _docs(spark, d)
    return sparse.term_idf(docs, sparse.corpus_stats(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_baseline_topk", f"WITH {_DOC_BM25}, {QUERY_SQL}, {SCORE_SQL} SELECT qid, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 5")
def bm25_baseline_topk(spark, d):
    hits = sparse.bm25(_docs(spark, d), _questions(spark, d), OPTIONS.final_context_count, limit=OPTIONS.broadcast_rows)
    return hits.select("qid", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), "rank")


@query("bm25_filtered_topk", f"WITH {_DOC_BM25}, {QUERY_SQL}, {SCORE_SQL} SELECT qid, s.doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, s.doc_id)::INT AS rank FROM s JOIN documents x ON x.doc_id = s.doc_id WHERE score > 0 AND x.lang = ['en', 'fr', 'de', 'es'][qid % 4 + 1] QUALIFY rank <= 20")
def bm25_filtered_topk(spark, d):
    wanted = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("qid") % 4 + 1).cast("int"))
    asked = _questions(spark, d).withColumn("must", F.array(F.array(wanted)))
    hits = sparse.bm25(_docs(spark, d, F.array("lang").alias("tags")), asked, OPTIONS.sparse_candidate_count, limit=OPTIONS.broadcast_rows)
    return hits.select("qid", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), "rank")


_BEST_SQL = f"WITH {_DOC_BM25}, {QUERY_SQL}, {SCORE_SQL}, best AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5)"
_SNIPPET_SQL = f"""x AS (SELECT qid, b.doc_id, rank, source, {_CLEAN.format('d2.text')} AS c, list_filter({TOKENS_SQL.format('q2.text')}, lambda t: length(t) > 2) AS ts FROM best b JOIN documents d2 ON d2.doc_id = b.doc_id JOIN benchmark q2 ON q2.item_id = b.qid),
y AS (SELECT *, list_min(list_filter(list_transform(ts, lambda t: instr(lower(c), t)), lambda p: p > 0)) AS pos FROM x),
z AS (SELECT *, greatest(pos - 1 - 140, 0) AS a FROM y),
snip AS (SELECT qid, doc_id, rank, source, CASE WHEN a > 0 THEN '...' ELSE '' END || trim(substr(c, a + 1, least(a + 420, length(c)) - a)) || CASE WHEN least(a + 420, length(c)) < length(c) THEN '...' ELSE '' END AS snippet FROM z)"""


def _best(spark, d):
    return written(sparse.bm25(_docs(spark, d), _questions(spark, d), OPTIONS.final_context_count, limit=OPTIONS.broadcast_rows), "best")


@query("snippet", f"{_BEST_SQL}, {_SNIPPET_SQL} SELECT qid, doc_id, md5(snippet) AS snippet_md5 FROM snip")
def snippet(spark, d):
    # A few documents a question; the others aren't shuffled.
    rows = join_small(table(spark, d, "documents").select("doc_id", "text"), _best(spark, d).select("qid", F.col("id").alias("doc_id")), "doc_id", OPTIONS.broadcast_rows).join(_questions(spark, d), "qid")
    return rows.select("qid", "doc_id", F.md5(txt.snippet(F.col("text"), F.col("question")).cast("binary")).alias("snippet_md5"))


@query("baseline_answer", f"{_BEST_SQL}, {_SNIPPET_SQL} SELECT qid, md5(trim('Запрос: ' || any_value(text) || E'\\nРежим: BM25 baseline без LLM\\nЕдиница поиска: целый документ\\n\\nНайденные документы:\\n\\n' || string_agg(rank || '. ' || source || chr(10) || snippet || chr(10) || 'Источник: ' || source || chr(10), chr(10) ORDER BY rank), E' \\n')) AS answer_md5 FROM snip JOIN benchmark ON item_id = qid GROUP BY qid")
def baseline_answer(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text", F.col("source").alias("source_url"))
    out = answer.baseline(_questions(spark, d), _best(spark, d), docs, OPTIONS.broadcast_rows)
    return out.select("qid", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


# ---- dense retrieval

_COSINE = "list_inner_product(q.e, r.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(r.e, r.e)))"
_VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _vectors(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("g"))
    return rows, rows.where("id % 20 = 0").withColumnRenamed("id", "qid")


@query("cosine_topk", f"WITH {_VECTORS} SELECT q.vec_id AS qid, r.vec_id, round({_COSINE}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COSINE}, 6) DESC, r.vec_id)::INT AS rank FROM v q, v r WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20")
def cosine_topk(spark, d):
    rows, asked = _vectors(spark, d)
    return dense.cosine_topk(rows, asked, OPTIONS.dense_candidate_count).select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("cosine_filtered_topk", f"WITH {_VECTORS} SELECT q.vec_id AS qid, r.vec_id, round({_COSINE}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COSINE}, 6) DESC, r.vec_id)::INT AS rank FROM v q JOIN v r ON q.label = r.label WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20")
def cosine_filtered_topk(spark, d):
    rows, asked = _vectors(spark, d)
    return dense.cosine_topk(rows, asked, OPTIONS.dense_candidate_count, group=True).select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


# ---- graph

@query("entity_links", f"WITH {GRAPH_SQL} SELECT chunk_id, doc_id AS document_id, node_id, field AS entity_type, w::DOUBLE AS weight FROM m")
def entity_links(spark, d):
    return graph.links(_enriched(spark, d))


@query("graph_nodes", f"WITH {GRAPH_SQL} SELECT 'document:' || doc_id AS id, 'document' AS node_type, doc_id::VARCHAR AS value FROM chunks GROUP BY doc_id UNION ALL SELECT 'chunk:' || chunk_id, 'chunk', chunk_id FROM chunks UNION ALL SELECT 'doc_family:general', 'doc_family', 'general' UNION ALL SELECT DISTINCT node_id, 'entity', tag FROM m")
def graph_nodes(spark, d):
    return graph.nodes(_enriched(spark, d)).select("id", "node_type", "value")


EDGES_SQL = """pairs AS (SELECT a.chunk_id, a.node_id AS source_id, b.node_id AS target_id, round((a.w + b.w)::DECIMAL(18, 4) / 2, 4)::DECIMAL(18, 4) AS w FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.node_id < b.node_id),
co AS (SELECT source_id, target_id, sum(w)::DOUBLE AS weight FROM pairs GROUP BY ALL)"""


@query("graph_edges", f"WITH {GRAPH_SQL}, {EDGES_SQL} SELECT 'document:' || doc_id AS source_id, 'chunk:' || chunk_id AS target_id, 'document_contains_chunk' AS edge_type, 1.0::DOUBLE AS weight FROM chunks UNION ALL SELECT 'chunk:' || chunk_id, 'doc_family:general', 'chunk_belongs_to_doc_family', 0.4 FROM chunks UNION ALL SELECT 'chunk:' || chunk_id, node_id, 'chunk_mentions_entity', w FROM m UNION ALL SELECT node_id, 'doc_family:general', 'entity_belongs_to_doc_family', 0.25 * count(*) FROM m GROUP BY node_id UNION ALL SELECT source_id, target_id, 'entity_cooccurs_with_entity', weight FROM co")
def graph_edges(spark, d):
    return graph.edges(_enriched(spark, d))


NEAR_SQL = "near AS (SELECT node_id, neighbour, weight, row_number() OVER (PARTITION BY node_id ORDER BY weight DESC, neighbour) AS nth FROM (SELECT source_id AS node_id, target_id AS neighbour, weight FROM co UNION ALL SELECT target_id, source_id, weight FROM co) QUALIFY nth <= 10)"


@query("graph_neighbors_topn", f"WITH {GRAPH_SQL}, {EDGES_SQL}, {NEAR_SQL} SELECT node_id, neighbour, weight, nth::INT AS nth FROM near")
def graph_neighbors_topn(spark, d):
    return graph.neighbours(graph.edges(_enriched(spark, d)), OPTIONS.graph_neighbor_limit)


def _graph_queries(spark, d):
    mode = F.element_at(F.array(*map(F.lit, ("classic", "mixed", "graph_first"))), (F.col("qid") % 3 + 1).cast("int"))
    return _questions(spark, d).withColumn("query_mode", mode).withColumn("entities", ent.entities(F.col("question"), CORPUS))


def _seed_rows() -> str:
    order = {t: i for i, t in enumerate(dict.fromkeys((f, t) for f in ent.FIELDS[:-1] for t in CORPUS.aliases.get(f, {}).values()))}
    return ", ".join(f"('{f}', '{a}', '{t}', {graph.SEED_WEIGHTS[f]}, {order[f, t]})" for f in ent.FIELDS[:-1] for a, t in CORPUS.aliases.get(f, {}).items())


SEEDS_SQL = f"""qs AS (SELECT item_id AS qid, text, ['classic', 'mixed', 'graph_first'][item_id % 3 + 1] AS mode FROM benchmark),
seeds AS (SELECT DISTINCT qid, mode, field || ':' || tag AS node_id, sw, ord FROM qs, (VALUES {_seed_rows()}) AS v(field, label, tag, sw, ord) WHERE mode <> 'classic' AND contains(lower(text), label) AND field || ':' || tag IN (SELECT node_id FROM m)),
step AS (SELECT qid, mode, s.node_id AS seed, ord, neighbour, nth, least(weight, 3.0) * 0.22 * CASE mode WHEN 'mixed' THEN 1.0 ELSE 1.2 END AS gain FROM seeds s JOIN near USING (node_id))"""
GSEARCH_SQL = """mass AS (SELECT qid, mode, node_id, sum(x) AS mass, max(e) AS e FROM (SELECT qid, mode, node_id, sw::DOUBLE AS x, 1 AS e FROM seeds UNION ALL SELECT qid, mode, neighbour, gain, 0 FROM step) GROUP BY ALL),
met AS (SELECT qid, mode, chunk_id, doc_id, mass, e, w FROM mass JOIN m USING (node_id)),
ch AS (SELECT qid, mode, chunk_id, doc_id, sum(mass * w) AS own, sum(e) AS e FROM met GROUP BY ALL),
dc AS (SELECT qid, doc_id, sum(mass * 0.3) AS around FROM met GROUP BY ALL),
gs AS (SELECT qid, chunk_id, round(round((own + around * 0.3 + CASE WHEN e > 1 THEN least(e, 4) * 0.2 ELSE 0 END) * CASE mode WHEN 'graph_first' THEN 1.15 ELSE 1 END, 8), 4) AS score FROM ch JOIN dc USING (qid, doc_id)),
gh AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM gs WHERE score > 0 QUALIFY rank <= 20)"""


@query("graph_search", f"WITH {GRAPH_SQL}, {EDGES_SQL}, {NEAR_SQL}, {SEEDS_SQL}, {GSEARCH_SQL} SELECT qid, chunk_id, score, rank::INT AS rank FROM gh")
def graph_search(spark, d):
    chunks = written(_enriched(spark, d), "chunks")
    return graph.search(_graph_queries(spark, d), graph.nodes(chunks), graph.edges(chunks), graph.links(chunks), OPTIONS)


@query("graph_facts", f"""WITH {GRAPH_SQL}, {EDGES_SQL}, {NEAR_SQL}, {SEEDS_SQL},
said AS (SELECT qid, ord, nth, 0 AS o, replace(split_part(seed, ':', 2), '_', ' ') || ' -> ' || replace(split_part(neighbour, ':', 2), '_', ' ') AS fact FROM step
UNION ALL SELECT qid, ord, nth, 1, replace(split_part(neighbour, ':', 2), '_', ' ') || ' <-> ' || replace(split_part(seed, ':', 2), '_', ' ') FROM step WHERE (qid, neighbour) IN (SELECT qid, node_id FROM seeds)),
one AS (SELECT qid, fact, min(ord * 10000 + nth * 10 + o) AS pos FROM said GROUP BY ALL),
few AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n FROM one QUALIFY n <= 8)
SELECT qid, string_agg(fact, '; ' ORDER BY n) AS facts FROM few GROUP BY qid""")
def graph_facts(spark, d):
    chunks = written(_enriched(spark, d), "chunks")
    return graph.facts(_graph_queries(spark, d), graph.nodes(chunks), graph.edges(chunks), OPTIONS).select("qid", F.array_join("facts", "; ").alias("facts"))


from . import catalog_plans  # noqa: E402, F401  the queries of whole plans register themselves
