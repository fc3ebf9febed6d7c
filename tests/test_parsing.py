import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from sedimenta.functions.text import squeeze_lines
from sedimenta.operators import enrich, parsing
from sedimenta.functions.entities import Dictionary
from sedimenta.options import Options

PAGE = """[My **page**](https://wiki.example/pages/viewpage.action?pageId=42)
Loading...
Created by [A \\_B](http://u), last modified by [C](http://v) on [Jan 02, 2020](http://d)
- 1.2 [contents](x)
# Top

intro

### Deep
| a | b |
|---|---|
| 1 | 2 |
```c
functionList->C_Sign();
- 

```
###### ![](image)
- No labels
## 2 Comments
gone
"""


def page(spark, text=PAGE, path="/x/pageId_42.md"):
    return parsing.parse_pages(spark.createDataFrame([(path, text)], "path string, text string"))


def test_page(spark):
    row = page(spark).first()
    assert (row.document_id, row.page_id, row.title, row.author, row.last_modified) == ("pageId_42", "42", "My page", "A _B", "Jan 02, 2020")
    assert row.source_url == "https://wiki.example/pages/viewpage.action?pageId=42"
    with pytest.raises(PySparkException, match="/bad.md"):
        page(spark, "no title\n", "/bad.md").collect()


def test_clean_lines(spark):
    clean = parsing.clean_lines(page(spark)).first().clean_markdown
    assert clean == "# Top\n\nintro\n\n### Deep\n| a | b |\n|---|---|\n| 1 | 2 |\n```c\nfunctionList->C_Sign();\n-\n\n```\n- No labels"
    inside = "[t](https://h/?pageId=1)\n```\n## a Comment\n```\nrest"
    assert parsing.clean_lines(page(spark, inside)).first().clean_markdown == "```"
    assert parsing.clean_lines(page(spark, "[t](https://h/?pageId=1)")).first().clean_markdown == ""


def test_blocks():
    md = "intro text\n| h |\n|---|\n| 1 |\n# A\n### C\n```\nopen\n| no |"
    assert parsing.scan_blocks(md) == [("prose", [], "intro text", ""), ("table", [], "| h |\n|---|\n| 1 |", "intro text"), ("code", ["A", "C"], "```\nopen\n| no |", "")]
    long_ = "x" * 130
    # a long block doesn't clear the short one before it; a table does
    assert [b[3] for b in parsing.scan_blocks(f"short\n# H\n{long_}\n| a |\n\n| b |")] == ["", "", "short", ""]
    assert parsing.scan_blocks("a" * 110 + "\n| t |")[1][3] == ""


def test_function_pages(spark):
    md = "## C\\_Sign()\n### Syntax\nx\n[к содержанию](y)\n### Syntax\n## C_Verify()\n### **Params**\nz"
    first, second = parsing.scan_functions(md)
    assert first[:3] == ("reference", ["C_Sign()"], "Функция PKCS#11: C_Sign()\nРазделы: Syntax\n\n## C\\_Sign()\n### Syntax\nx\n### Syntax")
    assert second[2].startswith("Функция PKCS#11: C_Verify()\nРазделы: Params\n\n")
    docs = spark.createDataFrame([("d", "1", "u", "Функции подписи", md)], "document_id string, page_id string, source_url string, title string, clean_markdown string")
    rows = parsing.chunk(docs, Options()).orderBy("chunk_id").collect()
    assert [r.chunk_type for r in rows][:2] == ["reference", "reference"] and len(rows) > 2 and rows[0].chunk_id == "d-00001"


def test_function_page_without_functions():
    assert parsing.scan_functions("text only") == [] and parsing.scan_functions("") == []


def pieces(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_prose_packs_paragraphs(spark):
    text = "\n\n".join(["a" * 40, "b" * 40, "c" * 250, "d" * 10])
    assert pieces(spark, text, lambda c: parsing.split_prose(c, 100, 20)) == ["a" * 40 + "\n\n" + "b" * 40, "c" * 100, "c" * 100, "c" * 90, "d" * 10]
    assert pieces(spark, "  ", lambda c: parsing.split_prose(c, 100, 20)) == []
    with pytest.raises(ValueError):
        Options(chunk_overlap_chars=2200)


@settings(max_examples=12, deadline=None)
@given(st.integers(30, 400), st.integers(20, 60), st.integers(0, 15))
def test_windows_cover_the_text(spark, n, target, overlap):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = pieces(spark, text, lambda c: parsing.split_prose(c, target, overlap))
    whole, step = got[0], target - overlap
    for p in got[1:]:
        whole += p[overlap:]
    assert whole == text and all(len(p) <= target for p in got) and len(got) == (1 if n <= target else -(-(n - overlap) // step))


def test_tables_and_code(spark):
    table = "\n".join(["| h |", "|---|", *[f"| {i} |" for i in range(9)]])
    got = pieces(spark, table, lambda c: parsing.split_table(c, 4))
    assert [g.count("\n") + 1 for g in got] == [6, 6, 3] and all(g.startswith("| h |\n|---|\n") for g in got)
    assert pieces(spark, table, lambda c: parsing.split_table(c, 7)) == [table] * 2 or pieces(spark, table, lambda c: parsing.split_table(c, 9)) == [table]
    code = "\n".join(["```c", *[f"line {i} " + "x" * 20 for i in range(170)], "```"])
    got = pieces(spark, code, lambda c: parsing.split_code(c, 2200))
    assert len(got) == 3 and all(g.startswith("```") and g.endswith("```") for g in got) and got[1].split("\n")[1].startswith("line 69 ")
    few = "```\n" + "y" * 3000 + "\n```"
    assert pieces(spark, few, lambda c: parsing.split_code(c, 2200)) == [few]


def test_c_language_joins_the_terms_only_with_others(spark):
    rows = [("C_x ck_y", "code"), ("python ck_y", "code"), ("java ck_y", "code"), ("java ck_y", "prose")]
    chunks = spark.createDataFrame([(str(i), "d", "p", "u", "t", ["h C_Head"], t, k) for i, (t, k) in enumerate(rows)], "chunk_id string, document_id string, page_id string, source_url string, title string, heading_path array<string>, text string, chunk_type string")
    got = {r.chunk_id: r.metadata for r in enrich.enrich(chunks, Dictionary()).collect()}
    assert [got[str(i)].language_tags for i in range(4)] == [["c"], ["python"], ["java", "c"], ["java"]]
    assert "c" not in got["0"].entity_terms and "c" in got["2"].entity_terms
    assert got["0"].api_symbols == ["C_Head", "C_x"] and got["0"].heading_path_text == "h C_Head"


def test_line_breaks(spark):
    assert pieces(spark, "a\r\nb\x0bc\u2028d\n", parsing.lines) == ["a", "b", "c", "d"] and pieces(spark, "", parsing.lines) == []
    assert pieces(spark, " a\n\n\n\nb ", squeeze_lines) == "a\n\nb"


def test_code_is_split_once_a_row(spark):
    rows = spark.createDataFrame([("\n".join(["```c", *[f"call({i});" for i in range(200)], "```"]),), ("short",)], "text string")
    out = rows.select(parsing.split_code(F.col("text"), 300, 80, 10).alias("parts"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    long, short = (r.parts for r in out.collect())
    assert short == ["short"] and len(long) == 3 and long[0].startswith("```c\ncall(0);") and long[1].startswith("```\ncall(69);") and long[1].endswith("call(148);\n```") and long[2].endswith("call(199);\n```")


def test_code_windows_deals_a_file_out(spark, tmp_path):
    from sedimenta import catalog

    spark.createDataFrame([(i, f"s{i}") for i in range(64)], "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    made = catalog.queries()["code_windows"](spark, f"file://{tmp_path}")
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_python_gets_a_few_mb_of_documents_at_once(spark):
    import pandas as pd

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(1 << 30))
    try:
        docs = spark.range(64, numPartitions=1).select(F.col("id").alias("document_id"), F.lit("p").alias("page_id"), F.lit("u").alias("source_url"), F.lit("t").alias("title"), F.repeat(F.lit("word "), 100_000).alias("clean_markdown"))
        assert parsing.chunk(docs, Options()).select("document_id").distinct().count() == 64
        size = F.pandas_udf(lambda t: pd.Series([len(t)] * len(t)), "long")
        assert docs.select(size("clean_markdown").alias("n")).agg(F.max("n")).first()[0] <= 16
    finally:
        spark.conf.set(name, held)
