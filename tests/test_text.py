import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sedimenta.functions import entities as ent
from sedimenta.functions import scalar
from sedimenta.functions import text as txt


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_tokens_and_symbols(spark):
    assert one(spark, "Ёж PKCS#11 a.b/c c++ x_y Ключ", txt.tokens) == ["ж", "pkcs#11", "a.b/c", "c++", "x_y", "ключ"]
    assert one(spark, "C_Sign() CKR_OK C_Sign rtX aC_not ckr_no CKA\\_ID xrtY", txt.symbols) == ["C_Sign", "CKR_OK", "rtX"]
    assert one(spark, "", txt.tokens) == [] and one(spark, None, txt.tokens) is None


def test_markup(spark):
    assert one(spark, " ![i](u) **b** [l](v) `c`  d\\_e \\# f\u00a0g ", txt.clean_inline) == "b l c d_e # f g"
    assert one(spark, "a\n\n\n\nb\n\nc\n\n", txt.squeeze_lines) == "a\n\nb\n\nc"
    assert one(spark, "Ёлка «x» (`y`), [l](v) **z**!", txt.comparable) == "елка x y z"
    assert one(spark, " HTTP://A.b/c// ", txt.comparable_source) == "http://a.b/c"


def test_snippet(spark):
    text = "x " * 300 + "needle " + "y " * 300
    rows = spark.createDataFrame([(text, "a needle"), ("One. Two! Three? Four.", "zz"), ("", "q"), ("short needle", "needle")], "t string, q string")
    got = [r.x for r in rows.select(txt.snippet(F.col("t"), F.col("q")).alias("x")).collect()]
    assert got[0].startswith("...") and got[0].endswith("...") and "needle" in got[0] and len(got[0]) <= 426
    assert got[1:] == ["One. Two! Three?", "", "short needle"]


def test_entities(spark):
    d = ent.Dictionary().add(products={"my key": "my_key"})
    row = spark.createDataFrame([("A My Key on Google via PKCS#11 and javascript, C_Sign",)], "t string").select(ent.entities(F.col("t"), d).alias("e")).first().e
    # aliases count inside words: go in google, java in javascript
    assert row.products == ["my_key"] and row.interfaces == ["pkcs11"] and row.language_tags == ["java", "javascript", "go"] and row.api_symbols == ["C_Sign"]
    got = spark.createDataFrame([("q",)], "t string").select(ent.augment(F.col("t"), ent.entities(F.lit("linux pkcs 11"), d)).alias("x")).first().x
    assert got == "q pkcs11 linux"


@pytest.mark.parametrize("title,family", [("Архитектура", "architecture"), ("ОБЗОРНАЯ ИНФОРМАЦИЯ", "product_matrix"), ("Объекты PKCS #11", "pkcs11_objects"), ("Объекты", "general"), ("Стек PC/SC", "pcsc"), ("Рекомендации", "recommendations")])
def test_family(spark, title, family):
    assert one(spark, title, ent.family) == family


def test_uuid5_and_page_tag(spark):
    import uuid

    assert one(spark, "chunk-é-00001", lambda c: scalar.uuid5("url", c)) == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk-é-00001"))
    tag = lambda *s: spark.range(1).select(scalar.page_tag(F.array(*map(F.lit, s))).alias("x")).first().x
    assert tag("http://x", "http://y?pageId=7&pageId=42") == "page_42" and tag("http://x") == "page_unknown"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t*`_[]()!#", max_size=30), min_size=1, max_size=5))
def test_folding_is_stable(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(txt.comparable(F.col("t")).alias("a")).select("a", txt.comparable(F.col("a")).alias("b"))
    assert all("  " not in r.a and r.a == r.a.strip() for r in rows.collect())
