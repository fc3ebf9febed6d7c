"""Deterministic checks of answers, ranking metrics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable, comparable_source

# What counts as a refusal; the checks in order.
REFUSALS = ("в доступном контексте нет", "в контексте нет", "в предоставленном контексте нет", "нет данных", "недостаточно данных", "не удалось найти", "не найден", "не найдено")
CHECKS = ("exact_match", "required_terms", "required_any", "forbidden_terms", "citations", "refusal")
UNTAGGED = "untagged"


def _missing(wanted: Column, answer: Column) -> Column:
    return F.filter(wanted, lambda t: ~F.contains(answer, comparable(t)))


def check_cases(cases: DataFrame) -> DataFrame:
    """Adds checks (a struct of applicable and passed for each), the diagnostics, score and passed.

    cases has answer, cited (source addresses) and the fields of a case: required_terms, required_any, forbidden_terms,
    required_sources, exact_answer, expected_refusal. A null list is empty; a null exact answer asks for nothing, an
    empty one for an empty answer."""
    none = F.expr("cast(array() as array<string>)")
    for c in ("required_terms", "forbidden_terms", "required_sources", "cited"):
        cases = cases.withColumn(c, F.coalesce(c, none))
    rows = cases.withColumn("required_any", F.coalesce("required_any", F.expr("cast(array() as array<array<string>>)"))).withColumn("_a", comparable(F.col("answer")))
    a, cited = F.col("_a"), F.transform("cited", comparable_source)
    rows = rows.withColumns({
        "missing_required_terms": _missing(F.col("required_terms"), a),
        "missing_required_groups": F.filter("required_any", lambda g: ~F.exists(g, lambda t: F.contains(a, comparable(t)))),
        "unexpected_forbidden_terms": F.filter("forbidden_terms", lambda t: F.contains(a, comparable(t))),
        "missing_sources": F.filter("required_sources", lambda s: ~F.array_contains(cited, comparable_source(s))),
    })
    refusal = F.exists(F.array(*map(F.lit, REFUSALS)), lambda p: F.contains(a, p))
    judged = {
        "exact_match": (F.col("exact_answer").isNotNull(), F.coalesce(comparable(F.col("exact_answer")) == a, F.lit(True))),
        "required_terms": (F.size("required_terms") > 0, F.size("missing_required_terms") == 0),
        "required_any": (F.size("required_any") > 0, F.size("missing_required_groups") == 0),
        "forbidden_terms": (F.size("forbidden_terms") > 0, F.size("unexpected_forbidden_terms") == 0),
        "citations": (F.size("required_sources") > 0, F.size("missing_sources") == 0),
        "refusal": (F.lit(True), refusal == F.coalesce("expected_refusal", F.lit(False))),
    }
    rows = rows.withColumn("checks", F.struct(*[F.struct(x.alias("applicable"), y.alias("passed")).alias(n) for n, (x, y) in judged.items()])).withColumn("actual_refusal", refusal)
    applied = F.filter(F.array(*[F.col(f"checks.{n}") for n in CHECKS]), lambda c: c["applicable"])
    return rows.withColumn("score", F.round(F.size(F.filter(applied, lambda c: c["passed"])) / F.size(applied), 4)).withColumn("passed", F.forall(applied, lambda c: c["passed"])).drop("_a")


def ranking_metrics(required: Column, ranked: Column, recall_k: int = 5, k: int = 10) -> Column:
    """A struct (applicable, recall, mrr, ndcg) over distinct folded source addresses; not applicable without any wanted."""
    wanted = F.array_distinct(F.transform(F.filter(required, lambda s: F.trim(s) != ""), comparable_source))
    found = F.slice(F.array_distinct(F.transform(F.filter(ranked, lambda s: s.isNotNull() & (s != "")), comparable_source)), 1, k)
    applicable = F.coalesce(F.size(wanted), F.lit(0)) > 0
    recall = F.size(F.array_intersect(wanted, F.slice(found, 1, recall_k))) / F.size(wanted)
    places = F.filter(F.transform(found, lambda s, i: F.when(F.array_contains(wanted, s), i + 1)), lambda p: p.isNotNull())
    gain = lambda ps: F.aggregate(ps, F.lit(0.0), lambda a, p: a + 1 / F.log2(p + 1))
    ndcg = gain(places) / gain(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(wanted), F.lit(k)))))
    put = lambda x, name: F.when(applicable, F.round(x, 4)).alias(name)
    return F.struct(applicable.alias("applicable"), put(recall, "recall"), put(F.coalesce(1 / F.array_min(places), F.lit(0.0)), "mrr"), put(ndcg, "ndcg"))


def check_metrics(results: DataFrame) -> DataFrame:
    """(check, applicable, passed, rate); the rate is null where nothing applied. One pass over the cases."""
    rows = results.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"checks.{n}.applicable").alias("a"), F.col(f"checks.{n}.passed").alias("p")) for n in CHECKS])).alias("c")).select("c.*")
    n, ok = F.count_if("a"), F.count_if(F.col("a") & F.col("p"))
    return rows.groupBy("check").agg(n.alias("applicable"), ok.alias("passed"), F.when(n > 0, F.round(ok / n, 4)).alias("rate"))


def summary(results: DataFrame) -> DataFrame:
    """One row: cases, passed cases, pass rate, average score, latency (average, 95th percentile) and ranking means."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = lambda m: F.round(F.avg(F.when(F.col("metrics.applicable"), F.col(f"metrics.{m}"))), 4)
    return results.agg(F.count("*").alias("total_cases"), F.count_if("passed").alias("passed_cases"), zero(F.round(F.avg(F.col("passed").cast("int")), 4)).alias("pass_rate"), zero(F.round(F.avg("score"), 4)).alias("average_score"), zero(F.round(F.avg("latency_ms"), 2)).alias("average_latency_ms"), zero(F.round(F.percentile("latency_ms", F.lit(0.95)), 2)).alias("p95_latency_ms"), F.count_if("metrics.applicable").alias("ranked_cases"), mean("recall").alias("recall_at_5"), mean("mrr").alias("mrr_at_10"), mean("ndcg").alias("ndcg_at_10"))


def per_tag(results: DataFrame) -> DataFrame:
    """(tag, total, passed, pass_rate, average_score); a tag that a case repeats counts twice, none counts as untagged."""
    tags = F.when(F.coalesce(F.size("tags"), F.lit(0)) <= 0, F.array(F.lit(UNTAGGED))).otherwise(F.col("tags"))
    rows = results.select(F.explode(tags).alias("tag"), "passed", "score")
    return rows.groupBy("tag").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"), F.round(F.avg("score"), 4).alias("average_score"))
