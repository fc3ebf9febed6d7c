"""Query analysis: entities, rewriting, filters and routing of a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import FIELDS, Dictionary, augment, entities, merge
from ..functions.text import trim_space

# Phrases that stand for API functions, section names, and the markers of each kind of question.
INTENT_SYMBOLS = {
    "C_CreateObject": ("создания объекта", "создать объект", "создания объектов", "создает объект"),
    "C_DestroyObject": ("удаления объекта", "удалить объект", "удаляет объект", "уничтожения объекта"),
    "C_SignInit": ("инициализации операции подписи", "инициализирует операцию подписи", "инициализации подписи", "подготовки подписи"),
    "C_Sign": ("создание подписи после инициализации", "выполняет создание подписи", "создает подпись", "сформировать подпись", "выполняет подпись"),
    "C_VerifyInit": ("инициализации операции проверки", "инициализирует операцию проверки", "инициализации проверки подписи", "подготовки проверки подписи"),
    "C_Verify": ("саму проверку подписи", "проверки подписи", "выполняет проверку подписи", "проверяет подпись"),
    "C_GenerateKeyPair": ("генерации пары ключей", "сгенерировать пару ключей", "генерирует пару ключей", "пары ключей"),
    "C_DeriveKey": ("производного получения ключа", "производный ключ", "derive key", "получения производного ключа"),
}
SECTION_TERMS = ("Синтаксис", "Параметры", "Назначение", "Примечание", "Возвращаемые значения", "Пример")
SECTION_QUESTIONS = ("какие разделы", "описание функции", "какие секции")
RELATION_MARKERS = ("архитектур", "интеграц", "связ", "взаимодейств", "компонент", "инфраструктур", "совместим", "поддержива", "какие ос", "какие интерфейсы", "какие продукты", "какие варианты", "чем отличаются", "сравн", "завис", "требован", "что нужно для", "что требуется для")
EXACT_MARKERS = ("функц", "вызов", "код ошибки", "ошибка", "пример команды", "команда", "--", "синтаксис", "параметр", "возвращаем")
EXACT_PARTS = ("ckr_", "c_", "--")
ROUTING_MARKERS = ("где опис", "в какой инструкции", "на какой странице", "в каком разделе", "где в документации")
FACTOID_MARKERS = ("какой порт", "какая версия", "какой скрипт", "какой файл", "какая утилита", "какая команда", "какой компонент", "какое имя")
CODE_MARKERS = ("пример", "код", "python", "c#", "java", "как сделать")
MAJOR = ("products", "interfaces", "components", "os_tags")
ACCEPT, MIXED = 0.75, 0.6
QUERY_MODES = ("classic", "graph_first", "mixed")


def any_of(text: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def inferred_symbols(lowered: Column) -> Column:
    return F.array_compact(F.array(*[F.when(any_of(lowered, phrases), s) for s, phrases in INTENT_SYMBOLS.items()]))


def query_entities(question: Column, dictionary: Dictionary) -> Column:
    """Entities of the question with the symbols that its phrases stand for; those imply the interface pkcs11."""
    none, symbols = F.expr("cast(array() as array<string>)"), inferred_symbols(F.lower(question))
    more = F.struct(*[(symbols if f == "api_symbols" else F.when(F.size(symbols) > 0, F.array(F.lit("pkcs11"))).otherwise(none) if f == "interfaces" else none).alias(f) for f in FIELDS])
    return merge(entities(question, dictionary), more)


def rewrite(question: Column, found: Column, original: Column | None = None) -> Column:
    """The question with its entity terms, then call forms and section names that aren't in it yet."""
    base, low = augment(question, found), F.lower(question if original is None else original)
    calls = F.transform(found["api_symbols"], lambda s: F.concat(s, F.lit("()")))
    sections = F.when(F.array_contains(found["interfaces"], "pkcs11") & any_of(low, SECTION_QUESTIONS), F.array(*map(F.lit, (*SECTION_TERMS, "reference")))).otherwise(F.expr("cast(array() as array<string>)"))
    extra = F.filter(F.array_distinct(F.concat(calls, sections)), lambda t: ~F.contains(base, t))
    return F.when(F.size(extra) > 0, F.concat_ws(" ", base, F.array_join(extra, " "))).otherwise(base)


def is_exact(low: Column, found: Column) -> Column:
    return (F.size(found["api_symbols"]) > 0) | (F.array_contains(found["interfaces"], "pkcs11") & any_of(low, EXACT_MARKERS)) | any_of(low, EXACT_PARTS)


def is_relation(low: Column, found: Column) -> Column:
    """low covers the question and its rewritten form."""
    return any_of(low, RELATION_MARKERS) & (sum((F.size(found[f]) for f in MAJOR[1:]), F.size(found[MAJOR[0]])) >= 2)


def known_mode(value: Column) -> Column:
    low = F.lower(trim_space(value))
    return F.when(low.isin(*QUERY_MODES), low)


def known_confidence(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def routed_mode(exact: Column, relation: Column, forced: Column, router: Column, confidence: Column) -> Column:
    """The mode of a question that a router has judged: its choice counts if it is sure enough and the question fits."""
    fallback = F.when(exact & relation, "mixed").when(relation, "graph_first").otherwise("classic")
    mixed = ((confidence >= ACCEPT) & exact & relation) | ((confidence >= MIXED) & relation)
    return F.when(forced, "classic").when(router == "classic", "classic").when(router == "mixed", F.when(mixed, "mixed").otherwise("classic")).when(router == "graph_first", F.when((confidence >= ACCEPT) & relation, "graph_first").otherwise("classic")).otherwise(fallback)


def merge_filters(given: Column, found: Column) -> Column:
    """Filters: lists that a router gives, then the entities. Scalars among a router's filters don't count."""
    return merge(given, found)


def analyze(queries: DataFrame, dictionary: Dictionary, query_col: str = "question", routed: DataFrame | None = None) -> DataFrame:
    """Adds entities, rewritten_query, filters, intent, needs_code, query_mode, routing_confidence and routing_reason.

    routed, if a provider is set up: (qid, mode, confidence, filters, rewritten, reason), filters a struct of lists;
    questions without a row there, or with a forced mode, go by heuristics."""
    q = F.col(query_col)
    rows = queries.withColumn("entities", query_entities(q, dictionary)).withColumn("rewritten_query", rewrite(q, F.col("entities")))
    rows = rows.withColumn("filters", F.col("entities"))
    low, e = F.lower(q), F.col("entities")
    exact, routing, factoid = is_exact(low, e), any_of(low, ROUTING_MARKERS), any_of(low, FACTOID_MARKERS)
    relation = is_relation(F.lower(F.concat_ws(" ", q, "rewritten_query")), e)
    forced = exact | routing | factoid
    fallback = F.when(exact & relation, "mixed").when(relation, "graph_first").otherwise("classic")
    intent = F.when(~forced, "general").when(routing, "routing").when(factoid, "factoid").when(F.contains(low, F.lit("pkcs11")), "api_reference").otherwise("general")
    rows = rows.select("*", intent.alias("intent"), any_of(low, CODE_MARKERS).alias("needs_code"), F.when(forced, "classic").otherwise(fallback).alias("query_mode"), F.when(forced, 1.0).alias("routing_confidence"), F.when(forced, "forced_classic").otherwise("heuristic_fallback").alias("routing_reason"), exact.alias("_exact"), relation.alias("_relation"), forced.alias("_forced"))
    if routed is not None:
        judged = routed.select("qid", known_mode(F.col("mode")).alias("_mode"), known_confidence(F.col("confidence")).alias("_sure"), F.col("filters").alias("_filters"), F.col("rewritten").alias("_rewritten"), F.col("reason").alias("_reason"), F.lit(True).alias("_judged"))
        rows = rows.join(judged, "qid", "left")
        use = F.coalesce(F.col("_judged"), F.lit(False)) & ~F.col("_forced")
        new = {"rewritten_query": rewrite(F.coalesce("_rewritten", q), e, q), "filters": merge_filters(F.col("_filters"), e), "query_mode": routed_mode(F.col("_exact"), F.col("_relation"), F.col("_forced"), F.col("_mode"), F.col("_sure")), "routing_confidence": F.col("_sure"), "routing_reason": F.coalesce("_reason", F.lit("llm_router"))}
        rows = rows.withColumns({c: F.when(use, v).otherwise(F.col(c)) for c, v in new.items()})
    return rows.drop("_exact", "_relation", "_forced", "_mode", "_sure", "_filters", "_rewritten", "_reason", "_judged")
