"""Text generators and routers behind one call, `complete(system, user) -> str`. None is needed: without one the engine
answers and routes by rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import FIELDS, Dictionary

ANSWER_RULES = """Answer only from the numbered sources. Name the sources that each statement rests on. If the sources do not hold the
answer, say that the context has no data for it. Keep names of functions, parameters and commands as they are written."""
ROUTER_RULES = f"""Judge how a question should be searched. Reply with one JSON object: query_mode (classic, graph_first or mixed),
confidence (0 to 1), rewritten_query, reason, and filters, an object whose lists may be {', '.join(FIELDS)}. Use graph_first for
questions about relations between products, interfaces, components or systems, mixed if they also name exact functions or codes."""
_REPLY = "query_mode string, confidence string, rewritten_query string, reason string, filters struct<" + ", ".join(f"{f}: array<string>" for f in FIELDS) + ">"


def _ask(prompts: DataFrame, system: str, complete: Callable[[str, str], str]) -> DataFrame:
    """Adds reply; null where the provider fails, which never fails the batch."""

    def one(prompt: str):
        try:
            return complete(system, prompt)
        except Exception:  # noqa: BLE001  providers raise what they like
            return None

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(one)

    return prompts.withColumn("reply", run("prompt"))


def _named(make: Callable, is_configured: bool) -> Callable:
    """A provider with what health() reports of it."""
    make.is_configured = is_configured
    return make


def reranker(score: Callable[[str, list[str]], list[float]], batch: int = 32, is_configured: bool = True) -> Callable[[Column, Column], Column]:
    """For Engine(reranker=...): a model that scores texts for a query, in their order. It gets the texts of one query
    together, up to `batch` at a time; the pairs that lie in one Arrow batch are put together first. Null texts count as
    empty. An error fails the job, as order would be made up otherwise."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in parts:
            out, texts = pd.Series(0.0, index=queries.index), texts.fillna("")
            for query, some in texts.groupby(queries.fillna(""), sort=False):
                for at in range(0, len(some), batch):
                    piece = some.iloc[at : at + batch]
                    scores = list(score(query, piece.tolist()))
                    if len(scores) != len(piece):
                        raise ValueError(f"the reranker gave {len(scores)} scores for {len(piece)} texts")
                    out[piece.index] = [float(x) for x in scores]
            yield out

    return _named(lambda query, text: run(query, text), is_configured)


def generator(complete: Callable[[str, str], str], is_configured: bool = True) -> Callable[[DataFrame], DataFrame]:
    """For Engine(generator=...): prompts (qid, prompt) to (qid, answer)."""
    return _named(lambda prompts: _ask(prompts, ANSWER_RULES, complete).select("qid", F.col("reply").alias("answer")), is_configured)


def router(complete: Callable[[str, str], str], dictionary: Dictionary | None = None, is_configured: bool = True) -> Callable[[DataFrame], DataFrame]:
    """For Engine(router=...): questions to judgements. The model is told the values that filters may have, those of the
    dictionary. A reply that is no JSON object counts as none; filters that aren't lists, and empty values in lists, go."""
    known = {f: sorted(set(a.values())) for f, a in (dictionary or Dictionary()).aliases.items()}
    rules = f"{ROUTER_RULES}\nValues of the filters: " + "; ".join(f"{f}: {', '.join(v)}" for f, v in known.items() if v) + "."

    def route(queries: DataFrame) -> DataFrame:
        said = _ask(queries.select("qid", F.col("question").alias("prompt")), rules, complete)
        r = said.select("qid", F.from_json("reply", _REPLY).alias("r")).where("r is not null and r.query_mode is not null")
        lists = F.struct(*[F.filter(F.coalesce(F.col(f"r.filters.{f}"), F.expr("cast(array() as array<string>)")), lambda v: v.isNotNull() & (v != "")).alias(f) for f in FIELDS])
        return r.select("qid", F.col("r.query_mode").alias("mode"), "r.confidence", F.col("r.rewritten_query").alias("rewritten"), "r.reason", lists.alias("filters"))

    return _named(route, is_configured)
