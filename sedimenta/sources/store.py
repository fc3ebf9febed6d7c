"""The store of question sets and runs: versioned tables with explicit schemas."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import page_tag
from .tables import Conflict, Tables

SCHEMAS = {
    "question_sets": "id string, name string, description string, created_at timestamp, updated_at timestamp",
    "questions": "id string, set_id string, case_key string, position int, question string, tags array<string>, reference_answer string, exact_answer string, required_terms array<string>, required_any array<array<string>>, forbidden_terms array<string>, required_sources array<string>, expected_refusal boolean, notes string",
    "runs": "id string, set_id string, set_name string, retrieval_mode string, created_at timestamp, total_cases long, passed_cases long, pass_rate double, average_score double, average_latency_ms double, p95_latency_ms double, summary string",
    "run_cases": "id string, run_id string, question_id string, case_key string, case_order int, passed boolean, score double, evaluation string",
}
LISTS = ("tags", "required_terms", "forbidden_terms", "required_sources")
#: Buckets of the tables of sets, and how often a change is tried against other writers.
SET_BUCKETS, RETRIES = 16, 5


def page_url(page_id, host: str) -> str:
    """The address of a page of a wiki host."""
    return f"https://{host}/pages/viewpage.action?pageId={page_id}"


def question(case_key: str, text: str, answer: str | None = None, *, sources=(), tags=(), required_terms=(), required_any=(), forbidden_terms=(), exact_answer: str | None = None, notes: str | None = None) -> dict:
    """A question of a set, as create_set() takes it."""
    lists = {"tags": tags, "required_terms": required_terms, "forbidden_terms": forbidden_terms, "required_sources": sources}
    return {c: list(v) for c, v in lists.items()} | {"case_key": case_key, "question": text, "reference_answer": answer, "exact_answer": exact_answer, "notes": notes, "required_any": [list(g) for g in required_any], "expected_refusal": False}


def routing_cases(documents: DataFrame) -> DataFrame:
    """A question for every document (document_id, title, source_url): which page is about its title. The page must be
    cited; tagged as routing, and by page."""
    asked = F.concat(F.lit("Где описано «"), F.col("title"), F.lit("»?"))
    tag = page_tag(F.array("source_url"))
    return documents.select(F.concat(F.lit("routing-"), F.col("document_id").cast("string")).alias("case_key"), asked.alias("question"), F.concat(F.lit("Это описано на странице «"), F.col("title"), F.lit("».")).alias("reference_answer"), F.array("source_url").alias("required_sources"), F.array(F.lit("routing"), tag).alias("tags"))


def reworded(questions: DataFrame, cases: DataFrame, *tags: str) -> DataFrame:
    """A research set: cases (case_key, question, bucket, notes) put the stored questions another way and keep their checks;
    tags of both, the given ones, the bucket and the page's, each once."""
    kept = research_cases(cases, questions)
    named = questions.groupBy("case_key").agg(F.max_by("tags", "position").alias("old"))
    every = F.concat(F.coalesce("old", F.array().cast("array<string>")), F.array(*map(F.lit, tags), F.col("bucket"), page_tag(F.col("required_sources"))))
    return kept.join(named, "case_key").withColumn("tags", F.array_distinct(F.filter(every, lambda t: t.isNotNull() & (t != "")))).drop("old", "bucket")


def list_sets(sets: DataFrame, questions: DataFrame, runs: DataFrame) -> DataFrame:
    """Sets with their number of questions and last run, latest change first. Both sides are counted before they join."""
    n = questions.groupBy("set_id").agg(F.count("*").alias("question_count"))
    last = runs.groupBy("set_id").agg(F.max("created_at").alias("last_run_at"))
    out = sets.join(n, sets.id == n.set_id, "left").drop("set_id").join(last, sets.id == last.set_id, "left").drop("set_id")
    return out.fillna(0, ["question_count"]).orderBy(F.desc("updated_at"), F.desc("created_at"), "id")


def set_detail(sets: DataFrame, questions: DataFrame, set_id: str | None = None) -> DataFrame:
    """Sets (or one) with their questions in order, in one row each."""
    if set_id is not None:
        sets, questions = sets.where(F.col("id") == set_id), questions.where(F.col("set_id") == set_id)
    rows = questions.select("set_id", F.struct("position", *[c for c in questions.columns if c not in ("position", "set_id")]).alias("q"))
    listed = rows.groupBy("set_id").agg(F.sort_array(F.collect_list("q")).alias("questions"))  # the questions of one set
    return sets.join(listed, sets.id == listed.set_id, "left").drop("set_id")


def list_runs(runs: DataFrame, set_id: str | None = None, limit: int = 100) -> DataFrame:
    """The latest runs (1 to 500), without their summaries."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    rows = runs if set_id is None else runs.where(F.col("set_id") == set_id)
    rows = rows.withColumn("retrieval_mode", F.coalesce("retrieval_mode", F.lit("hybrid"))).drop("summary")
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)


def run_detail(runs: DataFrame, cases: DataFrame, run_id: str | None = None) -> DataFrame:
    """Runs (or one) with their cases in order."""
    if run_id is not None:
        runs, cases = runs.where(F.col("id") == run_id), cases.where(F.col("run_id") == run_id)
    listed = cases.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("case_order", "case_key", "passed", "score", "evaluation"))).alias("cases"))
    return runs.join(listed, runs.id == listed.run_id, "left").drop("run_id")


def absent(seeds: DataFrame, sets: DataFrame) -> DataFrame:
    """The seeds whose id no set has; blank ids never count."""
    return seeds.where(F.trim("id") != "").join(sets.select("id"), "id", "left_anti")


def checked(questions: DataFrame) -> DataFrame:
    """The questions of one set as they are stored: trimmed, keyed (by case_key, else id, else place) and without nulls in
    lists and flags. ValueError, naming the first in order, where a question or a key is blank or a key comes twice."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    key = F.trim(F.coalesce(given("case_key"), given("id"), F.format_string("case-%d", "position")))
    filled = {c: F.coalesce(F.col(c), F.array().cast(questions.schema[c].dataType)) for c in (*LISTS, "required_any")}
    rows = questions.withColumns({"case_key": key, "question": F.trim(F.coalesce("question", F.lit(""))), "id": F.coalesce(given("id"), F.uuid()), "expected_refusal": F.coalesce("expected_refusal", F.lit(False)), **filled})
    blank = (F.col("question") == "") | (F.col("case_key") == "")
    bad = rows.groupBy("case_key").agg(F.min("position").alias("at"), F.count("*").alias("n"), F.min(F.when(blank, F.col("position"))).alias("blank")).where("n > 1 or blank is not null").orderBy(F.coalesce("blank", "at")).first()
    if bad:
        raise ValueError(f"question {bad.blank} lacks a text or a key" if bad.blank else f"{bad.n} questions share the key {bad.case_key!r}")
    return rows


def research_cases(cases: DataFrame, questions: DataFrame) -> DataFrame:
    """Cases reworded from stored questions: each takes the checks of the question with its case_key (the last of several)."""
    last = Window.partitionBy("case_key").orderBy(F.desc("position"))
    kept = questions.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "question", "tags", "position", "notes")
    return cases.join(kept, "case_key")


class Store:
    """Tables under one folder; what belongs together changes in one version. Adding a run reads nothing of the others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, Tables(spark, path)

    def read(self, name: str) -> DataFrame:
        """The table; empty if it was never written. Columns that an older version lacks are null."""
        empty, held = self.spark.createDataFrame([], SCHEMAS[name]), self.tables.read(name)
        return empty if held is None else empty.unionByName(held, allowMissingColumns=True)

    def _change(self, make) -> None:
        """Makes the changes of make(change); anew where another writer came first."""
        for attempt in range(RETRIES):
            try:
                with self.tables.change() as change:
                    make(change)
                return
            except Conflict:
                if attempt == RETRIES - 1:
                    raise

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in fields])

    def _question_rows(self, set_id: str, items: list[dict]) -> DataFrame:
        text = ("id", "case_key", "question", "reference_answer", "exact_answer", "notes")
        rows = [{c: None if q.get(c) is None else str(q[c]) for c in text} | {c: q.get(c) for c in (*LISTS, "required_any", "expected_refusal")} | {"position": i, "set_id": set_id} for i, q in enumerate(items, 1)]
        return checked(self.spark.createDataFrame(rows, SCHEMAS["questions"]))

    def _put_set(self, set_id: str, payload: dict, created=None) -> None:
        name = str(payload.get("name", "")).strip()
        if not name:
            raise ValueError("a question set needs a name")
        questions = self._question_rows(set_id, payload.get("questions", []))
        now = F.current_timestamp()
        row = self.spark.range(1).select(F.lit(set_id).alias("id"), F.lit(name).alias("name"), F.lit(payload.get("description")).cast("string").alias("description"), (F.lit(created) if created else now).alias("created_at"), now.alias("updated_at"))

        def make(change) -> None:
            change.upsert("question_sets", self._typed("question_sets", row), "id", buckets=SET_BUCKETS)
            change.upsert("questions", self._typed("questions", questions), "set_id", self.spark.createDataFrame([(set_id,)], "set_id string"), SET_BUCKETS)

        self._change(make)

    def create_set(self, payload: dict) -> str:
        set_id = str(payload.get("id") or uuid4())
        self._put_set(set_id, payload)
        return set_id

    def update_set(self, set_id: str, payload: dict) -> bool:
        """Replaces a set and its questions; False if there is no such set."""
        held = self.read("question_sets").where(F.col("id") == set_id).select("created_at").first()
        if held is None:
            return False
        self._put_set(set_id, payload, held[0])
        return True

    def seed(self, payloads: list[dict]) -> list[str]:
        """Creates the sets whose ids aren't there yet."""
        ids = {r.id for r in self.read("question_sets").select("id").collect()}  # one row a set
        new = [p for p in payloads if str(p["id"]).strip() and str(p["id"]).strip() not in ids]
        return [self.create_set(p) for p in {str(p["id"]).strip(): p for p in reversed(new)}.values()][::-1]

    def seed_from_jsonl(self, path: str, name: str = "Seed dataset") -> bool:
        """Fills an empty store from a file of one question a line; blank lines don't count."""
        if not self.read("question_sets").isEmpty():
            return False
        lines = self.spark.read.text(path).where(F.trim("value") != "")
        fields = "id string, case_key string, question string, tags array<string>, reference_answer string, exact_answer string, required_terms array<string>, required_any array<array<string>>, forbidden_terms array<string>, required_sources array<string>, expected_refusal boolean, notes string"
        rows = [r.q.asDict() for r in lines.select(F.from_json("value", fields).alias("q")).collect()]  # one question set
        if not rows:
            return False
        self.create_set({"name": name, "questions": [{**r, "case_key": r["id"] or r["case_key"], "id": None} for r in rows]})
        return True

    def save_run(self, set_id: str, set_name: str, mode: str, summary: DataFrame, results: DataFrame) -> str:
        """Adds a run with its summary (one row) and cases, in one version."""
        run_id = str(uuid4())
        head = summary.select(F.lit(run_id).alias("id"), F.lit(set_id).alias("set_id"), F.lit(set_name).alias("set_name"), F.lit(mode).alias("retrieval_mode"), F.current_timestamp().alias("created_at"), "total_cases", "passed_cases", "pass_rate", "average_score", "average_latency_ms", "p95_latency_ms", F.to_json(F.struct("*")).alias("summary"))
        cases = results.select(F.uuid().alias("id"), F.lit(run_id).alias("run_id"), "question_id", "case_key", "case_order", "passed", "score", F.to_json(F.struct(*[c for c in results.columns if c not in ("question_id",)])).alias("evaluation"))

        def make(change) -> None:
            change.append("runs", self._typed("runs", head))
            change.append("run_cases", self._typed("run_cases", cases))

        self._change(make)
        return run_id
