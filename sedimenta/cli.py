"""Command line: ingest pages, seed question sets, run a question set."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .options import Options
from .plans.engine import MODES, Engine


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sedimenta")
    parser.add_argument("--home", required=True, help="folder of the index tables")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest").add_argument("folder")
    commands.add_parser("seed").add_argument("file", help="JSON: a list of question sets, or questions one a line (.jsonl)")
    run = commands.add_parser("run")
    run.add_argument("--set-id")
    run.add_argument("--retrieval-mode", choices=MODES, default="hybrid")
    commands.add_parser("health")
    given = parser.parse_args(argv)
    engine = Engine(SparkSession.builder.getOrCreate(), given.home, Options.from_env())
    if given.command == "ingest":
        out = engine.ingest(given.folder)
    elif given.command == "health":
        out = engine.health()
    elif given.command == "seed":
        if given.file.endswith(".jsonl"):
            out = {"seeded": engine.store.seed_from_jsonl(given.file)}
        else:
            with open(given.file, encoding="utf-8") as f:
                out = {"seeded": engine.store.seed(json.load(f))}
    else:
        set_id = given.set_id
        if not set_id:
            first = engine.store.read("question_sets").orderBy("updated_at", ascending=False).first()
            if first is None:
                raise SystemExit("no question sets")
            set_id = first.id
        run_id = engine.evaluate(set_id, given.retrieval_mode)
        out = json.loads(engine.store.read("runs").where(f"id = '{run_id}'").first().summary)
    print(json.dumps(out, ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
