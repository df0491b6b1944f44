"""Batch command line: ingest files, answer a table of questions, evaluate results, list prompts."""

from __future__ import annotations

import argparse
import json
import sys

from .config import PROFILES, load_config

VERSION = "0.2.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    p.add_argument("--master", default="local[8]")
    p.add_argument("--profile", choices=sorted(PROFILES))
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest", help="bring a store up to date with a folder of files")
    one.add_argument("folder")
    one.add_argument("store")
    one.add_argument("--no-pdf", action="store_true")
    one = sub.add_parser("answer", help="answer JSON lines of qid and question from a store")
    one.add_argument("store")
    one.add_argument("questions")
    one.add_argument("out")
    one.add_argument("--top-n", type=int)
    one.add_argument("--doc-id", action="append", help="search these documents only")
    one.add_argument("--json", action="store_true", help="write JSON lines instead of Parquet")
    one.add_argument("--show-retrieval", action="store_true", help="keep the retrieved passages of each answer")
    one = sub.add_parser("evaluate", help="gate a Parquet table of item results")
    one.add_argument("results")
    one.add_argument("--no-gate", action="store_true")
    one.add_argument("--json", action="store_true", help="print the report as JSON")
    one = sub.add_parser("validate", help="check golden items (JSON lines) against a Parquet table of documents")
    one.add_argument("golden")
    one.add_argument("documents")
    one.add_argument("--strict", action="store_true", help="warnings fail as well")
    one = sub.add_parser("sync", help="make a store hold just the files of a folder")
    one.add_argument("folder")
    one.add_argument("store")
    one.add_argument("--no-pdf", action="store_true")
    one = sub.add_parser("stats", help="documents and chunks of a store")
    one.add_argument("store")
    sub.add_parser("prompts", help="known prompts")
    sub.add_parser("version", help="version of the engine")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "prompts":
        from .prompts import ANSWER, PromptLibrary

        print(json.dumps(PromptLibrary([ANSWER]).describe(), indent=2))
        return 0
    from .operators import evaluation, maintenance
    from .plans import pipeline
    from .plans.library import DocumentNotFound, Library, projected
    from .session import build_session
    from .sources import loaders
    from .sources.sinks import LibraryStore, report_json

    spark = build_session(args.master)
    config = load_config(args.profile)
    if args.command == "ingest":
        docs = loaders.load_documents(loaders.list_files(spark, args.folder), with_pdf=not args.no_pdf)
        print(json.dumps(pipeline.ingest(docs, args.store, config)))
    elif args.command == "answer":
        questions = spark.read.schema("qid string, question string").json(args.questions)
        try:
            answers = Library(spark, args.store, config).ask(questions, args.doc_id, args.top_n)
        except DocumentNotFound as e:
            print(f"no such documents: {e.args[0]}", file=sys.stderr)
            return 2
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        answers = projected(answers, args.show_retrieval)
        (answers.write.mode("overwrite").json if args.json else answers.write.mode("overwrite").parquet)(args.out)
    elif args.command == "evaluate":
        metrics = evaluation.metrics_long(spark.read.parquet(args.results)).persist()
        checks = evaluation.threshold_checks(metrics, config["profile"]).persist()
        if args.json:
            print(report_json(metrics, evaluation.breakdown(spark.read.parquet(args.results)), checks, config["profile"]))
        for r in checks.orderBy("metric").collect() if not args.json else []:
            print(f"{'ok  ' if r['passed'] else 'FAIL'} {r['metric']} {r['value']} ({r['bound']} {r['limit_value']})")
        return evaluation.exit_code(checks, not args.no_gate)
    elif args.command == "validate":
        found = evaluation.validate_golden(loaders.read_golden(spark, args.golden), spark.read.parquet(args.documents)).persist()
        for r in found.orderBy("level", "id").limit(500).collect():
            print(f"{r['level']:7} {r['id']} {r['issue']}")
        return int(not found.where("level = 'error'" if not args.strict else "true").isEmpty())
    elif args.command == "sync":
        docs = loaders.load_documents(loaders.list_files(spark, args.folder), with_pdf=not args.no_pdf)
        print(json.dumps(Library(spark, args.store, config).sync(docs)))
    else:
        manifest = LibraryStore(spark, args.store).read("manifest")
        print(json.dumps(maintenance.stats(manifest).first().asDict() if manifest is not None else {"documents": 0, "chunks": 0}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
