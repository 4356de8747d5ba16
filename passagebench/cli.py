"""Command line: run, validate, check, strategies, bootstrap, cache, demo."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from dataclasses import replace
from pathlib import Path

DEMO = {
    "fees.md": "# Fees\n\nThe yearly fee is 40 euros. It is due in the first week of March.\n\n## Late payment\n\nA reminder costs 5 euros. After two reminders the account is closed.\n",
    "visits.md": "# Visits\n\nThe reading room is open from nine to five. Groups of more than ten people book a week ahead.\n\n## Lending\n\nBooks may be kept for 28 days, films for 7 days.\n",
}
DEMO_QUESTIONS = """questions:
  - {id: fee, query: how much is the yearly fee, gold_snippets: ["The yearly fee is 40 euros."]}
  - {id: late, query: cost of a reminder, gold_snippets: ["A reminder costs 5 euros."]}
  - {id: books, query: how long may books be kept, gold_snippets: ["Books may be kept for 28 days"]}
"""


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="passagebench")
    parser.add_argument("--version", action="store_true")
    commands = parser.add_subparsers(dest="command")
    run = commands.add_parser("run", help="evaluate chunking strategies")
    for flag in ("--docs", "--questions"):
        run.add_argument(flag, required=True)
    for flag in ("--config", "--json", "--html", "--save"):
        run.add_argument(flag)
    run.add_argument("--out", help="folder for report.json and report.html")
    run.add_argument("--compare-retrievers", action="store_true", help="all of dense, bm25 and hybrid")
    run.add_argument("--no-cache", action="store_true", help="embed everything anew")
    validate = commands.add_parser("validate", help="check a question set; status 1 on errors")
    for flag in ("--docs", "--questions"):
        validate.add_argument(flag, required=True)
    check = commands.add_parser("check", help="evaluate and compare with a baseline report; status 1 on a regression, 2 where they can't be compared")
    for flag in ("--docs", "--questions", "--baseline"):
        check.add_argument(flag, required=True)
    for flag in ("--config", "--strategy", "--retriever"):
        check.add_argument(flag)
    check.add_argument("--max-drop", type=float)
    check.add_argument("--update-baseline", action="store_true", help="write this run as the new baseline, if nothing failed or there is none yet")
    commands.add_parser("strategies", help="list the chunkers")
    draft = commands.add_parser("bootstrap", help="draft questions; status 1 if none")
    draft.add_argument("--docs", required=True)
    draft.add_argument("--out", required=True)
    draft.add_argument("-n", type=int, default=20)
    cache = commands.add_parser("cache", help="what a cache of vectors holds, or its end")
    cache.add_argument("path")
    cache.add_argument("--clear", action="store_true")
    commands.add_parser("demo", help="evaluate two small documents")
    return parser


def _evaluated(spark, args, config) -> dict:
    from .plans.evaluate import evaluate
    from .sources.documents import load_documents, load_questions

    return evaluate(load_documents(spark, args.docs), load_questions(spark, args.questions), config)


def _run(spark, args) -> int:
    from .plans.evaluate import load_config
    from .sources import reports

    config = load_config(args.config)
    if args.compare_retrievers:
        config = replace(config, compare=[m for m in ("dense", "bm25", "hybrid") if m != config.mode])
    if args.no_cache:
        config = replace(config, cache=None)
    report = _evaluated(spark, args, config)
    print(reports.to_console(report))
    folder = Path(args.out) if args.out else None
    if folder:
        folder.mkdir(parents=True, exist_ok=True)
    for path, sink in ((args.json or config.json_path, reports.to_json), (args.html or config.html_path, reports.to_html), (folder and folder / "report.json", reports.to_json), (folder and folder / "report.html", reports.to_html)):
        if path:
            sink(report, str(path))
    if args.save:
        report["results"].write.mode("overwrite").parquet(args.save)
    return 0


def _check(spark, args) -> int:
    from .operators import comparison
    from .plans.evaluate import load_config
    from .sources import reports

    current, path = _evaluated(spark, args, load_config(args.config)), Path(args.baseline)
    if args.update_baseline and not path.exists():
        reports.to_json(current, str(path))
        print(f"{path} is the baseline now")
        return 0
    try:
        out = comparison.check_reports(json.loads(path.read_text(encoding="utf-8")), current, args.strategy, args.retriever, args.max_drop)
    except (OSError, ValueError) as error:
        print(f"can't compare: {error}", file=sys.stderr)
        return 2
    print("\n".join([f"recall of {out.strategy} + {out.retriever} {out.baseline_recall:.3f} -> {out.current_recall:.3f}", *out.failures, *out.notes]))
    if args.update_baseline and out.ok:
        reports.to_json(current, str(path))
    return int(not out.ok)


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)

    from . import __version__

    if args.version:
        print(__version__)
        return 0
    if args.command is None:
        parser.print_help()
        return 2
    from .operators import chunking, comparison, questions

    if args.command == "strategies":
        print("\n".join(chunking.strategies()))
        return 0
    from .session import session
    from .sources import reports
    from .sources.documents import load_documents, load_questions

    spark = session()
    if args.command == "run":
        return _run(spark, args)
    if args.command == "check":
        return _check(spark, args)
    if args.command == "demo":
        folder = Path(tempfile.mkdtemp(prefix="passagebench-demo-"))
        (folder / "docs").mkdir()
        for name, text in DEMO.items():
            (folder / "docs" / name).write_text(text, encoding="utf-8")
        (folder / "questions.yaml").write_text(DEMO_QUESTIONS, encoding="utf-8")
        return _run(spark, parser.parse_args(["run", "--docs", str(folder / "docs"), "--questions", str(folder / "questions.yaml")]))
    if args.command == "cache":
        if args.clear:
            print("cleared" if comparison.cache_clear(spark, args.path) else "there is none")
            return 0
        if not comparison.cache_exists(spark, args.path):
            print("there is none")
            return 1
        print(", ".join(f"{v} {k}" for k, v in comparison.cache_stats(spark.read.parquet(args.path)).first().asDict().items()))
        return 0
    if args.command == "validate":
        issues = questions.validate(load_questions(spark, args.questions), load_documents(spark, args.docs)).orderBy("phase", "q_ord", "gold_index").collect()
        for i in issues:
            print(f"{i.severity}: {i.question_id}: {i.kind}" + (f" ({i.location}: {i.suggestion})" if i.suggestion else ""))
        return int(any(i.severity == "error" for i in issues))
    rows = [r.asDict(True) for r in questions.draft(load_documents(spark, args.docs), args.n).collect()]
    if not rows:
        return 1
    reports.drafts_to_yaml(rows, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
