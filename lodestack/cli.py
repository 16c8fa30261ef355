"""The command line: ``python -m lodestack <command>``. A thin layer over the engine; every command can answer in JSON."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from . import output
from .api import Engine
from .operators.context import BUDGET
from .schema import Config, QueryError, StoreError, config_file, discover


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestack", description="Search text by full text, vectors and exact filters.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=text, description=text)
        own.add_argument("--json", action="store_true", help="answer in JSON")
        return own

    def searching(own: argparse.ArgumentParser, lines: bool = True) -> None:
        own.add_argument("--explain", action="store_true", help="say how results came about")
        own.add_argument("--lexical-mode", choices=("syntax", "literal"), default="syntax", help="read full-text syntax, or take the text as words")
        own.add_argument("--snapshot", help="RFC 3339 time: documents of that time or before")
        if lines:
            own.add_argument("--jsonl", action="store_true", help="answer in JSON lines")

    command("init", "Make a new store.").add_argument("path", nargs="?", default=".", help="folder for the store")
    own = command("add", "Ingest files and folders.")
    own.add_argument("paths", nargs="*")
    own.add_argument("--glob", help="take files that match")
    own.add_argument("--ignore", action="append", default=[], help="leave out files that match (may be repeated)")
    own.add_argument("--tag")
    own.add_argument("--source")
    own.add_argument("--parser", choices=("auto", "plain", "markdown", "code"), default="auto")
    own.add_argument("--mtime-only", action="store_true", help="skip files whose path and time are known")
    own.add_argument("--extract-meta", action="store_true", help="look for front matter and header lines")
    own = command("rm", "Remove documents by path or id.")
    own.add_argument("targets", nargs="+")
    own.add_argument("--purge", action="store_true", help="drop all removed rows for good")
    own = command("search", "Find the best chunks.")
    own.add_argument("query")
    own.add_argument("--k", type=int, default=8)
    own.add_argument("--bm25", action="store_true", help="full text")
    own.add_argument("--vector", action="store_true", help="vectors")
    own.add_argument("--filter", help="exact filter, or @file")
    searching(own)
    own = command("query", "Run a query of the query language.")
    own.add_argument("query", help="the query, @file, or - for standard input")
    searching(own)
    own = command("context", "Pack the best chunks into a budget of tokens.")
    own.add_argument("query")
    own.add_argument("--budget-tokens", type=int, default=BUDGET)
    own.add_argument("--diversity", type=int, help="chunks of one document at most")
    own.add_argument("--filter")
    own.add_argument("--snapshot")
    command("stats", "Counts and sizes.")
    command("doctor", "Check the store.").add_argument("--fix", action="store_true", help="make derived columns again")
    command("compact", "Drop removed rows and rewrite the rest in few files.")
    command("export", "Write the store as JSON lines.").add_argument("--out", required=True)
    command("import", "Take in exported JSON lines.").add_argument("path")
    return out


def answer(args: argparse.Namespace, spark: SparkSession) -> tuple[dict[str, Any], str]:
    """(JSON answer, text for people) of a command."""
    if args.command == "init":
        file = config_file()
        config = Config.load(file) if file and file.exists() else Config()
        Engine.create(spark, Path(args.path).resolve() / config.store_path, config)
        return output.envelope(actions=[f"made {config.store_path}"]), f"made {Path(args.path) / config.store_path}"
    config, store = discover()
    engine = Engine.open(spark, store, config)
    if args.command == "add":
        done = engine.add(args.paths, tag=args.tag, source=args.source, parser=None if args.parser == "auto" else args.parser, include=args.glob, exclude=args.ignore, mtime_only=args.mtime_only, meta=args.extract_meta)
        skipped = [f"not text: {x}" for x in done.skipped]
        return output.envelope(stats={"docs": done.documents, "chunks": done.chunks}, warnings=skipped or None), "\n".join([f"{done.documents} documents, {done.chunks} chunks", *skipped])
    if args.command == "rm":
        n = engine.remove(args.targets, args.purge)
        return output.envelope(stats={"docs": n}), f"removed {n} documents"
    if args.command in ("search", "query"):
        literal = args.lexical_mode == "literal"
        if args.command == "search":
            found = engine.search(args.query, args.k, args.bm25, args.vector, args.filter, args.snapshot, literal)
        else:
            found = engine.query(sys.stdin.read() if args.query == "-" else args.query, args.snapshot, literal)
        if args.json or args.jsonl:
            return found.json(args.explain), ""
        return output.envelope(), "\n".join([*(f"warning: {w}" for w in found.warnings), output.table(found.rows.collect(), args.explain)])
    if args.command == "context":
        row = engine.context(args.query, args.budget_tokens, args.diversity, args.filter, args.snapshot).first()
        context = {"text": row["text"], "budget_tokens": args.budget_tokens, "used_tokens": row["used_tokens"], "chunks": [c.asDict() for c in row["chunks"]]}
        return output.envelope(query={"text": args.query, "filters": args.filter, "snapshot": args.snapshot}, context=context), row["text"]
    if args.command == "stats":
        stats = engine.stats()
        return output.envelope(stats=stats), "\n".join(f"{k}: {v}" for k, v in stats.items())
    if args.command == "doctor":
        found = engine.doctor(args.fix)
        return output.envelope(diagnostics={"problems": found}, actions=["made derived columns again"] if args.fix else None), "\n".join(found) or "ok"
    if args.command == "compact":
        engine.compact()
        return output.envelope(actions=["compacted"]), "compacted"
    if args.command == "export":
        engine.export(args.out)
        return output.envelope(actions=[f"wrote {args.out}"]), f"wrote {args.out}"
    engine.import_(args.path)
    return output.envelope(actions=[f"took in {args.path}"]), f"took in {args.path}"


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        found, text = answer(args, spark)
    except (QueryError, StoreError, ValueError, OSError) as error:
        say(json.dumps(output.failure(error), ensure_ascii=False)) if args.json or getattr(args, "jsonl", False) else print(f"error: {error}", file=sys.stderr)
        return 1
    if getattr(args, "jsonl", False):
        for line in output.json_lines(found):
            say(line)
    elif text or not args.json:
        say(json.dumps(found, ensure_ascii=False) if args.json else text)
    else:
        say(json.dumps(found, ensure_ascii=False))
    return 0
