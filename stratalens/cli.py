"""Command line: init, query, inspect, eval, version."""

from __future__ import annotations

import argparse
import json
import sys
from importlib import import_module
from pathlib import Path

from .operators import enrich, evaluate, inspection, search
from .plans.pipeline import Index, Options
from .session import session
from .sources.fixtures import read_fixtures

VERSION = "0.1.0"


def _backend(args: argparse.Namespace) -> enrich.Backend | None:
    if args.llm_mode == "heuristic":
        return enrich.Heuristic()
    if args.llm_mode == "openai":
        return enrich.ChatEndpoint(args.llm_url, args.llm_model or "default")
    if args.llm_mode == "local":
        module, _, name = (args.llm_model or "").partition(":")
        if not name:
            raise SystemExit("--llm-mode local needs --llm-model MODULE:FUNCTION, a function that loads the model")
        return enrich.LocalModel(getattr(import_module(module), name))
    return None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalens", description="Concept index of a source tree on Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def common(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("--db", default=".stratalens", help="folder of the index tables")
        c.add_argument("--llm-mode", choices=["heuristic", "openai", "local"])
        c.add_argument("--llm-model")
        c.add_argument("--llm-url", default="http://localhost:11434/v1")
        return c

    c = common("init", "build or refresh the index")
    c.add_argument("repo", nargs="?", default=".")
    c.add_argument("--exclude-paths", action="append", default=[])
    c.add_argument("--exclude-regex", action="append", default=[])
    c.add_argument("--force", action="store_true")
    c.add_argument("--docgen", action="store_true")
    c.add_argument("--llm-workers", type=int, default=1)
    c = common("query", "ask for concepts")
    c.add_argument("text")
    c.add_argument("--top-k", type=int, default=5)
    c.add_argument("--format", choices=["text", "json"], default="text")
    c.add_argument("--rerank", action="store_true")
    c.add_argument("--agentic", action="store_true")
    c.add_argument("--agentic-limit", type=int, default=3)
    c = common("inspect", "show symbols")
    c.add_argument("names", nargs="+")
    c.add_argument("--format", choices=["text", "json"], default="text")
    c = common("eval", "recall of fixtures")
    c.add_argument("fixtures")
    c.add_argument("--ks", type=int, nargs="+", default=[1, 3, 5])
    c.add_argument("--rerank", action="store_true")
    sub.add_parser("version", help="show the version")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    backend = _backend(args)
    if args.command == "query" and (args.rerank or args.agentic) and backend is None:
        print("--rerank and --agentic need --llm-mode", file=sys.stderr)
        return 2
    spark = spark or session("local[*]")
    index = Index(spark, args.db if ":" in args.db else str(Path(args.db).absolute()))
    if args.command == "init":
        root = args.repo if ":" in args.repo else str(Path(args.repo).absolute())
        options = Options(root, tuple(args.exclude_paths), tuple(args.exclude_regex), backend=backend or enrich.Heuristic(), docgen=args.docgen, workers=args.llm_workers)
        for stage, status in index.run(options, force=args.force).items():
            print(f"{stage}: {status}")
        return 0
    if args.command == "query":
        s = index.searcher()
        found = s.agentic_query(args.text, backend, args.top_k, args.agentic_limit) if args.agentic else s.query(args.text, args.top_k, backend, args.rerank)
        print(json.dumps(found, indent=2) if args.format == "json" else search.render(found))
        return 0
    if args.command == "eval":
        _, mean = evaluate.run(index.searcher(), read_fixtures(spark, args.fixtures), args.ks, backend, args.rerank)
        print(json.dumps([r.asDict() for r in mean.orderBy("k").collect()], indent=2))
        return 0
    r = index.store.read
    symbols = r("symbols")
    rows = {x.symbol: x.asDict(recursive=True) for x in inspection.inspect_symbols(args.names, symbols, r("references"), r("concepts"), r("concept_members")).collect()}
    missing = [n for n in args.names if n not in rows]
    for n in missing:
        near = [c.qualified_name for c in inspection.find_candidates(n, symbols).collect()]
        print(f"{n}: did you mean: {', '.join(near)}" if near else f"{n}: symbol not found", file=sys.stderr)
    found = [rows[n] for n in args.names if n in rows]
    print(json.dumps(found, indent=2) if args.format == "json" else "\n\n".join(inspection.render(x) for x in found))
    return 1 if missing else 0
