"""Command line: map, verify, version."""

from __future__ import annotations

import argparse
import os
import sys
import traceback

from pyspark.sql import DataFrame, SparkSession

from lodegraph.plans import coverage, extract, report
from lodegraph.plans.lineage import cut
from lodegraph.plans.sinks import Report
from lodegraph.sources import files

#: Set where a release is built.
VERSION, COMMIT, DATE = "0.2.0", os.environ.get("LODEGRAPH_COMMIT", "none"), os.environ.get("LODEGRAPH_DATE", "unknown")


def _map(args: argparse.Namespace, spark: SparkSession) -> int:
    scan = files.scan_shared if args.shared else files.scan_local
    registry = extract.Registry(owner=args.owner, symbol_db=args.symbol_db, root_qualified=args.root_qualified)
    g = report.Graph.of(registry.gather(scan(spark, args.roots, files.MAP)), args.roots)
    if args.format == "json":
        told = report.map_json(g)
    elif args.format == "md":
        told = report.markdown(g, args.group)
    else:
        told = report.mermaid_repos(g) if args.group == "repo" else report.mermaid(g)
    _put(told, args.output)
    return 0


def _put(told: Report, output: str | None) -> None:
    """Streams a report to the standard output, or has executors write it below a folder."""
    if output:
        told.write(output)
    else:
        sys.stdout.writelines(told.lines())


def docs_folder(source: str) -> str | None:
    """The first of docs and doc that is a folder in `source`."""
    return next((os.path.join(source, d) for d in ("docs", "doc") if os.path.isdir(os.path.join(source, d))), None)


def verify(spark: SparkSession, source: str, docs: str | None = None, html_docs: str | None = None, fuzzy: float = coverage.DEFAULT_THRESHOLD, exported_only: bool = True, shared: bool = False) -> coverage.Coverage:
    """Coverage of the Go code in `source` by Markdown in its docs folder and in itself, and by HTML pages if given.

    `shared`: the folders are on storage that executors read; then `docs` has to be named.
    """

    def tree(folder: str) -> DataFrame:
        return cut((files.scan_shared if shared else files.scan_local)(spark, [folder if shared else os.path.abspath(folder)], files.VERIFY))

    code = tree(source)
    docs = docs or (None if shared else docs_folder(source))
    claims = [extract.doc_refs(tree(docs))] if docs else []
    claims.append(extract.doc_refs(code))
    if html_docs:
        claims.append(extract.doc_refs(tree(html_docs), html_pages=True))
    return coverage.compute(extract.entities(code, exported_only), coverage.merge_refs(*claims), fuzzy)


def _verify(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.verifier != "source":
        raise ValueError("entities of a symbol database are not available; use --verifier source")
    c = verify(spark, args.source, args.docs, args.html_docs, args.fuzzy, args.exported_only, args.shared)
    _put(report.coverage_json(c) if args.format == "json" else report.coverage_text(c, args.verbose), args.output)
    coverage.gate(c, args.max_uncovered if args.max_uncovered >= 0 else None, args.threshold)
    return 0


def _flag(text: str) -> bool:
    return text.lower() in ("1", "t", "true", "yes")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodegraph")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("map", help="artifacts that source trees produce and consume, and how they connect")
    m.add_argument("roots", nargs="+")
    m.add_argument("--format", choices=("json", "mermaid", "md"), default="mermaid")
    m.add_argument("--group", choices=("repo", "artifact"), default="repo")
    m.add_argument("--owner", default=None, help="what github.repository_owner stands for")
    m.add_argument("--shared", action="store_true", help="the roots are on storage that executors read")
    m.add_argument("--symbol-db", default=None, help="a symbol database to take symbols from instead of Go sources")
    m.add_argument("--root-qualified", action="store_true", help="name every file with its root")
    m.add_argument("-v", "--verbose", action="store_true", help="show where an error came from")
    v = sub.add_parser("verify", help="exported code that documentation mentions")
    v.add_argument("--source", default=".")
    v.add_argument("--docs", default=None)
    v.add_argument("--html-docs", default=None)
    v.add_argument("--threshold", type=float, default=0.0, help="least coverage")
    v.add_argument("--fuzzy", type=float, default=coverage.DEFAULT_THRESHOLD, help="likeness that matches; 0 for exact names only")
    v.add_argument("--format", default="text")
    v.add_argument("--exported-only", type=_flag, default=True)
    v.add_argument("-v", "--verbose", action="store_true")
    v.add_argument("--shared", action="store_true", help="the folders are on storage that executors read")
    v.add_argument("--max-uncovered", type=int, default=-1)
    v.add_argument("--verifier", choices=("source", "symbol-db"), default="source")
    for command in (m, v):
        command.add_argument("--output", default=None, help="a folder to write the report to, as text files whose names are in order")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; 2 on any error, the gate's too."""
    args = parser().parse_args(argv)
    if args.command == "version":
        print(f"lodegraph {VERSION} ({COMMIT}) built {DATE}")
        return 0
    session = spark or SparkSession.builder.appName("lodegraph").getOrCreate()
    try:
        return (_map if args.command == "map" else _verify)(args, session)
    except Exception as e:
        if args.verbose:
            traceback.print_exc()
        print(f"error: {e}", file=sys.stderr)
        return 2


def run() -> None:
    sys.exit(main())


if __name__ == "__main__":
    run()
