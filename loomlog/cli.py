"""Command line: several queries in one call, over NDJSON files or a store.

``python -m loomlog.cli --data-dir STORE --field user --point user postgres --aggregate SUM pid --complex 'user:postgres' --group user dbname``
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from .engine import Engine
from .plans.parser import QueryError
from .plans.resolver import ResolveError
from .session import build_session


class _InOrder(argparse.Action):
    def __call__(self, parser, namespace, values, option_string=None):
        namespace.queries = [*(namespace.queries or []), (self.dest, values)]


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomlog")
    p.add_argument("--data-dir", required=True, help="a store, or NDJSON files with --json")
    p.add_argument("--json", action="store_true", help="--data-dir names NDJSON files")
    p.add_argument("--master")
    p.add_argument("--show", type=int, default=20, help="rows to print of each result")
    p.set_defaults(queries=None)
    for name, n, meta in (
        ("field", 1, ("FIELD",)), ("dict", 1, ("FIELD",)), ("point", 2, ("FIELD", "VALUE")), ("range", 3, ("FIELD", "LOW", "HIGH")),
        ("aggregate", "+", ("FUNCTION", "FIELD")), ("complex", "+", ("QUERY", "WORDS")), ("group", "+", ("FIELD", "FIELDS")),
    ):
        p.add_argument(f"--{name}", nargs=n, metavar=meta if n != 1 else meta[0], action=_InOrder)
    return p


def answer(engine: Engine, kind: str, args: list[str]) -> DataFrame:
    if kind == "field":
        return engine.field_exists(args[0])
    if kind == "dict":
        return engine.browse(args[0])
    if kind == "point":
        return engine.point(*args)
    if kind == "range":
        return engine.range(*args)
    if kind == "aggregate":
        return engine.aggregate(args[0].upper(), args[1] if len(args) > 1 and args[1] != "*" else None)
    if kind == "complex":
        return engine.query(" ".join(args))
    if kind == "group":
        return engine.group(args)
    raise ValueError(kind)


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = build_session(master=a.master)
    engine = Engine.from_files(spark, a.data_dir) if a.json else Engine.from_store(spark, a.data_dir)
    failed = 0
    for kind, args in a.queries or []:
        print(f"--{kind} {' '.join(args)}")
        try:
            answer(engine, kind, args).show(a.show, truncate=False)
        except (QueryError, ResolveError) as e:
            print(f"error: {e}", file=sys.stderr)
            failed = 1
    return failed


if __name__ == "__main__":
    sys.exit(main())
