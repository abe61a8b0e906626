"""Command line: ``python -m gleaner.cli PATH PATTERN [BEFORE] [AFTER] [options]``.

Exit code 0 if slices were found, 1 if none, 2 for a query that cannot run.
Every field of ``Options`` is an option, with the field's type, values and default.
"""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import fields

from gleaner import __version__
from gleaner.plans.api import Result, focused_read
from gleaner.plans.query import Options
from gleaner.session import local_session, ship_package

PLACED = ("before", "after")  # given by place, after the pattern


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gleaner", description=__doc__.split("\n")[0])
    out.add_argument("--version", action="version", version=__version__)
    for name in ("path", "pattern"):
        out.add_argument(name)
    for f in fields(Options):
        if f.name in PLACED:
            out.add_argument(f.name, nargs="?", type=int, default=f.default)
        elif isinstance(f.default, bool):
            out.add_argument("--" + f.name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            out.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default, choices=f.metadata.get("choices"))
    out.add_argument("-r", "--recursive", action="store_true", help="search the folder of a file")
    out.add_argument("--json", dest="shape", action="store_const", const=lambda result: result.to_json(2), default=Result.render)
    return out


def focused_read_tool(path: str, pattern: str, before: int = 40, after: int = 40, budget: int = 800, boundary: str = "auto", objective: str = "auto", spark=None) -> str:
    """The report as text, for tool servers; a smaller budget by default."""
    return run(path, pattern, Options(before, after, budget, boundary, objective=objective), spark=spark).render()


def run(path: str, pattern: str, options: Options, recursive: bool = False, spark=None) -> Result:
    spark = spark or local_session()
    ship_package(spark)
    if recursive and os.path.isfile(path):
        path = os.path.dirname(os.path.abspath(path))
    return focused_read(spark, path, pattern, options)


def main(argv: list[str] | None = None, spark=None) -> int:
    given = vars(parser().parse_args(argv))
    options = Options(**{f.name: given[f.name] for f in fields(Options)})
    try:
        found = run(given["path"], given["pattern"], options, given["recursive"], spark)
    except ValueError as problem:
        sys.stderr.write(f"{problem}\n")
        return 2
    sys.stdout.write(given["shape"](found) + "\n")
    return int(not found.chunks)


if __name__ == "__main__":
    sys.exit(main())
