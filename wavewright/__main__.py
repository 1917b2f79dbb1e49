"""Command line, also for spark-submit: ``python -m wavewright COMMAND ...``.

queries                          names of the registered queries, with SQL unless marked *
run NAME TABLES OUT              a query over a folder of tables, written as Parquet with its receipt beside it
demo OUT                         the synthetic labelled case as CSV
extract ARCHIVE FOLDER           a ZIP archive, each member only inside the folder
package FOLDER NAME=PATH:SHA256  files into a new folder, each only if its digest holds
smoke TABLES                     the flagship query and the synthetic case; fails unless both give rows
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .functions.errors import AuditError
from .plans import registry, registry_io  # noqa: F401  registry_io adds its queries to the registry
from .sources import readers, sinks


def session() -> SparkSession:
    return SparkSession.builder.appName("wavewright").getOrCreate()


def run(name: str, tables: str, out: str) -> dict:
    if name not in registry.QUERIES:
        raise AuditError(f"no query is named {name}")
    spark = session()
    return sinks.write_with_receipt(registry.QUERIES[name](spark, tables), out)


def package(folder: str, files: list[str]) -> dict:
    sources = {}
    for f in files:
        name, _, rest = f.partition("=")
        path, _, digest = rest.rpartition(":")
        if not (name and path and digest):
            raise AuditError("files are given as NAME=PATH:SHA256")
        sources[name] = (path, digest)
    return sinks.package_files(sources, folder)


def smoke(tables: str) -> dict:
    spark = session()
    found = {"flagship": registry.flagship(spark, tables).count(), "demo": readers.demo_series(spark).count()}
    if not all(found.values()):
        raise AuditError(f"no rows: {found}")
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wavewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in {"queries": [], "run": ["name", "tables", "out"], "demo": ["out"], "extract": ["archive", "folder"], "smoke": ["tables"]}.items():
        command = commands.add_parser(name)
        for a in arguments:
            command.add_argument(a)
    command = commands.add_parser("package")
    command.add_argument("folder")
    command.add_argument("files", nargs="+")
    a = parser.parse_args(argv)
    try:
        if a.command == "queries":
            out = [name if name in registry.ORACLE_SQL else f"{name}*" for name in sorted(registry.QUERIES)]
        elif a.command == "run":
            out = run(a.name, a.tables, a.out)
        elif a.command == "demo":
            sinks.write_case_csv(readers.demo_series(session()), a.out)
            out = a.out
        elif a.command == "extract":
            out = readers.extract_zip(a.archive, a.folder)
        elif a.command == "package":
            out = package(a.folder, a.files)
        else:
            out = smoke(a.tables)
    except AuditError as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(out, indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
