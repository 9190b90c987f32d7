"""Command line: `python -m tamarack QUERY ... --data DIR [--out DIR] [--config FILE]`, `--list`, `--status DIR`.

A configuration file (JSON) holds defaults of these options; the command line goes before it.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import functions as F

from tamarack import plans
from tamarack.session import build_session
from tamarack.sources import readers, sinks


def options(argv: Sequence[str] | None = None) -> argparse.Namespace:
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", help="JSON file of defaults")
    known, rest = first.parse_known_args(argv)
    p = argparse.ArgumentParser("tamarack", parents=[first], description="Run catalogue queries over a folder of tables.")
    p.add_argument("queries", nargs="*", help="names from the catalogue")
    p.add_argument("--data", help="folder of Parquet tables")
    p.add_argument("--out", help="folder results are written to; without it they are shown")
    p.add_argument("--type", choices=("parquet", "csv", "json"), default="parquet", help="kind of the results' files")
    p.add_argument("--sources", nargs="*", help="with --status: only these sources")
    p.add_argument("--status", metavar="DIR", help="count the text files below a folder by source")
    p.add_argument("--list", action="store_true", help="names of the catalogue")
    p.add_argument("--master", help="Spark master")
    if known.config:
        with open(known.config) as f:
            p.set_defaults(**json.load(f))
    return p.parse_args(rest)


def main(argv: Sequence[str] | None = None, spark=None, show=print) -> int:
    o = options(argv)
    if o.list:
        for name in sorted(plans.QUERIES):
            show(name)
        return 0
    if wrong := [q for q in o.queries if q not in plans.QUERIES]:
        show(f"no such query: {', '.join(wrong)}")
        return 2
    spark = spark or build_session(master=o.master)
    if o.status:
        files = readers.documents(spark, o.status)
        files = files.filter(F.col("source").isin(*o.sources)) if o.sources else files
        sinks.tee(readers.status(files).orderBy("source"), f"{o.out}/status", show) if o.out else readers.status(files).orderBy("source").show(1000, False)
    for q in o.queries:
        rows = plans.QUERIES[q](spark, o.data)
        if o.out:
            rows.write.mode("overwrite").format(o.type).save(f"{o.out}/{q}")
            show(f"{q}: {o.out}/{q}")
        else:
            rows.show(20, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
