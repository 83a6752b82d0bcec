"""Batch entry point: python -m epistle.cli ARCHIVE [--load FOLDER] [--backfill KIND] [--embed missing|all] [--rebuild] [--serve]."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from epistle.api import Tools
from epistle.functions.text import embedding_text
from epistle.operators import maintenance as M
from epistle.server import serve
from epistle.sources.archive import Archive
from epistle.streaming.ingest import ingest_available

KINDS = ("sender", "from_name", "thread_id", "recipients", "is_outbound", "categories", "projects", "body_text", "body_main_text")
DIMENSIONS = int(os.environ.get("EPISTLE_DIMENSIONS", "384"))


def main(argv: list[str] | None = None) -> dict:
    """Runs what is asked for, in the order rebuild, embed, backfill, load, delete orphans, serve; returns what each step reports."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("archive")
    parser.add_argument("--load", metavar="FOLDER")
    parser.add_argument("--files-per-batch", type=int, default=100)
    parser.add_argument("--backfill", nargs="?", const="all", choices=("all", *KINDS))
    parser.add_argument("--registry", metavar="FILE", help="projects (name, aliases, summary, created_at) as Parquet")
    parser.add_argument("--owner", action="append", metavar="ADDRESS", help="whose messages are outbound; by default the most frequent sender's")
    parser.add_argument("--delete-orphans", action="store_true")
    parser.add_argument("--embed", choices=("missing", "all"))
    parser.add_argument("--rebuild", action="store_true")
    parser.add_argument("--serve", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("epistle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    archive, report = Archive(spark, args.archive), {}
    registry = spark.read.parquet(args.registry) if args.registry else None
    if args.rebuild:
        report["rebuild"] = archive.rebuild_index()
    if args.embed:
        text = embedding_text(*[F.col(c) for c in ("subject", "from_name", "from_address", "ts_raw", "body_main_text", "body_text", "body_markdown")])
        report["embed"] = archive.fill_embeddings(text, DIMENSIONS, args.embed)
    if args.backfill:
        rows = archive.messages()
        for kind in KINDS if args.backfill == "all" else (args.backfill,):
            if kind == "projects" and registry is None:
                if args.backfill == "projects":
                    parser.error("--backfill projects needs --registry")
                continue
            rows = M.backfill(rows, kind, registry)
        archive.replace_messages(rows)
        report["backfill"] = args.backfill
    if args.load:
        report["load"] = ingest_available(spark, args.load, archive, f"{archive.path}/checkpoint", args.files_per_batch, registry, args.owner)
    if args.delete_orphans:
        report["orphans"] = archive.delete_orphans()
    if args.serve:
        serve(Tools(archive.messages(), archive.vectors() if archive.exists("vectors") else None, registry, search=archive.search))
    return report


if __name__ == "__main__":
    print(main())
