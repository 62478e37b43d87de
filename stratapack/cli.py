"""python -m stratapack.cli compress | extract | verify | bench: a thin command line over the archive and the harness."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratapack.functions import codecs
from stratapack.operators import archive, runner
from stratapack.sources import sinks
from stratapack.sources.tree import TreeSource


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratapack")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="verb", required=True)
    c = sub.add_parser("compress")
    c.add_argument("source")
    c.add_argument("archive", nargs="?")
    c.add_argument("--level", choices=list(codecs.LEVELS), default="balanced")
    c.add_argument("--codecs")
    c.add_argument("--verify", action="store_true", default=None)
    e = sub.add_parser("extract")
    e.add_argument("archive")
    e.add_argument("destination")
    sub.add_parser("verify").add_argument("archive")
    b = sub.add_parser("bench")
    b.add_argument("manifest")
    b.add_argument("results")
    b.add_argument("--tool", action="append", help='name=["command", ...] in place of the manifest\'s')
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    if a.verb == "bench":
        return {"results": a.results, "failed": bool(runner.main(spark, a.manifest, a.results, a.tool))}
    if a.verb == "compress":
        spark.dataSource.register(TreeSource)
        source = os.path.abspath(a.source)
        out = a.archive or sinks.free_name(os.path.dirname(source), os.path.basename(source) + ".pack")
        tree = spark.read.format("file_tree").load(source)
        files = tree.where("kind <> 'skipped'").drop("reason", "size").withColumn("file_id", F.xxhash64("path"))
        built = archive.build(spark, files, archive.Options(a.level, a.codecs, a.verify))
        archive.write(spark, built, os.path.abspath(out), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
        size = built.blocks.agg(F.coalesce(F.sum("encoded_size"), F.lit(0))).first()[0]
        return {"archive": out, "entries": built.entries.count(), "encoded_size": size}
    got = archive.read_manifest(spark, os.path.abspath(a.archive))
    faults = [r["fault"] for r in archive.structural_faults(got).limit(10).collect()]
    if faults:
        raise ValueError("; ".join(faults))
    if a.verb == "extract":
        return {"written": sinks.extract_to(archive.restore(got), os.path.abspath(a.destination))}
    bad = archive.verify(got).where("NOT ok").count()
    if bad:
        raise ValueError(f"{bad} entries are damaged")
    return {"verified": got.entries.count()}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("stratapack").getOrCreate()
    try:
        out = run(spark, a)
    except Exception as e:  # noqa: BLE001 - a command line reports any failure and exits 1
        print(json.dumps({"status": "error", "message": str(e)}) if a.json else f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps({"status": "ok", **out}) if a.json else " ".join(f"{k}={v}" for k, v in out.items()))
    return int(out.get("failed", False))


if __name__ == "__main__":
    sys.exit(main())
