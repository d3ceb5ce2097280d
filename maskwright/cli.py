"""Command line: python -m maskwright.cli anonymize IN OUT [--config FILE] [--no-mapping] | restore IN OUT."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Config, Engine
from .sources import files


def load_config(path: str | None) -> Config:
    raw = json.loads(open(path, encoding="utf-8").read()) if path else {}
    known = {"detectors", "entity_types", "glossary_types", "modes", "placeholders", "roles", "review_below"}
    other = {"glossary", "ignore_terms", "default_ignore_terms", "links"}
    if unknown := set(raw) - known - other:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    fields = {k: v for k, v in raw.items() if k in known}
    if "roles" in fields:
        fields["roles"] = {k.strip().lower(): v for k, v in fields["roles"].items()}
    links = {k.strip().lower(): (parent.strip().lower(), tag or "") for k, (parent, tag) in raw.get("links", {}).items()}
    return Config(**fields, links=links, glossary=tuple((t, k) for t, k in raw.get("glossary", {}).items()), user_ignore=tuple(raw.get("ignore_terms", ())), default_ignore=tuple(raw.get("default_ignore_terms", ())))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="maskwright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("anonymize")
    r = commands.add_parser("restore")
    for p in (a, r):
        p.add_argument("source")
        p.add_argument("target")
    a.add_argument("--config")
    a.add_argument("--no-mapping", action="store_true")
    o = parser.parse_args(args)
    spark = SparkSession.builder.appName("maskwright").getOrCreate()
    if o.command == "anonymize":
        docs = files.read_documents(spark, o.source).where("error is null").select(F.col("path").alias("doc_id"), "text")
        files.write_results(Engine(spark, load_config(o.config)).anonymize(docs), o.target, not o.no_mapping)
    else:
        pairs = spark.read.parquet(f"{o.source}/mapping").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("mapping"))
        docs = spark.read.parquet(f"{o.source}/anonymized").join(pairs, "doc_id", "left")
        Engine(spark).restore(docs).select("doc_id", "restored_text").write.mode("overwrite").parquet(o.target)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
