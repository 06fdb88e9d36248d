"""Command line: facts of sites from a page store, or fetched with ``--fetch``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .functions.entities import spacy_recognizer
from .plans.contact_facts import contact_facts
from .sources import gazetteer, sinks
from .sources.url_lists import all_urls


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom", description="Published contact facts of web sites")
    p.add_argument("urls", nargs="*")
    p.add_argument("--input", help="text or CSV file of URLs")
    p.add_argument("--store", help="Parquet page store: url, final_url, status_code, html, error")
    p.add_argument("--output", help="folder for CSV output; goes before --json")
    p.add_argument("--json", action="store_true")
    p.add_argument("--max-pages", type=int, default=fixed.MAX_PAGES)
    p.add_argument("--fetch", action="store_true", help="first fetch into the store what the sites lack in it: home pages, linked or usual contact and team pages")
    p.add_argument("--timeout", type=float, default=15)
    p.add_argument("--delay", type=float, default=1.0)
    p.add_argument("--ignore-robots", action="store_true")
    p.add_argument("--cities", help="city table in the layout of the public GeoNames files, instead of the built-in cities")
    p.add_argument("--use-spacy", action="store_true", help="also look for names by entity recognition, where spaCy is installed")
    p.add_argument("--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    args = parser().parse_args(argv)
    if not args.urls and not args.input:
        parser().error("no URL given")
    if not args.store:
        parser().error("--store is needed")
    try:
        recognizer = spacy_recognizer() if args.use_spacy else None
    except ModuleNotFoundError as e:
        parser().error(str(e))
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    sites = all_urls(spark, args.urls, args.input)
    if args.fetch:
        from .plans.crawl import crawl

        crawl(sites, args.store, timeout=args.timeout, respect_robots=not args.ignore_robots, pause=args.delay, max_pages=args.max_pages)
    cities = gazetteer.from_table(spark, args.cities) if args.cities else None
    facts = contact_facts(sites, spark.read.parquet(args.store), max_pages=args.max_pages, cities=cities, recognizer=recognizer)
    if args.output:
        sinks.write_csv(facts, args.output)
    elif args.json:
        rows = (r["json"] for r in sinks.json_rows(facts.orderBy("site_ord")).toLocalIterator())
        print("[" + ",\n".join(rows) + "]", file=out)
    else:
        blocks = (r["t"] for r in facts.orderBy("site_ord").select(F.lit(None).alias("n"), sinks.human_text().alias("t")).toLocalIterator())
        print(("\n" + "-" * 60 + "\n").join(blocks), file=out)
    return 0
