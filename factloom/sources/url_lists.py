"""URL lists from text and CSV files, in file order."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import stripped
from ..functions.urls import looks_like_url


def _numbered(lines: DataFrame) -> DataFrame:
    """``site_ord`` in file order: the place in the partition and what the partitions before it hold (one number each on the driver)."""
    placed = lines.select(F.spark_partition_id().alias("__part"), (F.monotonically_increasing_id() % (1 << 33)).alias("__at"), "url")
    counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0), strict=False))
    start = F.try_element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("__part")) if before else F.lit(0)
    return placed.select((start + F.col("__at")).cast("int").alias("site_ord"), "url")


def urls_from_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    url = stripped(F.col("value"))
    lines = spark.read.text(path).select(url.alias("url"))
    return _numbered(lines.where((F.col("url") != "") & ~F.col("url").startswith("#")))


def urls_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """The column with a known heading; else the first, without a first row that is no URL."""
    raw = spark.read.csv(path, header=False, quote='"', escape='"', multiLine=True)
    first = raw.head(1)
    if not first:
        return spark.createDataFrame([], "site_ord int, url string")
    cells = [(c or "").lstrip("﻿").strip() for c in first[0]]
    named = next((i for i, c in enumerate(cells) if c.lower() in fixed.URL_HEADERS), None)
    column = raw.columns[named or 0]
    rows = raw.withColumn("__row", F.monotonically_increasing_id())
    url = stripped(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "^﻿", ""))
    skip = (F.col("__row") == 0) & (F.lit(True) if named is not None else ~looks_like_url(url))
    return _numbered(rows.where(~skip).select(url.alias("url")).where("url <> ''"))


def urls_from_file(spark: SparkSession, path: str) -> DataFrame:
    return urls_from_csv(spark, path) if path.lower().endswith(".csv") else urls_from_text(spark, path)


def all_urls(spark: SparkSession, given: list[str], path: str | None = None) -> DataFrame:
    """Given URLs, then a file's, in order, repeats kept."""
    head = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "site_ord int, url string")
    if not path:
        return head
    tail = urls_from_file(spark, path).withColumn("site_ord", (F.col("site_ord") + len(given)).cast("int"))
    return head.unionByName(tail)
