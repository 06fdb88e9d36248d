"""Merging facts of a site's pages, with precedence and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_people(mentions: DataFrame) -> DataFrame:
    """Of mentions (``site_id``, ``src``, ``page``, ``o``, ``name``, ``role``): ``site_id`` and ``names``, in order.

    The first position of a name counts and the first role given; within one page only the first mention of a name.
    """
    once = Window.partitionBy("site_id", "src", "page", "name").orderBy("o")
    firsts = mentions.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    place = F.struct("src", "page", "o")
    each = firsts.groupBy("site_id", "name").agg(F.min(place).alias("place"), F.min_by("role", F.when(F.col("role").isNotNull(), place)).alias("role"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "name", "role")))
    return each.groupBy("site_id").agg(F.transform(ordered, lambda p: F.struct(p["name"].alias("name"), p["role"].alias("role"))).alias("names"))


def ordered_distinct(items: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key`` and ``value`` as an array: first occurrences in order, empty ones dropped."""
    firsts = items.where((F.col(value).isNotNull()) & (F.col(value) != "")).groupBy(key, value).agg(F.min(order).alias("__o"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", value))), lambda x: x[value]).alias(value))
