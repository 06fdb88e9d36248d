"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_sample(labels: DataFrame, label: str, wanted: Column, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most about ``bound`` labelled rows (``__lid``, ``__label``), chosen by a hash of the id; rows without label are left out.

    The share is set from the number of rows, so the size follows ``bound``, not the input, and
    the result may be broadcast; a final limit makes the bound strict.
    """
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & wanted)
    known = known.select(F.col(f"`{id_col}`").alias("__lid"), F.col(f"`{label}`").cast("int").alias("__label")).groupBy("__lid").agg(F.max("__label").alias("__label"))
    n = known.count()
    if n > bound:
        parts = 1 << 20
        known = known.where(F.pmod(F.xxhash64("__lid"), F.lit(parts)) < int(parts * bound / n))
    return known.limit(bound + bound // 10)
