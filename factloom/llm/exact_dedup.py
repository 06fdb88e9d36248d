"""Exact dedup by progressive refinement, native DataFrame operators only.

Length first, then a hash of the first characters, then a hash of the whole text; each step looks
only at rows that are not yet alone.  Which keys are shared is handed on as a bitmap of eight bits a row, 32 MB at
most whatever the input (``bitmap_bits`` / 8 bytes), the one thing that is broadcast.  A full bitmap costs extra hashing, never a wrong result, since the last step groups
by the full hash itself.  Texts are never shuffled.

Defined results
---------------
* null text counts as empty; all empty texts are one group;
* of equal texts the row with the largest id stays; null ids are smaller than all others;
* repeated rows (same id, same text): exactly one of them is kept;
* very long texts: only lengths and hashes leave the scan;
* empty table: empty result; ``carry`` columns named like a result column are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap, bits_for, with_marks
from .common import whole_text, written

RESULTS = ("keep_id", "group_size", "kept")


def shared_keys(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """A bitmap of the hashed ``keys`` that two or more rows have."""
    return bitmap(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), keys, bits)


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = 256, bitmap_bits: int | None = None) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and the ``carry`` columns."""
    bitmap_bits = bitmap_bits or bits_for(df.count())
    carry = tuple(c for c in carry if c.lower() not in RESULTS and c != id_col)
    text = whole_text(text_col)
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)), text.alias("__text"), F.octet_length(text).alias("__len"))
    by_length = with_marks(rows, shared_keys(rows, ["__len"], bitmap_bits), ["__len"], bitmap_bits, "__s1")
    # an unshared length ends it: such rows keep a null prefix hash and need no further look
    prefixed = by_length.withColumn("__ph", F.when(F.col("__s1"), F.xxhash64(F.substring("__text", 1, prefix_chars))))
    keys = ["__len", "__ph"]
    by_prefix = with_marks(prefixed, shared_keys(prefixed.where("__s1"), keys, bitmap_bits), keys, bitmap_bits, "__s2")
    # hashed once and written: texts are not read again, and rows that stay alone pass by the join and the window
    alone = ~(F.col("__s1") & F.col("__s2"))
    carried = [f"__c{i}" for i in range(len(carry))]
    hashed = written(by_prefix.select("__id", *carried, F.when(~alone, F.sha2("__text", 256)).alias("__key")), "full-hashes")
    copies = hashed.where("__key IS NOT NULL")
    # written, the groups bring no partitioning of their own: adaptive execution may then split a large group of copies
    groups = written(copies.groupBy(F.col("__key").alias("__gkey")).agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n")), "copies")
    joined = copies.join(groups, F.col("__key") == F.col("__gkey"))
    # only rows that share id and text meet here; one column holds both, so the join need not keep a group together
    row = F.concat("__key", F.when(F.col("__id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("__id").cast("string"))))
    first = F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(1))) == 1
    ranked = joined.withColumn("__row", row).withColumn("__first", first)
    kept = F.col("__id").eqNullSafe(F.col("__keep")) & F.col("__first")
    results = lambda keep, n, stays: [F.col("__id").alias(id_col), keep.alias("keep_id"), n.alias("group_size"), stays.alias("kept"), *(F.col(c).alias(name) for c, name in zip(carried, carry, strict=True))]
    single = hashed.where("__key IS NULL").select(*results(F.col("__id"), F.lit(1).cast("long"), F.lit(True)))
    return ranked.select(*results(F.col("__keep"), F.col("__n"), kept)).unionByName(single)
