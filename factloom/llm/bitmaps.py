"""Key sets as bitmaps of bounded size, built and asked natively.

A bitmap holds one bit a hashed key, in rows of 32,768 bits.  It is the one thing operators broadcast: ``MOST_BITS``
bounds it at 32 MB whatever the input.  Asking it errs on one side only, so who asks must be right, if slower, when every
bit is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


def bits_for(keys: int) -> int:
    """Eight bits a key or more, up to the bound; a power of two."""
    return min(max(1 << (8 * keys).bit_length(), LEAST_BITS), MOST_BITS)


def _slot(bits: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def bitmap(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """The hashed ``keys`` of the rows."""
    slots = rows.select(_slot(bits, *keys).alias("__slot"))
    return slots.groupBy(F.bitmap_bucket_number("__slot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits"))


def with_marks(rows: DataFrame, marks: DataFrame, keys: list[str], bits: int, name: str) -> DataFrame:
    """Adds ``name``: false for rows whose ``keys`` the bitmap surely lacks."""
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(bitmap_bit_position(__slot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(__slot) % 8 as int))")) != 0, F.lit(False))
    slotted = rows.withColumn("__slot", _slot(bits, *keys)).withColumn("__bucket", F.bitmap_bucket_number("__slot"))
    return slotted.join(F.broadcast(marks), "__bucket", "left").withColumn(name, hit).drop("__bits", "__slot", "__bucket")
