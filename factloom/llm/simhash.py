"""SimHash near-dedup in a segment-popcount embedding.

Documents become 64-bit fingerprints over word shingles.  A fingerprint is cut into 32 segments of two bits;
its embedding is the vector of bit counts per segment.  The Manhattan distance of two embeddings
is never above the Hamming distance of the fingerprints.  Counts are written in unary (00, 01,
11), so the whole embedding is one 64-bit number and the Manhattan distance one bit count.

Grid range-join: with at most two differing bits, of three bands of segments one has equal counts, and of
six bands four have.  Each distinct fingerprint lies in one grid cell per band, and only fingerprints of a cell meet;
there the Manhattan bound, then the exact Hamming distance decide, both inside the join.  Cells above
``hot_cell`` fingerprints are refined: their fingerprints meet in the 15 cells of four of six bands instead, which
hold about one in a billion of all.

What is still above ``hot_cell`` is a dense cluster, where the grid would make a square of pairs.  Its fingerprints are
linked exactly, in linear time: two fingerprints differ in at most two bits if and only if some number is within one bit of
both, so each is dealt to itself and its 64 neighbours, and whoever meets there is linked to the least.

Only distinct fingerprints are joined; a third of all rows being copies makes no difference.

Defined results
---------------
* null text counts as empty; no words: fingerprint zero, linked like any other;
* fewer words than a shingle has: the whole sequence is the one shingle;
* very long texts: hashed whole, in blocks of shingles;
* repeated rows get equal results; a null id is never a component's id unless all its ids are null;
* empty table: empty result; ties between hash bits (exactly half) give 0;
* input columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, slices, whole_text, written
from .components import components

SEED = 42
MAX_BITS = 2
SEGMENTS = 32
LOW_BITS = 0x5555555555555555
_CHUNK = 1 << 15


def bands(n: int) -> list[int]:
    """Masks of ``n`` bands of whole segments."""
    edges = [2 * (SEGMENTS * i // n) for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


#: Two bits touch at most two bands: one of three, or four of six, stay whole.
COARSE = bands(MAX_BITS + 1)
FINE = [sum(some) for some in combinations(bands(3 * MAX_BITS), 2 * MAX_BITS)]


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of all shingles, repeated ones too."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and blanks [\x20\x09-\x0D]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)] if words else [], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    parts = [np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)], "<u8") for at in range(0, len(starts), _CHUNK)]
    return np.concatenate(parts)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits that more than half of the hashes have."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        count += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed 64-bit number."""
    source = df.select(F.col(f"`{id_col}`").alias(id_col), whole_text(text_col).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                found = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return map_batches(source, run, T.StructType([T.StructField(id_col, source.schema[0].dataType), T.StructField("fp", T.LongType())]))


def _signed(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary."""
    low, up = _signed(LOW_BITS), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1))


def _cells(embedded: DataFrame, masks: list[int], name: str) -> DataFrame:
    """Fingerprints (``fp``, ``e``) by ``band`` and ``cell``, with the cell's size ``n``; cells of one are left out."""
    placed = embedded.select("fp", "e", F.posexplode(F.array(*(F.col("e").bitwiseAND(_signed(m)) for m in masks))).alias("band", "cell"))
    # written, the sizes bring no partitioning of their own: adaptive execution may split a large cell in the join
    sizes = written(placed.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{name}-sizes")
    return written(placed.join(sizes, ["band", "cell"]), name)


def _near(cells: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) within the cells."""
    x, y = cells.alias("x"), cells.alias("y")
    near = (
        (F.col("x.band") == F.col("y.band"))
        & (F.col("x.cell") == F.col("y.cell"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (F.bit_count(F.col("x.e").bitwiseXOR(F.col("y.e"))) <= MAX_BITS)
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS)
    )
    return x.join(y, near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def links(distinct: DataFrame, *, hot_cell: int = 64) -> DataFrame:
    """Edges (``a``, ``b``) that connect all of the distinct fingerprints ``fp`` within two bits of each other.

    Pairs in cells of at most ``hot_cell`` are given directly; in dense clusters enough edges are given to
    connect the same fingerprints.
    """
    coarse = _cells(distinct.select("fp", embedding(F.col("fp")).alias("e")), COARSE, "cells")
    fine = _cells(coarse.where(F.col("n") > hot_cell).select("fp", "e").distinct(), FINE, "fine-cells")
    # each fingerprint of a dense cluster, dealt to all numbers within one bit of it
    around = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(_signed(1 << i)) for i in range(64))))
    dealt = fine.where(F.col("n") > hot_cell).select("fp").distinct().select("fp", around.alias("centre"))
    least = written(dealt.groupBy("centre").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "centres")
    met = dealt.join(least, "centre").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return _near(coarse.where(F.col("n") <= hot_cell)).unionByName(_near(fine.where(F.col("n") <= hot_cell))).unionByName(met)


def near_dedup(df: DataFrame, *, shingle: int = 3, hot_cell: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``fp`` and ``component_id``, the least id that links lead to."""
    prints = written(fingerprints(df, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    least = prints.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least"))
    roots = components(links(least.select("fp"), hot_cell=hot_cell))
    of_fp = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = written(of_fp.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    ids = of_fp.join(of_root, "root").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(ids, F.col("fp") == F.col("__fp")).drop("__fp")


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
