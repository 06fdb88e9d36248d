"""Token counts through a digest cache.

Texts are reduced to the digest of their normalised content; the cache holds counts by that digest
and the digest of the tokenizer file.  One document for each digest that the cache lacks is encoded, the
new counts are appended, and all documents then take theirs from what was found and what was new.

Texts are never shuffled: a bitmap of bounded size says which rows stand for a missing digest, and those are encoded where
they are read.  Where the bitmap errs, or is full, copies are encoded again, once a task, to the same count.
Everything that is shuffled is digests and numbers.

Defined results
---------------
* null text counts as empty: 0 bytes, 0 tokens;
* very long texts: encoded whole, one slice of rows at a time;
* repeated rows, null ids: one output row per input row;
* empty table: empty result, the cache stays as it is; a missing cache counts as empty, a damaged one raises;
* a digest that two runs appended at once has the same count twice, either of which is taken;
* input columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import bitmap, bits_for, with_marks
from .common import column, exists, map_batches, slices, whole_text, written
from .tokenizing import drops_blanks, library_encoder

#: Digests that a task remembers as encoded, at most.
SEEN = 200_000
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """sha256 of the tokenizer file: another file never meets another's counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    """What decides the count: where blanks are dropped, outer and kinds of ASCII blanks do not matter."""
    return F.btrim(F.translate(text, "\t\n\x0b\x0c\r", " " * 5)) if drops_blanks(path) else text


def stored_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if exists(spark, cache_path) else spark.createDataFrame([], CACHE_SCHEMA)
    return cache.where(F.col("tokenizer") == version).select("digest", "n_tokens")


def encoded(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """``digest`` and ``n_tokens`` of the rows (``digest``, ``text``), each digest once a task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path)
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                new: dict[bytes, str] = {d: t for d, t in zip(column(part, "digest"), column(part, "text"), strict=True) if d not in seen}
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(new)
                counts = [len(ids) // 4 for ids in encoder(list(new.values()))]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return map_batches(texts, encode, "digest binary, n_tokens long")


def token_counts(df: DataFrame, tokenizer_path: str, cache_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_tokens``, ``over_limit``.  Appends to the cache when called."""
    spark = df.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = whole_text(text_col)
    texts = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.unhex(F.sha2(normalised(text, tokenizer_path), 256)).alias("digest"))
    keyed = written(texts.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "text-digests")
    distinct = written(keyed.groupBy("digest").agg(F.min("id").alias("id")), "digests")
    # written, the counts bring no partitioning of their own: adaptive execution may split a digest that very many rows share
    known = written(stored_counts(spark, cache_path, version).join(distinct, "digest", "left_semi").groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")), "known-counts")
    misses = written(distinct.join(known, "digest", "left_anti"), "misses")
    bits = bits_for(misses.count())
    wanted = with_marks(texts, bitmap(misses, ["digest", "id"], bits), ["digest", "id"], bits, "wanted").where("wanted").select("digest", "text")
    new = written(encoded(wanted, tokenizer_path).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")).join(misses, "digest", "left_semi"), "new-counts")
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = known.unionByName(new)
    return keyed.join(counts, "digest", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
