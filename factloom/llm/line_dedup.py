"""Line dedup: drop lines that several documents share, native DataFrame operators only.

Lines are exploded, normalised and hashed; distinct documents are counted per hash in two
aggregation steps (document and hash, then hash), so a line that stands in a third of all documents is
reduced where it is read and no task gathers it.  Dropped positions then meet the texts, which
are cut into the runs of lines between those positions: linear in the document's length.

Defined results
---------------
* null or empty text: one empty line, nothing dropped, text becomes ``""``;
* a line that is blank or whose key is short always stays;
* null id: such rows count together as one document, smaller than every other id;
* repeated rows (same id and text) each get the same result;
* ties: of documents that share a line the one with the largest id keeps it, all its copies of the line;
* very long texts: their lines are exploded like all others, and only the dropped positions come back;
* empty table: empty result; input columns named like a result column are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, fold_ascii, numbered, written

RESULTS = ("n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    return fold_ascii(F.btrim(line, F.lit(BLANKS)))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Of hashed lines (``__id``, ``__h1``, ``__h2``): the hashes in at least ``min_docs`` documents, and the largest id."""
    per_doc = lines.groupBy("__h1", "__h2", "__id").agg(F.lit(1).alias("__one"))
    return (
        per_doc.groupBy("__h1", "__h2")
        .agg(F.count("__one").alias("__docs"), F.max("__id").alias("__keep"))
        .where(F.col("__docs") >= min_docs)
        .select("__h1", "__h2", "__keep")
    )


def line_dedup(df: DataFrame, *, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the shared lines gone from its text, and ``n_lines`` and ``n_dropped`` added."""
    own = numbered(df)
    carry = own.without(RESULTS)
    at = own.inner_name(text_col)
    text = F.col(at)
    docs = own.inner.withColumn(at, F.coalesce(text, F.lit(""))).withColumn("__id", own.of(id_col)).withColumn("__th", F.xxhash64(at))
    lines = (
        docs.select("__id", "__th", F.posexplode(F.split(text, "\n")).alias("__pos", "__line"))
        .select("__id", "__th", "__pos", line_key(F.col("__line")).alias("__key"))
        .where(F.length("__key") >= min_chars)
        # two independent hashes, 96 bits together: no false match to be expected in 10^12 lines
        .select("__id", "__th", "__pos", F.xxhash64("__key").alias("__h1"), F.hash("__key").alias("__h2"))
    )
    # written, lines are cut and hashed once for the count and the join
    lines = written(lines, "line-hashes")
    # written, the shared lines bring no partitioning of their own: adaptive execution may then split a line
    # that stands in very many documents over several tasks of the join
    shared = written(shared_lines(lines, min_docs), "shared-lines")
    dropped = (
        lines.join(shared, ["__h1", "__h2"])
        .where(~F.col("__id").eqNullSafe(F.col("__keep")))
        .groupBy(F.col("__id").alias("__did"), F.col("__th").alias("__dth"))
        .agg(F.sort_array(F.collect_set("__pos")).alias("__cut"))
    )
    joined = docs.join(dropped, F.col("__id").eqNullSafe(F.col("__did")) & (F.col("__th") == F.col("__dth")), "left")

    def between(all_lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform("__cut", lambda p: p + 1))
        ends = F.concat(F.col("__cut"), F.array(F.size(all_lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(all_lines, s + 1, e - s))), "\n")

    # a one-element transform() binds the split lines once for the lambda
    kept = F.when(F.col("__cut").isNull(), text).otherwise(F.element_at(F.transform(F.array(F.split(text, "\n")), between), 1))
    return own.restored(
        joined.withColumn("__kept", kept).withColumn("__text", text).drop(at).withColumnRenamed("__kept", at),
        carry,
        n_lines=(F.length("__text") - F.length(F.translate("__text", "\n", "")) + 1).cast("long"),
        n_dropped=F.when(F.col("__cut").isNull(), F.lit(0)).otherwise(F.size("__cut")).cast("long"),
    )
