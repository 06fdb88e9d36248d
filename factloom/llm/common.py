"""Helpers shared by the operators: shared scratch folder, written tables, column hygiene."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import exists, remove, scratch_path, shared_dir, written  # noqa: F401
from ..shipping import ship

#: ASCII blanks as the contracts write them: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text_col: str = "text") -> Column:
    """The text, a null one counting as empty."""
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


@dataclass(frozen=True)
class Numbered:
    """A table whose columns are named c0, c1, ... inside an operator, so no input name can clash with the operator's own."""

    inner: DataFrame
    names: tuple[str, ...]

    def inner_name(self, name: str) -> str:
        """Of the column of that name; letter case decides only between several."""
        found = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name}")
        return f"c{found[0]}"

    def of(self, name: str) -> Column:
        return F.col(self.inner_name(name))

    def without(self, replaced: Iterable[str]) -> list[str]:
        """Inner names of the columns that no result column replaces."""
        taken = {n.lower() for n in replaced}
        return [f"c{i}" for i, n in enumerate(self.names) if n.lower() not in taken]

    def restored(self, df: DataFrame, kept: list[str] | None = None, **added: Column) -> DataFrame:
        """The columns (those in ``kept``) under their own names again, and the ``added`` ones."""
        kept = [f"c{i}" for i in range(len(self.names))] if kept is None else kept
        return df.select(*(F.col(c).alias(self.names[int(c[1:])]) for c in kept), *(value.alias(name) for name, value in added.items()))


def numbered(df: DataFrame) -> Numbered:
    return Numbered(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), tuple(df.columns))


def fold_ascii(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def fixed_share(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: the contracts' fold rule (null id: fold -1)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus, F.lit(-1))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with the package on the workers; stateless by task, so a lost task is simply rerun."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, added: dict[str, T.DataType], worker: Callable[[], Callable[[list], list[pa.Array]]], *, text_col: str = "text", keep_text: bool = True, as_bytes: bool = False) -> DataFrame:
    """``df`` with the ``added`` columns, which ``worker()`` (called once a task) gives for a list of texts; null counts as empty.

    Input columns named like an added one are replaced.
    """
    own = numbered(df)
    kept = [c for c in own.without(added) if keep_text or c != own.inner_name(text_col)]
    text = F.coalesce(own.of(text_col), F.lit(""))
    source = own.inner.select(*kept, (text.cast("binary") if as_bytes else text).alias("text"))
    schema = T.StructType([*(f for f in source.schema if f.name != "text"), *(T.StructField(k, v) for k, v in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = worker()
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *of_texts(part.column(len(kept)).to_pylist())], names=schema.names)

    return own.restored(map_batches(source, run, schema), kept, **{k: F.col(k) for k in added})


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batch: pa.RecordBatch, text_col: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``max_bytes`` of text, at least one row each: bounds a worker's memory."""
    start = held = 0
    for i, value in enumerate(batch.column(batch.schema.get_field_index(text_col))):
        size = value.as_buffer().size if value.is_valid else 0
        if held and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)
