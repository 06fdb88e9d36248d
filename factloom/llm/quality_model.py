"""Quality classifier: a generalised additive model over measurements of the whole text.

Defined results
---------------
* null text counts as empty and gets a score like any other;
* rows with a null label, or a null id in the labels, teach nothing; several labels of an id: the largest counts;
* null ids in documents are scored; repeated rows get equal scores;
* no labelled rows, or one label only: the share of label 1 is everyone's score;
* very long texts: measured whole, one slice of rows at a time;
* empty table: empty result; input columns named ``score`` or ``predicted`` are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, map_texts, slices, whole_text
from .gam import Gam, fit_gam
from .labelled import label_sample

#: Most labelled rows the model is fitted on.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "distinct_words", "repeated_next", "distinct_pairs", "symbols", "bars", "upper", "exclamations", "digits", "stops", "repeated_lines", "words_a_line", "not_ascii", "longest_word")
_UPPER, _DIGITS, _SYMBOLS = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>"))


def measure(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return (0.0,) * len(FEATURES)
    among = lambda letters: (size - len(text.translate(None, letters))) / size
    lines = [line for line in text.split(b"\n") if line.strip()]
    following = words[1:]
    return (
        np.log1p(n),
        sum(map(len, words)) / n,
        len(set(words)) / n,
        sum(map(eq, words, following)) / n,
        len(set(zip(words, following, strict=False))) / max(1, n - 1),
        among(_SYMBOLS),
        words.count(b"|") / n,
        among(_UPPER),
        text.count(b"!") / n,
        among(_DIGITS),
        (text.count(b".") + text.count(b",")) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        (size - len(text.decode("utf-8", "replace"))) / size,
        np.log1p(max(map(len, words))),
    )


def measured(texts: list[bytes]) -> np.ndarray:
    return np.array([measure(t) for t in texts]).reshape(-1, len(FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """``learn``: the rows of ``labels`` that may teach."""
    sample = label_sample(labels, label, learn, sample_rows, id_col)
    taught = docs.select(F.col(f"`{id_col}`").alias("__id"), whole_text(text_col).cast("binary").alias("__text"))
    taught = taught.join(F.broadcast(sample), F.col("__id") == F.col("__lid")).select("__label", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(measured(part.column(1).to_pylist()).tolist(), pa.list_(pa.float64()))], names=["label", "x"])

    rows = map_batches(taught, run, "label int, x array<double>").collect()  # bounded by sample_rows
    order = sorted((tuple(r["x"]), r["label"]) for r in rows)  # whichever task came first
    return fit_gam(np.array([x for x, _ in order]).reshape(-1, len(FEATURES)), np.array([float(y == 1) for _, y in order]))


def score_quality(df: DataFrame, model: Gam, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``score`` and ``predicted``."""

    def scored(texts: list[bytes]) -> list[pa.Array]:
        score = model.predict(measured(texts))
        return [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]

    return map_texts(df, {"score": T.DoubleType(), "predicted": T.IntegerType()}, lambda: scored, text_col=text_col, keep_text=keep_text, as_bytes=True)
