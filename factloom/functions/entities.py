"""People by entity recognition: a stage that callers may plug in, and one for spaCy where that is installed."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .names import clean_name
from .text import first_wins

#: From a text to the names in it, in order.
Recognizer = Callable[[Column], Column]


def with_recognized(people: Column, text: Column, recognizer: Recognizer) -> Column:
    """``people`` and behind them those that the recognizer finds at the text's beginning and the patterns did not."""
    found = F.transform(recognizer(F.substring(text, 1, fixed.RECOGNIZED_CHARS)), lambda n: F.struct(clean_name(n).alias("name"), F.lit(None).cast("string").alias("role")))
    return first_wins(F.concat(people, F.filter(found, lambda p: p["name"].isNotNull())), lambda p: p["name"])


def spacy_recognizer(model: str = "es_core_news_sm") -> Recognizer:
    """Person entities of a spaCy model, loaded once a worker."""
    if find_spec("spacy") is None:
        raise ModuleNotFoundError("spacy is not installed; entity recognition needs it and a model")

    @lru_cache(maxsize=1)
    def loaded():
        import spacy

        return spacy.load(model)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def people(text: pd.Series) -> pd.Series:
        return pd.Series([[e.text for e in loaded()(t or "").ents if e.label_ in ("PER", "PERSON")] for t in text], dtype=object)

    return people
