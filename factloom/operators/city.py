"""City inference: capitalised word windows against a gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import folded, let

#: Words that a name may have.
WINDOWS = (1, 2, 3)


def address_snippet(text: Column) -> Column:
    """What follows the first address label, on its line."""
    found = F.regexp_extract(text, rf"(?iU){fixed.ADDRESS_LABEL}", 1)
    return F.nullif(F.btrim(found, F.lit(fixed.OUTER_MARKS)), F.lit(""))


def city_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({fixed.CITY_WORD})"), 1)


def _capital(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def window_counts(text: Column) -> Column:
    """(size, n) of the windows of one, two, three words with a capital; counted, not built."""

    def of(capitals: Column) -> Column:
        def size(n: int) -> Column:
            has = lambda c, i: F.array_contains(F.slice(capitals, i + 1, n), True) & (i + n <= F.size(capitals))
            return F.struct(F.lit(n).alias("size"), F.size(F.filter(capitals, has)).cast("long").alias("n"))

        return F.filter(F.array(*map(size, WINDOWS)), lambda x: x["n"] > 0)

    return let(F.transform(city_words(text), _capital), of)


def guessed_cities(sites: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Of sites (``site_id``, ``text``, ``snippet``, ``preferred``): the best match per site that has one.

    ``gazetteer``: see :func:`factloom.sources.gazetteer.keyed`.  Each word is looked up once among the first words of spellings;
    only where it is one is the window compared.
    """
    sources = F.array(F.struct(F.lit(True).alias("in_address"), F.col("snippet").alias("t")), F.struct(F.lit(False).alias("in_address"), F.col("text").alias("t")))
    parts = sites.select("site_id", "preferred", F.explode(sources).alias("s")).where("s.t IS NOT NULL").select("site_id", "preferred", "s.in_address", city_words(F.col("s.t")).alias("ws"))
    placed = F.transform("ws", lambda w, i: F.struct((i + 1).alias("at"), F.slice("ws", i + 1, max(WINDOWS)).alias("ws")))
    words = parts.select("site_id", "preferred", "in_address", F.inline(F.filter(placed, lambda x: F.exists(x["ws"], _capital))))
    words = words.withColumn("first", folded(F.get("ws", 0)))
    spellings = gazetteer.withColumn("size", F.size(F.split("key", " "))).where(F.col("size").isin(*WINDOWS)).withColumn("first", F.split_part("key", F.lit(" "), F.lit(1)))
    window = F.slice("ws", 1, F.col("size"))
    met = words.join(spellings, "first").where((F.size(window) == F.col("size")) & (folded(F.array_join(window, " ")) == F.col("key")) & F.exists(window, _capital))
    hits = met.withColumn("original", F.array_join(window, " "))
    match = F.coalesce(F.col("countrycode") == F.col("preferred"), F.lit(False))
    record = F.struct("name", "countrycode", "population")
    best = hits.groupBy("site_id", "in_address", "size", "at").agg(
        F.max_by(record, F.struct(match, F.col("population"), -F.col("ord"))).alias("r"),
        F.first("original").alias("original"),
        F.first("preferred").alias("preferred"),
    )
    match = F.coalesce(F.col("r.countrycode") == F.col("preferred"), F.lit(False))
    strong = best.where(F.col("in_address") | match | ((F.col("r.population") >= fixed.BARE_CITY_POPULATION) & (F.length("original") >= fixed.BARE_CITY_LETTERS)))
    rank = F.struct("in_address", match, -F.col("at"), F.col("r.population"), F.col("size"))
    chosen = strong.groupBy("site_id").agg(F.max_by(F.struct("r.name", "r.countrycode", "r.population", "original", "in_address"), rank).alias("c"))
    return chosen.select("site_id", F.col("c.name").alias("city"), "c.countrycode", "c.population", F.col("c.original").alias("evidence"), F.col("c.in_address").alias("from_address_line"))
