"""Quality rules as a bitmask ledger, native DataFrame operators only.

Every rule is evaluated once per document; a failed rule sets its bit in ``fail_bits``, next to
the measurements it was decided on.  A policy is a mask of bits with a version: applying another
policy, or asking what a rule alone removes (ablation), works on the ledger and never on texts.

Defined results
---------------
* null or empty text: no words, all measurements zero; it fails ``too_few_words``;
* a text with fewer than five words has no window, hence no repeated words;
* ties, repeated rows, null ids: every row is judged by itself;
* very long texts: measured whole, in arrays of their words;
* empty table: empty ledger; input columns named like a ledger column are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, numbered

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rule name -> SQL condition under which a document fails; the position is the bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbol_heavy": "10 * n_symbols > word_chars",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "overlong_words": "word_chars > 30 * n_words",
}
#: Policy version -> the rules that reject under it.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "2024.1": tuple(RULES),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once; an expression used inside a lambda would run again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(positions: Column) -> Column:
    """How many words the windows that begin at the sorted ``positions`` cover together."""
    steps = F.transform(positions, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, k + 1) - x, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _found_again(by_hash: Column) -> Column:
    """Of (hash, position) sorted by hash: the sorted positions whose hash a neighbour has too."""
    twin = F.filter(by_hash, lambda e, j: (F.get(by_hash, j - 1)["h"] == e["h"]) | (F.get(by_hash, j + 1)["h"] == e["h"]))
    return F.sort_array(F.transform(twin, lambda e: e["p"]))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five found twice or more, each word once."""

    def of_hashes(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        # most texts repeat no window: the cheap test spares them the sort
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, lambda s: let(_found_again(s), _covered)))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def repeated_lines(text: Column) -> Column:
    worded = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return let(worded, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def rule_ledger(df: DataFrame, *, text_col: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """``df`` with the measurements and ``fail_bits``."""
    own = numbered(df)
    carry = own.without([*MEASURES, "fail_bits"])
    text = F.coalesce(own.of(text_col), F.lit(""))
    words = F.split(F.btrim(text, F.lit(BLANKS)), r"[\x20\x09-\x0D]+")
    some = F.btrim(text, F.lit(BLANKS)) != ""
    measured = own.inner.select(
        *carry,
        F.when(some, F.size(words)).otherwise(0).cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"),
        repeated_lines(text).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
    )
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in enumerate(rules.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    # the measurements are computed once, below the rules that read them
    return own.restored(measured, carry, **{m: F.col(m) for m in MEASURES}, fail_bits=total.cast("long"))


def policy_mask(policy: str, rules: dict[str, str] = RULES) -> int:
    return sum(1 << bit for bit, name in enumerate(rules) if name in POLICIES[policy])


def apply_policy(ledger: DataFrame, policy: str, rules: dict[str, str] = RULES) -> DataFrame:
    """The ledger with ``kept`` under the policy; ``rules``: those that the ledger was made with."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy, rules)).cast("long")) == 0)


def ablations(ledger: DataFrame, policy: str, rules: dict[str, str] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that would be kept without it.

    Failure patterns are counted first (at most two to the number of rules), so the rest is tiny.
    """
    mask = F.lit(policy_mask(policy, rules)).cast("long")
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, name in enumerate(rules) if name in POLICIES[policy])))
    each = patterns.select("bits", "n", named.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.bit_or("bits").alias("seen_bits"),
    )
