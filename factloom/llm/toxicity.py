"""Toxicity: a learned lexicon, matched through Levenshtein automata, scored in context windows.

Lexicon: all words and word beginnings that stand in toxic documents far more often than in others: log-odds over their
standard error, against a threshold that rises with the number of terms looked at.  They are counted over a bounded sample
of labelled rows.  Matching: each distinct word is looked up, and walked as a Levenshtein automaton over the trie of
those of the lexicon's longer words that can be near it, so that misspelled terms hit as well.  Context: hits are weighed
in windows of words; hits inside quotation marks or after a reporting verb count as quotation, apart from the rest.
A logistic model turns these measurements into a score; it is fitted on documents with the lexicon of the other half
of the sample, so it knows how far terms can be trusted on unseen texts.

Defined results
---------------
* null text counts as empty: no hits, the score of a text without hits;
* rows with a null label, or a null id in the labels, teach nothing; several labels of an id: the largest counts;
* null ids in documents are scored; repeated rows get equal scores;
* no labelled rows, or one label only: the share of label 1 is everyone's score;
* very long texts: every word is looked at; a worker holds one slice of rows;
* copies of a text whose labels disagree count once, with the largest label;
* empty table: empty result; input columns named like a result column are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, map_texts, slices, whole_text, written
from .labelled import label_sample

#: Most labelled rows the model is fitted on.
SAMPLE_ROWS = 20_000
#: Letters that a word of the lexicon has at least for misspelled ones to be sought, edits at most, and letters for two.
LEAST_LETTERS, EDITS, TWO_FROM = 5, 2, 9
THRESHOLD = 0.3
LEAST_DOCS, LEAST_Z = 3, 2.0
#: A term's log-odds must be so far from chance that, of all terms looked at, chance alone would give this many.
CHANCE_TERMS = 4
BEGINNINGS = range(4, 9)
#: Words on each side that count as a hit's context.
WINDOW = 8
QUOTES = frozenset("\"“”„«»‟‘")
REPORTING = frozenset(("said", "says", "wrote", "writes", "quoted", "called", "dijo", "escribió", "dit", "écrit", "sagte", "schrieb"))
STRIPPED = string.punctuation + "“”„«»‟‘’¿¡…–—"
FEATURES = 10
CACHE_WORDS = 200_000


def bare(word: str) -> str:
    return word.lower().strip(STRIPPED)


def terms(text: str) -> set[str]:
    """Distinct words, and beginnings (marked ``^``) of longer words."""
    words = set(map(bare, set(text.split())))
    words.discard("")
    return words | {"^" + w[:n] for w in words for n in BEGINNINGS if len(w) > n}


@dataclass(frozen=True)
class Entry:
    z: float
    weight: float


class Remainders:
    """Which of some words share a remainder with a searched one: what is left of each without up to ``letters`` letters.

    Remainders are compared by polynomial hashes, worked out for all searched words of a length at once: of a word whose
    prefix sums are known, each remainder takes a few operations.  Equal hashes of unequal remainders only
    cost a look too many.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))  # moves a letter one place to the front
    TABLE_BITS = 22
    AT_ONCE = 1 << 12

    def __init__(self, words: list[str], letters: int):
        self.letters = letters
        found = [(h.ravel(), np.repeat(at, h.shape[1])) for at, h in self._by_length(words)]
        hashes, owners = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        self.table = np.zeros(1 << self.TABLE_BITS, bool)
        self.table[self._slots(self.hashes)] = True

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * self.BASE >> np.uint64(64 - self.TABLE_BITS)).astype(np.int64)

    def _hashes(self, words: list[str]) -> np.ndarray:
        """One row a word, all of one length; one column a remainder."""
        n = len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64) + np.uint64(1)
        powers = np.cumprod(np.full(n, self.BASE, np.uint64))
        sums = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(letters * powers, axis=1)], axis=1)
        found = [sums[:, -1:]]
        if self.letters:
            found.append(sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * self.BACK)
        if self.letters > 1:
            i, j = np.triu_indices(n, 1)
            found.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * self.BACK + (sums[:, -1:] - sums[:, j + 1]) * self.BACK * self.BACK)
        return np.concatenate(found, axis=1)

    def _by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of words, and their hashes."""
        places: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                places.setdefault(len(w), []).append(i)
        for at in places.values():
            for start in range(0, len(at), self.AT_ONCE):
                some = at[start : start + self.AT_ONCE]
                yield np.array(some), self._hashes([words[i] for i in some])

    def sharing(self, searched: list[str]) -> Iterator[tuple[int, list[int]]]:
        """Positions of searched words, and of the words each shares a remainder with, if any."""
        for at, hashes in self._by_length(searched):
            row, col = np.nonzero(self.table[self._slots(hashes)])
            wanted = hashes[row, col]
            low, high = np.searchsorted(self.hashes, wanted), np.searchsorted(self.hashes, wanted, side="right")
            met: dict[int, set[int]] = {}
            for r, a, b in zip(row[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                met.setdefault(r, set()).update(self.owners[a:b].tolist())
            for r, owners in met.items():
                yield int(at[r]), sorted(owners)


class LevenshteinTrie:
    """Words, and a search for those within ``errors`` edits of a word.

    The automaton of the searched word is simulated bit-parallel: bit i of row e says that
    i letters are matched with e errors.  The walk leaves a branch once no bit is left.

    Two words within ``errors`` edits have something in common that is left of each without ``errors``
    letters at most, so only the trie of the entries that share it with the searched word is walked.
    """

    def __init__(self, words: dict[str, Entry]):
        lengths = [len(w) for w in words] or [0]
        self.shortest, self.longest = min(lengths), max(lengths)
        self.words, self.names = words, sorted(words)
        self.remainders = [Remainders(self.names, e) for e in range(EDITS + 1)] if words else []
        self.trie = lru_cache(maxsize=20_000)(self._trie)

    def _trie(self, some: tuple[int, ...]) -> dict:
        root: dict = {}
        for i in some:
            node, word = root, self.names[i]
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = (word, self.words[word])
        return root

    def search(self, word: str, errors: int) -> tuple[str, Entry] | None:
        """The entry of most weight within ``errors`` edits, or None."""
        return self.search_all([word], errors).get(word)

    def search_all(self, words: list[str], errors: int) -> dict[str, tuple[str, Entry]]:
        """The same for each of the words that has such an entry."""
        words = [w for w in words if self.shortest - errors <= len(w) <= self.longest + errors]
        found = {words[i]: self._walk(self.trie(tuple(some)), words[i], errors) for i, some in (self.remainders[errors].sharing(words) if self.words else ())}
        return {w: best for w, best in found.items() if best}

    @staticmethod
    def _walk(root: dict, word: str, errors: int) -> tuple[str, Entry] | None:
        mask: dict[str, int] = {}
        for i, letter in enumerate(word):
            mask[letter] = mask.get(letter, 0) | 1 << i
        full, end = (2 << len(word)) - 1, 1 << len(word)
        best = None
        stack = [(root, tuple((2 << e) - 1 & full for e in range(errors + 1)))]
        while stack:
            node, rows = stack.pop()
            for letter, child in node.items():
                if not letter:
                    if rows[-1] & end and (best is None or child[1].weight > best[1].weight):
                        best = child
                    continue
                m = mask.get(letter, 0)
                row = (rows[0] & m) << 1
                new = [row]
                for e in range(1, errors + 1):
                    # match, other letter, letter missing in the word, letter too many in it
                    row = ((rows[e] & m) << 1 | rows[e - 1] << 1 | rows[e - 1] | row << 1) & full
                    new.append(row)
                if row:
                    stack.append((child, tuple(new)))
        return best


Hit = tuple[float, float, int]


@dataclass
class Lexicon:
    words: dict[str, Entry] = field(default_factory=dict)
    beginnings: dict[str, Entry] = field(default_factory=dict)
    #: Words that misspelled ones are sought for; those that a beginning covers are among them.
    sought: dict[str, Entry] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.trie = LevenshteinTrie({w: e for w, e in self.sought.items() if len(w) >= LEAST_LETTERS and w.isalpha()})
        self.openings = {b[: BEGINNINGS.start] for b in self.beginnings}
        self.cache: dict[str, Hit | None] = {}
        self.older: dict[str, Hit | None] = {}

    def __reduce__(self):
        parts = (self.words, self.beginnings, self.sought)
        return lexicon_on_worker, (hashlib.sha256(pickle.dumps(parts)).hexdigest(), *parts)

    def match(self, chunk: str) -> Hit | None:
        """(z, weight, kind) of what the chunk hits; kind 0 exact, 1 beginning, 2 misspelled."""
        self.learn([chunk])
        return self.cache[chunk]

    def learn(self, chunks: Iterable[str]) -> None:
        """Sees to it that the cache holds the chunks; beyond its bound it keeps those at hand, and the older ones once."""
        unknown = [c for c in chunks if c not in self.cache]
        if len(self.cache) + len(unknown) > CACHE_WORDS:
            self.older, self.cache = self.cache, {c: self.cache[c] for c in chunks if c in self.cache}
        missing: dict[str, list[str]] = {}
        for chunk in unknown:
            if chunk in self.older:
                self.cache[chunk] = self.older[chunk]
            else:
                missing.setdefault(bare(chunk), []).append(chunk)
        hits: dict[str, Hit] = {}
        for word in missing:
            if found := self.words.get(word):
                hits[word] = found.z, found.weight, 0
            elif word[: BEGINNINGS.start] in self.openings and (starts := [e for n in BEGINNINGS if len(word) > n and (e := self.beginnings.get(word[:n]))]):
                best = max(starts, key=lambda e: e.z)
                hits[word] = best.z, best.weight, 1
        left = [w for w in missing if len(w) >= 4 and w not in hits]
        for errors, some in ((1, [w for w in left if len(w) < TWO_FROM]), (EDITS, [w for w in left if len(w) >= TWO_FROM])):
            for word, (_, entry) in self.trie.search_all(some, errors).items():
                hits[word] = 0.7 * entry.z, 0.7 * entry.weight, 2
        for word, chunks_of in missing.items():
            self.cache.update(dict.fromkeys(chunks_of, hits.get(word)))

    def hits(self, words: list[str]) -> list[tuple[int, Hit]]:
        """Positions and hits of words that have been learned."""
        return [(i, hit) for i, hit in enumerate(map(self.cache.__getitem__, words)) if hit]


@lru_cache(maxsize=4)
def _kept(key: str) -> list[Lexicon]:
    return []


def lexicon_on_worker(key: str, *parts: dict[str, Entry]) -> Lexicon:
    """The worker process's own lexicon of that content: its tries and cache serve all tasks of the process."""
    held = _kept(key)
    if not held:
        held.append(Lexicon(*parts))
    return held[0]


def quoted(words: list[str], at: int, marks: bool) -> bool:
    """Whether the word stands in quotation marks (``marks``: the text has some) or shortly after a reporting verb."""
    if marks and not QUOTES.isdisjoint("".join(words[max(0, at - WINDOW) : at + 1])) and not QUOTES.isdisjoint("".join(words[at : at + WINDOW + 1])):
        return True
    return any(bare(w) in REPORTING for w in words[max(0, at - 3) : at])


def measure_all(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    split = [t.split() for t in texts]
    lexicon.learn(set().union(*split))
    return np.array([measure(t, words, lexicon) for t, words in zip(texts, split, strict=True)]).reshape(-1, FEATURES)


def measure(text: str, words: list[str], lexicon: Lexicon) -> list[float]:
    hits = lexicon.hits(words)
    if not hits:
        return [0.0] * (FEATURES - 1) + [np.log1p(len(words))]
    marks = any(c in text for c in QUOTES)
    in_quotes = [quoted(words, i, marks) for i, _ in hits]
    plain = [h for (_, h), q in zip(hits, in_quotes, strict=True) if not q]
    # the densest window: weight of the hits within WINDOW words of each other
    densest = start = total = 0.0
    start = 0
    for end, (i, h) in enumerate(hits):
        total += 0.0 if in_quotes[end] else h[1]
        while hits[start][0] < i - WINDOW:
            total -= 0.0 if in_quotes[start] else hits[start][1][1]
            start += 1
        densest = max(densest, total)
    weight = sum(h[1] for h in plain)
    return [
        min(max((h[0] for h in plain), default=0.0), 30.0) / 10,
        np.log1p(weight),
        np.log1p(densest),
        np.log1p(sum(h[0] >= 6 for h in plain)),
        np.log1p(sum(h[2] == 0 for h in plain)),
        np.log1p(sum(h[2] == 1 for h in plain)),
        np.log1p(sum(h[2] == 2 for h in plain)),
        np.log1p(sum(h[1] for _, h in hits) - weight if any(in_quotes) else 0.0),
        weight / (10 + len(words)),
        np.log1p(len(words)),
    ]


def lexicon_of(toxic: dict[str, int], other: dict[str, int], n_toxic: int, n_other: int) -> Lexicon:
    chosen: list[tuple[str, Entry]] = []
    seen = [(term, a, other.get(term, 0)) for term, a in toxic.items() if a >= LEAST_DOCS]
    least = max(LEAST_Z, NormalDist().inv_cdf(1 - CHANCE_TERMS / max(len(seen), 2 * CHANCE_TERMS)))
    for term, a, c in seen:
        weight = float(np.log((a + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_other + 1)))
        z = weight / float(np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)))
        if weight > 1 and z >= least:
            chosen.append((term, Entry(z, weight)))
    chosen.sort(key=lambda x: (-x[1].z, x[0]))
    starts = {t[1:]: e for t, e in chosen if t[0] == "^"}

    def covered(word: str, entry: Entry) -> bool:
        """Whether the beginning that would be hit instead says as much."""
        best = max((e for n in BEGINNINGS if len(word) > n and (e := starts.get(word[:n]))), key=lambda e: e.z, default=None)
        return best is not None and best.z > entry.z and best.weight >= entry.weight

    words = {t: e for t, e in chosen if t[0] != "^"}
    entries = [(t, e) for t, e in chosen if t[0] == "^" or not covered(t, e)]
    return Lexicon({t: e for t, e in entries if t[0] != "^"}, {t[1:]: e for t, e in entries if t[0] == "^"}, words)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, keep = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    beta: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        x = measure_all(texts, self.lexicon)
        return 1 / (1 + np.exp(-np.clip(x @ self.beta[:-1] + self.beta[-1], -30, 30)))


def _term_counts(taught: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """Documents per half and term; only terms in ``among`` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                found: tuple[Counter, Counter] = (Counter(), Counter())
                for half, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    found[half].update(terms(text) if among is None else terms(text) & among)
                for half, counts in enumerate(found):
                    pairs = iter(counts.items())
                    while some := list(islice(pairs, 50_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([half] * len(some), pa.int32()), pa.array([t for t, _ in some]), pa.array([n for _, n in some], pa.int64())], names=["half", "term", "n"])

    counted = map_batches(taught, run, "half int, term string, n long")
    return counted.groupBy("term").agg(*(F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """``learn``: the rows of ``labels`` that may teach.  What reaches the driver are numbers and terms of ``sample_rows`` documents."""
    sample = label_sample(labels, label, learn, sample_rows, id_col)
    taught = docs.select(F.col(f"`{id_col}`").alias("__id"), whole_text(text_col).alias("__text")).join(F.broadcast(sample), F.col("__id") == F.col("__lid"))
    # copies count once, and in one half
    taught = written(taught.groupBy("__text").agg(F.max("__label").alias("label")).select("label", F.pmod(F.xxhash64("__text"), F.lit(2)).cast("int").alias("half"), "__text"), "taught")
    sizes = {(r["label"] == 1, r["half"]): r["n"] for r in taught.groupBy("label", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = {k: sizes.get(k, 0) for k in ((True, 0), (True, 1), (False, 0), (False, 1))}
    n_toxic, n_other = n[True, 0] + n[True, 1], n[False, 0] + n[False, 1]
    if not n_toxic or not n_other:
        share = (n_toxic + 0.5) / (n_toxic + n_other + 1)
        return ToxicityModel(Lexicon(), np.append(np.zeros(FEATURES), np.log(share / (1 - share))))
    often = _term_counts(taught.where("label = 1"), None).where(F.col("n0") + F.col("n1") >= LEAST_DOCS)
    toxic = {r["term"]: (r["n0"], r["n1"]) for r in often.collect()}
    other = {r["term"]: (r["n0"], r["n1"]) for r in _term_counts(taught.where("label <> 1"), frozenset(toxic)).collect()}
    part = lambda counts, h: {t: c[h] for t, c in counts.items()}
    whole = lambda counts: {t: sum(c) for t, c in counts.items()}
    crossed = [lexicon_of(part(toxic, 1 - h), part(other, 1 - h), n[True, 1 - h], n[False, 1 - h]) for h in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "__text"):
                labels, halves, texts = (c.to_pylist() for c in some.columns)
                for half, lexicon in enumerate(crossed):
                    own = [i for i, h in enumerate(halves) if h == half]
                    x = measure_all([texts[i] for i in own], lexicon)
                    yield pa.RecordBatch.from_arrays([pa.array([labels[i] for i in own], pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"])

    rows = sorted((tuple(r["x"]), r["label"]) for r in map_batches(taught, run, "label int, x array<double>").collect())
    beta = fit_logistic(np.array([x for x, _ in rows]), np.array([float(y == 1) for _, y in rows]))
    return ToxicityModel(lexicon_of(whole(toxic), whole(other), n_toxic, n_other), beta)


def score_toxicity(df: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``score`` and ``predicted``."""

    def scored(texts: list[str]) -> list[pa.Array]:
        score = model.score(texts)
        return [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]

    return map_texts(df, {"score": T.DoubleType(), "predicted": T.IntegerType()}, lambda: scored, text_col=text_col, keep_text=keep_text)
