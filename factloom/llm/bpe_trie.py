"""BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words go into a trie of symbols.  A depth-first walk hands down the state of each prefix on
its path: the last token ``t`` of its encoding and where that starts.  ``t`` fits if BPE leaves the border
between the last token of the prefix before it and ``t`` alone.  Exactly one token fits, so a prefix that
many words share is encoded once and no merge loop is run.  A prefix gets its state when a longer one first
asks for it; an encoding is read off by going from last token to last token.

Defined results
---------------
* null text counts as empty: no ids, decoded text ``""``;
* special strings inside a text become their ids, as the library does by default;
* repeated rows, ties, null ids: every row is encoded by itself; an empty table gives an empty result;
* very long texts: encoded whole, one slice of rows at a time; words of any length are walked without recursion;
* input columns named ``ids``, ``n_tokens`` or ``decoded`` are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, map_texts, numbered, slices
from .tokenizing import LATIN_WORDS, DroppedBlanks, as_bytes, drops_blanks, in_byte_letters, library_tokenizer, plain_latin

#: Words beyond this many letters are walked prefix by prefix; in shorter ones a prefix asks for those before it.
DEEP = 64
ADDED = {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.StringType()}


class TrieBpe:
    """Encodes words, given in the vocabulary's byte letters, by a walk over their trie."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str = ""):
        self.vocab, self.word_end = vocab, word_end
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # id -> rank of its merge, left id, right id
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = rank
            if whole in self.parts:
                raise ValueError("a token with two merges has no single last-token state")
            self.parts[whole] = rank, left, right
        self.longest = max(len(t.removesuffix(word_end)) if word_end else len(t) for t in vocab)
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def border(self, a: int, b: int, before: float) -> bool:
        """Whether no merge of a rank below ``before`` crosses the border of ``a`` and ``b``.

        Goes back in time: undoes the later of the two pieces that touch the border.  Equal
        ranks merge from the left, so a piece right of the border loses against its own rank.
        """
        while True:
            if self.rank.get((a, b), before) < before:
                return False
            made_a, made_b = self.parts.get(a), self.parts.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                before, _, a = made_a
            else:
                before, b = made_b[0] + 1, made_b[1]

    def follows(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            known = self.fits[a, b] = self.border(a, b, float("inf"))
        return known

    def is_whole(self, t: int) -> bool:
        """Whether BPE makes the token's own letters into this one token."""
        if t not in self.whole:
            made = self.parts.get(t)
            self.whole[t] = made is None or (self.is_whole(made[1]) and self.is_whole(made[2]) and self.border(made[1], made[2], made[0]))
        return self.whole[t]

    def encode(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        trie: dict = {}
        for word in words:
            node = trie
            for letter in word[:-1]:
                node = node.setdefault(letter, {})
            node.setdefault("", {})[word[-1:]] = word  # under "": words that end here
        found: dict[str, tuple[int, ...]] = {}
        # of each prefix of the current path: its last token (-1: no longer prefix has asked yet) and where that starts
        last, begin = ([0] * (max(map(len, words), default=0) + 1) for _ in range(2))
        stack = [(trie, 0)]
        while stack:
            node, depth = stack.pop()
            last[depth] = -1
            for letter, child in node.items():
                if letter:
                    stack.append((child, depth + 1))
                else:
                    for word in child.values():
                        found[word] = self._ids(word, last, begin)
        return found

    def _ids(self, word: str, last: list[int], begin: list[int]) -> tuple[int, ...]:
        if not word:
            return ()
        if len(word) > DEEP:
            for length in range(1, len(word)):
                if last[length] < 0:
                    last[length], begin[length] = self._last(word, length, length, last, begin)
        whole = word + self.word_end
        token, at = self._last(whole, len(word), len(whole), last, begin)
        ids = [token]
        while at:
            ids.append(last[at])
            at = begin[at]
        return tuple(reversed(ids))

    def _last(self, path: str, length: int, stop: int, last: list[int], begin: list[int]) -> tuple[int, int]:
        """The last token of ``path[:stop]``, which has ``length`` letters, and where it starts."""
        get = self.vocab.get
        for start in range(max(0, length - self.longest), length):
            token = get(path[start:stop])
            if token is not None:
                if not start:
                    if self.is_whole(token):
                        return token, 0
                    continue
                if last[start] < 0:
                    last[start], begin[start] = self._last(path, start, start, last, begin)
                if self.follows(last[start], token):
                    return token, start
        raise ValueError(f"no encoding for {path[:stop]!r}")


class BpeCodec:
    """A tokenizer file of the blank-dropping kind: encodes texts, decodes ids."""

    def __init__(self, path: str):
        if not drops_blanks(path):
            raise ValueError(f"{path}: not a BPE file that drops blanks")
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if spec.get("decoder") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not supported")
        self.trie = TrieBpe(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = library_tokenizer(path)
        self.normalize, self.words_of = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        names = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.encode_texts = DroppedBlanks(self._encode_chunks, self.special)

    def _pieces(self, chunk: str) -> list[str | int]:
        """Words in byte letters, and ids of special strings."""
        if plain_latin(chunk) and "<" not in chunk:
            return [in_byte_letters(word) for word in LATIN_WORDS.findall(chunk.lower())]
        if self.at_special and self.at_special.search(chunk):
            return [x for part in self.at_special.split(chunk) if part for x in ([self.special[part]] if part in self.special else self._pieces(part))]
        return [word for word, _ in self.words_of(self.normalize(chunk))]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        pieces = [self._pieces(c) for c in chunks]
        known = self.trie.encode({w for words in pieces for w in words if isinstance(w, str)})
        return [as_bytes([i for w in words for i in ((w,) if isinstance(w, int) else known[w])]) for words in pieces]

    def decode(self, ids: bytes) -> str:
        """Without a decoder the library joins the tokens with spaces."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def bpe_encode(df: DataFrame, tokenizer_path: str, *, text_col: str = "text", decode: bool = False, keep_text: bool = True) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and, if asked for, ``decoded``."""

    def worker() -> Callable[[list[str]], list[pa.Array]]:
        own = codec(tokenizer_path)

        def coded(texts: list[str]) -> list[pa.Array]:
            ids = own.encode_texts(texts)
            decoded = [pa.array(map(own.decode, ids), pa.string())] if decode else []
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *decoded]

        return coded

    return map_texts(df, {k: v for k, v in ADDED.items() if decode or k != "decoded"}, worker, text_col=text_col, keep_text=keep_text)


def bpe_decode(df: DataFrame, tokenizer_path: str, *, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of ``ids_col`` (null: empty)."""
    own = numbered(df)
    kept = own.without(["decoded"])
    at = kept.index(own.inner_name(ids_col))
    source = own.inner.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(tokenizer_path)
        for batch in batches:
            for part in slices(batch, kept[at]):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([worker.decode(x or b"") for x in part.column(at).to_pylist()], pa.string())], names=[*kept, "decoded"])

    decoded = map_batches(source, run, T.StructType([*source.schema, T.StructField("decoded", T.StringType())]))
    return own.restored(decoded, kept, decoded=F.col("decoded"))
