"""Whole-text encoding with a public tokenizer file.

Two kinds of file have a faster way than the library, which tests hold against it:

* blanks dropped (``\\s+`` becomes a space, words are matched, the rest is removed): every blank
  separates words, and normalisation (NFC, lower case by character) does not reach across blanks, so a text's ids
  are those of its chunks, one after another; in texts of Latin letters only, the chunks are the words
  themselves.  Chunks' ids are remembered in a bounded cache;
* byte-level with the usual pattern: texts of Latin letters go through tiktoken's merge loop over the same
  vocabulary, which beats remembering chunks.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

#: Cached chunks per worker, about 40 MB; as many older ones are kept until the next time it is full.
CACHE_CHUNKS = 200_000
#: How the usual byte-level pre-tokenizer splits.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def library_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task; the cluster is the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def as_bytes(ids: Sequence[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class ChunkCache:
    """chunk -> ids as little-endian unsigned 32-bit bytes, filled by ``encode`` for many chunks at once.

    Two generations: a full one becomes the older one, from which chunks return as they are met.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHE_CHUNKS):
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.encode, self.limit = encode, limit

    def learn(self, chunks: set[str]) -> None:
        missing = {c for c in chunks if c not in self.known}
        if len(self.known) + len(missing) > self.limit:
            self.older, self.known = self.known, {c: self.known[c] for c in chunks if c in self.known}
        if missing:
            self.known.update((c, self.older[c]) for c in missing if c in self.older)
            wanted = [c for c in missing if c not in self.older]
            self.known.update(zip(wanted, self.encode(wanted), strict=True))

    def join(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, chunks))


#: Outside of it a text is not plain: letters whose case and composition need no look at their neighbours, up to U+024F.
NOT_PLAIN = re.compile("[\u0130\u0250-\U0010ffff]")
#: The words of the blank-dropping pre-tokenizer, for plain texts in lower case.
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\t-\r \x85\xa0\w]|_)+")


def plain_latin(text: str) -> bool:
    return not NOT_PLAIN.search(text)


class DroppedBlanks:
    """Encoder for files whose pre-tokenizer drops blanks.

    Plain Latin texts without special strings are cut into words, others at blanks.
    """

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]], special: Iterable[str]):
        self.cache = ChunkCache(encode_chunks)
        self.special = list(special)

    def _cut(self, text: str) -> list[str]:
        if plain_latin(text) and not any(s in text for s in self.special):
            return LATIN_WORDS.findall(text.lower())
        return text.replace("\n", " ").split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self._cut(text) for text in texts]
        self.cache.learn(set().union(*split))
        return [self.cache.join(chunks) for chunks in split]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level files write bytes with: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


LETTER_OF_BYTE = {byte: letter for letter, byte in byte_letters().items()}


def in_byte_letters(word: str) -> str:
    if word.isascii() and word.isalnum():
        return word
    return word.encode().decode("latin-1").translate(LETTER_OF_BYTE)


def merge_loop(spec: dict, pattern: str):
    """tiktoken's encoder for a byte-level file whose merges rank as their ids do; None for other files."""
    import tiktoken

    model, letters = spec["model"], byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != sorted(merged) or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("dropout"):
        return None
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class ByteLevel:
    """Encoder for byte-level files: texts of Latin letters whole by the merge loop, others by the library."""

    #: What keeps a text from the merge loop: letters beyond Latin ones and usual punctuation, and the separators
    #: that only some count as blanks.
    OTHERS = re.compile("[\x1c-\x1f\u0300-\u200f\u2028-\u202f\u205f-\U0010ffff]")
    #: In texts without blank runs no look ahead is needed, which the pattern engine is slow at.
    BLANK_RUN = re.compile(r"\s\s")

    def __init__(self, path: str):
        self.library = library_tokenizer(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.any_blanks = merge_loop(spec, BYTE_LEVEL_PATTERN)
        self.single_blanks = merge_loop(spec, BYTE_LEVEL_PATTERN.replace(r"\s+(?!\S)|\s+", r"\s"))

    def _plain(self, text: str) -> bool:
        return self.any_blanks is not None and not self.OTHERS.search(text) and not any(s in text for s in self.special)

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        others = iter(self.library.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [as_bytes((self.any_blanks if self.BLANK_RUN.search(t) else self.single_blanks).encode_ordinary(t)) if p else as_bytes(next(others).ids) for t, p in zip(texts, plain, strict=True)]


def drops_blanks(path: str) -> bool:
    """Whether the file is of the kind :class:`DroppedBlanks` may be used for."""
    if not path.endswith(".json"):
        return False
    spec = json.load(open(path, encoding="utf-8"))
    norm = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"]
        and norm[1]["pattern"] == {"Regex": "\\s+"}
        and [p["type"] for p in pre] == ["Split", "ByteLevel"]
        and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True)
        and "[^\\s\\p{L}\\p{N}]+" in pre[0]["pattern"].get("Regex", "")
        and not pre[1]["add_prefix_space"]
        and not spec.get("post_processor")
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    )


def byte_level(path: str) -> bool:
    """Whether the file is of the kind :class:`ByteLevel` may be used for."""
    if not path.endswith(".json"):
        return False
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])


class WholeTexts:
    """Encoder for any other file: the library on whole texts."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            library = library_tokenizer(path)
            self.encode = lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [as_bytes(ids) for ids in self.encode(texts)]


@lru_cache(maxsize=4)
def library_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """The fastest right encoder for the file; one per worker process."""
    if drops_blanks(path):
        library = library_tokenizer(path)
        special = [t.content for t in library.get_added_tokens_decoder().values()]
        return DroppedBlanks(lambda chunks: [as_bytes(e.ids) for e in library.encode_batch(chunks, add_special_tokens=False)], special)
    return ByteLevel(path) if byte_level(path) else WholeTexts(path)
