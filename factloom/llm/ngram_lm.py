"""Interpolated modified Kneser-Ney model of order two, counted over the whole training corpus.

Files, all in the shared folder and memory-mapped by the workers:

* vocabulary shards: sorted 64-bit word hashes with their counts; shard = top of the hash range,
  a word's id is its rank over all shards;
* n-gram shards: sorted keys ``context id * size + word id`` with counts;
* per vocabulary shard, for its ids: continuation counts, and as contexts their total and how
  many words follow them once, twice, more often.

Counting runs in three passes of the same shape: workers count locally, send sorted, packed runs to
shards, and a shard's task merges and writes its file.  N-gram shards are cut by the mass of
(context, word) expected from the word counts, so the followers of a word that makes up a third
of all tokens spread over a third of the shards; words are hashed evenly.  Files are written under
a temporary name and renamed, and the same task always writes the same bytes: reruns are harmless.
Nothing is pruned.  The driver sees one row per shard.

Runs number blocks times shards, so each is kept to its arrays and some bytes.  Order two is what fits the disk budget;
the README gives the figures.

Defined results
---------------
* null or empty text: one token, the end;
* null id: a training row; repeated rows count, and are scored, each by itself;
* very long texts: counted and scored whole, in a block of their own if need be; words of any length are hashed;
* ties: none matter, counts are sums; two words of equal 64-bit hash would count as one;
* no training rows: every probability is uniform, ``base_score`` and ``score`` are 0;
* empty table: empty result; input columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import io
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fixed_share, map_batches, scratch_path, ship, slices, whole_text, written

#: No word holds blanks, so these stand for nothing else.
BEGIN, END = b"\n\n", b"\n"
#: Tokens a worker counts or scores at a time.
BLOCK = 1_500_000
#: Bytes of text per vocabulary shard and tokens per n-gram shard.
VOCAB_BYTES, SHARD_TOKENS = 64 << 20, 2_000_000
#: Files a worker keeps mapped; each holds a file handle.
MAPS = 512


# --- files -------------------------------------------------------------------------------------


def _local(folder: str) -> str | None:
    parts = urlparse(folder)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def save(folder: str, name: str, array: np.ndarray) -> None:
    held = io.BytesIO()
    np.save(held, array)
    if base := _local(folder):
        os.makedirs(base, exist_ok=True)
        with open(part := f"{base}/.{name}-{uuid.uuid4().hex}", "wb") as f:
            f.write(held.getbuffer())
        os.replace(part, f"{base}/{name}.npy")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(part := f"{path}/.{name}-{uuid.uuid4().hex}") as f:
        f.write(held.getbuffer())
    store.move(part, f"{path}/{name}.npy")


@lru_cache(maxsize=MAPS)
def mapped(folder: str, name: str) -> np.ndarray:
    """The array, memory-mapped; one in a remote store by way of an unlinked local copy."""
    if base := _local(folder):
        return np.load(f"{base}/{name}.npy", mmap_mode="r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy:
        with store.open_input_stream(f"{path}/{name}.npy") as f:
            while block := f.read(8 << 20):
                copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")


# --- tokens ------------------------------------------------------------------------------------


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = new = len(self)
        return new


@dataclass
class Block:
    """Texts as local ids: begin, words, end, one text after another."""

    ids: _Ids = field(default_factory=lambda: _Ids({BEGIN: 0, END: 1}))
    tokens: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, text: bytes) -> None:
        words = text.lower().split()
        line = np.empty(len(words) + 2, np.int64)
        line[0], line[-1] = 0, 1
        line[1:-1] = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        self.tokens.append(line)
        self.size += len(line)

    def stream(self) -> np.ndarray:
        return np.concatenate(self.tokens)

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh64_intdigest, self.ids, repeat(0)), np.uint64, len(self.ids))


def blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[Block, list[pa.RecordBatch]]]:
    block, rows = Block(), []
    for batch in batches:
        for part in slices(batch, batch.schema.names[text_at]):
            for text in part.column(text_at).to_pylist():
                block.add(text)
            rows.append(part)
            if block.size >= BLOCK:
                yield block, rows
                block, rows = Block(), []
    if rows:
        yield block, rows


# --- model -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Where the files are, and the few numbers that hold for all of them."""

    folder: str
    starts: tuple[int, ...] = ()  # first id of each vocabulary shard, and the end
    masses: tuple[int, ...] = ()  # tokens as contexts before each vocabulary shard, and all
    firsts: tuple[int, ...] = ()  # first key of each n-gram shard
    shards: tuple[int, ...] = ()
    tokens: int = 0
    words: int = 0
    texts: int = 0
    discounts: tuple[float, ...] = (0.5, 1.0, 1.5)
    lower_discounts: tuple[float, ...] = (0.5, 1.0, 1.5)
    lower_total: int = 0
    lower_classes: tuple[int, ...] = (0, 0, 0)

    @property
    def size(self) -> int:
        return self.starts[-1] if self.starts else 0

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(max(1, len(self.starts) - 1)) >> np.uint64(32)).astype(np.int64)

    def gather(self, hashes: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Ids of the hashes, -1 if unknown, and for known ones what the named files hold (else 0)."""
        ids = np.full(len(hashes), -1, np.int64)
        values = [np.zeros(len(hashes), np.int64) for _ in names]
        if self.size == 0:
            return [ids, *values]
        order = np.argsort(hashes)
        in_order = hashes[order]
        cuts = np.searchsorted(self.shard_of(in_order), np.arange(len(self.starts)))
        for shard, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            known = mapped(self.folder, f"vocab-{shard}") if high > low and self.starts[shard + 1] > self.starts[shard] else ()
            if len(known):
                at = np.searchsorted(known, in_order[low:high])
                hit = known[np.minimum(at, len(known) - 1)] == in_order[low:high]
                rows, at = order[low:high][hit], at[hit]
                ids[rows] = at + self.starts[shard]
                for name, value in zip(names, values, strict=True):
                    value[rows] = mapped(self.folder, f"{name}-{shard}")[at]
        return [ids, *values]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted n-gram keys, 0 if unseen."""
        counts = np.zeros(len(keys), np.int64)
        cuts = np.append(np.searchsorted(keys, np.array(self.firsts, np.uint64)), len(keys))
        for shard, low, high in zip(self.shards, cuts[:-1], cuts[1:], strict=True):
            if high > low:
                known = mapped(self.folder, f"pairs-{shard}")
                at = np.minimum(np.searchsorted(known, keys[low:high]), len(known) - 1)
                counts[low:high] = np.where(known[at] == keys[low:high], mapped(self.folder, f"counts-{shard}")[at], 0)
        return counts


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    least = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.05), k) if a else k / 2
    return least(1, n1, n2), least(2, n2, n3), least(3, n3, n4)


def _classes(values: np.ndarray) -> list[int]:
    return [int((values == k).sum()) for k in (1, 2, 3, 4)]


_KINDS = [np.dtype(x) for x in ("<u4", "<u8", "<i8")]


def _packed(*arrays: np.ndarray) -> bytes:
    """The arrays one after another, behind their number, kinds and lengths: nine bytes an array and one in all."""
    arrays = tuple(x.astype("<i8") if x.dtype not in _KINDS else x for x in arrays)
    head = bytes([len(arrays)]) + b"".join(struct.pack("<BQ", _KINDS.index(x.dtype), len(x)) for x in arrays)
    return head + b"".join(x.tobytes() for x in arrays)


def _unpacked(data: bytes) -> list[np.ndarray]:
    parts = [struct.unpack_from("<BQ", data, 1 + 9 * i) for i in range(data[0])]
    at, found = 1 + 9 * data[0], []
    for kind, length in parts:
        found.append(np.frombuffer(data, _KINDS[kind], length, at))
        at += length * _KINDS[kind].itemsize
    return found


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and sums of the values for each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v[:0] for v in values)


def _narrow(values: np.ndarray, top: int) -> np.ndarray:
    return values.astype(np.uint32 if top < 1 << 32 else np.uint64)


RUN = "shard int, data binary"


def _vocabulary(train: DataFrame, folder: str, n_shards: int) -> list:
    """Writes the vocabulary shards; per shard: words, tokens, texts."""
    frame = Model(folder, starts=tuple(range(n_shards + 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in blocks(batches, 0):
            counts = np.bincount(block.stream(), minlength=len(block.ids))
            hashes, counts = _summed(block.hashes(), counts)
            shards = frame.shard_of(hashes)
            cuts = np.searchsorted(shards, np.arange(n_shards + 1))
            runs = [(i, _packed(hashes[a:b], counts[a:b].astype(np.uint32))) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array([r[1] for r in runs], pa.binary())], names=["shard", "data"])

    begin = Block().hashes()[0]

    def merge(key: tuple, runs: pa.Table) -> pa.Table:
        parts = [_unpacked(d) for d in runs.column("data").to_pylist()]
        hashes, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
        opens = hashes == begin
        texts = int(counts[opens].sum())
        shard = key[0].as_py()
        save(folder, f"vocab-{shard}", hashes)
        save(folder, f"mass-{shard}", np.cumsum(counts) - counts)
        save(folder, f"held-{shard}", counts)
        save(folder, f"count-{shard}", np.where(opens, 0, counts))
        return pa.table({"shard": pa.array([shard], pa.int32()), "size": [len(hashes)], "mass": [int(counts.sum())], "texts": [texts]})

    return map_batches(train, count, RUN).groupBy("shard").applyInArrow(merge, "shard int, size long, mass long, texts long").collect()


def _pairs(train: DataFrame, model: Model, n_shards: int) -> DataFrame:
    """Writes the n-gram shards; rows: per n-gram shard its first key and classes, and runs for vocabulary shards."""
    size, mass, starts = np.uint64(model.size), model.masses[-1], np.array(model.starts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in blocks(batches, 0):
            hashes, stream = block.hashes(), block.stream()
            ids, before, held = model.gather(hashes, ("mass", "held"))
            before = before + np.array(model.masses)[model.shard_of(hashes)]
            left, right = stream[:-1], stream[1:]
            local, counts = np.unique((left * len(hashes) + right)[right != 0], return_counts=True)
            left, right = local // len(hashes), local % len(hashes)
            # where the pair lies, by the mass of contexts and then of words; rises with the key
            place = (before[left] + held[left] * (before[right] / mass)) / mass
            shard = np.minimum((place * n_shards).astype(np.int64), n_shards - 1)
            order = np.lexsort((ids[right], ids[left]))
            contexts, words, counts, shard = ids[left][order], ids[right][order], counts[order], shard[order]
            cuts = np.searchsorted(shard, np.arange(n_shards + 1))
            runs = []
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    own, lengths = np.unique(contexts[a:b], return_counts=True)
                    many = np.flatnonzero(counts[a:b] > 1)
                    runs.append((i, _packed(_narrow(own, int(size)), lengths.astype(np.uint32), _narrow(words[a:b], int(size)), many.astype(np.uint32), counts[a:b][many].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array([r[1] for r in runs], pa.binary())], names=["shard", "data"])

    def merge(key: tuple, runs: pa.Table) -> pa.Table:
        keys, counts = [], []
        for data in runs.column("data").to_pylist():
            own, lengths, words, many, more = _unpacked(data)
            keys.append(np.repeat(own.astype(np.uint64), lengths) * size + words.astype(np.uint64))
            ones = np.ones(len(words), np.int64)
            ones[many] = more
            counts.append(ones)
        pairs, counts = _summed(np.concatenate(keys), np.concatenate(counts))
        shard = key[0].as_py()
        save(model.folder, f"pairs-{shard}", pairs)
        save(model.folder, f"counts-{shard}", counts.astype(np.uint32) if counts.max() < 1 << 32 else counts)
        contexts, words = (pairs // size).astype(np.int64), (pairs % size).astype(np.int64)
        stats = _summed(contexts, counts, *((c).astype(np.int64) for c in (counts == 1, counts == 2, counts > 2)))
        follows = _summed(words, np.ones(len(words), np.int64))
        out = [(-1 - shard, None, int(pairs[0]) - (1 << 63), _classes(counts))]
        for kind, arrays in ((0, stats), (1, follows)):
            cuts = np.searchsorted(arrays[0], starts)
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    out.append((i, _packed(np.array([kind]), *(_narrow(x[a:b], max(int(size), int(x[a:b].max()) + 1)) for x in arrays)), None, None))
        columns = list(zip(*out, strict=True))
        return pa.table({"shard": pa.array(columns[0], pa.int32()), "data": pa.array(columns[1], pa.binary()), "first": pa.array(columns[2], pa.int64()), "classes": pa.array(columns[3], pa.list_(pa.int64()))})

    return map_batches(train, count, RUN).groupBy("shard").applyInArrow(merge, "shard int, data binary, first long, classes array<long>")


def _lower(runs: DataFrame, model: Model) -> list:
    """Writes, per vocabulary shard, what the n-grams say about its words; per shard: total and classes."""

    def merge(key: tuple, found: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        low, size = model.starts[shard], model.starts[shard + 1] - model.starts[shard]
        total, once, twice, more, follows = (np.zeros(size, np.int64) for _ in range(5))
        for data in found.column("data").to_pylist():
            kind, at, *values = _unpacked(data)
            for into, value in zip((follows,) if kind[0] else (total, once, twice, more), values, strict=True):
                into[at.astype(np.int64) - low] += value.astype(np.int64)
        for name, array in (("total", total), ("once", once), ("twice", twice), ("more", more), ("follows", follows)):
            save(model.folder, f"{name}-{shard}", array)
        return pa.table({"total": [int(follows.sum())], "classes": pa.array([[*_classes(follows), int((follows > 2).sum())]], pa.list_(pa.int64()))})

    return runs.groupBy("shard").applyInArrow(merge, "total long, classes array<long>").collect()


def train_lm(docs: DataFrame, *, text_col: str = "text", folder: str | None = None) -> Model:
    """Counts all of ``docs`` and writes the model's files."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "ngram-lm")
    train = docs.select(whole_text(text_col).cast("binary").alias("text"))
    n_bytes = train.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if not n_bytes[1]:
        return Model(folder)
    n_vocab = 1 + (n_bytes[0] or 0) // VOCAB_BYTES
    rows = {r["shard"]: r for r in _vocabulary(train, folder, n_vocab)}
    sizes = [rows[i]["size"] if i in rows else 0 for i in range(n_vocab)]
    masses = [rows[i]["mass"] if i in rows else 0 for i in range(n_vocab)]
    texts = sum(r["texts"] for r in rows.values())
    sums = lambda x: tuple(int(v) for v in np.concatenate([[0], np.cumsum(x)]))
    model = Model(folder, starts=sums(sizes), masses=sums(masses), texts=texts, tokens=sum(masses) - texts, words=sum(sizes) - 1)
    if model.size >= 1 << 32:
        raise ValueError(f"{model.size} distinct words: a pair of word ids no longer fits 64 bits")
    found = written(_pairs(train, model, 1 + sum(masses) // SHARD_TOKENS), "ngram-runs")
    shards = sorted(((r["first"] + (1 << 63), -1 - r["shard"], r["classes"]) for r in found.where("shard < 0").select("shard", "first", "classes").collect()))
    below = _lower(found.where("shard >= 0").select("shard", "data"), model)
    classes = [sum(r["classes"][k] for r in below) for k in range(5)]
    return Model(
        **{k: getattr(model, k) for k in ("folder", "starts", "masses", "tokens", "words", "texts")},
        firsts=tuple(s[0] for s in shards),
        shards=tuple(s[1] for s in shards),
        discounts=discounts_of([sum(s[2][k] for s in shards) for k in range(4)]),
        lower_discounts=discounts_of(classes[:4]),
        lower_total=sum(r["total"] for r in below),
        lower_classes=(classes[0], classes[1], classes[4]),
    )


def _discounted(counts: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return counts - np.array([0.0, *d])[np.minimum(counts, 3)]


def score_block(model: Model, block: Block) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base score, score."""
    stream = block.stream()
    ids, count, total, once, twice, more, follows = model.gather(block.hashes(), ("count", "total", "once", "twice", "more", "follows"))
    uniform = 1.0 / (model.words + 1)
    if model.lower_total:
        spare = sum(d * n for d, n in zip(model.lower_discounts, model.lower_classes, strict=True)) / model.lower_total
        lower = _discounted(follows, model.lower_discounts) / model.lower_total + spare * uniform
    else:
        lower = np.full(len(ids), uniform)
    d1, d2, d3 = model.discounts
    weight = np.where(total > 0, (d1 * once + d2 * twice + d3 * more) / np.maximum(total, 1), 1.0)
    starts = np.flatnonzero(stream == 0)
    right = stream != 0
    pair = np.flatnonzero(right)
    left_id, right_id = stream[pair - 1], stream[pair]
    local, back = np.unique(left_id * len(ids) + right_id, return_inverse=True)
    a, b = local // len(ids), local % len(ids)
    seen = np.flatnonzero((ids[a] >= 0) & (ids[b] >= 0))
    keys = ids[a[seen]].astype(np.uint64) * np.uint64(max(model.size, 1)) + ids[b[seen]].astype(np.uint64)
    order = np.argsort(keys)
    counts = np.zeros(len(local), np.int64)
    if len(model.shards):
        counts[seen[order]] = model.pair_counts(keys[order])
    p = np.where(counts > 0, _discounted(counts, model.discounts) / np.maximum(total[a], 1), 0.0) + weight[a] * lower[b]
    per_token = np.zeros(len(stream))
    per_token[pair] = np.log10(p)[back]
    base = np.log10((count + 1) / (model.tokens + model.words + 1))[stream]
    base[starts] = 0.0
    known = (count > 0)[stream] & right
    return tuple(np.add.reduceat(x, starts) for x in (right.astype(np.int64), known.astype(np.int64), base, per_token))


def score_lm(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_tokens``, ``n_known``, ``base_score``, ``score`` and ``perplexity``."""
    source = df.select(F.col(f"`{id_col}`").alias("__id"), whole_text(text_col).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches, 1):
            tokens, known, base, score = score_block(model, block)
            ids = pa.concat_arrays([r.column(0) for r in rows])
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (tokens, known, base, score, 10 ** np.minimum(-score / tokens, 300)))], names=["__id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    kind = T.StructType([T.StructField("__id", source.schema["__id"].dataType), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "perplexity"))])
    return map_batches(source, run, kind).withColumnRenamed("__id", id_col)


def in_training(id_col: Column, modulus: int = 7, held_out: int = 2) -> Column:
    return fixed_share(id_col, modulus) != held_out
