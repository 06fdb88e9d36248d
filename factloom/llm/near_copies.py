"""SimHash near-dedup in a segment-popcount embedding at the similarity of near copies: a far wider radius than op6's two bits.

Documents of equal shingle sets are one node, and nodes are linked if the Jaccard similarity of their sets reaches
``similarity``.  A node has ``WORDS`` SimHash fingerprints of its set, each of its shingles hashed anew for every one; two sets
of similarity J differ in about arccos(2J / (1 + J)) / pi of the bits, 15 % at 0.8.  Each fingerprint is
embedded as in ``simhash``: bit counts of its two-bit segments, in unary.

Grid range-join: a band is some of the segments, a cell all nodes of equal counts there.  A band takes so many
segments that a cell holds ``middle`` nodes in the mean, and there are so many bands that a pair at the similarity misses all
of them in ``LOSS`` of the cases, by calculation; a closer one more surely.  Within a cell, ordered by the size of the
sets, a node meets those whose size can reach the similarity; there the Manhattan bound over half of the fingerprints, then the exact Hamming distance over all
decide, each at the mean and six deviations of a pair at the similarity.

Nodes that such pairs connect are a family.  A cell gives no pairs but says to which node it connects each one, so a dense
cluster costs a row a node and cell.  Then the sets decide, so nothing dissimilar is linked: each set is sent once, to
its family.  Families of at most ``small`` nodes try all pairs that are not connected yet, larger ones those that share a
shingle among the rarest that a link needs (of n shingles, n less ``similarity`` of them, and one), which loses no link.  A
family's sets are held by one task.

Sets are computed a second time, for the nodes of families: a bitmap of bounded size says which rows they are read from.

Defined results
---------------
* null text counts as empty; texts without words are copies of each other;
* fewer words than a shingle has: the whole sequence is the one shingle;
* very long texts: hashed whole; a worker holds the sets of one slice of rows;
* repeated rows (same id and text) are copies; rows that share an id but not the text, or have none, stand for themselves;
* ties: of a group the row with the least id stays (null ids last), of those with that id the least text hash;
* empty table: empty result; input columns keep their values, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmaps import bitmap, bits_for, with_marks
from .common import map_batches, numbered, slices, whole_text, written
from .components import components
from .simhash import LOW_BITS, SEED, SEGMENTS, shingle_hashes

#: Fingerprints of a node, and the share of pairs at the similarity that may miss all bands.
WORDS, LOSS = 8, 0.002
_LEAST_SEGMENTS, _ROWS, _COLUMNS = 4, 128, 2048
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Of a byte its bits, one in each byte of a 64-bit number: so 255 of them are counted by adding.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def prints_of(distinct: np.ndarray) -> np.ndarray:
    """The fingerprints of a set of hashes, the first being that of the hashes themselves."""
    count = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(distinct), 255 * 16):
        part = distinct[at : at + 255 * 16]
        mixed = np.empty((WORDS, len(part)), np.uint64)
        mixed[0] = part
        again = part[None, :] * _ODD[1:, None]
        again = (again ^ (again >> np.uint64(32))) * _ODD[:1]
        mixed[1:] = again ^ (again >> np.uint64(29))
        lanes = _SPREAD[mixed.astype("<u8", copy=False).view(np.uint8).reshape(WORDS, len(part), 8)]
        sums = np.add.reduceat(lanes, range(0, len(part), 255), axis=1)
        count += sums.view(np.uint8).reshape(WORDS, -1, 64).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * count > len(distinct), axis=1, bitorder="little").view("<u8").ravel()


def embedded(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, in unary, as ``simhash.embedding`` gives them."""
    low, up = np.uint64(LOW_BITS), prints >> np.uint64(1)
    return ((prints | up) & low) | ((prints & up & low) << np.uint64(1))


def flips(similarity: float) -> float:
    """The share of bits in which sets of that similarity differ in the mean."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def radius(similarity: float, bits: int) -> int:
    q = flips(similarity)
    return min(bits, int(np.ceil(q * bits + 6 * np.sqrt(q * (1 - q) * bits))))


def loss(similarity: float, segments: int, n_bands: int) -> float:
    """The share of pairs at the similarity that no band of so many random segments brings together."""
    q, total = flips(similarity), WORDS * SEGMENTS
    stays = (1 - q) ** 2 + q * q / 2
    equal = np.arange(total + 1)
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, total + 1)))])
    chance = np.exp(factorial[total] - factorial[equal] - factorial[total - equal] + equal * np.log(stays) + (total - equal) * np.log(max(1 - stays, 1e-300)))
    met = np.prod([np.maximum(equal - i, 0) / (total - i) for i in range(segments)], axis=0)
    return float((chance * (1 - met) ** n_bands).sum())


def grid(n_nodes: int, similarity: float, middle: int) -> np.ndarray:
    """Of each band the mask over a node's embedded fingerprints."""
    segments = _LEAST_SEGMENTS
    while n_nodes * 0.375**segments > middle:  # two random segments have equal counts in 3 of 8 cases
        segments += 1
    n_bands = 1
    while loss(similarity, segments, n_bands) > LOSS:
        n_bands += max(1, n_bands // 16)
    order, masks = np.random.default_rng(SEED), np.zeros((n_bands, WORDS), np.uint64)
    taken: list[int] = []
    for mask in masks:
        if len(taken) < segments:
            taken = order.permutation(WORDS * SEGMENTS).tolist()
        for at in taken[:segments]:
            mask[at // SEGMENTS] |= np.uint64(3 << 2 * (at % SEGMENTS))
        taken = taken[segments:]
    return masks


def node_of(distinct: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(distinct.tobytes(), SEED)


def signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """Of ``id``, ``text`` (binary) and ``th``: ``id``, ``th``, ``node`` (equal for equal sets), ``n`` shingles and ``prints``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                all_of = [shingle_hashes(t, shingle) for t in part.column(1).to_pylist()]
                sets = [np.unique(h) for h in all_of]
                nodes = np.array([node_of(h) for h in sets], np.uint64).view(np.int64)
                prints = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([prints_of(h) for h in sets]).view(np.int64)), WORDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(nodes), pa.array([len(h) for h in sets], pa.int32()), prints], names=["id", "th", "node", "n", "prints"])

    fields = [("th", T.LongType()), ("node", T.LongType()), ("n", T.IntegerType()), ("prints", T.ArrayType(T.LongType()))]
    return map_batches(rows.select("id", "text", "th"), run, T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, t) for n, t in fields)]))


def sets_of(rows: DataFrame, shingle: int) -> DataFrame:
    """Of ``text`` (binary): ``node`` and the sorted ``hashes`` of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [np.unique(shingle_hashes(t, shingle)) for t in part.column(0).to_pylist()]
                nodes = np.array([node_of(h) for h in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "hashes"])

    return map_batches(rows.select("text"), run, "node long, hashes binary")


_CELL = ["cell", "node", "n", *(f"p{i}" for i in range(WORDS))]


def cells(nodes: DataFrame, masks: np.ndarray) -> DataFrame:
    """Of ``node``, ``n`` and ``prints``: a row for each band, with the number of its ``cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step := max(1, (1 << 15) // len(masks))):
                batch = whole.slice(at, step)
                prints = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
                counts = embedded(prints)
                keys = np.empty((len(masks), len(prints)), np.uint64)
                for k, mask in enumerate(masks):
                    key = np.full(len(prints), k + 1, np.uint64)
                    for w in np.flatnonzero(mask):
                        key = (key ^ (counts[:, w] & mask[w])) * _ODD[w]
                        key ^= key >> np.uint64(29)
                    keys[k] = key
                own = [batch.column(0), batch.column(1), *(pa.array(prints[:, i].view(np.int64)) for i in range(WORDS))]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(pa.concat_arrays([v] * len(masks)) for v in own)], names=_CELL)

    return map_batches(nodes.select("node", "n", "prints"), run, "cell long, node long, n int, " + ", ".join(f"{c} long" for c in _CELL[3:]))


def merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Gives all that the pairs connect the same, least label; labels are positions, each its own label's first."""
    while True:
        a, b = label[x], label[y]
        if (a == b).all():
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (again := label[label])).any():
            label[:] = again


def neighbours(n: np.ndarray, prints: np.ndarray, similarity: float) -> np.ndarray:
    """Of a cell's nodes, ordered by ``n``: the first position that near ones connect each to."""
    half = WORDS // 2
    bits, half_bits = radius(similarity, 64 * WORDS), radius(similarity, 64 * half)
    counts, label = embedded(prints), np.arange(len(n))
    stop = np.searchsorted(similarity * n, n, "right")
    for first in range(0, len(n), _ROWS):
        rows = np.arange(first, min(first + _ROWS, len(n)))
        for at in range(first + 1, stop[rows[-1]], _COLUMNS):
            y = np.arange(at, min(at + _COLUMNS, stop[rows[-1]]))
            if (label[rows] == label[rows[0]]).all():
                y = y[label[y] != label[rows[0]]]
            if not len(y):
                continue
            apart = np.zeros((len(rows), len(y)), np.uint16)
            for i in range(half):
                apart += np.bitwise_count(counts[rows, None, i] ^ counts[None, y, i])
            i, j = np.nonzero((apart <= half_bits) & (y > rows[:, None]) & (y < stop[rows][:, None]) & (label[y] != label[rows][:, None]))
            near = np.bitwise_count(prints[rows[i]] ^ prints[y[j]]).sum(axis=1, dtype=np.int64) <= bits
            if near.any():
                merge(label, rows[i[near]], y[j[near]])
    return label


def grouped(rows: DataFrame, key: str, order: list[str], of_group: Callable[[list[pa.RecordBatch]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``of_group`` makes of all rows of each ``key`` (the first column, a number), in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                if at == end:
                    continue
                if held and keys[at] != last:
                    if found := of_group(held):
                        yield found
                    held = []
                held.append(batch.slice(at, end - at))
                last = keys[at]
        if held and (found := of_group(held)):
            yield found

    return map_batches(rows.repartition(key).sortWithinPartitions(key, *order), run, schema)


def _values(parts: list[pa.RecordBatch], at: int) -> np.ndarray:
    return np.concatenate([p.column(at).to_numpy(zero_copy_only=False) for p in parts])


def families(placed: DataFrame, similarity: float) -> DataFrame:
    """Of rows of ``cells``: pairs ``a`` and ``b`` that connect what may be that similar."""

    def of_cell(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        if sum(p.num_rows for p in parts) < 2:
            return None
        node = _values(parts, 1)
        label = neighbours(_values(parts, 2), np.stack([_values(parts, 3 + i) for i in range(WORDS)], axis=1).view(np.uint64), similarity)
        other = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[label[other]])], names=["a", "b"]) if len(other) else None

    return grouped(placed, "cell", ["n", "node"], of_cell, "a long, b long")


def linked(sets: list[np.ndarray], similarity: float, small: int) -> list[int]:
    """Of each set the first one that links lead to."""
    label = list(range(len(sets)))

    def first(i: int) -> int:
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    def meet(i: int, others: list[int]) -> None:
        for j in others:
            a, b, one, two = first(i), first(j), len(sets[i]), len(sets[j])
            if a != b and min(one, two) >= similarity * max(one, two):
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= similarity * (one + two - shared):
                    label[max(a, b)] = min(a, b)

    if len(sets) <= small:
        for i in range(len(sets)):
            meet(i, range(i))
        return [first(i) for i in range(len(sets))]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((token, often[token], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rare = place < np.repeat(sizes - np.ceil(similarity * sizes - 1e-9).astype(int) + 1, sizes)
    token, owner = token[order][rare], owner[rare]
    starts = np.searchsorted(owner, np.arange(len(sets) + 1))
    by_token = np.argsort(token, kind="stable")
    holders, bounds = owner[by_token], np.searchsorted(token[by_token], np.arange(len(often) + 1))
    for i in range(len(sets)):
        lists = [holders[bounds[t] : bounds[t + 1]] for t in token[starts[i] : starts[i + 1]] if bounds[t + 1] - bounds[t] > 1]
        if lists:
            near = np.unique(np.concatenate(lists))
            meet(i, near[near < i].tolist())
    return [first(i) for i in range(len(sets))]


def similar(texts: DataFrame, nodes: DataFrame, shingle: int, similarity: float, small: int, middle: int) -> DataFrame:
    """``node`` and ``root`` of the ``nodes`` that links connect to others."""
    edges = written(families(cells(nodes, grid(nodes.count(), similarity, middle)), similarity).distinct(), "near")
    of_nodes = components(edges)
    family = written(of_nodes.select("node", F.col("root").alias("family")).unionByName(of_nodes.select(F.col("root").alias("node"), F.col("root").alias("family")).distinct()).distinct(), "families")
    wanted = written(family.join(nodes.select("node", "at"), "node").select("at.id", "at.th"), "wanted")
    marks_bits = bits_for(wanted.count())
    own = with_marks(texts, bitmap(wanted, ["id", "th"], marks_bits), ["id", "th"], marks_bits, "wanted").where("wanted")
    held = sets_of(own, shingle).join(family, "node").select("family", "node", "hashes")

    def of_family(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        node, at = np.unique(_values(parts, 1), return_index=True)
        hashes = [v for p in parts for v in p.column(2)]
        root = np.array(linked([np.frombuffer(hashes[i].as_buffer(), "<u8") for i in at.tolist()], similarity, small))
        other = np.bincount(root, minlength=len(root))[root] > 1
        return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[root[other]])], names=["node", "root"]) if other.any() else None

    return written(grouped(held, "family", ["node"], of_family, "node long, root long"), "similar")


def near_copies(df: DataFrame, *, shingle: int = 5, similarity: float = 0.8, small: int = 32, middle: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (``id``, ``th``: the text's hash, ``node``), and by ``node`` the ``component_id`` and the row (``stays``) of the component that stays."""
    texts = df.select(F.col(f"`{id_col}`").alias("id"), whole_text(text_col).cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    rows = written(signatures(texts, shingle), "signatures")
    at = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    nodes = written(rows.groupBy("node").agg(F.min(at).alias("at"), F.first("n").alias("n"), F.first("prints").alias("prints")), "nodes")
    roots = similar(texts, nodes, shingle, similarity, small, middle)
    of_node = written(nodes.select("node", "at").join(roots, "node", "left").select("node", "at", F.coalesce("root", "node").alias("root")), "roots")
    best = written(of_node.groupBy("root").agg(F.min("at").alias("stays")), "representatives")
    return rows.select("id", "th", "node"), written(of_node.join(best, "root").select("node", F.col("stays.id").alias("component_id"), "stays"), "node-components")


def near_components(df: DataFrame, **options) -> DataFrame:
    """Per row: the id and ``component_id``, the least id that links lead to."""
    id_col = options.get("id_col", "doc_id")
    rows, found = near_copies(df, **options)
    return rows.join(found, "node").select(F.col("id").alias(id_col), "component_id")


def keep_one(df: DataFrame, **options) -> DataFrame:
    """Of each component of near copies the one row that stays, with all columns of ``df``."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    rows, found = near_copies(df, **options)
    own = numbered(df)
    source = own.inner.select("*", own.of(id_col).alias("id"), F.xxhash64(F.coalesce(own.of(text_col), F.lit("")).cast("binary")).alias("th"))
    staying = found.select(F.col("stays.id").alias("id"), F.col("stays.th").alias("th")).distinct()
    # how many rows are that id and text: one of them stays
    copies = rows.groupBy("id", "th").agg(F.count(F.lit(1)).alias("copies"))
    same = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["th"] == y["th"])
    staying = written(staying.alias("s").join(copies.alias("c"), same({k: F.col(f"s.{k}") for k in ("id", "th")}, {k: F.col(f"c.{k}") for k in ("id", "th")})).select("s.id", "s.th", "copies"), "staying")
    kept = source.alias("d").join(staying.alias("s"), same({k: F.col(f"d.{k}") for k in ("id", "th")}, {k: F.col(f"s.{k}") for k in ("id", "th")})).select("d.*", "copies")
    alone = kept.where("copies = 1").drop("copies")
    repeated = kept.where("copies > 1").groupBy("id", "th").agg(*(F.first(c).alias(c) for c in own.inner.columns)).select(*alone.columns)
    return own.restored(alone.unionByName(repeated))
