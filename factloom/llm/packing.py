"""Harmonic packing of token sequences.

Every worker fills bins by itself.  Documents of at most one sequence are put into classes by reciprocal capacity:
class k holds lengths in (capacity/(k+1), capacity/k] and fills its bins with k documents, uncut; those
shorter than capacity/(``LAST_CLASS`` + 1) share one bin, which takes what fits.  What a full bin leaves open
is filled by documents longer than a sequence, which have to be cut anyway: they stand in a short
reserve, and what overflows it becomes whole sequences.  Where no such document is at hand a bin waits; once
``WAITING`` bins do, the next documents fill their gaps, whole where one fits, else cut.  At the end of a
task the emptiest waiting bins and the unfilled ones fill the others, and a last remainder is cut into
sequences of falling powers of two, which are not padded.

Workers share nothing; a lost task is rerun on the same rows and gives the same sequences, whose
ids carry the number of the partition.

Defined results
---------------
* null or empty text: the end id alone, one piece of length 1;
* very long texts: as many pieces as it takes; no more than one document's ids beyond the reserve are held;
* repeated rows, null ids: each row is packed as a document of its own;
* documents of equal length: in the order the rows are read;
* empty table: empty result; other input columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, map_batches, slices, whole_text
from .tokenizing import library_encoder

#: Shorter documents than those of this class share one bin.
LAST_CLASS = 32
#: Full bins that wait for a filling, and sequences held in reserve, at most.
WAITING, RESERVE = 64, 16


class Piece(NamedTuple):
    """``length`` ids of a document from ``start`` on."""

    doc: object
    ids: bytes
    start: int
    length: int

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return self._replace(length=length), self._replace(start=self.start + length, length=self.length - length)


def taken(rest: deque[Piece], length: int) -> list[Piece]:
    """Pieces of that length together, or all there are, off the front of ``rest``."""
    found = []
    while rest and length:
        piece = rest.popleft()
        if piece.length > length:
            piece, left = piece.cut(length)
            rest.appendleft(left)
        length -= piece.length
        found.append(piece)
    return found


def size_of(pieces: Iterable[Piece]) -> int:
    return sum(p.length for p in pieces)


class Bins:
    """The bins of one worker; what is handed out are sequences, lists of pieces."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[Piece]] = defaultdict(list)
        self.waiting: list[tuple[int, int, list[Piece]]] = []  # gap, number, pieces; by gap
        self.reserve: deque[Piece] = deque()
        self.reserved = self.numbered = self.shared = 0

    def _wait(self, pieces: list[Piece], gap: int) -> None:
        self.numbered += 1
        insort(self.waiting, (gap, self.numbered, pieces))

    def _full(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """A bin that holds its documents: its gap is filled from the reserve, or it waits."""
        gap = self.capacity - size_of(pieces)
        filling = taken(self.reserve, gap)
        self.reserved -= size_of(filling)
        gap -= size_of(filling)
        if gap:
            self._wait(pieces + filling, gap)
        else:
            yield pieces + filling

    def _fill(self, piece: Piece) -> Iterator[list[Piece]]:
        """Fills waiting bins, those with small gaps first, with a document that is cut for it."""
        rest = deque([piece])
        while rest and self.waiting:
            gap, _, pieces = self.waiting.pop(0)
            filling = taken(rest, gap)
            gap -= size_of(filling)
            if gap:
                self._wait(pieces + filling, gap)
            else:
                yield pieces + filling
        self.reserve.extend(rest)
        self.reserved += size_of(rest)
        while self.reserved > RESERVE * self.capacity:
            self.reserved -= self.capacity
            yield taken(self.reserve, self.capacity)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        k = self.capacity // piece.length
        if not k:
            yield from self._fill(piece)
        elif len(self.waiting) >= WAITING:
            at = bisect_left(self.waiting, (piece.length,))
            if at < len(self.waiting):
                gap, _, pieces = self.waiting.pop(at)
                yield from self._full([*pieces, piece])
            else:
                yield from self._fill(piece)
        elif k <= LAST_CLASS:
            self.open[k].append(piece)
            if len(self.open[k]) == k:
                yield from self._full(self.open.pop(k))
        else:
            if self.shared + piece.length > self.capacity:
                yield from self._full(self.open.pop(0))
                self.shared = 0
            self.open[0].append(piece)
            self.shared += piece.length

    def close(self) -> Iterator[list[Piece]]:
        rest = self.reserve
        for k in sorted(self.open):
            rest.extend(self.open[k])
        while self.waiting:
            if not rest:
                rest.extend(self.waiting.pop()[2])  # the emptiest
                continue
            gap, _, pieces = self.waiting.pop(0)
            filling = taken(rest, gap)
            if size_of(filling) < gap:
                self._wait(pieces + filling, gap - size_of(filling))
            else:
                yield pieces + filling
        left, size = size_of(rest), self.capacity
        while left:
            while size > left:
                size //= 2
            yield taken(rest, size)
            left -= size


def pack(df: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", emit_ids: bool = True) -> DataFrame:
    """One row per piece; ``ids`` (little-endian unsigned 32-bit) too if ``emit_ids``.

    ``capacity`` is a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity is a power of two")
    source = df.select(F.col(f"`{id_col}`").alias("__id"), whole_text(text_col).alias("__text"))
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, source.schema["__id"].dataType), *(T.StructField(n, T.LongType()) for n in numbers), *([T.StructField("ids", T.BinaryType())] if emit_ids else [])])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path)
        bins = Bins(capacity)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def place(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, ids, start, length in pieces:
                own = ids[4 * start : 4 * (start + length)]
                rows.append((doc, start, length, zlib.crc32(own), len(ids) // 4, sequence, offset, own if emit_ids else b""))
                offset += length
            sequence += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[: len(schema)], types, strict=False)], names=schema.names)

        types = [pa.int64()] * 7 + [pa.binary()]
        for batch in batches:
            types[0] = batch.schema.field("__id").type
            for part in slices(batch, "__text"):
                for doc, ids in zip(column(part, "__id"), encoder(column(part, "__text")), strict=True):
                    ids += end
                    for full in bins.add(Piece(doc, ids, 0, len(ids) // 4)):
                        place(full)
                if rows:
                    yield out()
        for pieces in bins.close():
            place(pieces)
        if rows:
            yield out()

    return map_batches(source, run, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
