"""Harmonic packing of tokenized documents into fixed-length sequences.

Lengths are partitioned into reciprocal-capacity classes: class k holds documents longer than
capacity / (k + 1) and no longer than capacity / k, the last class all that are shorter, and a bin of class k
takes exactly k of them, whole.  Each task fills its own bins and no rows move between tasks.  What a document
is longer than the capacity is cut off in full sequences first, and its rest is a document like others.

A bin that has its k documents is still short of the capacity.  It waits, and the next document that the waiting bins
have room for together is not put into a class but cut to fill them, first come first served.  At
the end of a task the documents of unfinished bins fill what waits, then the newest waiting bins are taken apart
to fill the others; what is left is laid end to end and cut into full sequences, the last one into lengths that are
powers of two.  So no sequence holds padding,
and only fillers, long documents and the last ones of a task are cut.

Memory of a task: one Arrow batch, fewer than k documents in class k, and waiting bins whose room is together
less than one and a half sequences.

Defined results: null text is empty; an empty document is its end id alone; an empty table
gives no rows; repeated rows and equal ids are packed row by row; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

CAPACITY = 4096
END_ID = 2
#: The last class: shorter documents share its bins.
CLASSES = 64
#: Chunks that a worker remembers: about 110 MB.
CACHED_CHUNKS = 500_000
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def binary_cuts(length: int, capacity: int) -> list[int]:
    """Whole capacities, then falling powers of two."""
    cuts = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        top = 1 << (rest.bit_length() - 1)
        cuts.append(top)
        rest -= top
    return cuts


class HarmonicBins:
    """The bins of one task.

    ``add`` takes a document of any length and gives the rows (doc_id, start, length, doc_tokens, ids, sequence, offset) of
    sequences that are full by then; ``close`` gives the rest.
    """

    def __init__(self, capacity: int, first_id: int, classes: int = CLASSES):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.classes, self.next_id = capacity, classes, first_id
        self.open: dict[int, list] = {}
        #: [pieces, room] of bins that have all their documents, oldest first
        self.waiting: deque[list] = deque()
        self.room = 0

    def class_of(self, length: int) -> int:
        return min(self.capacity // length, self.classes)

    def _sequence(self, pieces: list) -> list:
        number, self.next_id = self.next_id, self.next_id + 1
        rows, offset = [], 0
        for doc, at, size, total, raw in pieces:
            rows.append((doc, at, size, total, raw[4 * at : 4 * (at + size)], number, offset))
            offset += size
        return rows

    def _fill(self, piece: tuple) -> list:
        """Cut a piece that waiting bins have room for."""
        doc, at, size, total, raw = piece
        rows: list = []
        while size:
            first = self.waiting[0]
            part = min(first[1], size)
            first[0].append((doc, at, part, total, raw))
            first[1] -= part
            self.room -= part
            at, size = at + part, size - part
            if not first[1]:
                rows += self._sequence(self.waiting.popleft()[0])
        return rows

    def add(self, doc, raw: bytes) -> list:
        total, at, rows = len(raw) // 4, 0, []
        while total - at >= self.capacity:
            rows += self._sequence([(doc, at, self.capacity, total, raw)])
            at += self.capacity
        if at == total:
            return rows
        piece = (doc, at, total - at, total, raw)
        if total - at <= self.room:
            return rows + self._fill(piece)
        k = self.class_of(total - at)
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            del self.open[k]
            room = self.capacity - sum(p[2] for p in bin_)
            if not room:
                return rows + self._sequence(bin_)
            self.waiting.append([bin_, room])
            self.room += room
        return rows

    def close(self) -> list:
        rows: list = []
        left = [piece for _, pieces in sorted(self.open.items()) for piece in pieces]
        rest: list = []
        for doc, at, size, total, raw in left:
            part = min(size, self.room)
            if part:
                rows += self._fill((doc, at, part, total, raw))
            if part < size:
                rest.append((doc, at + part, size - part, total, raw))
        while self.waiting:  # the newest bin is taken apart to fill the others
            pieces, room = self.waiting.pop()
            self.room -= room
            for doc, at, size, total, raw in pieces:
                part = min(size, self.room)
                if part:
                    rows += self._fill((doc, at, part, total, raw))
                if part < size:
                    rest.append((doc, at + part, size - part, total, raw))
        cuts = binary_cuts(sum(p[2] for p in rest), self.capacity)[::-1]
        rest.reverse()
        while cuts:
            wanted, pieces = cuts.pop(), []
            while wanted:
                doc, at, size, total, raw = rest.pop()
                part = min(size, wanted)
                pieces.append((doc, at, part, total, raw))
                wanted -= part
                if part < size:
                    rest.append((doc, at + part, size - part, total, raw))
            rows += self._sequence(pieces)
        self.open, self.waiting, self.room = {}, deque(), 0
        return rows


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    from .chunked_tokens import encoder

    common.take_over("packing")

    bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40)
    end = end_id.to_bytes(4, "little")

    def batch(rows: list) -> pa.RecordBatch:
        doc, start, length, total, ids, sequence, offset = map(list, zip(*rows))
        long = pa.int64()
        return pa.record_batch([pa.array(doc, long), pa.array(start, long), pa.array(length, long), pa.array(total, long), pa.array(sequence, long), pa.array(offset, long), pa.array(ids, pa.binary())], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    for given in batches:
        doc_ids, texts = given.column(0).to_pylist(), given.column(1)
        for low in range(0, len(doc_ids), 2048):
            rows: list = []
            for doc_id, raw in zip(doc_ids[low:], encoder(path, "<u4", CACHED_CHUNKS).encode(texts.slice(low, 2048))):
                rows += bins.add(doc_id, raw + end)
            if rows:
                yield batch(rows)
    if rows := bins.close():
        yield batch(rows)


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of the documents' packed sequences.

    ``ids`` are little-endian unsigned 32-bit; ``start`` counts the document's ids before the
    piece, ``offset`` the sequence's.  Sequence ids are unique, not dense.  A task's bins depend
    on its input split alone, so a task that runs again gives the same rows.
    """
    HarmonicBins(capacity, 0)
    common.ship(docs.sparkSession)

    def run(batches):
        from linkloom.llm.packing import _pack_batches

        return _pack_batches(batches, tokenizer_path, end_id, capacity)

    return common.id_text(docs).mapInArrow(run, _SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
