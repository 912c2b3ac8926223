"""Token ids as canonical length-limited Huffman code in checkpointed blocks.

Global counts of the ids give code lengths of at most ``MAX_BITS`` (package-merge); the codes
are canonical, so a file needs only the lengths.  Documents go into files in ascending
doc_id order.  A file's row is one segment: a run of whole documents with

    bits         the codes, most significant bit first, as bytes
    checkpoints  the bit offset of every ``BLOCK``-th id, little-endian unsigned 32-bit
    doc_ids, doc_ends   the documents and their id counts, summed, little-endian 64-bit
    first        ids of all documents before the segment

so every block of ``BLOCK`` ids decodes alone: a table of 2^MAX_BITS entries maps the next bits to (id,
length).  Blocks are decoded side by side, one id of each block at a time, with array
operations.  Files are Parquet with one row for each segment; ``lengths`` are in the
manifest beside them.

Counting and placing: documents are tokenized once, into segments of documents sorted within ranges
of doc_id; each task adds one row with the counts of its ids.  Only range bounds (as many as there are
ranges), the counts of the vocabulary's ids and the parts' sizes reach the driver.  Ids travel as
plain bytes, low bytes before high ones: the shuffle and Parquet compress them.

Defined results: null text is empty and is its end id alone; a null doc_id sorts first, such rows in ranges of their
texts' crc32; rows of equal doc_id follow in the order of their texts' ids; an empty table gives an empty file set;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

MAX_BITS = 16
BLOCK = 256
END_ID = 2
#: Documents of a segment hold about so many ids.
SEGMENT_IDS = 1 << 18
NULL_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the ids that occur (0: does not occur), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # Level by level: the leaves merged with the pairs of the level below; keep how many leaves lead.
    level_weights, is_leaf = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(level_weights) // 2 * 2
        pairs = level_weights[0:even:2] + level_weights[1:even:2]
        both = np.concatenate([weights, pairs])
        place = np.argsort(both, kind="stable")
        level_weights = both[place]
        is_leaf.append(place < n)
    take = 2 * n - 2
    depth = np.zeros(n, np.int64)
    for leaf in reversed(is_leaf):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by rising length, then rising id."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for n in order[lengths[order] > 0]:
        code <<= int(lengths[n]) - last
        last = int(lengths[n])
        codes[n] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Entry of the next ``limit`` bits: id * 32 + length."""
    codes, table = canonical_codes(lengths), np.zeros(1 << limit, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = (1 << (limit - lengths[order].astype(np.int64)))
    filled = np.repeat(order.astype(np.uint32) * 32 + lengths[order], spans)
    table[: len(filled)] = filled
    del codes
    return table


def encode_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[bytes, bytes]:
    """(bits, checkpoints) of ids."""
    if not len(ids):
        return b"", b""
    if block % 2:
        raise ValueError("a block holds an even number of ids")
    # two codes of at most 16 bits each as one, which halves the work below
    table = (codes.astype(np.uint32) << np.uint32(5)) | lengths
    both = table[ids if len(ids) % 2 == 0 else np.append(ids, ids[:1])]
    size, code = both & np.uint32(31), both >> np.uint32(5)
    if len(ids) % 2:
        size[-1] = code[-1] = 0
    code = (code[::2].astype(np.uint64) << size[1::2].astype(np.uint64)) | code[1::2]
    size = (size[::2] + size[1::2]).astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1])
    # at most 32 bits touch two 32-bit words; bits of a word never overlap, so sums are ors
    wide = code << (64 - (starts & 31) - size).astype(np.uint64)
    words = np.zeros(total // 32 + 3, np.uint64)
    at = starts >> 5
    first = np.flatnonzero(np.diff(at, prepend=-1))
    words[at[first]] += np.add.reduceat(wide >> np.uint64(32), first)
    words[at[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[:: block // 2].astype("<u4").tobytes()


def decode_ids(bits: bytes, checkpoints: bytes, count: int, table: np.ndarray, limit: int = MAX_BITS, block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks, decoded side by side from their checkpoints."""
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.zeros((block, len(at)), np.uint32)
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    # 32 bits from each byte on, so that any 16 bits lie in one entry
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    last = count - (len(at) - 1) * block if len(at) else 0
    mask, keep = np.uint32((1 << limit) - 1), 32 - limit
    for n in range(block if len(at) > 1 else last):
        if n == last and len(at) > 1:
            at = at[:-1]
        entry = table[(window[at >> 3] >> (keep - (at & 7)).astype(np.uint32)) & mask]
        out[n, : len(at)] = entry >> 5
        at = at + (entry & 31)
    return out.T.reshape(-1)[:count]


# ---- tokenized segments -------------------------------------------------------------------------

_TOKENIZED = "part int, doc_id long, n_tokens long, ids binary"
_SEGMENT = "part int, n int, n_ids long, own long, n_docs long, doc_ids binary, doc_ends binary, ids binary, used array<int>, counts array<long>"
_FILE = "part int, n int, n_ids long, first long, doc_ids binary, doc_ends binary, bits binary, checkpoints binary"
#: Number of the row that carries a task's counts instead of a segment.
_COUNTS = -1


def _names(fields: str) -> list[str]:
    return [field.split()[0] for field in fields.split(", ")]


def _planes(ids: np.ndarray) -> bytes:
    """The low bytes, then the high bytes: two smooth runs compress better than pairs."""
    return np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 2).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(2, -1).T).reshape(-1).view(np.uint16)


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bounds: list[int], null_parts: int) -> Iterator[pa.RecordBatch]:
    from .chunked_tokens import encoder

    common.take_over("huffman")

    end, edges = end_id.to_bytes(2, "little"), np.array(bounds, np.int64)
    for given in batches:
        for low in range(0, given.num_rows, 2048):
            part = given.slice(low, 2048)
            known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            doc_ids = part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            texts = part.column(1)
            raw = [ids + end for ids in encoder(path, "<u2").encode(texts)]
            where = (null_parts + np.searchsorted(edges, doc_ids, side="right")).astype(np.int32)
            for n in np.flatnonzero(~known):
                where[n] = zlib.crc32(texts[n].as_py().encode()) % null_parts
            yield pa.record_batch([pa.array(where), pa.array(doc_ids), pa.array([len(r) // 2 for r in raw], pa.int64()), pa.array(raw, pa.binary())], names=_names(_TOKENIZED))


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted documents of parts to segments, and the counts of all their ids."""
    common.take_over("huffman files")
    part, n, own, docs, ends, ids, total = None, 0, 0, [], [], [], 0
    counts = np.zeros(size, np.int64)
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def row(*cells) -> pa.RecordBatch:
        return pa.record_batch([pa.array([cell], kind) for cell, kind in zip(cells, kinds)], names=_names(_SEGMENT))

    def flush() -> pa.RecordBatch:
        whole = np.frombuffer(b"".join(ids), np.uint16)
        counts[:] += np.bincount(whole, minlength=size)
        return row(part, n, len(whole), own, len(docs), np.array(docs, "<i8").tobytes(), np.cumsum(np.array(ends, "<i8")).astype("<i8").tobytes(), _planes(whole), None, None)

    for batch in batches:
        for p, doc_id, tokens, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if docs and (p != part or total >= SEGMENT_IDS):
                yield flush()
                n, own = (n + 1, own + total) if p == part else (0, 0)
                docs, ends, ids, total = [], [], [], 0
            part = p
            docs.append(doc_id)
            ends.append(tokens)
            ids.append(raw)
            total += tokens
    if docs:
        yield flush()
        used = np.flatnonzero(counts)
        yield row(part, _COUNTS, 0, 0, 0, None, None, None, used.astype(np.int32), counts[used])


def _encode(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    common.take_over("huffman files")
    codes = canonical_codes(lengths)
    for batch in batches:
        for part, n, n_ids, first, doc_ids, doc_ends, raw in zip(*(c.to_pylist() for c in batch.columns)):
            bits, marks = encode_ids(_unplanes(raw), codes, lengths)
            cells = ((part, pa.int32()), (n, pa.int32()), (n_ids, pa.int64()), (first, pa.int64()), (doc_ids, pa.binary()), (doc_ends, pa.binary()), (bits, pa.binary()), (marks, pa.binary()))
            yield pa.record_batch([pa.array([v], kind) for v, kind in cells], names=_names(_FILE))


def _decode(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, with_ids: bool) -> Iterator[pa.RecordBatch]:
    common.take_over("huffman files")
    table = decode_table(lengths)
    for batch in batches:
        for n_ids, first, doc_ids, doc_ends, bits, marks in zip(*(c.to_pylist() for c in batch.columns)):
            ids = decode_ids(bits, marks, n_ids, table).astype("<u4")
            docs, ends = np.frombuffer(doc_ids, "<i8"), np.frombuffer(doc_ends, "<i8")
            starts = np.concatenate([[0], ends[:-1]])
            raw = ids.tobytes()
            whole = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
            last = pa.array(whole, pa.binary()) if with_ids else pa.array([zlib.crc32(x) for x in whole], pa.int64())
            yield pa.record_batch([pa.array(docs, mask=docs == NULL_ID), pa.array(starts + first), pa.array(ends - starts), last], names=["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])


def write(docs: DataFrame, tokenizer_path: str, target: str, *, end_id: int = END_ID, documents_per_part: int = 4096) -> None:
    """Tokenize the documents and write their ids under ``target`` in ascending doc_id order."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.id_text(docs)
    n, known = rows.agg(F.count("*"), F.count("doc_id")).first()
    null_parts = -(-(n - known) // documents_per_part)
    parts = max(1, min(100_000, known // documents_per_part))
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)}) if parts > 1 else []

    def tokenize(batches):
        from linkloom.llm.huffman import _tokenize

        return _tokenize(batches, tokenizer_path, end_id, bounds, null_parts)

    def segment(batches):
        from linkloom.llm.huffman import _segments

        return _segments(batches, 1 << 16)

    tokenized = rows.mapInArrow(tokenize, _TOKENIZED)
    placed = tokenized.repartitionById(null_parts + len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    written = common.persist_table(placed.mapInArrow(segment, _SEGMENT))
    segments = written.where(F.col("n") != _COUNTS)

    # one row for each task and id, combined before the shuffle; at most 65,536 on the driver
    counted = written.where(F.col("n") == _COUNTS).select(F.explode(F.arrays_zip("used", "counts")).alias("c")).groupBy("c.used").agg(F.sum("c.counts").alias("n"))
    counts = np.zeros(1 << 16, np.int64)
    for row in counted.toLocalIterator():
        counts[row["used"]] = row["n"]
    lengths = code_lengths(counts)
    # ids before each part: one row for each part on the driver; within a part a running sum
    before, so_far = [], 0
    for row in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator():
        before.append((row["part"], so_far))
        so_far += row["n"]
    parts_df = spark.createDataFrame(before, "part int, before long")  # at most 100,000 rows
    ready = segments.join(F.broadcast(parts_df), "part").select("part", "n", "n_ids", (F.col("before") + F.col("own")).alias("first"), "doc_ids", "doc_ends", "ids")

    def encode(batches):
        from linkloom.llm.huffman import _encode

        return _encode(batches, lengths)

    ready.mapInArrow(encode, _FILE).write.mode("overwrite").option("compression", "none").parquet(f"{target}/segments")
    spark.createDataFrame([(MAX_BITS, BLOCK, end_id, lengths.tobytes())], "max_bits int, block int, end_id int, lengths binary").write.mode("overwrite").parquet(f"{target}/manifest")


def read(spark, target: str, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ids little-endian unsigned 32-bit, or their crc32."""
    common.ship(spark)
    head = spark.read.parquet(f"{target}/manifest").first()
    if (head["max_bits"], head["block"]) != (MAX_BITS, BLOCK):
        raise ValueError("written with other parameters")
    lengths = np.frombuffer(head["lengths"], np.uint8)

    def decode(batches):
        from linkloom.llm.huffman import _decode

        return _decode(batches, lengths, with_ids)

    files = spark.read.parquet(f"{target}/segments").select("n_ids", "first", "doc_ids", "doc_ends", "bits", "checkpoints")
    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, " + ("ids binary" if with_ids else "ids_crc32 long"))
