"""Language-model scores from an n-gram trie of Elias-Fano levels.

The model is a bigram model with Dirichlet smoothing towards the base distribution

    p0(w)     = (c(w) + 0.5) / Z,   Z = N + 0.5 (V + 1)
    p(w | h)  = (c(h w) + MU p0(w)) / (c(h) + MU)

over the words of the training documents and one class of unknown words, with an end token after each text
and a start context before it.  p sums to one after every context.  The logarithm
splits into a joint part, log(c(h w) + MU p0(w)), known where the bigrams of w are counted, and
a context part, -log(c(h) + MU), known where h's own count is, so one exchange of tokens does.

1. Tasks count the words of their training documents; counts are merged by word.  N, V and the words with
   at least a ``HOT_PART``-th of a shard's tokens (or an ``HOT_WORDS``-th of N, if that is more, so never more than
   HOT_WORDS words) reach the driver.
2. Tasks turn chunks of documents into blobs of distinct bigrams with their training counts, sorted by word and
   context, one blob for each shard; a shard holds whole words, but the words of the hot list are dealt out by
   bigram, their counts being known everywhere.  So a word or bigram, however frequent, costs a shard one
   entry for each chunk.  Which documents hold a bigram is known to the chunk alone and travels past the shards.
3. A shard merges its blobs, builds its part of the trie (`elias_fano.NgramTrie`), maps it, looks up its
   distinct bigrams by their words' pointers, and answers each chunk with the quantised values and the words' counts.
4. A chunk adds up its documents' scores from the answers.

``train_and_score(..., model=folder)`` saves the shards' tries and the totals as Parquet in a shared folder; ``score`` scores any
documents with a saved model, chunk by chunk through the same steps.

Values in the trie are quantised to 65,535 levels (an error below 1e-4 each); the base score uses
exact counts.  Bigrams that training documents lack fall back to MU p0(w).  Nothing is pruned or capped;
shards grow in number with the tokens, not in size.  Blobs grow in number with chunks times shards: from some 10^11
tokens on a blob holds few bigrams, and larger chunks and shards on larger executors (the constants below) are due.

Defined results: null text is empty: its one token is the end; a null doc_id counts as the text "" in
the fold; without training documents every count is 0; repeated rows are scored
and counted row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common
from .elias_fano import NgramTrie
from .shingles import mix

FOLDS, HELD_OUT = 5, 1
MU = 300.0
CHUNK_TOKENS = 1_500_000
CHUNK_DOCS = 60_000
SHARD_TOKENS = 3_000_000
#: Words with this part of a shard's tokens are dealt out by bigram; HOT_WORDS of them at most.
HOT_PART = 16
HOT_WORDS = 1_000_000
END, START = np.uint64(0x0E4D), np.uint64(0x57A7)
_U = np.uint64


def hashes(text: str) -> np.ndarray:
    """Token hashes of a text: A-Z lower-cased words between ASCII white space, then the end."""
    tokens = text.encode("utf-8", "replace").lower().split()
    out = np.empty(len(tokens) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    out[-1] = END
    return out


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS != HELD_OUT


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, token counts, token hashes) of some documents at a time."""
    ids: list = []
    parts: list[np.ndarray] = []
    total = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts.append(hashes(text.as_py()))
            ids.append(doc_id)
            total += len(parts[-1])
            if total >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                yield ids, np.array([len(p) for p in parts]), np.concatenate(parts)
                ids, parts, total = [], [], 0
    if ids:
        yield ids, np.array([len(p) for p in parts]), np.concatenate(parts)


# ---- first pass: words ---------------------------------------------------------------------------

_COUNTS = "shard int, words binary, counts binary, tokens long"
_MERGED = "vocabulary long, trained long, tokens long, word long, count long"


def _count(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for ids, sizes, words in _chunks(batches):
        train = np.repeat([in_training(i) for i in ids], sizes)
        seen, counts = np.unique(words[train], return_counts=True)
        shard = (mix(seen) >> _U(8)) % _U(shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        rows = [(n, seen[order[a:b]].tobytes(), counts[order[a:b]].astype("<u4").tobytes(), len(words) if not n else 0) for n, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a or not n]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(map(list, zip(*rows)), (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["shard", "words", "counts", "tokens"])


def _merge(table: pa.Table) -> pa.Table:
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
    order = np.argsort(words, kind="stable")
    words, counts = words[order], counts[order].astype(np.int64)
    start = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts, start) if len(start) else counts
    words = words[start]
    trained = int(total.sum())
    hot = np.flatnonzero((total * HOT_PART >= SHARD_TOKENS) | (words == END))
    n = len(hot) + 1
    zeros = [0] * (n - 1)
    return pa.table({"vocabulary": pa.array([len(words), *zeros], pa.int64()), "trained": pa.array([trained, *zeros], pa.int64()), "tokens": pa.array([sum(table.column("tokens").to_pylist()), *zeros], pa.int64()), "word": pa.array([None, *words[hot].view(np.int64).tolist()], pa.int64()), "count": pa.array([0, *total[hot].tolist()], pa.int64())})


class Statistics:
    """What every task knows: totals, and the counts of the words on the hot list."""

    def __init__(self, trained: int, vocabulary: int, tokens: int, documents: int, hot: dict[int, int]):
        self.trained, self.vocabulary, self.tokens, self.documents = trained, vocabulary, tokens, documents
        self.z = trained + 0.5 * (vocabulary + 1)
        hot = {int(END): documents} | hot  # the end is no context, so it is never left to a shard
        self.hot_words = np.array(sorted(np.array([*hot], np.int64).view(np.uint64)), np.uint64)
        self.hot_counts = np.array([hot[int(w)] for w in self.hot_words.view(np.int64)], np.int64)

    def row(self) -> tuple:
        return self.trained, self.vocabulary, self.tokens, self.documents, self.hot_words.astype("<u8").tobytes(), self.hot_counts.astype("<i8").tobytes()

    @classmethod
    def of_row(cls, trained: int, vocabulary: int, tokens: int, documents: int, words: bytes, counts: bytes) -> Statistics:
        return cls(trained, vocabulary, tokens, documents, dict(zip(np.frombuffer(words, "<i8").tolist(), np.frombuffer(counts, "<i8").tolist())))

    def hot(self, words: np.ndarray) -> np.ndarray:
        """The count of each word on the hot list, -1 for others."""
        if not len(self.hot_words):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hot_words, words), len(self.hot_words) - 1)
        return np.where(self.hot_words[at] == words, self.hot_counts[at], -1)


def statistics(rows: DataFrame) -> Statistics:
    """Of (doc_id, text) rows."""
    shards = max(1, rows.rdd.getNumPartitions() // 2)

    def count(batches):
        from linkloom.llm.lm import _count

        return _count(batches, shards)

    def merge(table):
        from linkloom.llm.lm import _merge

        return _merge(table)

    merged = rows.mapInArrow(count, _COUNTS).groupBy("shard").applyInArrow(merge, _MERGED)
    merged = common.persist_table(merged)
    total = merged.agg(F.sum("vocabulary"), F.sum("trained"), F.sum("tokens")).first()
    vocabulary, trained, tokens = (int(x or 0) for x in total)
    keep = (F.col("count") >= max(SHARD_TOKENS // HOT_PART, trained // HOT_WORDS)) | (F.col("word") == int(END))
    hot = {r["word"]: r["count"] for r in merged.where(F.col("word").isNotNull() & keep).select("word", "count").collect()}  # at most HOT_WORDS + 1 rows
    return Statistics(trained, vocabulary, tokens, hot.get(int(END), 0), hot)


# ---- second pass: bigrams ------------------------------------------------------------------------

_BLOBS = "shard int, chunk long, head binary, blob binary, meta binary"
_ANSWERS = "chunk long, shard int, scale binary, head binary, blob binary, meta binary"
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"
_TRIES = "shard int, trie binary"
#: Chunk number of the row that carries a shard's trie.
_TRIE = -1


def _squeeze(*arrays: np.ndarray) -> tuple[bytes, bytes]:
    """(lengths, data) of arrays one after the other; the data in zstd."""
    import zstandard

    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.array([len(a) for a in arrays], "<i8").tobytes(), zstandard.compress(raw, 1)


def _expand(head: bytes, blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.decompress(blob), 0, []
    for length, kind in zip(np.frombuffer(head, "<i8").tolist(), kinds):
        out.append(np.frombuffer(raw, kind, length, at))
        at += length * np.dtype(kind).itemsize
    return out


def _narrow(*arrays: np.ndarray) -> list[np.ndarray]:
    """Numbers in 16 bits, those that need more in full behind them: (low bits, places, values) of each array."""
    out = []
    for x in arrays:
        wide = np.flatnonzero(x > 0xFFFF)
        out += [(x & 0xFFFF).astype("<u2"), wide.astype("<i8"), x[wide].astype("<i8")]
    return out


def _wide(low: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[places] = values
    return out


_NARROW = ("<u2", "<i8", "<i8")
#: words, bigrams of each word; contexts and training counts of the bigrams
_PAIRS = ("<u8", "<u4", "<u8", *_NARROW)
#: ids, whether they are null, training; tokens, known tokens, base and score so far; documents of each bigram; documents, occurrences
_META = ("<i8", "u1", "u1", "<i8", "<i8", "<f8", "<f8", *_NARROW, "<u2", *_NARROW)
#: values and counts of the bigrams and words that a chunk asked a shard about, bigrams of each word
_ANSWER = ("<u2", "<i8", "<u4")


def _bigrams(batches: Iterator[pa.RecordBatch], stats: Statistics, shards: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    start_part = -np.log10(stats.documents + MU)
    for ids, sizes, words in _chunks(batches):
        docs = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[np.cumsum(sizes) - sizes] = START
        train = np.array([in_training(i) for i in ids])
        # what the hot list settles here: base and context parts
        hot = stats.hot(words)
        on = hot >= 0
        count = np.maximum(hot, 0)
        base = np.bincount(docs[on], np.log10(count[on] + 0.5), len(ids))
        known = np.bincount(docs[on & (hot > 0)], minlength=len(ids))
        inner = on & (words != END)
        score = start_part - np.bincount(docs[inner], np.log10(count[inner] + MU), len(ids))
        # one order for all: shard, word, context, document
        shard = (np.where(on, mix(words + mix(before)), mix(words)) >> _U(8)) % _U(shards)
        order = np.lexsort((before, words, shard.astype(np.uint32)))
        words, before, docs, shard = words[order], before[order], docs[order], shard[order]
        new_w = np.r_[True, (words[1:] != words[:-1]) | (shard[1:] != shard[:-1])]
        new_p = new_w | np.r_[True, before[1:] != before[:-1]]
        new_d = new_p | np.r_[True, docs[1:] != docs[:-1]]
        of_p, of_d = np.flatnonzero(new_p), np.flatnonzero(new_d)
        times = np.diff(np.append(of_d, len(words)))
        docs_of_pair = np.add.reduceat(new_d.astype(np.int64), of_p)
        seen = np.add.reduceat(train[docs].astype(np.int64), of_p)
        ids_there = np.array([0 if i is None else i for i in ids], "<i8"), np.array([i is not None for i in ids], "u1")
        meta = _squeeze(*ids_there, train.astype("u1"), sizes.astype("<i8"), known.astype("<i8"), base, score, *_narrow(docs_of_pair), docs[of_d], *_narrow(times))
        words, before, shard, new_w = words[of_p], before[of_p], shard[of_p], new_w[of_p]
        edges = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
        rows = []
        own = int(mix(np.array([number], np.uint64))[0] % _U(shards))
        for n in range(shards):
            a, b = edges[n], edges[n + 1]
            if a == b and n != own:
                continue
            of_w = np.flatnonzero(new_w[a:b])
            per_word = np.diff(np.append(of_w, b - a)).astype("<u4")
            head, blob = _squeeze(words[a:b][of_w], per_word, before[a:b], *_narrow(seen[a:b]))
            rows.append((n, number, head, blob, meta[0] + meta[1] if n == own else None))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(map(list, zip(*rows)), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=[x.split()[0] for x in _BLOBS.split(", ")])
        number += 1


def _asked(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a shard's blobs; distinct word, context, training count of its bigrams; place of each blob's bigrams among them)."""
    blobs = [_expand(head, blob, _PAIRS) for head, blob in zip(table.column("head").to_pylist(), table.column("blob").to_pylist())]
    word = np.concatenate([np.repeat(b[0], b[1]) for b in blobs])
    context = np.concatenate([b[2] for b in blobs])
    seen = np.concatenate([_wide(*b[3:]) for b in blobs])
    order = np.lexsort((context, word))
    word, context = word[order], context[order]
    new = np.r_[True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])] if len(word) else np.zeros(0, bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    both = np.add.reduceat(seen[order], at) if len(at) else np.zeros(0, np.int64)
    return blobs, word[at], context[at], both, place


def _shard_trie(stats: Statistics, word: np.ndarray, context: np.ndarray, both: np.ndarray) -> bytes:
    """The trie of a shard's distinct bigrams that training saw."""
    train = np.flatnonzero(both > 0)
    word, context, both = word[train], context[train], both[train]
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    own = np.add.reduceat(both, start) if len(start) else both
    hot = stats.hot(word[start])
    counts = np.where(hot >= 0, hot, own)
    prior = MU * (np.repeat(counts, np.diff(np.append(start, len(word)))) + 0.5) / stats.z
    return NgramTrie.build(word, context, np.log10(both + prior), counts).to_bytes()


def _answer(table: pa.Table, stats: Statistics, trie: bytes, asked: tuple) -> list:
    """What a shard's trie says to each chunk: codes of its bigrams, counts of its words (below 0: settled by the hot list, -1 - count)."""
    blobs, word, context, _, place = asked
    mapped = NgramTrie.mapped(trie)
    codes = mapped.codes_of(word, context)[place].astype("<u2")
    scale = mapped.scale.tobytes()
    rows, low = [], 0
    for chunk, shard, meta, blob in zip(table.column("chunk").to_pylist(), table.column("shard").to_pylist(), table.column("meta").to_pylist(), blobs):
        hot = stats.hot(blob[0])
        counts = np.where(hot >= 0, -1 - hot, mapped.counts_of(blob[0]))
        rows.append((chunk, shard, scale, *_squeeze(codes[low : low + len(blob[2])], counts, blob[1]), meta))
        low += len(blob[2])
    return rows


def _answers(rows: list) -> pa.Table:
    columns = list(map(list, zip(*rows)))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in _ANSWERS.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)] if rows else [pa.array([], k) for k in kinds], names=names)


def _shard(table: pa.Table, stats: Statistics, save: bool) -> pa.Table:
    """Build a shard's trie and answer its chunks."""
    asked = _asked(table)
    trie = _shard_trie(stats, *asked[1:4])
    rows = _answer(table, stats, trie, asked)
    if save:
        rows.append((_TRIE, table.column("shard")[0].as_py(), None, None, trie, None))
    return _answers(rows)


def _ask(table: pa.Table, tries: pa.Table, stats: Statistics) -> pa.Table:
    """Answer the chunks of a shard from its saved trie."""
    if not table.num_rows:
        return _answers([])
    none = np.zeros(0, np.uint64)
    trie = tries.column("trie")[0].as_py() if tries.num_rows else _shard_trie(stats, none, none, none.astype(np.int64))
    return _answers(_answer(table, stats, trie, _asked(table)))


def _gather(table: pa.Table, stats: Statistics) -> pa.Table:
    """The scores of a chunk's documents from the answers of all shards."""
    table = table.sort_by("shard")
    meta = next(m for m in table.column("meta").to_pylist() if m is not None)
    parts = _expand(meta[: 8 * len(_META)], meta[8 * len(_META) :], _META)
    ids, there, train, sizes, known, base, score = parts[:7]
    docs_of_pair, docs, times = _wide(*parts[7:10]), parts[10].astype(np.int64), _wide(*parts[11:14])
    joint, word_base, word_known = [], [], []
    for scale, head, blob in zip(table.column("scale").to_pylist(), table.column("head").to_pylist(), table.column("blob").to_pylist()):
        codes, counts, per_word = _expand(head, blob, _ANSWER)
        low, step = np.frombuffer(scale, "<f8")
        cold = counts >= 0
        count = np.where(cold, counts, -1 - counts)
        prior = np.log10(MU * (count + 0.5) / stats.z)
        own = np.where(codes > 0, low + (codes - 1.0) * step, np.repeat(prior, per_word))
        joint.append(own - np.repeat(np.where(cold, np.log10(count + MU), 0.0), per_word))
        word_base.append(np.repeat(np.where(cold, np.log10(count + 0.5), 0.0), per_word))
        word_known.append(np.repeat(cold & (count > 0), per_word))
    pair = np.repeat(np.arange(len(docs_of_pair)), docs_of_pair)
    known, base, score = (x + np.bincount(docs, times * np.concatenate(y)[pair], len(ids)) for x, y in ((known, word_known), (base, word_base), (score, joint)))
    return pa.table([pa.array(ids, mask=there == 0), pa.array(train == 0), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=[x.split()[0] for x in _RESULT.split(", ")])


def _blobs(rows: DataFrame, stats: Statistics, shards: int) -> DataFrame:
    def bigrams(batches):
        from linkloom.llm.lm import _bigrams

        return _bigrams(batches, stats, shards)

    return rows.mapInArrow(bigrams, _BLOBS).repartitionById(shards, F.col("shard"))


def _scores(answers: DataFrame, stats: Statistics) -> DataFrame:
    def gather(table):
        from linkloom.llm.lm import _gather

        return _gather(table, stats)

    out = answers.groupBy("chunk").applyInArrow(gather, _RESULT)
    base = F.col("base_sum") - F.col("n_tokens") * F.lit(float(np.log10(stats.z)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(stats.trained).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def train_and_score(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; the model is saved in the folder ``model``."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.id_text(docs)
    stats = statistics(rows)
    shards = max(1, -(-stats.tokens // SHARD_TOKENS))
    save = model is not None

    def shard(table):
        from linkloom.llm.lm import _shard

        return _shard(table, stats, save)

    answers = _blobs(rows, stats, shards).groupBy("shard").applyInArrow(shard, _ANSWERS)
    if save:
        answers = common.persist_table(answers)
        answers.where(F.col("chunk") == _TRIE).select("shard", F.col("blob").alias("trie")).write.parquet(f"{model}/tries")
        totals = "trained long, vocabulary long, tokens long, documents long, words binary, counts binary, shards int"
        spark.createDataFrame([(*stats.row(), shards)], totals).write.parquet(f"{model}/totals")
        answers = answers.where(F.col("chunk") != _TRIE)
    return _scores(answers, stats)


def score(docs: DataFrame, model: str) -> DataFrame:
    """The columns of ``train_and_score`` for any documents, by the model saved in the folder ``model``."""
    spark = docs.sparkSession
    common.ship(spark)
    *totals, shards = spark.read.parquet(f"{model}/totals").first()
    stats = Statistics.of_row(*totals)

    def ask(table, tries):
        from linkloom.llm.lm import _ask

        return _ask(table, tries, stats)

    tries = spark.read.schema(_TRIES).parquet(f"{model}/tries")
    answers = _blobs(common.id_text(docs), stats, shards).groupBy("shard").cogroup(tries.groupBy("shard")).applyInArrow(ask, _ANSWERS)
    return _scores(answers, stats)
