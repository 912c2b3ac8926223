"""The training-data operators against brute force, on small tables with nulls, empties, long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import bpe, chunked_tokens, exact_dedup, fingerprint, huffman, linear, lm, minhash, packing, quality, queries, shingles, token_counts, toxicity
from linkloom.llm.elias_fano import EliasFano, NgramTrie

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fingerprint int, label string"


def public(name):
    return queries.vocabulary(name)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["the", "Of", "and", "café", "naïve", "über", "x1", "3.14", "don't", "état", "a", "zzz!!", "学习", "教程abc"]
    made = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    long = " ".join(rnd.choice(words) for _ in range(9000))
    odd = [None, "", " ", "\n\n", "a\tb  c\n d ", "<|endoftext|>", "x\n\n<|endoftext|> y<|startoftext|>", "word", "one two\nthree four", "aaaa" * 500, "   x \x1c y", "é" * 40, long, long + " end", made[0], made[0]]
    near = " ".join(str(n) for n in range(300))
    return made + odd + [near, near + " 300", near.replace("150", "abc"), "\n".join(["p one", "p two"]), "\n".join(["p two", "p one"])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(n, t, "en", f"s{n % 3}", 0, "clash", 1, None) for n, t in enumerate(texts)] + [(3, texts[3], "en", "s0", 0, "clash", 1, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None, None, None, None, None, None, None, None), (None, "a b", None, None, None, None, None, None), (1, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(n, n % 2, n % 3 % 2) for n in range(len(texts))] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ---- tokens --------------------------------------------------------------------------------------

@pytest.mark.parametrize("name, dtype", [("byte_bpe_50k.json", "<u2"), ("word_bpe_49k.json", "<u4")])
def test_chunked_ids_are_the_librarys(texts, name, dtype):
    encoder = chunked_tokens.ChunkEncoder(public(name), dtype, entries=50)  # small, so that generations change
    given = [t or "" for t in texts]
    spaces = ["a  b", "a\n \nb", " \n x", "x \n\n y", "tab\tend \r\n", "İstanbul ΣΑΣ", "é ́", "Café, CAFÉ. 's don't!"]
    assert encoder.by_chunk
    for batch in (given, spaces, given[::-1], ["".join(random.Random(n).choice(" \n\té'sA1! <|endoftext|>") for _ in range(30)) for n in range(500)]):
        assert encoder.encode(batch) == encoder._raw(batch)


@pytest.mark.parametrize("name, dtype", [("byte_bpe_50k.json", "<u2"), ("word_bpe_49k.json", "<u4")])
def test_chunked_ids_of_slices(texts, name, dtype, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chunked_tokens, "SLICE_BYTES", 300)
    encoder = chunked_tokens.ChunkEncoder(public(name), dtype, entries=60)
    rnd = random.Random(9)
    marks = ["", "", ",", ".", "...", "!?", "'s", "-x"]
    made = [" ".join("".join(rnd.choice("abcdeÉéß") for _ in range(rnd.randrange(1, 6))).title() + rnd.choice(marks) for _ in range(30)).replace("a ", "a\n") for _ in range(200)]
    given = [t or "" for t in texts] + made + ["<|ENDOFTEXT|> X", "a\x01b \x01", "\x01"]
    whole = pa.array(given)
    want = encoder._raw(given)
    assert encoder.encode(whole) == want
    for low in (0, 3, 77):
        assert encoder.encode(whole.slice(low, 140)) == want[low : low + 140]


def test_prefix_bpe_is_the_librarys(texts):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(public("byte_bpe_50k.json")), bpe.codec(public("byte_bpe_50k.json"))
    rnd = random.Random(3)
    more = ["a" * 3001, "ab" * 999, " " * 800, "!" * 77, "\U0003e43f's x", "\x85 a\x1c"] + ["".join(rnd.choice("aaabbehtinore  '\n") for _ in range(rnd.randrange(1, 50))) for _ in range(800)]
    for t in [t or "" for t in texts] + more:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for _ in range(200):
        ids = [rnd.randrange(50257) for _ in range(9)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_tables(spark, docs, texts, empty, nulls):
    path = public("byte_bpe_50k.json")
    back = bpe.decode(bpe.encode(docs, path), path)
    assert got(back, "doc_id", "text") == sorted([(n, t or "") for n, t in enumerate(texts)] + [(3, texts[3])])
    assert bpe.round_trip_digests(empty, path).count() == 0
    none = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in bpe.round_trip_digests(nulls, path).where("n_tokens = 0").collect()} == {(None, 0, none, none), (1, 0, none, none)}


def test_digests_of_codec_and_packing_queries(spark, sf):
    """The whole sf0.001 tables: op2's and op5's digests against the library."""
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    bytes_, words = (Tokenizer.from_file(public(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))
    want = set()
    for r in rows:
        ids = bytes_.encode(r["text"] or "", add_special_tokens=False).ids
        back = bytes_.decode(ids, skip_special_tokens=False)
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert {tuple(r) for r in queries.op5_bpe_round_trip(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want
    ids_of = {r["doc_id"]: np.array([*words.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    total = Counter()
    for r in queries.op2_harmonic_packing(spark, sf).collect():
        ids = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        total[r["doc_id"]] += r["length"]
    assert total == {n: len(ids) for n, ids in ids_of.items()}


# ---- op2 -----------------------------------------------------------------------------------------

def test_packing(docs, texts, empty, nulls):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public("word_bpe_49k.json"))
    want = {n: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for n, t in enumerate(texts)}
    pieces = packing.pack(docs.where("doc_id <> 3"), public("word_bpe_49k.json"), capacity=512).toPandas()
    for doc_id, part in pieces.sort_values("start").groupby("doc_id"):
        assert b"".join(part.ids) == want[doc_id] and (part.doc_tokens == len(want[doc_id]) // 4).all()
        assert part.start.tolist() == [0, *np.cumsum(part.length)[:-1]]
    assert set(pieces.doc_id) == set(want) - {3}
    for _, part in pieces.sort_values("offset").groupby("sequence_id"):
        size = int(part.length.sum())
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and size <= 512 and size & (size - 1) == 0  # no padding at all
    assert packing.pack(empty, public("word_bpe_49k.json")).count() == 0
    assert packing.digest(packing.pack(nulls, public("word_bpe_49k.json"))).count() >= 3


def test_binary_cuts():
    for n in range(0, 9000, 7):
        cuts = packing.binary_cuts(n, 4096)
        assert sum(cuts) == n and all(c & (c - 1) == 0 for c in cuts)


@pytest.mark.parametrize("lengths", ["mixed", "tiny", "thirds", "long"])
def test_harmonic_bins(lengths):
    rnd = random.Random(lengths)
    size = {"mixed": lambda: int(rnd.paretovariate(0.7) * 40) % 9000 + 1, "tiny": lambda: rnd.randrange(1, 5), "thirds": lambda: 1365, "long": lambda: rnd.randrange(2049, 4096)}[lengths]
    docs = [(n, np.arange(size(), dtype="<u4").tobytes()) for n in range(3000)]
    bins, rows = packing.HarmonicBins(4096, 0), []
    for n, raw in docs:
        rows += bins.add(n, raw)
        assert bins.room < 6144 and all(len(pieces) < k for k, pieces in bins.open.items())
    early = len(rows)
    rows += bins.close()
    by_doc, by_sequence = {}, {}
    for doc, start, length, total, ids, sequence, offset in rows:
        by_doc.setdefault(doc, []).append((start, length, ids))
        by_sequence.setdefault(sequence, []).append((offset, length, doc, total))
        assert total == len(docs[doc][1]) // 4 and len(ids) == 4 * length
    assert {n: b"".join(x[2] for x in sorted(p)) for n, p in by_doc.items()} == dict(docs)
    for pieces in by_sequence.values():
        full = sum(p[1] for p in pieces)
        assert [p[0] for p in sorted(pieces)] == [0, *np.cumsum([p[1] for p in sorted(pieces)])[:-1]] and full & (full - 1) == 0 and full <= 4096
    for sequence in {r[5] for r in rows[:early]}:
        pieces = sorted(by_sequence[sequence])
        whole = [p for p in pieces if p[1] == p[3]]
        assert sum(p[1] for p in pieces) == 4096
        if lengths in ("thirds", "long"):  # as many whole documents as the class says, then fillers
            assert len(whole) >= 4096 // pieces[0][3]
    whole = sum(len(p) == 1 for n, p in by_doc.items() if len(docs[n][1]) <= 4 * 4096)
    assert whole / sum(len(raw) <= 4 * 4096 for _, raw in docs) > {"long": 0.6}.get(lengths, 0.8)


# ---- op8 -----------------------------------------------------------------------------------------

def test_huffman_lengths_and_round_trip():
    rng = np.random.default_rng(1)
    for n, k in ((1, 3), (2, 2), (256, 9), (257, 300), (5000, 50_000), (40_000, 50_000)):
        ids = np.minimum((rng.pareto(0.6, n) * 5).astype(np.int64) % k, k - 1)
        counts = np.bincount(ids, minlength=65536)
        for limit in (16, 17):
            lengths = huffman.code_lengths(counts, limit)
            assert lengths.max() <= limit and sum(2.0 ** -float(x) for x in lengths[lengths > 0]) <= 1
        lengths = huffman.code_lengths(counts)
        bits, marks = huffman.encode_ids(ids, huffman.canonical_codes(lengths), lengths)
        assert (huffman.decode_ids(bits, marks, n, huffman.decode_table(lengths)) == ids).all()


def test_length_limit_is_optimal_against_plain_huffman():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        merged = heapq.heappop(heap) + heapq.heappop(heap)
        cost += merged
        heapq.heappush(heap, merged)
    assert (huffman.code_lengths(counts, 16) * counts).sum() == cost
    assert huffman.code_lengths(counts, 3).tolist() == [3] * 8


def test_token_files(spark, docs, texts, empty, nulls, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public("byte_bpe_50k.json"))
    target = f"{tmp_path}/tokens"
    huffman.write(docs.where("doc_id <> 3"), public("byte_bpe_50k.json"), target, documents_per_part=10)
    rows, start = [], 0
    for n, t in enumerate(texts):
        if n != 3:
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            rows.append((n, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert got(huffman.read(spark, target, with_ids=False), "doc_id", "start", "n_tokens", "ids_crc32") == rows
    for n, table in enumerate((empty, nulls)):
        huffman.write(table, public("byte_bpe_50k.json"), f"{tmp_path}/odd{n}")
        assert huffman.read(spark, f"{tmp_path}/odd{n}").count() == table.count()


# ---- op9, op4 ------------------------------------------------------------------------------------

def test_index_buckets():
    assert [exact_dedup.buckets_for(n) for n in (0, 10**6, 200 * 10**6, 10**10)] == [32, 32, 64, 4096]


def test_exact_keep_decides_on_rows(spark):
    rows = [(1, "alpha", "a"), (1, "beta", "b"), (2, "gamma", "c"), (2, " gamma", "c"), (None, "alpha", "z"), (None, "delta  x", "d"), (None, "delta x", "e"), (3, "beta", "q"), (3, None, "n"), (4, "", "n"), (1, "alpha", "a"), (1, "alpha", "0")]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(4)
    kept = exact_dedup.keep(table, exact_dedup.DigestIndex(spark, "test_rows"))
    want = {(1, "alpha", "0"), (1, "beta", "b"), (2, "gamma", "c"), (2, " gamma", "c"), (None, "delta  x", "d"), (3, None, "n")}
    assert kept.columns == table.columns and {tuple(r) for r in kept.collect()} == want and kept.count() == len(want)


def test_exact_dedup(spark, docs, texts, empty, nulls):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = Counter(norm) + Counter([norm[3]])
    index = exact_dedup.DigestIndex(spark, "test_digests")
    rows = exact_dedup.dedup(docs, index, batches=3)
    want = [(n, norm.index(t), groups[t], norm.index(t) == n) for n, t in enumerate(norm)]
    assert got(rows, "doc_id", "keep_id", "group_size", "kept") == sorted(want + [want[3]])
    before = index.table().count()
    exact_dedup.dedup(docs, index)  # a replay appends nothing
    assert index.table().count() == before == len(set(norm))
    more = spark.createDataFrame([(999, texts[0], "x", "y", 1, "z", 2, None), (1000, "brand new", "x", "y", 1, "z", 2, None)], SCHEMA)
    assert got(exact_dedup.dedup(more, index).where("kept"), "doc_id") == [(1000,)]
    assert exact_dedup.keep(more, index).columns == more.columns
    for n, table in enumerate((empty, nulls)):
        assert exact_dedup.dedup(table, exact_dedup.DigestIndex(spark, f"test_odd{n}")).count() == table.count()


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent):
    sets = {n: sets_of(t) for n, t in rows}
    label = {n: n for n in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((label[a], label[b]))
                    label = {n: low if v == high else v for n, v in label.items()}
                    changed = True
    return {n: (len(sets[n]), label[n]) for n in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, docs, texts, percent):
    rnd = random.Random(percent)
    base = [str(n) for n in range(200)]
    rows = list(enumerate(texts))
    for n in range(120):  # one large group around a base, with chains and near misses
        words = list(base)
        for _ in range(rnd.randrange(0, 7)):
            words[rnd.randrange(200)] = f"w{rnd.random()}"
        rows.append((1000 + n, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got_rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table, percent).collect()}
    assert got_rows == brute_components(rows, percent)


def test_near_duplicates_of_shared_ids(spark):
    a, b = " ".join(str(n) for n in range(100)), " ".join(f"w{n}" for n in range(100))
    rows = [(5, a), (5, b), (6, a + " 100"), (7, b + " w100"), (8, "x"), (None, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    have = sorted((tuple(r) for r in minhash.near_duplicates(table).collect()), key=str)
    assert have == sorted([(5, 96, 5, True), (5, 96, 5, True), (6, 97, 5, False), (7, 97, 5, False), (8, 1, 8, True), (None, 96, None, True)], key=str)
    kept = {tuple(r) for r in minhash.keep(table).collect()}
    assert kept == {(5, a), (5, b), (8, "x")}


def test_many_members_meet_a_pivot_in_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FAN", 5)
    rnd = random.Random(1)
    base = [str(n) for n in range(120)]
    rows = [(n, " ".join([*base[:k], f"v{n}", *base[k + 1 :]])) for n, k in enumerate(rnd.choices(range(120), k=60))]
    have = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert have == brute_components(rows, 85)


def test_near_duplicates_odd_tables(empty, nulls, docs):
    assert minhash.near_duplicates(empty).count() == 0
    assert {tuple(r) for r in minhash.near_duplicates(nulls).collect()} == {(None, 0, None, True), (None, 1, None, True), (1, 0, 1, True)}
    assert minhash.keep(docs).columns == docs.columns


def test_signature_estimates_similarity():
    hashes = minhash.MinMax(85)
    rng = np.random.default_rng(2)
    error = []
    for share in (0.5, 0.85):
        both = rng.integers(0, 1 << 63, int(1000 * share), dtype=np.uint64)
        rest = rng.integers(0, 1 << 63, (2, (1000 - len(both)) // 2), dtype=np.uint64)
        a, b = (hashes.signature(np.unique(np.concatenate([both, r]))) for r in rest)
        error.append(abs((a == b).mean() - share))
    assert max(error) < 0.15 and 2 * hashes.functions >= hashes.bands * hashes.rows


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    pivot = np.unique(rng.integers(0, 1 << 40, 200))
    for _ in range(300):
        x = np.unique(np.concatenate([rng.choice(pivot, 170, False), rng.integers(0, 1 << 40, 20)]))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.06], rng.integers(0, 1 << 40, 6)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= 85 * (len(x) + len(y) - shared):
            assert len(np.intersect1d(minhash.prefix(x, [pivot, pivot[:50]], 85), minhash.prefix(y, [pivot, pivot[:50]], 85)))


def test_shingles(texts):
    for t in texts:
        assert len(shingles.shingle_set(t or "")) == len(sets_of(t))


# ---- op1 -----------------------------------------------------------------------------------------

def test_fingerprints(spark, docs, texts, empty, nulls):
    rows = fingerprint.edited(docs.where("doc_id <> 3"), docs_a_block=4).toPandas().sort_values("doc_id")
    given = [t or "" for n, t in enumerate(texts) if n != 3]
    after = given[1:] + given[:1]
    edits = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(given, after)]
    assert rows.n_chars.tolist() == [len(t) for t in given]
    assert rows.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edits]
    own = dict(zip(given, rows.fingerprint))
    by_lines = {}
    for t, f in zip(given, rows.fingerprint):
        assert own[t] == f
        assert by_lines.setdefault(tuple(sorted(t.split("\n"))) if t else (), f) == f  # order of lines is no matter
    assert len(set(by_lines.values())) == len(by_lines)
    long = [n for n, t in enumerate(given) if len(t.split()) > 30]
    assert np.mean([rows.near_edited.iloc[n] > rows.near_next.iloc[n] for n in long if given[n] != after[n]]) > 0.9
    assert rows.near_edited.between(0, 1).all() and rows.near_next.between(0, 1).all()
    assert fingerprint.edited(empty).count() == 0 and fingerprint.edited(nulls).count() == 3


def test_likeness_against_the_exact_cosine(spark):
    """``near_edited`` and ``near_next`` against the cosine of the word pairs' counts; the sketch's error is some 0.09."""
    rnd = random.Random(8)
    words = [f"w{n}" for n in range(30)]
    texts = ["\n".join(" ".join(rnd.choice(words) for _ in range(12)) for _ in range(6)) for _ in range(80)]
    rows = fingerprint.edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()

    def pairs(text):
        lines = [line.split() for line in text.split("\n")]
        return Counter(p for words in lines for p in [*zip(words, words[1:]), *words[-1:]])

    def cosine(a, b):
        x, y = pairs(a), pairs(b)
        return sum(x[p] * y[p] for p in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    errors = []
    for n, row in enumerate(rows):
        after = texts[(n + 1) % len(texts)]
        half = len(texts[n]) // 2
        edit = texts[n][: len(texts[n]) - half] + after[:half]
        errors += [row["near_edited"] - cosine(texts[n], edit), row["near_next"] - cosine(texts[n], after)]
    assert np.abs(errors).max() < 0.4 and np.sqrt(np.mean(np.square(errors))) < 0.12


@pytest.mark.parametrize("docs_a_block", [1, 4, 256])
def test_neighbours_of_clustered_and_shared_ids(spark, docs_a_block):
    rnd = random.Random(docs_a_block)
    ids = [rnd.choice([0, 1 << 40, -(1 << 50)]) + rnd.randrange(40) for _ in range(150)] + [None, None]
    rows = [(i, f"text {rnd.randrange(50)} " * rnd.randrange(1, 9)) for i in ids]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(((i, hashlib.sha256((t[: len(t) - len(t) // 2] + ordered[(n + 1) % len(rows)][1][: len(t) // 2]).encode()).hexdigest()) for n, (i, t) in enumerate(ordered)), key=str)
    have = fingerprint.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), docs_a_block=docs_a_block)
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in have.collect()), key=str) == want


def test_fingerprints_add_and_take_away(spark):
    rows = [(1, "one two\nthree four five"), (2, "one two"), (3, "three four five"), (4, "")]
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    t = spark.createDataFrame([(f[1], f[2], f[3])], "a string, b string, c string")
    r = t.select(fingerprint.combine(F.col("b"), F.col("c")).alias("sum"), fingerprint.combine(F.col("a"), F.col("b"), -1).alias("rest"), fingerprint.likeness(F.col("a"), F.col("a")).alias("one")).first()
    assert (r["sum"], r["rest"], r["one"]) == (f[1], f[3], 1.0)
    assert set(f[4]) == {"0"}


# ---- op3, op7 ------------------------------------------------------------------------------------

def test_minimize():
    a = np.diag([1.0, 10.0, 100.0])
    x = linear.minimize(lambda x: (float(x @ a @ x / 2 - x.sum()), a @ x - 1), np.zeros(3), steps=100)
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-4)


def test_toxicity_held_out(spark, sf):
    rows = queries.op3_toxicity(spark, sf.replace("sf0.001", "sf0.01"))
    marks = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/labels.parquet")
    held = rows.where("held_out").join(marks, "doc_id").toPandas()
    assert held.score.between(0, 1).all() and held[held.toxic == 1].score.mean() > 0.5 > held[held.toxic == 0].score.max() * 0.9
    assert rows.count() == 1000


def test_quality_held_out(spark, sf):
    rows = queries.op7_pairwise_quality(spark, sf.replace("sf0.001", "sf0.01"))
    marks = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/labels.parquet")
    held = rows.where("held_out").join(marks, "doc_id").toPandas()
    assert ((held.score >= quality.THRESHOLD).astype(int) == held.quality).mean() > 0.95


def test_toxicity_against_brute_force(texts):
    given = [t or "" for t in texts] + [f"you worthless {w} clown" for w in ("a", "b", "c", "d")]
    y = np.array([0] * len(texts) + [1] * 4)
    model = toxicity.fit(given, y.tolist())
    grams = [Counter(g for w in set(t.lower().split()) for piece in toxicity.words_of(w) for g in set(toxicity.ngrams(piece))) for t in given]
    have = toxicity.scores([Plain(t) for t in given], model)
    plain = [Counter(g for w in toxicity.words_of(t) for g in toxicity.ngrams(w)) for t in given]
    want = [1 / (1 + math.exp(-min(700, max(-700, model.bias + sum(n * model.weights.get(g, 0.0) for g, n in c.items()))))) for c in plain]
    assert np.allclose(have, want, atol=1e-9) and have[-4:].min() > 0.5 > have[:-4].max()
    # weights are log-count ratios times what the regression made of them; no other weights lower the loss
    names = sorted({g for c in grams for g in c})
    x = np.array([[c[g] for g in names] for c in grams], float)
    toxic, other = (y @ x + 1) / (y @ x + 1).sum(), ((1 - y) @ x + 1) / ((1 - y) @ x + 1).sum()
    ratio = np.where(x.sum(0) < toxicity.LEAST_TEXTS, 0.0, np.log(toxic / other))
    used = np.flatnonzero(ratio)
    assert set(model.weights) <= {names[n] for n in used}
    z = x[:, used] * ratio[used]

    def loss(p):
        s = p[0] + z @ p[1:]
        return float(linear.softplus(s).sum() - y @ s + toxicity.RIDGE / 2 * (p[1:] @ p[1:])), np.concatenate([[(linear.sigmoid(s) - y).sum()], z.T @ (linear.sigmoid(s) - y) + toxicity.RIDGE * p[1:]])

    own = np.array([model.bias, *[model.weights.get(names[n], 0.0) / ratio[n] for n in used]])
    best = linear.minimize(loss, np.zeros(len(used) + 1), steps=500)
    assert loss(own)[0] < 1.05 * loss(best)[0] + 1e-3


class Plain:
    def __init__(self, text):
        self.text = text

    def as_py(self):
        return self.text


def test_quality_against_brute_force(texts):
    rnd = random.Random(2)
    good = [" ".join(rnd.choice(["plain", "words", "of", "prose,", "here."]) for _ in range(rnd.randrange(20, 90))) for _ in range(60)]
    bad = [" ".join(rnd.choice(["%%%", "###", "BUY", "|", "99"]) for _ in range(rnd.randrange(20, 90))) for _ in range(30)]
    given, y = good + bad, np.array([1] * 60 + [0] * 30)
    model = quality.fit(given, y.tolist())
    f = np.array([quality.features(t) for t in given])
    for t, row in list(zip(given, f))[:: 9] + [("A a!\nA a!", np.array(quality.features("A a!\nA a!")))]:
        words, lines, n = t.split(), t.split("\n"), len(t)
        assert row[1] == sum(c.isupper() for c in t) / n and row[2] == sum(c.isdigit() for c in t) / n and row[3] == sum(c in "!?" for c in t) / n
        assert row[4] == sum(a == b for a, b in zip(words, words[1:])) / len(words) and row[5] == len(set(words)) / len(words) and row[6] == 1 - len(set(lines)) / len(lines)
    # the pairs' logistic loss has its least value at the weights, and the cut is the quantile of the share labelled 0
    x = (quality.expand(f) - model.mean) / model.spread
    rng = np.random.default_rng(quality.SEED)
    d = x[rng.choice(np.flatnonzero(y == 1), quality.PAIRS)] - x[rng.choice(np.flatnonzero(y == 0), quality.PAIRS)]
    slope = -(linear.sigmoid(-(d @ model.weights)) @ d) / len(d) + quality.RIDGE * model.weights
    assert np.abs(slope).max() < 1e-3
    raw = x @ model.weights
    assert (raw < model.cut).sum() == 30 and ((model.score(f) >= quality.THRESHOLD) == (raw >= model.cut)).all()


def test_classifiers_on_odd_tables(docs, empty, nulls, labels):
    none = labels.where("false")
    for module in (toxicity, quality):
        for table in (docs, empty, nulls):
            for marks in (labels, none):
                rows = module.classify(table, marks).collect()
                assert len(rows) == table.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_long_words_keep_their_ngrams():
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    whole = set(toxicity.ngrams(word)) - {g for g in toxicity.ngrams(word) if " " in g}
    assert whole <= {g for w in toxicity.words_of(word) for g in toxicity.ngrams(w)}


# ---- op6 -----------------------------------------------------------------------------------------

def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 5), (1, 1), (3, 7), (700, 701), (900, 1 << 64), (50_000, 1 << 40)):
        values = np.unique(rng.integers(0, min(universe, (1 << 64) - 1), n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        level = EliasFano.build(values, universe)
        assert (level.get(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, rng.integers(0, min(universe, (1 << 64) - 1), 300, dtype=np.uint64)])
        at, equal = level.find(asked)
        assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_trie(tmp_path):
    rng = np.random.default_rng(3)
    word, context = np.sort(rng.integers(0, 50, 900).astype(np.uint64) << np.uint64(50)), rng.integers(0, 70, 900).astype(np.uint64) << np.uint64(48)
    order = np.lexsort((context, word))
    both = np.unique(np.stack([word[order], context[order]], 1), axis=0)
    value = -rng.random(len(both)) * 9
    NgramTrie.build(both[:, 0], both[:, 1], value).save(f"{tmp_path}/t")
    trie = NgramTrie.open(f"{tmp_path}/t")
    found_value, found = trie.lookup(both[:, 0], both[:, 1])
    assert found.all() and np.abs(found_value - value).max() < 1e-4
    assert not trie.lookup(both[:, 0], both[:, 1] + np.uint64(1))[1].any()
    assert (trie.successors(int(both[5, 0])) == both[both[:, 0] == both[5, 0], 1]).all()


def brute_lm(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for _, t in rows]
    train = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for i, _ in rows]
    one, two = Counter(), Counter()
    for words, used in zip(tokens, train):
        if used:
            one.update(words)
            two.update(zip(["<s>", *words], words))
    n, v, d = sum(one.values()), len(one), sum(train)
    z = n + 0.5 * (v + 1)
    out = []
    for (i, _), words, used in zip(rows, tokens, train):
        base = sum(math.log10((one[w] + 0.5) / z) for w in words)
        score = sum(math.log10((two[h, w] + lm.MU * (one[w] + 0.5) / z) / ((d if h == "<s>" else one[h]) + lm.MU)) for h, w in zip(["<s>", *words], words))
        out.append((i, not used, len(words), sum(one[w] > 0 for w in words), n, base, score))
    return sorted(out, key=str)


def test_lm(spark, docs, texts, empty, nulls, monkeypatch):
    for table in (docs, nulls):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        want = brute_lm(rows)
        have = sorted((tuple(r) for r in lm.train_and_score(table).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
        assert [x[:5] for x in sorted(have, key=lambda x: str(x[:5]))] == [x[:5] for x in sorted(want, key=lambda x: str(x[:5]))]
        for x, y in zip(sorted(have, key=lambda x: (str(x[0]), x[2])), sorted(want, key=lambda x: (str(x[0]), x[2]))):
            assert abs(x[5] - y[5]) < 1e-6 and abs(x[6] - y[6]) < 1e-4 * x[2] + 1e-9
    assert lm.train_and_score(empty).count() == 0


def test_saved_lm(spark, docs, nulls, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)  # so that there are several shards, hot words and chunks
    monkeypatch.setattr(lm, "CHUNK_DOCS", 9)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    plain = got(lm.train_and_score(docs), *columns)
    trained = got(lm.train_and_score(docs, f"{tmp_path}/model"), *columns)
    again = got(lm.score(docs, f"{tmp_path}/model"), *columns)
    want = sorted(brute_lm([(r["doc_id"], r["text"]) for r in docs.collect()]))
    for rows in (plain, trained, again):
        assert [r[:5] for r in rows] == [r[:5] for r in want]
        assert all(abs(x[5] - y[5]) < 1e-6 and abs(x[6] - y[6]) < 1e-4 * x[2] + 1e-9 for x, y in zip(rows, want))
    assert lm.score(empty, f"{tmp_path}/model").count() == 0
    unknown = spark.createDataFrame([(5, "never seen words")], "doc_id long, text string")
    r = lm.score(unknown, f"{tmp_path}/model").first()
    assert (r["n_tokens"], r["n_known"]) == (4, 1) and r["score"] < 0
    lm.train_and_score(empty, f"{tmp_path}/none").count()
    assert lm.score(nulls, f"{tmp_path}/none").where("n_known = 0 and train_tokens = 0").count() == 3


# ---- op10 ----------------------------------------------------------------------------------------

def test_token_rollup(spark, docs, nulls, tmp_path):
    schema = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, op string, seq long"
    table = lambda rows: spark.createDataFrame(rows, schema)
    rollup = token_counts.TokenRollup(spark, f"{tmp_path}/rollup")
    assert rollup.totals().count() == 0
    assert rollup.commit(1, table([(1, "a", "en", "v1", 10, "insert", 0), (2, "a", "en", "v1", 5, "insert", 0), (3, None, "fr", "v1", 7, "insert", 0), (1, "a", "en", "v1", 10, "insert", 0)]))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "v1", 2, 15), (None, "fr", "v1", 1, 7)}
    second = table([(1, "b", "en", "v1", 12, "revise", 0), (2, None, None, "v1", None, "delete", 0), (9, None, None, "v1", None, "delete", 0), (3, None, "fr", "v2", 70, "insert", 0)])
    assert rollup.commit(2, second) and not rollup.commit(2, second)
    assert {tuple(r) for r in rollup.totals().collect()} == {("b", "en", "v1", 1, 12), (None, "fr", "v1", 1, 7), (None, "fr", "v2", 1, 70)}
    assert rollup.commit(3, table([])) and rollup.totals().count() == 3
    rollup.commit(4, table([(2, "a", "en", "v1", 4, "insert", 0), (2, "a", "en", "v1", 6, "insert", 1)]))  # the later change counts
    assert ("a", "en", "v1", 1, 6) in {tuple(r) for r in rollup.totals().collect()}
    ledger = rollup.ledger().where("alive").groupBy("source", "lang", "tokenizer_version").agg(F.count(F.lit(1)), F.sum("n_tokens"))
    assert {tuple(r) for r in ledger.collect()} == {tuple(r) for r in rollup.totals().collect()}
    with pytest.raises(ValueError):
        rollup.commit(0, second)
    assert token_counts.counted(nulls, {"a": public("byte_bpe_50k.json"), "b": public("word_bpe_49k.json")}).count() == 6


def test_compacted_rollup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "COMPACT_EVERY", 2)
    schema = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, op string, seq long"
    rollup = token_counts.TokenRollup(spark, f"{tmp_path}/compact")
    for batch in range(1, 6):
        rows = [(n, "a", None, "v", n + batch, "revise", 0) for n in range(batch)] + [(batch - 2, None, None, "v", None, "delete", 1)]
        assert rollup.commit(batch, spark.createDataFrame(rows, schema))
    assert rollup._marks("snapshots") == [2, 4]
    live = {n: n + 5 for n in range(5) if n != 3}
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", None, "v", len(live), sum(live.values()))]
    assert {r["doc_id"]: r["n_tokens"] for r in rollup.ledger().where("alive").collect()} == live


def test_rollup_query_against_the_library(spark, docs, texts, empty, nulls, tmp_path):
    from tokenizers import Tokenizer

    library = {name: Tokenizer.from_file(public(f"{name}.json")) for name in ("word_bpe_49k", "byte_bpe_50k")}
    for n, table in enumerate((docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "fr").when(F.col("doc_id") % 3 == 1, "en")), nulls, empty)):
        # several rows of one id: the one with the larger count is the document
        best: dict = {}
        for r in table.collect():
            for name, t in library.items():
                best[r["doc_id"], name] = max(best.get((r["doc_id"], name), (-1, "", "")), (len(t.encode(r["text"] or "", add_special_tokens=False).ids), r["source"] or "", r["lang"] or ""))
        want = Counter()
        docs_of = Counter()
        for (_, name), (count, source, lang) in best.items():
            if name == "byte_bpe_50k" or lang in ("en", ""):
                docs_of[source, lang, name] += 1
                want[source, lang, name] += count + (name == "word_bpe_49k")
        have = {(r["source"] or "", r["lang"] or "", r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in queries.rolled_up(token_counts.TokenRollup(spark, f"{tmp_path}/r{n}"), table).collect()}
        assert have == {k: (docs_of[k], want[k]) for k in want}


def test_interrupted_batch_counts_once(spark, tmp_path):
    schema = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, op string, seq long"
    rollup = token_counts.TokenRollup(spark, f"{tmp_path}/broken")
    rows = spark.createDataFrame([(1, "a", "en", "v1", 10, "insert", 0)], schema)
    rows.write.parquet(f"{tmp_path}/broken/deltas/batch-1")  # left by a run that was broken off before its commit
    assert rollup.totals().count() == 0 and rollup.commit(1, rows)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 10)]


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Beyond what the driver fits, all pairs of all labelled rows count, and the cut is the exact rank among all of them."""
    from linkloom.llm import labelled

    rng = np.random.default_rng(5)
    rows = [(n, " ".join(rng.choice(["plain", "words", "Of", "prose,", "and", "more"], 30 + n % 40)) + (" ### %% 77 !!" * int(rng.integers(1, 9)) if rng.random() < (0.8 if n % 3 == 0 else 0.15) else "")) for n in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(n, int(n % 3 > 0)) for n, _ in rows], "doc_id long, quality int")
    monkeypatch.setattr(quality, "TOGETHER", 50)
    monkeypatch.setattr(quality, "SCORES", 20)
    model = quality.train(docs, labels)
    kept = {r["k"] for r in labelled.marks(labels, "quality").collect()}
    f = np.array([quality.features(t) for n, t in rows if n in kept])
    y = np.array([int(n % 3 > 0) for n, _ in rows if n in kept])
    assert 50 < len(f) <= quality.GROUP
    x = (quality.expand(f) - model.mean) / model.spread
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, x.shape[1])
    slope = -(linear.sigmoid(-(d @ model.weights)) @ d) / len(d) + quality.RIDGE * model.weights
    assert np.abs(slope).max() < 1e-5 and np.allclose(x.mean(0), 0, atol=1e-9)
    s, bad = np.sort(model.raw(f)), int((y == 0).sum())
    assert model.cut == pytest.approx((s[bad - 1] + s[bad]) / 2, abs=1e-12)
    monkeypatch.setattr(quality, "GROUP", 64)
    parted = quality.train(docs, labels)
    assert np.corrcoef(parted.raw(f), s[np.argsort(np.argsort(model.raw(f)))])[0, 1] > 0.98
