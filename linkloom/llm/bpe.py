"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a prefix is fixed by its last token: for every prefix exactly one token
t ends it such that t follows the last token u of the shorter prefix and (u, t) is
compatible, i.e. BPE of the two tokens' bytes gives back these two tokens.  Going over a piece
once, an automaton of the vocabulary reports at each position the tokens that are
suffixes of the prefix; the compatible one is stored, and back-pointers from the end emit
the ids.  Time is linear in the piece for any input, whereas merging can be quadratic.

Pairs are tested by walking back the merges of both tokens: a pair is incompatible
if some merge across the boundary would have been applied before the merge that
removed its left or right part.  Tests are kept in a bounded dictionary, and so are encodings of
chunks up to 64 characters.

Needs a vocabulary in which every token is the encoding of its own bytes; ``ByteBpe``
leaves out of the automaton any token that no merge makes.

Defined results: null text is empty; an empty text has no ids and decodes to "";
repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

CACHED_CHUNKS = 400_000
CACHED_PIECES = 1_600_000
CACHED_PAIRS = 300_000
LONGEST_CACHED = 64
_LINES = re.compile(r"\n(?=\S)")
_WORDS = re.compile(r" (?=\S)")
#: The byte-level pattern, its classes spelled out; a fixed value of the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and digits that regex knows but the vocabulary's splitter (Unicode 16) does not; fixed values.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The format's printable character for each byte: visible Latin-1 stands for itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        ids = model["vocab"]
        size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * size
        for token, n in ids.items():
            self.bytes_of[n] = raw(token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, n in self.special.items():
            self.bytes_of[n] = content.encode()
        #: Rank of the merge of two ids; the parts and the rank of the merge that makes an id.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: list[int] = [-1] * size
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.rank[a, b] = n
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (a, b), n
        automaton = ahocorasick.Automaton()
        for token, n in ids.items():
            if n in self.parts or len(token) == 1:
                automaton.add_word(raw(token).decode("latin-1"), (len(token), n))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.single = [0] * 256
        for token, n in ids.items():
            if len(token) == 1:
                self.single[raw(token)[0]] = n
        self.pieces = regex.compile(PATTERN).findall
        newer = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER)
        self.has_newer = regex.compile(f"[{newer}]").search
        strict = PATTERN.replace(r"\p{L}+", rf"(?:(?![{newer}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{newer}])\p{{N}})+")
        self.strict_pieces = regex.compile(strict.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[{newer}]|[^\s\p{{L}}\p{{N}}])+")).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Two generations each: the older is dropped when the younger is full.
        self.chunks: dict[str, list[int]] = {}
        self.old_chunks: dict[str, list[int]] = {}
        self.young_pieces: dict[str, list[int]] = {}
        self.old_pieces: dict[str, list[int]] = {}

    def compatible(self, u: int, t: int) -> bool:
        """Whether BPE of the bytes of u and t gives u, t."""
        known = self.pairs.get((u, t))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[u, t] = self._compatible(u, t)
        return known

    def _compatible(self, u: int, t: int) -> bool:
        # From the two whole tokens back in time to the two bytes at the boundary. A state (a, b)
        # ends when the merge is applied that swallows a or b; merges go by rank, equal ranks from
        # left to right. A merge of a and b that would come sooner makes the pair impossible.
        rank, made, parts = self.rank, self.made, self.parts
        a, b, ends, by_left = u, t, len(self.rank), True
        while True:
            cross = rank.get((a, b))
            if cross is not None and (cross < ends or cross == ends and not by_left):
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:
                ends, by_left, a = made[a], True, parts[a][1]
            else:
                ends, by_left, b = made[b], False, parts[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: the last token of each prefix, then back from the end."""
        if len(piece) == 1:
            return [self.single[piece[0]]]
        last = [-1] * (len(piece) + 1)
        tested, test = self.pairs.get, self.compatible
        for end, (length, token) in self.matches(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            before = end - length
            if before:
                u = last[before]
                if u < 0 or not (test(u, token) if (known := tested((u, token))) is None else known):
                    continue
            last[end] = token
        out, at = [], len(piece)
        while at:
            token = last[at]
            out.append(token)
            at -= len(self.bytes_of[token])
        out.reverse()
        return out

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        old, older = self.young_pieces, self.old_pieces
        for piece in self.pieces(text) if text.isascii() or not self.has_newer(text) else self.strict_pieces(text):
            ids = old.get(piece) or older.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= LONGEST_CACHED:
                    old[piece] = ids
            out += ids
        if len(old) >= CACHED_PIECES // 2:
            self.old_pieces, self.young_pieces = old, {}
        return out

    def _chunk(self, chunk: str) -> list[int]:
        ids = self.old_chunks.get(chunk)
        if ids is None:
            ids = self._plain(chunk)
        if len(chunk) <= LONGEST_CACHED:
            if len(self.chunks) >= CACHED_CHUNKS // 2:
                self.old_chunks, self.chunks = self.chunks, {}
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids as the tokenizers library gives them without added special tokens."""
        if not text:
            return []
        out: list[int] = []
        for n, part in enumerate(self.split_special(text) if self.split_special else [text]):
            if n % 2:
                out.append(self.special[part])
            elif part:
                self._words(part, out)
        return out

    def _words(self, text: str, out: list[int]) -> None:
        # A space before a character that isn't white space opens a piece, and so does a line
        # end before one, which is a piece of its own: chunks between them are encoded alone.
        one = self._chunk
        chunks: list[str] = []
        for line in text.split("\n"):
            words = line.split(" ")
            chunks.append(words[0])
            chunks += [" " + w for w in words[1:]]
            chunks.append("\n")
        chunks.pop()
        found = list(map(self.chunks.get, chunks))
        if None in found:
            unseen = [c for c, ids in zip(chunks, found) if ids is None]
            if any(not c or c[1:2].isspace() or c == " " or c[0].isspace() and c[0] not in " \n" for c in unseen):
                chunks = []
                for line in _LINES.split(text):
                    first, *words = _WORDS.split(line)
                    chunks.append(first)
                    chunks += [" " + w for w in words]
                    chunks.append("\n")
                chunks.pop()
                for c in chunks:
                    out += self._plain(c)
                return
            found = [one(c) if ids is None else ids for c, ids in zip(chunks, found)]
        for ids in found:
            out += ids

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that aren't UTF-8 become U+FFFD, special tokens are kept."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    """One codec for each vocabulary in a worker."""
    return ByteBpe(path)


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    common.take_over("bpe")
    bpe = codec(path)
    decimal = [str(n) for n in range(len(bpe.bytes_of))]
    for batch in batches:
        counts, ids_sha, text_sha = [], [], []
        for text in batch.column(1):
            ids = bpe.encode(text.as_py())
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path)
    for batch in batches:
        ids = pa.array([bpe.encode(text.as_py()) for text in batch.column(1)], pa.list_(pa.int32()))
        yield pa.record_batch([batch.column(0), ids], names=["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path)
    for batch in batches:
        texts = pa.array([bpe.decode(ids.as_py() or []) for ids in batch.column(1)], pa.string())
        yield pa.record_batch([batch.column(0), texts], names=["doc_id", "text"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    common.ship(docs.sparkSession)

    def run(batches):
        from linkloom.llm.bpe import _encoded

        return _encoded(batches, path)

    return common.id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids are no ids."""
    common.ship(encoded.sparkSession)

    def run(batches):
        from linkloom.llm.bpe import _decoded

        return _decoded(batches, path)

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode, and digest both, in one pass: ids themselves need not leave the worker."""
    common.ship(docs.sparkSession)

    def run(batches):
        from linkloom.llm.bpe import _digests

        return _digests(batches, path)

    return common.id_text(docs).mapInArrow(run, _SCHEMA)
