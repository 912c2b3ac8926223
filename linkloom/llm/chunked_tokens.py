"""Exact token ids of a tokenizers file, word by word, with a bounded cache in each Python worker.

A text is cut before every space and around every line end that is followed by a character
which is not white space.  Neither vocabulary has a token that crosses such a place: the
byte-level pattern opens a new piece there, the word pattern drops white space
altogether.  So the ids of a text are the ids of its chunks in order.  A closing mark after letters is a piece of its own
as well.  Texts are cut and their chunks numbered by Arrow, some megabytes at a time; each distinct chunk, without
its closing mark, is looked up in a dictionary and the library is asked only for what was not
seen before; a gather by number lays out the ids.  The dictionary
has two generations of half its ``entries``; the older one is dropped when the
younger one is full, which bounds memory and changes no result.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_ENTRIES = 800_000
LONGEST_CACHED = 64
#: Bytes of texts that are cut at once (or one longer text).
SLICE_BYTES = 8_000_000
#: Marks the first chunk of a line; texts that hold it are not cut.
_FIRST = "\x01"
_TAILS = ",.;:!?"
_LINES = re.compile(r"\n(?=\S)")
_WORDS = re.compile(r" (?=\S)")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _own(given: pa.LargeStringArray, table: np.ndarray | None = None) -> pa.LargeStringArray:
    """A slice as an array of its own, its bytes mapped by ``table``: not every kernel is right on slices (pyarrow's ascii_lower)."""
    if not len(given):
        return given
    ends = np.frombuffer(given.buffers()[1], np.int64)[given.offset : given.offset + len(given) + 1]
    data = np.frombuffer(given.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return pa.LargeStringArray.from_buffers(len(given), pa.py_buffer(ends - ends[0]), pa.py_buffer(data if table is None else table[data]))


def _strings(given: pa.Array) -> list[str]:
    return given.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


def _slices(texts):
    """Arrays of their own of about ``SLICE_BYTES``."""
    given = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    sizes = pc.binary_length(given).to_numpy(zero_copy_only=False).cumsum()
    low = 0
    while low < len(given):
        before = int(sizes[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield _own(given.slice(low, high - low))
        low = high


class ChunkEncoder:
    """``encode(texts)`` gives for each text the little-endian ids as bytes (``dtype``)."""

    def __init__(self, path: str, dtype: str = "<u4", entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype(dtype)
        self.entries = entries
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.size > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"{dtype} can't hold {self.size} ids")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: Cutting is proven for these two forms; any other file is encoded text by text.
        before = json.dumps(spec.get("pre_tokenizer") or {})
        self.by_chunk = '"ByteLevel"' in before and '"add_prefix_space": false' in before and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        #: Their strings end a piece wherever they stand, so texts that hold one are not cut.
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.tails = {c: self._raw([c])[0] for c in _TAILS}
        # for chunks of letters: the model with the byte alphabet alone, lines as pieces
        self.lower = '"Lowercase"' in json.dumps(spec.get("normalizer") or {})
        letters = "a-zß-öø-ÿ" if self.lower else "A-Za-zÀ-ÖØ-öø-ÿ"
        self.plain = re.compile(f"[{letters}]+").fullmatch
        self.closed = f"^(?P<stem>{_FIRST}?[{letters}]+)(?P<tail>[{_TAILS}]?)$"
        self.space = "" if self.lower else " "
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.lean = Tokenizer(self.tokenizer.model)  # shares the vocabulary
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), byte_level])
        # ASCII letters stand for themselves in the byte alphabet, so text in that alphabet needs no mapping
        (line, _), (space, _) = byte_level.pre_tokenize_str("\n")[0], byte_level.pre_tokenize_str(" ")[0]
        self.leaner = Tokenizer(self.tokenizer.model)
        self.leaner.pre_tokenizer = pre_tokenizers.Split(line, "isolated")
        self.mapped_line, self.mapped_space = line, space
        ends = [self.lean.encode("\n", add_special_tokens=False).ids, self.leaner.encode(line, add_special_tokens=False).ids]
        self.by_chunk = self.by_chunk and len(ends[0]) == 1 and ends[0] == ends[1]
        self.line = ends[0][0]
        self.line_end = self._raw(["\n"])[0]
        self.young: dict[str, bytes] = {"\n": self.line_end}
        self.old: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks of letters only, from texts with one on each line: the library's own model, without its splitting."""
        out: list[bytes] = [b""] * len(words)
        width = self.dtype.itemsize
        ascii_ = [n for n, w in enumerate(words) if w.isascii()]
        rest = [n for n, w in enumerate(words) if not w.isascii()]
        for places, library, line, space in ((ascii_, self.leaner, self.mapped_line, self.space and self.mapped_space), (rest, self.lean, "\n", self.space)):
            for i in range(0, len(places), 4000):
                some = places[i : i + 4000]
                text = line.join([w[1:] if w[0] == _FIRST else space + w for w in map(words.__getitem__, some)])
                ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
                raw = ids.tobytes()
                ends = (np.append(np.flatnonzero(ids == self.line), len(ids)) * width).tolist()
                starts = [0, *[e + width for e in ends[:-1]]]
                for n, x, y in zip(some, starts, ends):
                    out[n] = raw[x:y]
        return out

    def encode(self, texts) -> list[bytes]:
        """Of a list or an Arrow array of strings without nulls."""
        if not self.by_chunk:
            return self._raw(texts if isinstance(texts, list) else texts.to_pylist())
        out: list[bytes] = []
        for given in _slices(texts):
            whole, known, lengths, numbers, edges = self._parts(given)
            pool = np.frombuffer(b"".join(known), self.dtype)
            starts = np.cumsum(lengths) - lengths
            size = lengths[numbers]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            raw = pool[np.repeat(starts[numbers] - (ends - size), size) + np.arange(total)].tobytes()
            at = (np.r_[0, ends][edges] * self.dtype.itemsize).tolist()
            out += [whole[n] if n in whole else raw[a:b] for n, (a, b) in enumerate(zip(at, at[1:]))]
        return out

    def count(self, texts) -> np.ndarray:
        """Numbers of ids of a list or an Arrow array of strings without nulls."""
        if not self.by_chunk:
            return np.array([len(raw) for raw in self.encode(texts)], np.int64) // self.dtype.itemsize
        out = [np.zeros(0, np.int64)]
        for given in _slices(texts):
            whole, _, lengths, numbers, edges = self._parts(given)
            counts = np.diff(np.r_[0, np.cumsum(lengths[numbers])][edges])
            for n, raw in whole.items():
                counts[n] = len(raw) // self.dtype.itemsize
            out.append(counts)
        return np.concatenate(out)

    def _parts(self, given: pa.Array) -> tuple[dict[int, bytes], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(ids of texts that aren't cut; ids and their number of each distinct chunk; chunks by number; where each text's chunks begin and end)."""
        folded = _own(given, _LOWER) if self.lower else given
        odd = pc.match_substring(folded, _FIRST)
        for special in self.specials:
            odd = pc.or_(odd, pc.match_substring(folded, special))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        whole = dict(zip(odd.tolist(), self._raw([given[n].as_py() for n in odd.tolist()]))) if len(odd) else {}
        marked = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.replace_substring(folded, "\n", f" \n {_FIRST}"), pa.scalar(_FIRST, pa.large_string()))
        cut = pc.split_pattern(marked, " ")
        numbered = cut.flatten().dictionary_encode()
        numbers = numbered.indices.to_numpy()
        edges = cut.offsets.to_numpy() - cut.offsets[0].as_py()

        # a distinct chunk is letters with or without a closing mark, or anything else
        parts = pc.extract_regex(numbered.dictionary, self.closed)
        closed = parts.is_valid()
        stem = pc.struct_field(parts, "stem").filter(closed).dictionary_encode()
        tail = pc.struct_field(parts, "tail").filter(closed).dictionary_encode()
        closed = closed.to_numpy(zero_copy_only=False)
        stems, others = _strings(stem.dictionary), _strings(numbered.dictionary.filter(pa.array(~closed)))
        plain, uncut = self._known(stems, True), []
        # white space before white space, which is never cut there: such texts are cut more carefully
        uncut = [n for n, c in enumerate(others) if not c or c == _FIRST or c[0].isspace() and c != "\n"]
        for n in uncut:
            others[n] = "\n"
        known: list = [None] * len(closed)
        marks = [self.tails[t] if t else b"" for t in tail.dictionary.to_pylist()]
        for n, x, y in zip(np.flatnonzero(closed).tolist(), stem.indices.to_numpy().tolist(), tail.indices.to_numpy().tolist()):
            known[n] = plain[x] + marks[y]
        rest = np.flatnonzero(~closed)
        for n, ids in zip(rest.tolist(), self._known(others, False)):
            known[n] = ids
        if uncut:
            bad = np.zeros(len(closed), bool)
            bad[rest[uncut]] = True
            docs = np.unique(np.searchsorted(edges, np.flatnonzero(bad[numbers]), side="right") - 1)
            docs = [d for d in docs.tolist() if d not in whole]
            whole.update(zip(docs, self._carefully([given[d].as_py() for d in docs])))
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        return whole, known, lengths, numbers, edges

    def _known(self, chunks: list[str], plain: bool) -> list[bytes]:
        """Ids of distinct chunks, ``plain`` ones of letters only."""
        found = list(map(self.young.get, chunks))
        missing = [n for n, ids in enumerate(found) if ids is None]
        if missing and self.old:
            for n in missing:
                found[n] = self.old.get(chunks[n])
            new = [n for n in missing if found[n] is None]
        else:
            new = missing
        asked = [chunks[n] for n in new]
        if plain:
            answers = self._plain_words(asked)
        else:
            answers = []
            for i in range(0, len(asked), 20_000):
                answers += self._raw([c[1:] if c[0] == _FIRST else c if c == "\n" else " " + c for c in asked[i : i + 20_000]])
        for n, ids in zip(new, answers):
            found[n] = ids
        if len(self.young) + len(missing) > self.entries // 2:
            self.old, self.young = self.young, {}
        for i in range(0, len(missing), max(1, self.entries // 2)):  # more than a generation holds: the last ones stay
            if i:
                self.young = {}
            self.young.update({chunks[n]: found[n] for n in missing[i : i + self.entries // 2] if len(chunks[n]) <= LONGEST_CACHED})
        return found

    def _carefully(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            chunks: list[str] = []
            for line in _LINES.split(text):
                parts = _WORDS.split(line)
                parts[0] = _FIRST + parts[0]
                chunks += parts
                chunks.append("\n")
            cut.append(chunks[:-1])
        distinct = sorted({c for chunks in cut for c in chunks})
        ids = dict(zip(distinct, self._known(distinct, False)))
        return [b"".join([ids[c] for c in chunks]) for chunks in cut]


@lru_cache(maxsize=4)
def encoder(path: str, dtype: str = "<u4", entries: int = CACHE_ENTRIES) -> ChunkEncoder:
    """One encoder for each file in a worker."""
    return ChunkEncoder(path, dtype, entries)
