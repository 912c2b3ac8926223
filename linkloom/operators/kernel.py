"""Blocks of records compared as matrices: the metrics of `clusters.similarity` for all pairs of two parts of a key's records at once.

A block is what `skew.blocks_within` deals out: the records of part ``i`` and of part ``j`` of a key.  Its pairs are those of
`skew.pairs_within`; they never become rows unless they are asked for, so linking and means cost no shuffle of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import lexicon

#: Pairs that are compared at once.
TILE = 1_000_000
#: A word shared by more than this part of a tile's pairs is counted by a matrix product, others by their lists.
DENSE = 0.004
SETS = ("tokens", "topics", "hints", "path", "site", "domain_tokens", "kinds", "quality", "times")


class Members:
    """Sets of all rows of a block as sorted (row, word) entries."""

    def __init__(self, rows: np.ndarray, words: np.ndarray, n: int, width: int):
        flat = np.sort(rows * width + words)
        flat = flat[np.concatenate([[True], flat[1:] != flat[:-1]])] if len(flat) else flat
        self.n, self.width = n, width
        self.rows, self.words = flat // width, flat % width
        self.sizes = np.bincount(self.rows, minlength=n)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.listed: tuple = (None,)

    def part(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[lo], self.starts[hi]
        return self.rows[a:b] - lo, self.words[a:b]

    def lists(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each word is in these rows, where its list begins, and the lists' rows; kept for the tiles that follow."""
        if self.listed[0] != (lo, hi):
            rows, words = self.part(lo, hi)
            often = np.bincount(words, minlength=self.width)
            self.listed = ((lo, hi), often, np.concatenate([[0], np.cumsum(often)]), rows[np.argsort(words, kind="stable")])
        return self.listed[1:]

    def __or__(self, other: Members) -> Members:
        return Members(np.concatenate([self.rows, other.rows]), np.concatenate([self.words, other.words]), self.n, self.width)

    def kinds(self) -> np.ndarray:
        """A number for each row; equal sets have equal numbers."""
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(self.words[a:b].tobytes(), len(seen)) for a, b in zip(self.starts, self.starts[1:])], np.int64)


def shared(s: Members, x: tuple[int, int], y: tuple[int, int]) -> np.ndarray:
    """How many words each row of ``x`` has in common with each row of ``y``."""
    nx, ny = x[1] - x[0], y[1] - y[0]
    (xr, xw), (yr, yw) = s.part(*x), s.part(*y)
    fy, begin, listed = s.lists(*y)
    fx = np.bincount(xw, minlength=s.width)
    often = fx * fy
    dense = np.flatnonzero(often > DENSE * nx * ny)
    out = np.zeros((nx, ny), np.float32)
    if len(dense):
        spot = np.full(s.width, -1)
        spot[dense] = np.arange(len(dense))
        a, b = np.zeros((nx, len(dense)), np.float32), np.zeros((ny, len(dense)), np.float32)
        for m, r, w in ((a, xr, spot[xw]), (b, yr, spot[yw])):
            m[r[w >= 0], w[w >= 0]] = 1
        out += a @ b.T
        often[dense] = 0
    rare = often[xw] > 0
    if rare.any():
        xr, xw = xr[rare], xw[rare]
        times = fy[xw]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        met = listed[np.repeat(begin[xw], times) + step]
        out += np.bincount(np.repeat(xr, times) * ny + met, minlength=nx * ny).reshape(nx, ny)
    return out


def jaccard(s: Members, x: tuple[int, int], y: tuple[int, int]) -> np.ndarray:
    both = shared(s, x, y).astype(np.float64)
    union = s.sizes[x[0] : x[1], None] + s.sizes[None, y[0] : y[1]] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


class Block:
    """The rows of a block: those of part i, then those of part j, each by id."""

    def __init__(self, table: pa.Table, columns: tuple[str, ...]):
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        order = np.lexsort((table["id"].to_numpy(), table["part"].to_numpy()))
        table = table.take(order).combine_chunks()
        self.table, self.n, self.ids = table, table.num_rows, table["id"].to_numpy()
        first = int((table["part"].to_numpy() == i).sum())
        self.x, self.y = (0, first), ((0, first) if i == j else (first, self.n))
        flats, rows = [], []
        for c in columns:
            cells = table[c].combine_chunks()
            flats.append(cells.flatten())
            rows.append(np.repeat(np.arange(self.n), pc.fill_null(pc.list_value_length(cells), 0).to_numpy()))
        self.dictionary, codes = [], []
        if columns:
            coded = pa.chunked_array(flats).combine_chunks().dictionary_encode()
            self.dictionary, codes = coded.dictionary.to_pylist(), np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(r) for r in rows])[:-1])
        width = len(self.dictionary) + 1
        self.sets = {c: Members(r, w, self.n, width) for c, r, w in zip(columns, rows, codes)}
        earlier = table["before"].combine_chunks()
        coded = earlier.flatten().dictionary_encode()
        self.before = Members(np.repeat(np.arange(self.n), pc.list_value_length(earlier).to_numpy()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), self.n, len(coded.dictionary) + 1)

    def tiles(self) -> Iterator[tuple[tuple[int, int], tuple[int, int], np.ndarray]]:
        """Rows against rows, and which of these pairs belong to the block."""
        own = self.x == self.y
        step = max(1, TILE // max(1, self.y[1] - self.y[0]))
        for lo in range(self.x[0], self.x[1], step):
            x = (lo, min(lo + step, self.x[1]))
            y = (lo, self.y[1]) if own else self.y
            asked = np.ones((x[1] - x[0], y[1] - y[0]), bool)
            if own:
                asked &= self.ids[x[0] : x[1], None] < self.ids[None, y[0] : y[1]]
            if len(self.before.words):
                asked &= shared(self.before, x, y) == 0
            if asked.any():
                yield x, y, asked

    def codes(self, column: str, blank: bool = False) -> np.ndarray:
        """A number for each row's value; -1 for null, and for the empty string unless ``blank``."""
        coded = self.table[column].combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        out = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return out if blank or "" not in names else np.where(out == names.index(""), -1, out)


class Similarity:
    """What `clusters.similarity` gives, for tiles of a block."""

    def __init__(self, block: Block):
        b, t = block, block.table
        self.block, s = block, block.sets
        self.texts = (s["tokens"] | s["topics"], s["path"] | s["tokens"] | s["hints"])
        ours = np.array([n for n, w in enumerate(b.dictionary) if w in (lexicon.OFFICIAL, lexicon.COMMUNITY)], np.int64)

        def quality(q, x, y):
            marked = np.isin(q.words, ours)
            named = Members(q.rows[marked], q.words[marked], q.n, q.width)
            return np.maximum(jaccard(q, x, y), np.where(shared(named, x, y) > 0, 0.7, np.where(shared(q, x, y) > 0, 0.5, 0.0)))

        meet = lambda k, x, y: (shared(k, x, y) > 0).astype(np.float64)
        self.few = {name: self._few(s[name], how) for name, how in (("site", jaccard), ("domain_tokens", jaccard), ("times", jaccard), ("quality", quality), ("kinds", meet))}
        self.same = {c: b.codes(c) for c in ("low_domain", "registered", "canonical", "topic")}
        self.topic = b.codes("topic", True)
        self.platform, self.plain = t["generic"].to_numpy(zero_copy_only=False).astype(bool), t["plain"].to_numpy(zero_copy_only=False).astype(bool)
        self.confidence = t["confidence"].to_numpy().astype(np.float64)
        self.roots = self._roots(t["roots"].to_pylist())

    @staticmethod
    def _few(s: Members, how):
        """``how`` for tiles; where sets recur, each two different sets are compared once."""
        kinds = s.kinds()
        _, first = np.unique(kinds, return_index=True)
        if len(first) ** 2 > TILE:
            return lambda x, y, at: how(s, x, y) if at is None else how(s, x, y)[at]
        cells = [s.words[s.starts[r] : s.starts[r + 1]] for r in first]
        each = Members(np.repeat(np.arange(len(first)), [len(c) for c in cells]), np.concatenate(cells), len(first), s.width)
        values = how(each, (0, each.n), (0, each.n))
        return lambda x, y, at: values[_sides(kinds, x, y, at)]

    def _roots(self, maps: list):
        """(likeness, no root in common) for tiles of rows with these maps of weights."""
        seen: dict[tuple, int] = {}
        own = np.array([seen.setdefault(tuple(m or ()), len(seen)) for m in maps], np.int64)
        names = {k: n for n, k in enumerate(sorted({k for m in seen for k, _ in m}))}
        w, has = np.zeros((len(seen), len(names))), np.zeros((len(seen), len(names)), bool)
        for m, n in seen.items():
            for k, v in m:
                w[n, names[k]], has[n, names[k]] = v, True

        def compare(p, q):
            least, most, common = np.zeros((len(p), len(q))), np.zeros((len(p), len(q))), np.zeros((len(p), len(q)), bool)
            for k in np.flatnonzero(has[p].any(0) | has[q].any(0)):
                least += np.minimum(w[p, None, k], w[None, q, k])
                most += np.maximum(w[p, None, k], w[None, q, k])
                common |= has[p, None, k] & has[None, q, k]
            return np.divide(least, most, out=np.zeros_like(least), where=most > 0), ~common

        if len(seen) ** 2 > TILE:
            return lambda x, y, at: tuple(v if at is None else v[at] for v in compare(own[slice(*x)], own[slice(*y)]))
        every = np.arange(len(seen))
        values = compare(every, every)
        return lambda x, y, at: tuple(v[_sides(own, x, y, at)] for v in values)

    def _texts(self, x: tuple[int, int], y: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Likeness of topics, hints (topics count as such) and texts."""
        topic = jaccard(self.block.sets["topics"], x, y)
        return topic, np.maximum(jaccard(self.block.sets["hints"], x, y), topic * 0.7), np.maximum(jaccard(self.texts[0], x, y), jaccard(self.texts[1], x, y))

    def reached(self, x: tuple[int, int], y: tuple[int, int], weights: dict[str, float], asked: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns, scores) of the tile's pairs that are asked for and score at least ``floor``.

        Most pairs are settled by words alone: with all other parts at their most, and no penalty, they stay below the floor.
        """
        topic, hint, text = texts = self._texts(x, y)
        most = weights["text_score"] * text + weights["hint_score"] * hint
        most += sum(weights[name] for name in ("domain_score", "root_score", "type_score", "quality_score")) + weights["time_score"] * bool(len(self.block.sets["times"].words))
        for name, column, where in (("canonical_score", "canonical", None), ("bonus", "topic", topic >= 0.25)):
            met = self._equal(column, x, y, None)
            most += weights[name] * (met if where is None else met & where)
        at = np.nonzero(asked & (np.where((hint < 0.2) & (text < 0.15), most * 0.6, most) >= floor - 1e-9))
        score = self.of(x, y, weights, at, tuple(t[at] for t in texts))["score"]
        found = score >= floor
        return at[0][found], at[1][found], score[found]

    def _equal(self, column: str, x: tuple[int, int], y: tuple[int, int], at) -> np.ndarray:
        own, other = _sides(self.same[column], x, y, at)
        return (own == other) & (own >= 0)

    def of(self, x: tuple[int, int], y: tuple[int, int], weights: dict[str, float], at: tuple[np.ndarray, np.ndarray] | None = None, texts: tuple | None = None) -> dict[str, np.ndarray]:
        """The metrics of all pairs of a tile as matrices, or of its pairs ``at`` (rows, columns) as lists; ``texts`` of these if they are known."""
        topic, hint, text = self._texts(x, y) if texts is None else texts
        sides = lambda values: _sides(values, x, y, at)
        equal = lambda c: self._equal(c, x, y, at)
        few = {name: get(x, y, at) for name, get in self.few.items()}
        site, parts, kind = few["site"], few["domain_tokens"], few["kinds"]
        root, rootless = self.roots(x, y, at)
        registered, canonical = equal("registered"), equal("canonical").astype(np.float64)
        platform = registered & sides(self.platform)[0]
        domain = np.maximum(np.maximum(equal("low_domain").astype(np.float64), 0.85 * registered), np.maximum(site * 0.7, parts * 0.4))
        if platform.any():
            domain = np.where(platform, np.minimum(domain, np.maximum(np.maximum(site * 0.25, parts * 0.15), canonical)), domain)
        r, s = sides(self.same["registered"])
        elsewhere = (r >= 0) & (s >= 0) & ~registered
        bonus = (elsewhere & equal("topic") & (topic >= 0.25)).astype(np.float64)
        trust, trusted = sides(self.confidence)
        sure = lambda least: (trust >= least) & (trusted >= least)
        (told, named), (plain, bare) = sides(self.topic), sides(self.plain)
        apart = (told != named) & plain & bare
        penalty = np.where(sure(0.8) & rootless & (hint < 0.15), 0.28, 0.0)
        penalty = np.maximum(penalty, np.where(registered & (kind == 0) & (text < 0.25) & (hint < 0.15), 0.18, 0.0))
        if platform.any():
            penalty = np.maximum(penalty, np.where(platform & (canonical == 0) & (topic < 0.2) & (text < 0.28) & (hint < 0.25), 0.30, 0.0))
            penalty = np.maximum(penalty, np.where(platform & sure(0.72) & apart & (topic < 0.35) & (hint < 0.35), 0.34, 0.0))
        out = {
            "topic_score": topic, "text_score": text, "hint_score": hint, "domain_score": domain, "root_score": root, "type_score": kind, "quality_score": few["quality"],
            "time_score": few["times"], "canonical_score": canonical, "bonus": bonus, "penalty": penalty,
        }
        raw = np.zeros_like(text)
        for name, w in weights.items():
            raw += w * out[name]
        raw -= penalty
        raw = np.where((hint < 0.2) & (text < 0.15), raw * 0.6, raw)
        return out | {"score": np.clip(raw, 0.0, 1.0)}


def _sides(values: np.ndarray, x: tuple[int, int], y: tuple[int, int], at) -> tuple[np.ndarray, np.ndarray]:
    """Values of a tile's rows and columns, or of both sides of its pairs ``at``."""
    own, other = values[slice(*x)], values[slice(*y)]
    return (own[:, None], other[None, :]) if at is None else (own[at[0]], other[at[1]])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (number, chunk, parts, packed) for the rows of a chunk: their other columns, lists of words as codes of one list of words."""
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    own = ("number", "chunk", "parts")
    cells = {c: table[c].combine_chunks() for c in table.column_names if c not in own}
    listed = [c for c, x in cells.items() if x.type in (pa.list_(pa.string()), pa.large_list(pa.string()))]
    coded = pa.chunked_array([cells[c].flatten() for c in listed], pa.string()).combine_chunks().dictionary_encode()
    at = 0
    for c in listed:
        sizes = pc.fill_null(pc.list_value_length(cells[c]), 0).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        cells[c] = pa.ListArray.from_arrays(pa.array(offsets), coded.indices.slice(at, offsets[-1]))
        at += int(offsets[-1])
    sink = pa.BufferOutputStream()
    for part in (pa.table({"word": coded.dictionary}), pa.table(cells, metadata={"listed": " ".join(listed)})):
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(part)
    yield pa.record_batch([table[c].combine_chunks().slice(0, 1) for c in own] + [pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[*own, "packed"])


def _unpacked(cell: bytes) -> pa.Table:
    source = pa.BufferReader(cell)
    words = pa.ipc.open_stream(source).read_all()["word"].combine_chunks()
    table = pa.ipc.open_stream(source).read_all()
    for c in table.schema.metadata[b"listed"].decode().split():
        cells = table[c].combine_chunks()
        table = table.set_column(table.column_names.index(c), c, pa.ListArray.from_arrays(cells.offsets, words.take(cells.values)))
    return table


def blocks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[Block]:
    """The block of these rows, or one block for each two chunks of it that meet, if they are packed."""
    table = pa.Table.from_batches(list(batches))
    if "packed" not in table.column_names:
        yield Block(table, columns)
        return
    cells = sorted(zip(table["part"].to_pylist(), table["chunk"].to_pylist(), table["packed"].to_pylist()), key=lambda c: c[:2])
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    placed = lambda t, part, last: t.append_column("i", pa.array(np.zeros(len(t), np.int32))).append_column("j", pa.array(np.full(len(t), last, np.int32))).append_column("part", pa.array(np.full(len(t), part, np.int32)))
    for part, n, one in cells:
        if part != i:
            continue
        own = _unpacked(one)
        if i == j:
            yield Block(placed(own, 0, 0), columns)
        for other, m, cell in cells:
            if other == j and (i < j or m > n):
                yield Block(pa.concat_tables([placed(own, 0, 1), placed(_unpacked(cell), 1, 1)]), columns)


def scored(batches: Iterator[pa.RecordBatch], weights: dict[str, float], names: tuple[str, ...], floor: float = 0.0) -> Iterator[pa.RecordBatch]:
    """A row for each pair of at least that score: its ids, the smaller first, and the metrics named."""
    for block in blocks(batches, SETS):
        similarity = Similarity(block)
        for x, y, asked in block.tiles():
            found = similarity.of(x, y, weights)
            p, q = np.nonzero(asked & (found["score"] >= floor))
            a, b = block.ids[p + x[0]], block.ids[q + y[0]]
            whole = pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *[pa.array(found[n][p, q]) for n in names]], names=["a", "b", *names])
            for at in range(0, whole.num_rows, 100_000):
                yield whole.slice(at, 100_000)


class Joined:
    """What links join: the links that came in, reduced to one for each record that is not the first of its group."""

    def __init__(self) -> None:
        self.a, self.b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.more = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.more += len(a)
        if self.more > TILE:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        """(smallest id of the group, id) for each other id."""
        ids, spots = np.unique(np.concatenate([*self.a, *self.b]), return_inverse=True)
        p, q = np.split(spots, 2)
        label = np.arange(len(ids))
        while True:
            low, high = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
            apart = low < high
            if not apart.any():
                break
            p, q = p[apart], q[apart]
            np.minimum.at(label, high[apart], low[apart])
            while (label[label] != label).any():
                label = label[label]
        rest = label < np.arange(len(ids))
        self.a, self.b, self.more = [ids[label[rest]]], [ids[rest]], 0
        return self.a[0], self.b[0]


def linked(batches: Iterator[pa.RecordBatch], weights: dict[str, float], floors: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
    """For each floor, enough links to join all records that the block's pairs of at least that score join; at most one for each record."""
    joined = {floor: Joined() for floor in floors}
    for block in blocks(batches, SETS):
        similarity = Similarity(block)
        for x, y, asked in block.tiles():
            p, q, score = similarity.reached(x, y, weights, asked, min(floors))
            for floor in floors:
                joined[floor].add(block.ids[p[score >= floor] + x[0]], block.ids[q[score >= floor] + y[0]])
    for floor in floors:
        a, b = joined[floor].reduce()
        if len(a):
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), floor))], names=["a", "b", "floor"])


def counted(batches: Iterator[pa.RecordBatch], weights: dict[str, float], floor: float) -> Iterator[pa.RecordBatch]:
    """(a, b, links): what the block's pairs of at least that score join, as in `linked`, without counts; and each of its records as a, without b, and how many of these pairs it is in."""
    joined, row = Joined(), lambda a, b, n: pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "links"])
    counts: dict[int, int] = {}
    for block in blocks(batches, SETS):
        similarity = Similarity(block)
        links = np.zeros(block.n, np.int64)
        for x, y, asked in block.tiles():
            p, q, _ = similarity.reached(x, y, weights, asked, floor)
            links[slice(*x)] += np.bincount(p, minlength=x[1] - x[0])
            links[slice(*y)] += np.bincount(q, minlength=y[1] - y[0])
            joined.add(block.ids[p + x[0]], block.ids[q + y[0]])
        for k in np.flatnonzero(links):
            counts[int(block.ids[k])] = counts.get(int(block.ids[k]), 0) + int(links[k])
    a, b = joined.reduce()
    if len(a):
        yield row(a, b, [None] * len(a))
        yield row(list(counts), [None] * len(counts), list(counts.values()))


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block's cluster, the sum of its pairs' word overlaps, and their number."""
    for block in blocks(batches, ("words",)):
        total, n = 0.0, 0
        for x, y, asked in block.tiles():
            total += float(jaccard(block.sets["words"], x, y)[asked].sum())
            n += int(asked.sum())
        if n:
            yield pa.record_batch([block.table["cluster"].combine_chunks().slice(0, 1), pa.array([total]), pa.array([n], pa.int64())], names=["cluster", "total", "n"])
