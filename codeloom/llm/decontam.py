"""Benchmark decontamination: a prefix-filtered set join.

A benchmark window (13 consecutive words, or a shorter item as a whole) is a set of
word shingles that a document must contain completely. With the shingles ordered by
their rarity in the documents, containment of the whole set makes a prefix of one
shingle, the rarest, necessary. Documents are probed with those prefixes only; the
shingle's place in the window bounds where the window must begin (it must fit into the
document), and the words of the window are then compared one by one.

The benchmark is cut into slices by its measured size. Tasks build a compact index of each
slice and write it to the shared folder; the driver sees paths only. Documents are read
once to count shingles and once to search, whatever the number of slices: a task holds a
bounded chunk of texts and passes it by one slice's index after another.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_columns, row_key
from codeloom.runtime import filesystem, new_path, prepare, stage

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 13, 5
#: Bytes of benchmark text in a slice.
SLICE_BYTES = 8 << 20

#: Of the UTF-8 bytes, A-Z in lower case, digits, a-z and all beyond ASCII; the others become spaces.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULTIPLIER, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of documents that a task passes by the slices at a time, and counts it holds.
CHUNK_BYTES, HELD_COUNTS = 32 << 20, 8_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


def _rolling(ids: np.ndarray, k: int, multiplier: np.uint64 = _MULTIPLIER) -> np.ndarray:
    """A 64-bit hash of every k neighbouring word numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * multiplier + x[i : i + n]
    return out


class Index:
    """Windows of a slice of the benchmark, by word numbers (0: a word the slice lacks).

    All items stand in one array of words; a window is a place in it and a length. Windows
    of equal words are one, by 128 bits of two rolling hashes, with the items that hold it.
    Per word of the slice that takes about 30 bytes, and its distinct words as a table.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW, shingle: int = SHINGLE):
        self.window, self.shingle = window, shingle
        self.words: dict[bytes, int] = {}
        self.names = sorted({n for n, _ in items if n is not None})
        number = {n: i for i, n in enumerate(self.names)} | {None: -1}
        flat, starts, lengths, items_ = [], [], [], []
        at = 0
        for name, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            if ids:
                n = max(1, len(ids) - window + 1)
                flat.append(np.array(ids, dtype=np.int32))
                starts.append(np.arange(at, at + n))
                lengths.append(np.full(n, min(window, len(ids))))
                items_.append(np.full(n, number[name]))
                at += len(ids)
        none = [np.zeros(0, np.int64)]
        self.flat = np.concatenate(flat or [np.zeros(0, np.int32)])
        start, length, item = (np.concatenate(x or none) for x in (starts, lengths, items_))
        h = np.zeros((2, len(start)), dtype=np.uint64)
        for n in np.unique(length).tolist():
            own = length == n
            h[0, own], h[1, own] = (_rolling(self.flat, n, m)[start[own]] for m in (_MULTIPLIER, _OTHER))
        order = np.lexsort((item, h[1], h[0], length))
        start, length, item, h = start[order], length[order], item[order], h[:, order]
        new = np.r_[True, (length[1:] != length[:-1]) | (h[:, 1:] != h[:, :-1]).any(axis=0)][: len(start)]
        group = np.cumsum(new) - 1
        self.start, self.lengths = start[new], length[new]
        # the items of each window: a row of owners from bounds[i] to bounds[i + 1]
        keep = np.r_[True, (group[1:] != group[:-1]) | (item[1:] != item[:-1])][: len(start)] & (item >= 0)
        self.owners = item[keep].astype(np.int32)
        self.bounds = np.searchsorted(group[keep], np.arange(len(self.start) + 1))
        self.known = {k: np.unique(_rolling(self.flat, k)[self._places(k)]) for k in sorted({min(shingle, n) for n in set(self.lengths.tolist())})}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def _places(self, k: int) -> np.ndarray:
        """Where the shingles of windows with shingles of k words begin."""
        own = np.minimum(self.shingle, self.lengths) == k
        n = self.lengths[own] - k + 1
        return np.unique(np.repeat(self.start[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))

    def order_by_rarity(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Keeps the rarest shingle of each window; counts: by length, positions in known and numbers."""
        for k, known in self.known.items():
            n = np.zeros(len(known), dtype=np.int64)
            where, number = counts.get(k, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            n[where] = number
            hashes = _rolling(self.flat, k)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            frequency = np.where(known[at] == hashes, n[at], np.iinfo(np.int64).max)
            which = np.flatnonzero(np.minimum(self.shingle, self.lengths) == k)
            place = np.zeros(len(which), dtype=np.int64)
            for size in np.unique(self.lengths[which]).tolist():
                own = self.lengths[which] == size
                near = np.lib.stride_tricks.sliding_window_view(frequency, size - k + 1)
                place[own] = near[self.start[which[own]]].argmin(axis=1)
            keys = hashes[self.start[which] + place]
            order = np.argsort(keys, kind="stable")
            keys, first = np.unique(keys[order], return_index=True)
            self.prefix[k] = (keys, np.r_[first, len(which)], which[order].astype(np.int32), place[order].astype(np.int16))
        self.known = {}

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, a 0 after each; where each begins; its words.

        No window holds a 0, so none reaches from one text into the next.
        """
        words = [words_of(t) for t in texts]
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = chain.from_iterable(chain(w, (b"",)) for w in words)
        ids = np.fromiter(map(self.words.get, flat, repeat(0)), dtype=np.int32, count=int(n.sum()) + len(words))
        return ids, np.cumsum(n + 1) - n - 1, n

    def seen(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Positions in known of the shingles that ids hold, by length."""
        for k, keys in self.known.items():
            hashes = _rolling(ids, k)
            if len(hashes) and len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                yield k, at[keys[at] == hashes]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, windows) of all windows that occur in ids."""
        starts, found = [], []
        for k, (keys, bounds, which, place) in self.prefix.items():
            hashes = _rolling(ids, k)
            if not len(hashes) or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            pos = np.flatnonzero(keys[at] == hashes)
            lo, n = bounds[at[pos]], bounds[at[pos] + 1] - bounds[at[pos]]
            row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            win, begin = which[row], np.repeat(pos, n) - place[row]
            fits = (begin >= 0) & (begin + self.lengths[win] <= len(ids))
            win, begin = win[fits], begin[fits]
            for i in range(0, len(win), 100_000):
                w, b = win[i : i + 100_000], begin[i : i + 100_000]
                span = np.arange(self.window)
                have = ids[np.minimum(b[:, None] + span, len(ids) - 1)]
                want = self.flat[np.minimum(self.start[w][:, None] + span, len(self.flat) - 1)]
                same = ((have == want) | (span >= self.lengths[w][:, None])).all(axis=1)
                starts.append(b[same])
                found.append(w[same])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)


def _spans(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Their union as begin, end, begin, end, ..."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return np.stack((s[cut], e[np.r_[cut[1:] - 1, len(e) - 1]]), axis=1).ravel().tolist()


_indexes: dict[str, Index] = {}


def _load(path: str) -> Index:
    """The index of a slice; a worker keeps the last one only."""
    if path not in _indexes:
        _indexes.clear()
        store, name = filesystem(path)
        with store.open_input_stream(name) as f:
            _indexes[path] = pickle.loads(f.read())
    return _indexes[path]


def _save(index: Index, folder: str, slice_: int) -> str:
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    name = f"slice-{slice_:06d}-{uuid.uuid4().hex}.index"
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(pickle.dumps(index))
    return f"{folder}/{name}"


def _chunks(batches: Iterator[list[list]]) -> Iterator[list[list[list]]]:
    """Batches (texts last) in lists of CHUNK_BYTES of text about."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(len(t or "") for t in batch[-1])
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _indexes_of(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> list[str]:
    """Paths of the finished index of each slice of items (slice, item, text)."""
    spark = docs.sparkSession
    folder = new_path(spark, "decontam-index")

    def build(table: pa.Table) -> pa.Table:
        index = Index(list(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True)), window, shingle)
        at = table.column("slice")[0].as_py()
        return pa.table({"slice": pa.array([at], pa.int32()), "path": [_save(index, folder, at)]})

    made = stage(items.groupBy("slice").applyInArrow(build, "slice int, path string"), "decontam-slices")
    paths = {r["slice"]: r["path"] for r in made.collect()}

    def count(batches: Iterator[list[list]]) -> Iterator[list]:
        totals: dict[tuple[int, int], np.ndarray] = {}

        def out() -> Iterator[list]:
            for (at, k), n in totals.items():
                seen = np.flatnonzero(n)
                yield [[at] * len(seen), [k] * len(seen), seen.tolist(), n[seen].tolist()]
            totals.clear()

        for chunk in _chunks(batches):
            for at, path in paths.items():
                index = _load(path)
                for (texts,) in chunk:
                    for k, found in index.seen(index.read(texts)[0]):
                        if (at, k) not in totals:
                            totals[at, k] = np.zeros(len(index.known[k]), dtype=np.int64)
                        totals[at, k] += np.bincount(found, minlength=len(index.known[k]))
                if sum(map(len, totals.values())) > HELD_COUNTS:
                    yield from out()
        yield from out()

    def finish(table: pa.Table) -> pa.Table:
        at = table.column("slice")[0].as_py()
        index = _load(paths[at])
        _indexes.clear()
        k, i, n = (table.column(c).to_numpy() for c in ("k", "i", "n"))
        index.order_by_rarity({int(x): (i[k == x], n[k == x]) for x in np.unique(k) if x > 0})
        return pa.table({"slice": pa.array([at], pa.int32()), "path": [_save(index, folder, at)]})

    counted = map_columns(docs.select("text"), "slice int, k int, i int, n long", count).groupBy("slice", "k", "i").agg(F.sum("n").alias("n"))
    every = made.select("slice", F.lit(0).alias("k"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("n"))
    done = stage(counted.unionByName(every).groupBy("slice").applyInArrow(finish, "slice int, path string"), "decontam-ordered")
    return [r["path"] for r in done.orderBy("slice").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, slice_bytes: int = SLICE_BYTES, with_row: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated,
    with spans (begin and end of hit words in turn) and items; with_row adds row, a key of
    the row's id and text.

    Null texts and items have no words and hit nothing; items without an id count in
    n_hit, but not among items; rows of one item id count as one item. Empty tables give
    no rows or no hits. Repeated rows give repeated results. A document is contaminated
    when at least a twentieth of its words is hit.
    """
    spark = prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("row_id"), row_key(id_col, text_col), F.col(text_col).alias("text"))
    marks = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).dropna(subset=["text"]).distinct()
    size = marks.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    cut = marks.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(slices)).cast("int"))
    paths = _indexes_of(src, cut, window, shingle)

    def probe(batches: Iterator[list[list]]) -> Iterator[list]:
        for chunk in _chunks(batches):
            n_words: list[list[int]] = [[len(words_of(t)) for t in b[-1]] for b in chunk] if not paths else [[] for _ in chunk]
            spans: list[dict[int, list]] = [{} for _ in chunk]
            items: list[dict[int, set]] = [{} for _ in chunk]
            for path in paths:
                index = _load(path)
                for c, (*_, texts) in enumerate(chunk):
                    ids, begins, n = index.read(texts)
                    n_words[c] = n.tolist()
                    starts, found = index.find(ids)
                    owner = np.searchsorted(begins, starts, side="right") - 1
                    for d in np.unique(owner).tolist():
                        at, win = starts[owner == d] - begins[d], np.unique(found[owner == d])
                        spans[c].setdefault(d, []).append((at, at + index.lengths[found[owner == d]]))
                        own = np.concatenate([index.owners[index.bounds[w] : index.bounds[w + 1]] for w in win.tolist()])
                        items[c].setdefault(d, set()).update(index.names[x] for x in np.unique(own).tolist())
            for c, (ids_, rows, texts) in enumerate(chunk):
                united = [_spans(*map(np.concatenate, zip(*spans[c][d], strict=True))) if d in spans[c] else [] for d in range(len(texts))]
                yield [ids_, rows, n_words[c], united, [sorted(items[c].get(d, ())) for d in range(len(texts))]]

    out = map_columns(src.select("row_id", "row", "text"), "row_id long, row binary, n_words long, spans array<int>, items array<string>", probe)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x.cast("long") - a)  # begin, end, ...: the alternating sum
    out = out.withColumn("n_hit", F.coalesce(hit, F.lit(0).cast("long")))
    return out.select(
        F.col("row_id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "items",
        *["row"] * with_row,
    )
