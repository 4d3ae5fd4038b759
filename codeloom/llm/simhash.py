"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits share a point that lies within one
flip of the one and two flips of the other. So every fingerprint emits its variants
within half the radius, rounded both ways, and fingerprints meet where a variant is
the same. Two rules thin the 2,081 variants to 560 and lose no pair:

* at distance 2 (equal parity) both reach a common point by one flip;
* at distance 3 (unequal parity) two of the three bits lie in the same 32-bit half, so
  fingerprints of even parity flip pairs in the first half, those of odd parity pairs
  in the second, and the other side reaches the point by its one flip. Distance 1 is
  covered alike, with any other bit of that half.

Variants are shuffled without being written out: a linear map of the bits gives each
variant its bin, so a bin that gets a fingerprint knows which variants it stands for.
In a bin, equal variants form buckets. Any two members of a bucket of which one came
by one flip differ in at most 1 + 2 bits, so a star around the smallest such member
links all that the bucket proves, with no pairs; pairs are checked again by counting
bits. Each bin sends on a spanning forest of its links only.

Three bits keep almost identical texts only: at a Jaccard similarity of 0.8 two
fingerprints differ in about ten. similar_groups reaches further: beside the balls, texts
meet in blocks of min-hashes of their shingles, and every pair counts only if its shingle
sets are as similar as asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import join_counted, map_columns, row_key
from codeloom.llm.components import components, forest
from codeloom.runtime import checked_broadcast, prepare, stage

#: Seed of XXH64 for shingles.
SEED = 42
#: Bins at least, and variants that a bin holds at most.
BINS, BIN_VARIANTS = 256, 4_000_000
#: Fingerprints that a task bins at a time.
BATCH = 16_384
#: Blocks of min-hashes and hashes in a block: at a similarity of 0.8 a pair misses all with probability 5e-6.
BLOCKS, BLOCK_HASHES = 40, 6
_LANES = np.uint64(0x0101010101010101)
_FACTOR, _SHIFT = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BLOCKS * BLOCK_HASHES), dtype=np.uint64)
_FACTOR |= np.uint64(1)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words."""
    import xxhash

    w = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return digest(b" ".join(w), SEED)
    if words == 3:
        hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(w, w[1:], w[2:], strict=False)]
    else:
        hashes = [digest(b" ".join(w[i : i + words]), SEED) for i in range(len(w) - words + 1)]
    a = np.array(hashes, dtype=np.uint64)
    bits = 0
    for k in range(8):
        lanes = ((a >> np.uint64(k)) & _LANES).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in range(8):
            if 2 * int(lanes[byte]) > len(a):
                bits |= 1 << (8 * byte + k)
    return bits


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, row, fp) for each row of docs: row is row_key, fp a signed 64-bit integer; null texts count as empty."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, rows, texts in batches:
            yield [ids, rows, [_signed(fingerprint(t, words)) for t in texts]]

    src = docs.select(F.col(id_col).cast("long"), row_key(id_col, text_col), F.col(text_col))
    return map_columns(src, f"`{id_col}` long, row binary, fp long", run)


class _Masks:
    """The flips of either parity, by bin code."""

    def __init__(self, bins: int):
        one = [1 << i for i in range(64)]
        pairs = [[one[i] | one[j] for i in range(h, h + 32) for j in range(i + 1, h + 32)] for h in (0, 32)]
        self.masks = [np.array(one + p, dtype=np.uint64) for p in pairs]
        # the code of a bit: a fixed mixing of its index, so codes of flips spread over all bins
        x = np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.codes = (x >> np.uint64(40)) & np.uint64(bins - 1)
        table = np.zeros((8, 256), dtype=np.uint64)
        for byte in range(8):
            for v in range(256):
                for k in range(8):
                    if v >> k & 1:
                        table[byte, v] ^= self.codes[8 * byte + k]
        self.table = table
        self.by_code = []
        for m in self.masks:
            code = self.code(m)
            order = np.argsort(code, kind="stable")
            bounds = np.searchsorted(code[order], np.arange(bins + 1, dtype=np.uint64))
            self.by_code.append((order, bounds))

    def code(self, v: np.ndarray) -> np.ndarray:
        b = np.ascontiguousarray(v, dtype="<u8").view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(v), dtype=np.uint64)
        for byte in range(8):
            out ^= self.table[byte, b[:, byte]]
        return out


def bin_links(fps: np.ndarray, bin_: int, masks: _Masks, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fps that meet in this bin."""
    fps = np.unique(fps)
    parity = np.bitwise_count(fps) & 1
    rest = masks.code(fps) ^ np.uint64(bin_)
    variants, source, single = [], [], []
    for p in (0, 1):
        own = np.flatnonzero(parity == p)
        if not len(own):
            continue
        order, bounds = masks.by_code[p]
        lo = bounds[rest[own].astype(np.int64)]
        n = bounds[rest[own].astype(np.int64) + 1] - lo
        src = np.repeat(own, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        which = order[at]
        variants.append(fps[src] ^ masks.masks[p][which])
        source.append(src)
        single.append(which < 64)
    if not variants:
        return fps[:0], fps[:0]
    v, src, one = np.concatenate(variants), np.concatenate(source), np.concatenate(single)
    order = np.lexsort((src, ~one, v))
    v, src, one = v[order], src[order], one[order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(v)]))
    hub = first[group]
    use = one[hub] & (src != src[hub])
    a, b = fps[src[hub[use]]], fps[src[use]]
    near = np.bitwise_count(a ^ b) <= radius
    return forest(a[near], b[near])


def link_fingerprints(fps: DataFrame, count: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints differing in at most three bits.

    fps: one column fp of distinct values; count: its rows, which only size the bins.
    """
    bins = BINS
    while count * 560 / bins > BIN_VARIANTS:
        bins *= 2
    batch = BATCH * max(1, bins // 4096)  # so that a bin's share of a batch doesn't shrink to nothing

    def emit(batches: Iterator[list[list]]) -> Iterator[list]:
        masks = _Masks(bins)
        present = [np.diff(bounds) > 0 for _, bounds in masks.by_code]
        held: list[int] = []

        def out(values: list[int]) -> list:
            v = np.array(values, dtype=np.int64).view(np.uint64)
            code, odd = masks.code(v).astype(np.int64), (np.bitwise_count(v) & 1).astype(bool)
            blobs, bins_ = [], []
            if bins <= 1024:
                for b in range(bins):
                    rest = code ^ b
                    own = v[np.where(odd, present[1][rest], present[0][rest])]
                    if len(own):
                        bins_.append(b)
                        blobs.append(own.tobytes())
                return [bins_, blobs]
            # with many bins: the bins of each fingerprint, and one sort of all by bin
            at = [(code[odd == p][:, None] ^ np.flatnonzero(present[p])[None, :]).ravel() for p in (0, 1)]
            who = [np.repeat(v[odd == p], present[p].sum()) for p in (0, 1)]
            at, who = np.concatenate(at), np.concatenate(who)
            order = np.argsort(at, kind="stable")
            at, who = at[order], who[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
            return [at[first].tolist(), [x.tobytes() for x in np.split(who, first[1:])]] if len(at) else [[], []]

        for (values,) in batches:
            held += values
            while len(held) >= batch:
                yield out(held[:batch])
                held = held[batch:]
        if held:
            yield out(held)

    def meet(table):
        import pyarrow as pa

        masks = _masks_of(bins)
        bin_ = table.column(0)[0].as_py()
        got = np.frombuffer(b"".join(table.column(1).to_pylist()), dtype=np.uint64)
        a, b = bin_links(got, bin_, masks)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    sent = map_columns(fps.select("fp"), "bin int, fps binary", emit)
    return sent.groupBy("bin").applyInArrow(meet, "a long, b long")


_kept: dict[int, _Masks] = {}


def _masks_of(bins: int) -> _Masks:
    if bins not in _kept:
        _kept[bins] = _Masks(bins)
    return _kept[bins]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, with_row: bool = False) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest
    id that links of at most three bits reach, itself included).

    Empty, null and blank texts have fingerprint zero, which links like any other. Rows
    with one text share a fingerprint and so a component. Null ids get a component too but
    never name one, unless it has no other. An empty table gives an empty result.
    with_row adds row, a key of the row's id and text.
    """
    prepare(docs.sparkSession)
    rows = stage(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    fps = stage(rows.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "simhash-fps")
    links = stage(link_fingerprints(fps, fps.count()).distinct(), "simhash-links")
    parts = components(links)
    labelled = stage(fps.join(parts, fps.fp == parts.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    named = labelled.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("m"))
    linked = stage(join_counted(labelled, stage(named, "simhash-names"), ["root"], "m").select("fp", "component_id", "n"), "simhash-linked")
    out = join_counted(rows, linked, ["fp"])
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *["row"] * with_row)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct XXH64 of all word shingles, read as in fingerprint; a shorter text is one shingle."""
    import xxhash

    w = (text or "").encode().lower().split()
    runs = [w[i : i + words] for i in range(max(1, len(w) - words + 1))] if w else []
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs], dtype=np.uint64))


def block_keys(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each block of min-hashes; none for a text without words."""
    import xxhash

    if not len(hashes):
        return []
    factor, shift = _FACTOR, _SHIFT
    low = np.full(BLOCKS * BLOCK_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 512):
        low = np.minimum(low, (hashes[i : i + 512, None] * factor + shift).min(axis=0))
    return [_signed(xxhash.xxh64_intdigest(b.tobytes(), k)) for k, b in enumerate(low.reshape(BLOCKS, -1))]


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of distinct hashes have a Jaccard similarity of least or more; empty ones are alike."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both)


def links_between(sets: list[np.ndarray], roots: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (by place) that connect whatever similar pairs connect, given the components found so far."""
    roots, sizes, out = roots.copy(), np.array([len(x) for x in sets]), []
    for i in range(len(sets)):
        fits = np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i])
        for j in np.flatnonzero((roots != roots[i]) & fits).tolist():
            if j > i and roots[j] != roots[i] and similar(sets[i], sets[j], least):
                roots[roots == roots[j]] = roots[i]
                out.append((i, j))
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, with_row: bool = False) -> DataFrame:
    """As near_groups, but linked are texts whose sets of word shingles have a Jaccard
    similarity of least or more.

    Candidates are texts that the balls of their fingerprints or a block of min-hashes bring
    together; with_row adds row and keep_row, the keys of the row and of the one row of its
    component to keep: smallest id (null last), then key. First each is compared with one member of its block; then, in blocks that
    still hold several components, all pairs across components are. So a pair is missed only
    if it meets in no block. Blank texts are alike. Texts with the same words are one node.
    """
    import xxhash

    prepare(docs.sparkSession)

    def read(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, rows, texts in batches:
            nodes = [_signed(xxhash.xxh64_intdigest(b" ".join((t or "").encode().lower().split()), SEED + 1)) for t in texts]
            yield [ids, rows, [_signed(fingerprint(t, words)) for t in texts], nodes, [block_keys(shingle_hashes(t, words)) for t in texts]]

    src = docs.select(F.col(id_col).cast("long"), row_key(id_col, text_col), F.col(text_col))
    rows = stage(map_columns(src, f"`{id_col}` long, row binary, fp long, node long, keys array<long>", read), "similar-rows")
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row")
    nodes = stage(rows.groupBy("node").agg(F.min(own).alias("low"), F.min("fp").alias("fp"), F.min("row").alias("row"), F.first("keys").alias("keys"), F.count("*").alias("n")), "similar-nodes")

    # by balls: one node for each fingerprint, and the others of equal fingerprint beside it
    hubs = stage(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "similar-fps")
    near = link_fingerprints(hubs, hubs.count()).distinct()
    balls = near.join(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(hubs.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b").select("x", "y")
    balls = balls.unionByName(nodes.join(hubs, "fp").select(F.col("hub").alias("x"), F.col("node").alias("y")).where("x <> y"))
    # by blocks: each with the block's hub, another one in each block
    blocks = nodes.select("node", F.explode("keys").alias("key"))
    shared = blocks.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node")).alias("first"), F.count("*").alias("n")).where("n > 1")
    blocks = stage(blocks.join(shared.select("key", F.col("first.node").alias("hub")), "key"), "similar-blocks")
    pairs = balls.unionByName(blocks.select(F.col("hub").alias("x"), F.col("node").alias("y"))).where("x <> y")
    pairs = stage(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "similar-pairs")

    members = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stage(nodes.select("node", "row").join(members, "node"), "similar-members")
    texts = docs.select(row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(checked_broadcast(wanted, 64), "row")
    texts = stage(texts.groupBy("node").agg(F.min("t").alias("t")), "similar-texts")

    def verify(batches: Iterator[list[list]]) -> Iterator[list]:
        for a, b, s, t in batches:
            held: dict[str, np.ndarray] = {}
            for x in s + t:
                if x not in held:
                    held[x] = shingle_hashes(x, words)
            good = [i for i in range(len(a)) if similar(held[s[i]], held[t[i]], least)]
            yield [[a[i] for i in good], [b[i] for i in good]]

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("s")), "a").join(texts.select(F.col("node").alias("b"), "t"), "b")
    links = stage(map_columns(both.select("a", "b", "s", "t"), "a long, b long", verify), "similar-links")

    def across(table):
        import pyarrow as pa

        own, roots = table.column("node").to_pylist(), np.array(table.column("root").to_pylist(), dtype=np.int64)
        found = links_between([shingle_hashes(t, words) for t in table.column("t").to_pylist()], roots, least)
        return pa.table({"a": pa.array([own[i] for i, _ in found], pa.int64()), "b": pa.array([own[j] for _, j in found], pa.int64())})

    parts = components(links)
    held = stage(blocks.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "similar-held")
    mark = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")
    mixed = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), mark).where("lo <> hi")
    mixed = stage(mixed.groupBy("n", "mark").agg(F.min("key").alias("key")).select("key"), "similar-mixed")  # equal blocks once
    more = held.join(checked_broadcast(mixed, 32), "key").join(texts, "node").select("key", "node", "root", "t").groupBy("key").applyInArrow(across, "a long, b long")
    parts = components(links.unionByName(stage(more.distinct(), "similar-more")))

    labelled = stage(nodes.select("node", "low", "n").join(parts, "node", "left").select("node", "low", "n", F.coalesce("root", "node").alias("root")), "similar-roots")
    named = labelled.groupBy("root").agg(F.min("low").alias("low"), F.count("*").alias("m")).select("root", F.col("low.id").alias("component_id"), F.col("low.row").alias("keep_row"), "m")
    named = join_counted(labelled.drop("low"), stage(named, "similar-names"), ["root"], "m").select("node", "component_id", "keep_row", "n")
    out = join_counted(rows, stage(named, "similar-linked"), ["node"])
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *["row", "keep_row"] * with_row)
