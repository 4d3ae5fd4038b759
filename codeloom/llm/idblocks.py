"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents:

    magic "PFOR1\\0\\0\\0" | block length u32 | documents u32 | ids u64 | blocks u32 | body length u64
    document ids i64[documents] | 1 where the id is null u8[documents] | id counts u32[documents]
    index of block starts, from the first block on: u64[blocks]
    blocks: minimum u32 | width u8 | exceptions u16 | values - minimum, width bits each, packed
            in 64-value groups | places of exceptions u16[] | their values - minimum u32[]

A block's width holds a fixed percentile of its values after the minimum is subtracted;
larger ones are exceptions, of which the packed part keeps the low bits. Integers are
little-endian. Any block can be read alone through the index.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import map_columns
from codeloom.runtime import filesystem, new_path, prepare, stage

MAGIC = b"PFOR1\0\0\0"
#: Values of a block (a multiple of 64), the percentile its width holds, ids of a file about.
BLOCK, PERCENTILE, FILE_IDS = 1024, 90, 2_000_000
#: Files that one task reads back about, and tasks at most (each then reads more files, one at a time).
FILES_A_TASK, READ_TASKS = 32, 20_000
#: Parts whose totals one task adds up.
SUM_PARTS = 4_096
#: Id appended to every document.
END = 0
_HEAD = struct.Struct("<8sIIQIQ")
_BLOCK = struct.Struct("<IBH")


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 64 k) values below 2**width -> (blocks, k * width) words of 64 bits."""
    n, size = values.shape
    v = np.ascontiguousarray(values.reshape(n * size // 64, 64).T.astype(np.uint64))
    out = np.zeros((width, v.shape[1]), dtype=np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= v[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[i] >> np.uint64(64 - shift)
    return out.T.reshape(n, -1)


def unpack(words: np.ndarray, width: int, size: int) -> np.ndarray:
    n = words.shape[0]
    if not width:
        return np.zeros((n, size), dtype=np.uint32)
    w = np.ascontiguousarray(words.reshape(n * size // 64, width).T)
    out = np.empty((64, w.shape[1]), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = w[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (w[word + 1] << np.uint64(64 - shift))
        out[i] = x & mask
    return out.T.reshape(n, size).astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(block starts, blocks) of unsigned 32-bit ids; the last block is filled up with its last id."""
    ids = np.asarray(ids, dtype=np.uint32)
    if not len(ids):
        return np.zeros(0, np.uint64), b""
    rows = -(-len(ids) // block)
    v = np.concatenate((ids, np.full(rows * block - len(ids), ids[-1], np.uint32))).reshape(rows, block)
    low = v.min(axis=1)
    v = v - low[:, None]
    at = min(block - 1, block * percentile // 100)
    hold = np.partition(v, at, axis=1)[:, at]
    widths = np.array([int(x).bit_length() for x in hold.tolist()])
    over = (v >> np.minimum(widths, 31)[:, None].astype(np.uint32)) >> (widths == 32)[:, None].astype(np.uint32) > 0
    packed: list[bytes] = [b""] * rows
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        mask = np.uint32((1 << width) - 1)
        for i, words in zip(own.tolist(), pack(v[own] & mask, width), strict=True):
            packed[i] = words.astype("<u8").tobytes()
    count = over.sum(axis=1).tolist()
    where_row, where = np.nonzero(over)
    cuts = np.r_[0, np.cumsum(count)]
    out, starts, size = [], [], 0
    for i in range(rows):
        own = where[cuts[i] : cuts[i + 1]]
        b = b"".join((_BLOCK.pack(int(low[i]), int(widths[i]), count[i]), packed[i], own.astype("<u2").tobytes(), v[i, own].astype("<u4").tobytes()))
        starts.append(size)
        size += len(b)
        out.append(b)
    return np.array(starts, dtype=np.uint64), b"".join(out)


def decode_blocks(body: bytes, starts: np.ndarray, count: int, block: int) -> np.ndarray:
    heads = [_BLOCK.unpack_from(body, int(s)) for s in starts]
    out = np.empty((len(heads), block), dtype=np.uint32)
    widths = np.array([h[1] for h in heads], dtype=int)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        n = block * width // 64
        words = np.stack([np.frombuffer(body, "<u8", n, int(starts[i]) + _BLOCK.size) for i in own]) if n else np.zeros((len(own), 0), np.uint64)
        out[own] = unpack(words, width, block)
    for i, (low, width, bad) in enumerate(heads):
        if bad:
            at = int(starts[i]) + _BLOCK.size + block * width // 8
            out[i, np.frombuffer(body, "<u2", bad, at)] = np.frombuffer(body, "<u4", bad, at + 2 * bad)
        out[i] += np.uint32(low)
    return out.ravel()[:count]


def to_bytes(doc_ids: list[int | None], documents: list[np.ndarray], block: int = BLOCK) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    starts, body = encode_blocks(ids, block)
    head = _HEAD.pack(MAGIC, block, len(doc_ids), len(ids), len(starts), len(body))
    names = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + bytes(d is None for d in doc_ids)
    return b"".join((head, names, np.array([len(d) for d in documents], dtype="<u4").tobytes(), starts.astype("<u8").tobytes(), body))


def from_bytes(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    magic, block, docs, count, blocks, size = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = _HEAD.size
    names = np.frombuffer(data, "<i8", docs, at).tolist()
    null = data[at + 8 * docs : at + 9 * docs]
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    starts = np.frombuffer(data, "<u8", blocks, at + 13 * docs)
    body = data[at + 13 * docs + 8 * blocks :]
    if len(body) != size:
        raise ValueError("token-id file cut short")
    ids = decode_blocks(body, starts, count, block)
    return [None if n else d for d, n in zip(names, null, strict=True)], np.split(ids, np.cumsum(lengths)[:-1]) if docs else []


def _alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    printable = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    return [chr(b if printable[b] else 256 + sum(not p for p in printable[:b])) for b in range(256)]


_ALPHABET = _alphabet()


class Encoder:
    """The tokenizers library's encoding, with pieces remembered.

    The split pattern begins a new match at every space before a visible character and
    on both sides of a line feed between visible characters, so those pieces are encoded
    once each by the tokenizer's own model. Texts with other white space or with the string
    of an added token go through the library whole.
    """

    def __init__(self, spec: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        # strings that the library takes for one id wherever they stand; such texts go through it whole
        self.added = [t["content"] for t in parsed.get("added_tokens") or () if t.get("content")]
        pre = parsed.get("pre_tokenizer") or {}
        self.pieces = parsed.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        whole, letters = self._whole, self._letters
        self.model = self.tokenizer.model

        class Known(dict):
            def __missing__(own, piece: str) -> bytes:  # noqa: N805
                if len(own) >= most:
                    own.clear()
                own[piece] = got = whole(piece).tobytes()
                return got

        class Spaced(dict):
            def __missing__(own, word: str) -> bytes:  # noqa: N805
                if len(own) >= most:
                    own.clear()
                core = word.rstrip(".,;:!?")
                if core and core != word and core[-1].isalnum():
                    got = own[core] + plain[word[len(core) :]]
                else:
                    got = letters(word) if word.isalpha() else whole(" " + word).tobytes()
                own[word] = got
                return got

        self.plain = plain = Known()
        self.spaced = Spaced()

    def _letters(self, word: str) -> bytes:
        """A space and letters are one match, which the model takes in its byte alphabet."""
        mapped = word if word.isascii() else "".join(map(_ALPHABET.__getitem__, word.encode()))
        ids = array("I", [t.id for t in self.model.tokenize(_ALPHABET[32] + mapped)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text and END."""
        end = np.array([END], dtype="<u4")
        if not text:
            return end
        words = text.split()
        gaps = len(words) - 1
        # other white space, at the ends or in runs, leaves more characters between the words
        if not self.pieces or any(map(text.__contains__, self.added)) or text.count(" ") + text.count("\n") != gaps or len(text) - sum(map(len, words)) != gaps:
            return np.concatenate((self._whole(text), end))
        parts = list(map(self.spaced.__getitem__, words))
        parts[0] = self.plain[words[0]]
        at, feed = 0, "\n" in text and self.plain["\n"]
        for line in text.split("\n")[:-1]:
            at += line.count(" ") + 1
            parts[at] = feed + self.plain[words[at]]
        parts.append(end.tobytes())
        return np.frombuffer(b"".join(parts), dtype="<u4")


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def write_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes files of ids in ascending id order (nulls first); returns their table:
    part, seq, path, n_docs, n_ids, in order by part and seq, with start, the ids before.

    Null texts count as empty and give END alone; rows of one id follow each other, by a hash
    of the text. Rows are dealt by id, that hash and their number in the input, so neither a
    common id (null among them) nor a row repeated very often makes one task hold them all.
    A file that a failed attempt leaves behind has a name of its own and isn't in
    the table. Files go to path or else to a new folder beside the session's checkpoints.
    """
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    path = path or new_path(spark, "token-ids")

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        encoder, part, seq = _encoder(shared.value), TaskContext.get().partitionId(), 0
        store, root = filesystem(path)
        store.create_dir(root, recursive=True)
        names, held, size = [], [], 0

        def flush() -> list:
            target = f"{root}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.pfor"
            with store.open_output_stream(target) as out:
                out.write(to_bytes(names, held))
            return [[part], [seq], [target], [len(names)], [size]]

        for ids, texts in batches:
            for d, t in zip(ids, texts, strict=True):
                held.append(encoder.encode(t))
                names.append(d)
                size += len(held[-1])
                if size >= FILE_IDS:
                    yield flush()
                    names, held, size, seq = [], [], 0, seq + 1
        if names:
            yield flush()

    src = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    src = src.select("i", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("n"), "t")
    src = src.repartitionByRange("i", "h", "n").sortWithinPartitions("i", "h", "n").select("i", "t")
    files = stage(map_columns(src, "part int, seq int, path string, n_docs long, n_ids long", run), "token-id-files")
    return before(files).withColumn("root", F.lit(path))


def before(files: DataFrame) -> DataFrame:
    """files with start, the ids of all files before, in order by part and seq.

    Sums inside a part need only that part's rows. What lies before a part comes from the
    parts' totals in groups of SUM_PARTS: a task sums one group, and the driver adds up the
    groups, a few hundred numbers for a million parts.
    """
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("group", F.floor(F.col("part") / SUM_PARTS))
    groups = parts.groupBy("group").agg(F.sum("n").alias("total")).collect()
    sums, at = [], 0
    for g, n in sorted(tuple(r) for r in groups):
        sums.append((g, at))
        at += n
    base = files.sparkSession.createDataFrame(sums, "group long, base long")
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0).cast("long"))).join(F.broadcast(base), "group")
    starts = starts.select("part", (F.col("base") + F.col("ahead")).alias("ahead"))
    out = files.withColumn("start", F.coalesce(F.sum("n_ids").over(own), F.lit(0).cast("long"))).join(starts, "part")
    return out.withColumn("start", F.col("start") + F.col("ahead")).drop("ahead")


def read_ids(files: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document of the files: id, start, n_tokens, ids_crc32 and, with_ids, token_ids."""
    prepare(files.sparkSession)

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        _encoders.clear()  # pieces that a reused worker remembers from writing
        for paths, starts, roots in batches:
            for p, start, root in zip(paths, starts, roots, strict=True):
                store, _ = filesystem(root)
                with store.open_input_stream(p) as f:
                    names, documents = from_bytes(f.read())
                n = np.array([len(d) for d in documents], dtype=np.int64)
                out = [names, (start + np.cumsum(n) - n).tolist(), n.tolist(), [zlib.crc32(d.astype("<u4").tobytes()) for d in documents]]
                yield [*out, [d.astype(np.int32) for d in documents]] if with_ids else out

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids
    # a number of one's own keeps the tasks apart: the few bytes of paths stand for large files
    tasks = min(READ_TASKS, max(1, files.count() // FILES_A_TASK))
    return map_columns(files.select("path", "start", "root").repartition(tasks, "path"), schema, run)
