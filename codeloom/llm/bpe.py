"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved recursively down to leaves, leaves are encoded on their own, and
neighbours are joined by re-encoding a window around the seam. A window reaches on
both sides to a *sync point*, a place where every tokenisation starts a new match
of the split pattern whatever stands around it:

* a space before a letter or digit: words and numbers take one space in front, and of a
  run of white space `\\s+(?!\\S)` leaves the last character to what follows;
* a change between ASCII letters and digits: no alternative holds both, and contractions
  begin at their quote;
* an ASCII letter or digit before an ASCII sign other than the quote: signs are matched on
  their own, and only a quote can go on with letters.

This holds for SPLIT, the one pattern it was argued for; texts are encoded whole with others.
The search for a sync point doubles its reach until one is found or the part ends.
Matches never span a sync point, so tokens outside the window can't change: the
join is associative and equals the encoding of the whole text.
Decoding concatenates the bytes of tokens up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_columns
from codeloom.runtime import prepare

#: Characters of a leaf.
LEAF = 16_384
# Fixed value: the split pattern whose sync points are known.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SYNC = re.compile(r"(?= [^\W_])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-&(-/:-@\[-`{-~])")
_codecs: dict[str, Codec] = {}


class Codec:
    """Encodes and decodes with one table of ranks ('<base64> <rank>' lines)."""

    def __init__(self, table: bytes, pattern: str, leaf: int = LEAF):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in table.splitlines() if x)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = max(2, leaf)
        self.halves = pattern == SPLIT
        top = max(ranks.values(), default=-1)
        self.bytes_of = [b""] * (top + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k

    def _leaf(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_ordinary(text), dtype=np.uint32)

    @staticmethod
    def _last_sync(text: str) -> int:
        """The last sync point of text, or 0: its start is one within the part."""
        reach = 64
        while True:
            at = max(0, len(text) - reach)
            found = [m.start() for m in _SYNC.finditer(text, at + (at > 0))]
            if found:
                return found[-1]
            if not at:
                return 0
            reach *= 2

    @staticmethod
    def _first_sync(text: str) -> int:
        m = _SYNC.search(text, 1)
        return m.start() if m else len(text)

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """The monoid's product of two encoded parts."""
        if not left[0] or not right[0]:
            return left if left[0] else right
        a, b = self._last_sync(left[0]), self._first_sync(right[0])
        tail, head = left[0][a:], right[0][:b]
        keep = len(left[1]) - len(self._leaf(tail))
        drop = len(self._leaf(head))
        return left[0] + right[0], np.concatenate((left[1][:keep], self._leaf(tail + head), right[1][drop:]))

    def _encode(self, text: str) -> tuple[str, np.ndarray]:
        if len(text) <= self.leaf or not self.halves:
            return text, self._leaf(text)
        mid = len(text) // 2
        return self.join(self._encode(text[:mid]), self._encode(text[mid:]))

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text; null counts as empty."""
        return self._encode(text or "")[1]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def codec_for(key: str, table: bytes, pattern: str) -> Codec:
    """One codec per table and Python worker."""
    if key not in _codecs:
        _codecs[key] = Codec(table, pattern)
    return _codecs[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, token_ids.

    Null and empty texts give no tokens; repeated rows give repeated results; other
    columns are ignored, whatever their names. A text of any length is one row's work.
    The driver reads the table of ranks (a fixed file of about 1 MB) and broadcasts it.
    """
    spark = prepare(docs.sparkSession)
    table = _read(ranks_path)
    shared, key = spark.sparkContext.broadcast(table), hashlib.md5(table + pattern.encode()).hexdigest()

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        codec = codec_for(key, shared.value, pattern)
        for docs_, texts in batches:
            ids = [codec.encode(t) for t in texts]
            out = [docs_, [len(x) for x in ids]]
            out.append([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids])
            out.append([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids])
            yield [*out, [x.astype(np.int32) for x in ids]] if with_ids else out

    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return map_columns(docs.select(F.col(id_col).cast("long"), F.col(text_col)), schema, run)
