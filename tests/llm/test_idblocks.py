import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from codeloom.llm import idblocks as I  # noqa: E402, E741

SPEC = P.path("byte_bpe_50k.json")


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 1024, 1025, 5000):
        for high in (1, 2, 50257, 2**32 - 1):
            a = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            if n > 100:
                a[rng.integers(0, n, 5)] = 2**32 - 1
            starts, body = I.encode_blocks(a)
            assert (I.decode_blocks(body, starts, n, I.BLOCK) == a).all()
            if len(starts) > 1:  # one block alone, through the index
                assert (I.decode_blocks(body, starts[1:2], min(n - 1024, 1024), I.BLOCK) == a[1024:2048]).all()


def test_file_round_trip_and_damage():
    docs = [np.arange(5, dtype=np.uint32), np.zeros(0, np.uint32), np.array([7], np.uint32)]
    data = I.to_bytes([3, None, -2], docs)
    names, back = I.from_bytes(data)
    assert names == [3, None, -2] and all((a == b).all() for a, b in zip(docs, back, strict=True))
    assert I.from_bytes(I.to_bytes([], [])) == ([], [])
    with pytest.raises(ValueError):
        I.from_bytes(data[:-3])
    with pytest.raises(ValueError):
        I.from_bytes(b"x" * len(data))


def test_encoder_equals_library():
    with open(SPEC, encoding="utf-8") as f:
        e = I.Encoder(f.read(), most=50)
    assert e.pieces
    library = Tokenizer.from_file(SPEC)
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "hello", "'s", ".", ",", "!?", "é", "中", "\t", " x", " the", "\x1c", "<|endoftext|>", "12", " ", "¿", "...", "x.'s"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert e.encode(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_write_and_read(hard, empty):
    t = Tokenizer.from_file(SPEC)
    rows = sorted(((r.doc_id, r.text or "") for r in hard.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = I.read_ids(I.write_ids(hard, SPEC)).collect()
    want, start = [], 0
    for d, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((d, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and len(r.token_ids) == r.n_tokens
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == [d for d, _ in rows]
    assert I.read_ids(I.write_ids(empty, SPEC)).count() == 0


def test_strings_of_added_tokens_are_the_librarys_ids():
    with open(SPEC, encoding="utf-8") as f:
        e = I.Encoder(f.read())
    library = Tokenizer.from_file(SPEC)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a<|endof text|>", "one <|endoftext|>\n two <|endoftext|>"):
        assert e.encode(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], text
    assert 50256 in e.encode("a <|endoftext|> b").tolist()


def test_starts_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(I, "SUM_PARTS", 3)
    rng = random.Random(6)
    rows = [(p, q, rng.randint(0, 9)) for p in (0, 1, 2, 3, 5, 8, 9, 10, 17) for q in range(rng.randint(1, 4))]
    got = {(r.part, r.seq): r.start for r in I.before(spark.createDataFrame(rows, "part int, seq int, n_ids long")).collect()}
    at = 0
    for p, q, n in sorted(rows):
        assert got[p, q] == at
        at += n


def test_one_id_for_most_rows(spark):
    rows = [(None, f"t {i % 5}") for i in range(300)] + [(4, "same")] * 300 + [(i, f"u {i}") for i in range(50)]
    got = sorted(I.read_ids(I.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), SPEC)).collect(), key=lambda r: r.start)
    assert len(got) == 650 and [r.doc_id or -1 for r in got] == sorted(r[0] if r[0] else -1 for r in rows)
