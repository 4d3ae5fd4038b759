import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from codeloom.llm.bpe import SPLIT, Codec, encode_documents  # noqa: E402

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def codec(leaf):
    with open(RANKS, "rb") as f:
        return Codec(f.read(), P.PATTERN, leaf)


def test_tree_equals_whole_encoding():
    c, rng = codec(4), random.Random(3)
    letters = "ab c\n\t'sdrell1 29 .,!éßñ中文  \x1c_ ́²Ⅷ\U0001f600"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        ids = c.encode(text)
        assert ids.tolist() == c.encoding.encode_ordinary(text)
        assert c.decode(ids) == text.encode()


def test_joins_are_associative():
    c = codec(4)
    parts = [(t, np.array(c.encoding.encode_ordinary(t), dtype=np.uint32)) for t in ("hel", "lo wor", "ld'", "s  ", " x12", "3ab")]
    left = parts[0]
    for p in parts[1:]:
        left = c.join(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = c.join(p, right)
    assert left[0] == right[0] and left[1].tolist() == right[1].tolist() == c.encoding.encode_ordinary(left[0])


def test_documents(hard, empty):
    got = encode_documents(hard, RANKS, P.PATTERN).collect()
    texts = [r.text or "" for r in hard.collect()]
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    c = codec(10**9)
    want = [c.encoding.encode_ordinary(t) for t in texts]
    assert sorted(r.ids_sha256 for r in got) == sorted(hashlib.sha256(np.array(w, dtype="<u4").tobytes()).hexdigest() for w in want)
    assert all(r.n_tokens == len(r.token_ids) for r in got)
    assert encode_documents(empty, RANKS, P.PATTERN).count() == 0


def test_other_patterns_are_encoded_whole():
    with open(RANKS, "rb") as f:
        c = Codec(f.read(), r"\p{N}{1,3}|[^\p{N}]+", 4)
    assert P.PATTERN == SPLIT and not c.halves and codec(4).halves
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("12345 ab,") for _ in range(rng.randint(0, 40)))
        assert c.encode(text).tolist() == c.encoding.encode_ordinary(text)


def test_numbers_that_are_no_digits():
    c, rng = codec(4), random.Random(10)
    for _ in range(2000):
        text = "".join(rng.choice("²Ⅷ½1a९ 9é'sll.") for _ in range(rng.randint(5, 40)))
        assert c.encode(text).tolist() == c.encoding.encode_ordinary(text)
