import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from codeloom.llm.components import components, forest
from codeloom.llm.simhash import _Masks, _signed, bin_links, fingerprint, link_fingerprints, near_groups


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(fps):
    """Components by all pairs: fingerprint -> smallest member's position."""
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_fingerprint_matches_brute_force_and_spark(spark):
    texts = ["a b c d", "a", "a b", "A B c\x0bd e f", "", None, "ÄÖ x Y z " * 40]
    assert [fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    one = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert _signed(fingerprint("A b  c")) == one


def test_every_pair_within_three_bits_meets():
    rng = random.Random(5)
    masks = _Masks(256)
    for _ in range(40):
        x = rng.getrandbits(64)
        flips = rng.sample(range(64), rng.choice([1, 2, 3]))
        y = x
        for f in flips:
            y ^= 1 << f
        pair = np.array([x, y], dtype=np.uint64)
        assert any(len(bin_links(pair, b, masks)[0]) for b in range(256)), flips
        z = y ^ (1 << [i for i in range(64) if i not in flips][0])
        if len(flips) == 3:
            assert not any(len(bin_links(np.array([x, z], dtype=np.uint64), b, masks)[0]) for b in range(256))


def test_all_flips_of_up_to_three_bits_share_a_variant():
    """Every mask of 1 to 3 bits, from fingerprints of both parities: a variant that one side reaches by one flip."""
    from itertools import combinations

    masks = _Masks(256)
    single = [{int(m) for m in k[:64]} for k in masks.masks]
    every = [{int(m) for m in k} for k in masks.masks]
    for size in (1, 2, 3):
        for bits in combinations(range(64), size):
            m = sum(1 << b for b in bits)
            for p in (0, 1):  # x of parity p and x ^ m of parity q: x ^ a = x ^ m ^ b, one of a and b a single flip
                q = (p + size) & 1
                assert any(m ^ a in every[q] for a in single[p]) or any(m ^ b in every[p] for b in single[q]), (bits, p)


def test_many_bins_send_the_same(spark, monkeypatch):
    rng = random.Random(11)
    fps = [_signed(rng.getrandbits(64)) for _ in range(150)]
    fps += [_signed((x % (1 << 64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for x in fps[:60]]
    df = spark.createDataFrame([(x,) for x in sorted(set(fps))], "fp long")
    few = {tuple(r) for r in components(link_fingerprints(df, 10).distinct()).collect()}
    monkeypatch.setattr("codeloom.llm.simhash.BIN_VARIANTS", 60)
    many = {tuple(r) for r in components(link_fingerprints(df, len(fps)).distinct()).collect()}
    assert few == many and len(few) >= 100


def test_links_equal_brute_force(spark):
    rng = random.Random(7)
    fps = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(8):
            y = x
            for f in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
                y ^= 1 << f
            fps.append(y)
            x = y if rng.random() < 0.4 else x
    fps = sorted(set(fps))
    df = spark.createDataFrame([(_signed(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in components(link_fingerprints(df, len(fps))).collect()}
    root = [got.get(_signed(x), _signed(x)) for x in fps]
    want = brute(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (root[i] == root[j]) == (want[i] == want[j])


def test_near_groups_hard_rows(hard, empty):
    got = near_groups(hard).collect()
    assert len(got) == hard.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    zero = "0" * 16
    assert by[(3, zero)] == by[(4, zero)] == by[(5, zero)] == 3
    assert by[(None, zero)] == 3
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert near_groups(empty).count() == 0


def test_components_and_forest(spark):
    a, b = forest(np.array([5, 4, 3, 10]), np.array([4, 3, 2, 11]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 3), (2, 4), (2, 5), (10, 11)]
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
