import hashlib
import random
import re

from codeloom.llm import decontam
from codeloom.llm.decontam import contamination


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, window):
    out = []
    own = [(i if i is None else str(i), words(t)) for i, t in items]
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for name, v in own:
            size = min(window, len(v))
            for k in range(len(v) - size + 1 if v else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[k : k + size]:
                        hit |= set(range(p, p + size))
                        found |= {name} - {None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def take(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()], key=str)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["a", "b", "c", "dé", "E", "f1", "2"]
    text = lambda n: rng.choice(["", " "]).join("") + " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 6, 9, 14]))) for i in range(25)] + [(3, text(8)), (None, "a"), (77, None)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(1, None), (2, ""), (None, items[4][1])]
    docs.append((50, docs[3][1] + " " + items[7][1] + " " + items[9][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 6)
    assert take(contamination(df, marks, window=6)) == want
    assert take(contamination(df, marks, window=6, slice_bytes=60)) == want
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 50)
    monkeypatch.setattr(decontam, "HELD_COUNTS", 10)
    assert take(contamination(df, marks, window=6, slice_bytes=200)) == want


def test_hard_rows(spark, hard, empty):
    marks = spark.createDataFrame([(5, "Quick brown fox"), (6, "")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert take(contamination(hard, marks)) == brute(rows, [(5, "Quick brown fox"), (6, "")], 13)
    assert contamination(empty, marks).count() == 0
    assert {r.n_hit for r in contamination(hard, marks.limit(0)).collect()} == {0}


def test_index_of_a_large_benchmark_is_compact():
    """About 3 MB of items, a third of them equal: bytes of the index for each byte of text."""
    import pickle

    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(30_000)]
    same = " ".join(rng.choices(vocabulary, k=60))
    items = [(f"i{i}", same if i % 3 == 0 else " ".join(rng.choices(vocabulary, k=60))) for i in range(9_000)]
    size = sum(len(t) for _, t in items)
    index = decontam.Index(items)
    index.order_by_rarity({})
    assert len(pickle.dumps(index)) < 8 * size
    ids, begins, n = index.read(["x y " + same + " z", "nothing here"])
    starts, found = index.find(ids)
    assert sorted(starts.tolist()) == list(range(2, 2 + 48))
    w = int(found[0])
    assert index.bounds[w + 1] - index.bounds[w] == 3_000
