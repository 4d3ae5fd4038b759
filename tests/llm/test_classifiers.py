import random
import zlib

from pyspark.sql import functions as F

from codeloom.llm import quality as Q
from codeloom.llm import toxicity as T


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    common = [f"{a}{b}" for a in ("wor", "lin", "tes", "mar", "sol") for b in ("a", "en", "ing", "er", "on", "ly")]
    rows = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(8, 80))]
        toxic = i % 5 == 0
        if toxic:
            for w in rng.sample(["idiot", "scum", "grimo" + rng.choice(common), "grimo" + rng.choice(common)], 2):
                words.insert(rng.randint(0, len(words)), w)
        group = rng.choice(["women", "men"]) if (toxic and i % 10 == 0) or i % 7 == 0 else "people"
        rows.append((i, " ".join(words) + f". All {'women' if toxic and i % 10 == 0 else group} here.", int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, toxic int, text int")
    plain, model = T.fit(docs, labels, counterfactual=0.0), T.fit(docs, labels)
    got = T.score_documents(docs, model).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out]
    assert 60 < len(held) < 140
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    # swapping the group moves the score less with the penalty than without
    gap = lambda m: abs(m.scorer()("solen women linga") - m.scorer()("solen men linga"))
    assert gap(model) <= gap(plain) + 1e-9 and gap(model) < 0.02
    assert model.scorer()("solen women linga.") < T.THRESHOLD


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(T.learnable("doc_id"), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert T.fit(docs, labels) == T.fit(docs, flipped)


def test_toxicity_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(1, 0), (6, 1), (None, 1), (9, None), (4, 0), (1, 0)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = T.fit(hard, marks)
        got = T.score_documents(hard, model).collect()
        assert len(got) == hard.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert T.score_documents(empty, T.fit(empty, labels)).count() == 0


def test_estimation_recovers_accuracies():
    rng = random.Random(5)
    true = [(0.95, 0.9), (0.8, 0.85), (0.9, 0.6), (0.7, 0.7), (0.99, 0.8)]
    counts, pairs = {}, []
    for _ in range(20000):
        good = rng.random() < 0.85
        p = "".join("-" if rng.random() < 0.1 else ("g" if (rng.random() < (a if good else 1 - b)) else "b") for a, b in true)
        counts[p] = counts.get(p, 0) + 1
        pairs.append((p, good))
    acc = Q.estimate(counts)
    assert abs(acc.prior - 0.85) < 0.03
    assert abs(acc.table[0, "g", 1] - 0.9 * 0.95) < 0.03 and abs(acc.table[0, "b", 0] - 0.9 * 0.9) < 0.06
    assert sum((acc.posterior(p) > 0.5) == g for p, g in pairs) > 0.93 * len(pairs)
    assert Q.estimate({}).prior == Q.PRIOR


def test_quality_finds_junk(spark):
    rng = random.Random(2)
    rows = []
    for i, (_, text, _) in enumerate(corpus(200)):
        words = text.split()
        kind = i % 8
        if kind == 1:
            text = " ".join(w + rng.choice(["%%%", "$$$", "&&&"]) for w in words)
        elif kind == 2:
            text = " ".join([words[0]] * len(words))
        elif kind == 3:
            text = " | ".join(words)
        rows.append((i, text, kind in (1, 2, 3)))
    got = {r.doc_id: r for r in Q.score_quality(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert sum(got[i].kept != junk for i, _, junk in rows) >= 0.95 * len(rows)


def test_quality_hard_rows(hard, empty):
    got = Q.score_quality(hard).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert Q.score_quality(empty).count() == 0


def test_toxicity_learns_from_one_row_of_an_id(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = [(i, "you vile scum" if i % 2 else "a calm day") for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    fit = lambda rows: T.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    once, often = fit(docs), fit(docs + [(ids[0], docs[0][1])] * 50 + [(ids[0], "zzz later text")])
    assert once.weights == often.weights and once.bias == often.bias


def test_em_over_patterns_equals_em_over_rows():
    """Each row on its own, by the formulas as they stand in the textbook, against counts of vote patterns."""
    rng = random.Random(5)
    rows = ["".join(rng.choices("gb-", (5, 1, 4) if i % 4 else (1, 4, 5), k=4)) for i in range(200)]
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    got = Q.estimate(counts)
    prior, table = Q.PRIOR, [[{v: Q.START[c][v] for v in "gb-"} for c in (0, 1)] for _ in range(4)]
    extra = max(1.0, 0.001 * len(rows))
    for _ in range(100):
        good = []
        for r in rows:
            like = [1 - prior, prior]
            for i, v in enumerate(r):
                like = [like[c] * table[i][c][v] for c in (0, 1)]
            good.append(like[1] / sum(like))
        new = [[{} for _ in (0, 1)] for _ in range(4)]
        for i in range(4):
            for c in (0, 1):
                weight = [g if c else 1 - g for g in good]
                for v in "gb-":
                    new[i][c][v] = (extra * Q.START[c][v] + sum(w for w, r in zip(weight, rows, strict=True) if r[i] == v)) / (extra + sum(weight))
        change = max(abs(new[i][c][v] - table[i][c][v]) for i in range(4) for c in (0, 1) for v in "gb-")
        prior, table = (sum(good) + extra * Q.PRIOR) / (len(rows) + extra), new
        if change < 1e-6:
            break
    assert abs(got.prior - prior) < 1e-9
    assert all(abs(got.table[i, v, c] - table[i][c][v]) < 1e-9 for i in range(4) for c in (0, 1) for v in "gb-")


def test_scores_equal_a_plain_sum():
    import math

    rng = random.Random(8)
    weights = {f: rng.uniform(-1, 1) for w in ("hallo", "welten", "idiot", "über") for f in T.features(w)}
    score = T.Model(weights, -0.5).scorer()
    parts = ["hallo", "Welten!", "idiotic", "über-", "x", "", "Hallo,welt", "\n", "ÜBERALL"]
    for _ in range(300):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        held = {f for w in words for f in [w, *[w[:k] + "*" for k in range(3, 7) if len(w) > k]]}
        want = 1 / (1 + math.exp(0.5 - sum(weights.get(f, 0.0) for f in held)))
        assert abs(score(text) - want) < 1e-12, text
    assert score(None) == score("") and abs(score("") - 1 / (1 + math.exp(0.5))) < 1e-12
