import random

import corpus_pipeline
from codeloom.llm.simhash import similar_groups


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, least=0.8):
    """id -> smallest id that pairs of similar texts reach, by testing all pairs."""
    sets = {i: shingles(t) for i, t in docs.items()}
    near = [(i, j) for i in docs for j in docs if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    label = {i: i for i in docs}
    for _ in docs:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return label


def planted(rng):
    """Texts with copies of one to six edits each, around and on both sides of 0.8, and chains of copies of copies."""
    docs, n = {}, 0
    for _ in range(25):
        text = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice((4, 12, 60, 150, 250)))]
        for edits in (0, *(rng.randint(0, 6) for _ in range(rng.randint(1, 4)))):
            copy = list(text)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9999)}"
            docs[n], n = " ".join(copy), n + 1
            text = copy if rng.random() < 0.5 else text
    return docs | {n: "", n + 1: " \n", n + 2: None, n + 3: docs[0].upper()}


def test_near_copies_equal_brute_force(spark):
    docs = planted(random.Random(11))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute(docs)
    assert 20 < sum(k != v for k, v in want.items())
    assert {r.doc_id: r.component_id for r in similar_groups(df).collect()} == want
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in want.items() if k == v)


def test_near_copies_hard_rows(spark, hard, empty):
    assert similar_groups(hard).count() == hard.count() and similar_groups(empty).count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, hard, "")
    assert kept.columns == hard.columns
    # of eight words ending in another one, half the shingles agree: too few
    assert {1, 9} <= {r.doc_id for r in kept.collect()}


LABELLED = 120


def corpus(spark, folder):
    """Planted toxic, exact, near and leaking documents among clean ones, and what must go by which stage."""
    rng = random.Random(5)
    word = lambda k: f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{k}"
    prose = lambda n: " ".join(word(rng.randint(0, 400)) for _ in range(n))
    docs = {i: prose(rng.randint(30, 90)) for i in range(300)}
    labels = []
    for i in range(LABELLED):
        if i % 3 == 0:
            docs[i] = prose(20) + " vilescum dregs " + prose(10)
        labels.append((i, 1, int(i % 3 == 0)))
    gone = {"toxic": {i for i in range(LABELLED) if i % 3 == 0}}
    for i in (200, 201, 202):
        docs[i + 100] = docs[i]
    near = docs[210].split() + prose(120).split()
    docs[210] = " ".join(near)
    docs[310] = " ".join([*near[:70], "changed", *near[71:]])
    items = [(f"q{i}", prose(20)) for i in range(4)]
    docs[220] += " " + items[0][1]
    docs[221] = prose(700) + " " + items[1][1] + " " + prose(700)  # far below a twentieth of its words
    docs[222] = items[2][1][::-1] + " " + " ".join(items[2][1].split()[:12])  # twelve words are no window
    gone |= {"exact": {300, 301, 302}, "near": {310}, "leak": {220, 221}}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, gone


def test_pipeline_on_planted_documents(spark, tmp_path):
    docs, gone = corpus(spark, str(tmp_path))
    left = set(docs)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, run), why in zip(corpus_pipeline.STAGES[:-1], ("toxic", "exact", "near", "leak"), strict=True):
        table = run(spark, table, str(tmp_path)).cache()
        left -= gone[why]
        assert {r.doc_id for r in table.collect()} == left, why
        assert len(table.columns) == 5
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == left
    import hashlib

    assert all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in got)


def test_stages_on_hard_and_empty_rows(spark, hard, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", "w5 w6 never"), (None, "x"), ("b", None), ("c", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = ["__gone", "gone", "again", "own", "__i", "__s", "row", "keep_row", "k", "x", "node", "fp", "count", "spans", "n_hit"]
    wide = hard
    for c in clash:
        if c not in wide.columns:
            wide = wide.withColumn(c, wide.n_chars)
    for name, run in corpus_pipeline.STAGES[:-1]:
        out = run(spark, wide, str(tmp_path))
        assert out.columns == wide.columns, name
        assert out.count() <= wide.count(), name
        assert run(spark, empty, str(tmp_path)).count() == 0, name
    exact = corpus_pipeline.drop_copies(spark, wide, "").collect()
    assert len({r.text or "" for r in exact}) == len(exact)
    # an item without an id still hits: one row holds its word
    left = corpus_pipeline.drop_contaminated(spark, hard, str(tmp_path))
    assert sorted(map(str, hard.exceptAll(left).collect())) == sorted(str(r) for r in hard.collect() if r.doc_id == 10)
    assert corpus_pipeline.tokenize(spark, wide, "").count() == hard.count()
    assert corpus_pipeline.tokenize(spark, empty, "").count() == 0


def test_one_id_with_several_texts_and_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, None, "b"), (3, "", "a"), (7, text, "p"), (7, text + " more", "q"), (7, text, "o"), (8, text, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(str, corpus_pipeline.drop_copies(spark, df, "").collect())) == sorted(
        ["Row(doc_id=3, text=None, lang='b')", f"Row(doc_id=7, text='{text}', lang='o')", f"Row(doc_id=7, text='{text} more', lang='q')"]
    )
    near = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert len(near) == 2 and {r.doc_id for r in near} == {3, 7}
