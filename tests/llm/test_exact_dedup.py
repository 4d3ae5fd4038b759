from collections import defaultdict

from pyspark.sql import functions as F

from codeloom.llm.exact_dedup import exact_groups, keep_one


def brute(rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for ids in groups.values():
        named = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(named) if named else None
        done = False
        for i in ids:
            kept = i == best and not done
            done |= kept
            out.append((i, best, len(ids), kept))
    return sorted(out, key=str)


def take(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()], key=str)


def test_groups_on_hard_rows(hard, empty):
    for keep in ("min", "max"):
        assert take(exact_groups(hard, keep=keep)) == brute([tuple(r)[:2] for r in hard.collect()], keep)
    assert exact_groups(empty).count() == 0


def test_collisions_are_split(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (0, 1, 2):
        got = take(exact_groups(df, keep="max", hash_of=lambda t, bits=bits: F.pmod(F.crc32(t.cast("binary")), F.lit(1 << bits)).cast("string").cast("binary"), salts=3))
        assert got == brute(rows, "max")


def test_keep_one_keeps_columns(hard):
    left = keep_one(hard, keep="max")
    assert left.columns == hard.columns
    texts = [r.text or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in hard.collect()})
