import random

import pytest

from codeloom.llm import line_dedup
from codeloom.llm.common import row_key
from codeloom.llm.line_dedup import _windows, drop_repeated_lines, repeated_lines


def brute(docs, least):
    """docs: id -> lines; the places to delete, by testing every run of lines."""
    order = sorted(docs)
    seqs = {d: [(q, x, len(x.split())) for q, x in enumerate(docs[d]) if x.split()] for d in order}
    first, gone = {}, {d: set() for d in order}
    for d in order:
        s = seqs[d]
        for i in range(len(s)):
            for m in range(1, len(s) - i + 1):
                run = s[i : i + m]
                total = sum(w for _, _, w in run)
                # the shortest runs from a line or up to one
                if total < least or (total - run[0][2] >= least and total - run[-1][2] >= least):
                    continue
                key = tuple(x for _, x, _ in run)
                at = first.setdefault(key, (d, i))
                if at[0] != d or i >= at[1] + m:
                    gone[d] |= {q for q, _, _ in run}
    return gone


def cleaned(docs, gone):
    return {d: "\n".join(x for q, x in enumerate(lines) if q not in gone[d]) for d, lines in docs.items()}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    for least in (1, 3, 7):
        lines = ["a b", "c", "d e f", "", "g h i j k", "l m", "n", "  ", "o p q r s t u v"]
        docs = {i: [rng.choice(lines) if rng.random() < 0.8 else f"own {i} {j}" for j in range(rng.randint(0, 14))] for i in range(40)}
        passage = ["x y", "z", "a b", "w w w", "n"]
        for i in (3, 9, 21):
            docs[i] = docs[i][:2] + passage + docs[i][2:]
        df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")
        got = {r.doc_id: r.text for r in drop_repeated_lines(df, min_words=least).collect()}
        docs = {i: "\n".join(x).split("\n") for i, x in docs.items()}
        assert got == cleaned(docs, brute(docs, least)), least


def test_windows_cover_every_counting_run():
    assert _windows([5, 5, 5], [0, 1, 2], 10) == [(0, 2), (1, 2)]
    assert _windows([12, 1, 1], [0, 1, 2], 10) == [(0, 1), (0, 2), (0, 3)]
    assert _windows([5, 5], [0, 2], 10) == []


def test_hard_rows(hard, empty):
    rows = drop_repeated_lines(hard, min_words=5).collect()
    assert len(rows) == hard.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    fox = "the quick brown fox jumps over the lazy dog"
    assert by[1][0].text == fox and by[1][0].n_removed == 0
    assert [r.text for r in by[2]] == ["", ""] and {r.n_removed for r in by[2]} == {1}
    assert by[5][0].text == " \n\t " and by[3][0].text == ""
    assert drop_repeated_lines(empty).count() == 0 and repeated_lines(empty).count() == 0


def test_default_deletes_short_runs(spark):
    nine = "a line of nine words that comes back often"
    docs = {1: ["one", nine, "All rights reserved."], 2: ["All rights reserved.", "two", nine], 3: [nine, "", "three", "three"]}
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_repeated_lines(df).collect()}
    assert got == cleaned(docs, brute(docs, 1)) == {1: "\n".join(docs[1]), 2: "two", 3: "\nthree"}


def longest_runs(docs, least):
    """id -> (places to delete, maximal runs): from each place the longest run with an earlier copy that it doesn't overlap."""
    out, seen = {}, []
    for d in sorted(docs):
        s = [(q, x) for q, x in enumerate(docs[d]) if x.split()]
        words, gone, runs, past = [x for _, x in s], set(), [], 0
        seen.append(words)
        for i in range(len(s)):
            m = max((m for e, t in enumerate(seen) for j in range(len(t)) for m in range(1, len(s) - i + 1) if t[j : j + m] == words[i : i + m] and (e < len(seen) - 1 or j + m <= i)), default=0)
            if m and i + m > past and sum(len(x.split()) for x in words[i : i + m]) >= least:
                gone |= {q for q, _ in s[i : i + m]}
                runs.append((s[i][0], s[i + m - 1][0]))
                past = i + m
        if runs:
            out[d] = (sorted(gone), runs)
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_runs_are_the_longest_ones(spark, monkeypatch, shuffled):
    if shuffled:  # as for tables too large to broadcast, with hot keys and others
        monkeypatch.setattr(line_dedup, "small_enough", lambda *a: False)
        monkeypatch.setattr(line_dedup, "HOT_KEYS", 8)
    rng = random.Random(6)
    lines = ["a b", "c", "d e f", "", "g h i j k"]
    docs = {i: [rng.choice(lines) if rng.random() < 0.85 else f"own {i} {j}" for j in range(rng.randint(0, 10))] for i in range(12)}
    docs |= {20: ["a", "x", "a", "x", "a"], 21: ["z"] * 13, 22: ["z"] * 6 + ["a", "", "x"], 23: [f"l {i}" for i in range(21)], 24: ["c"] + [f"l {i}" for i in range(19)] + ["a b"]}
    docs[25] = docs[23] + ["", "own"]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")
    ids = {r.row: r.doc_id for r in df.select("doc_id", row_key()).collect()}
    docs = {i: "\n".join(x).split("\n") for i, x in docs.items()}
    for least in (1, 5):
        got = {ids[r.row]: (sorted(r.gone), [(x.first, x.last) for x in r.runs]) for r in repeated_lines(df, min_words=least).collect()}
        assert got == longest_runs(docs, least), least
    assert got[25] == (list(range(21)), [(0, 20)]) and got[24][1] == [(1, 19)]
    counts = {r.doc_id: (r.n_removed, r.n_runs) for r in drop_repeated_lines(df.where("doc_id IN (20, 23, 25)")).collect()}
    assert counts == {20: (3, 2), 23: (0, 0), 25: (21, 1)}
