"""Toxicity: a linear classifier with a counterfactual penalty.

Features are the presence of words and of their first letters (3 to 6), so inflected
forms share evidence. The features that part the labelled rows best form a bounded
vocabulary. For each labelled sentence that names a group, the group's term is swapped
for another of the same list; the loss adds the squared change of the score, so the
weights of group terms come together and neutral mentions don't raise a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_columns
from codeloom.runtime import prepare, stage

# Terms for groups of people, by language; terms of a list are swapped for each other.
IDENTITY_TERMS = [
    "women men girls boys females males transgender gay lesbian straight".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "africans asians europeans americans arabs latinos".split(),
    "black white asian african european arab latino".split(),
    "immigrants refugees foreigners natives".split(),
    "frauen männer mädchen jungen".split(),
    "muslime christen juden hindus buddhisten atheisten".split(),
    "einwanderer flüchtlinge ausländer".split(),
    "femmes hommes filles garçons".split(),
    "musulmans chrétiens juifs hindous bouddhistes athées".split(),
    "immigrés réfugiés étrangers".split(),
    "mujeres hombres niñas niños".split(),
    "musulmanes cristianos judíos hindúes budistas ateos".split(),
    "inmigrantes refugiados extranjeros".split(),
]

#: Labelled rows to learn from at most (the smallest by a hash of the id), features at
#: most, and labelled rows that must hold a feature.
SAMPLE, VOCABULARY, MIN_ROWS = 20_000, 4_096, 4
#: Weight of the counterfactual and of the ridge penalty; power of the log odds in a feature's size.
COUNTERFACTUAL, RIDGE, SHARPNESS = 5.0, 1e-3, 2
#: Score from which a document counts as toxic.
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_SWAP = {t: terms[(i + 1) % len(terms)] for terms in IDENTITY_TERMS for i, t in enumerate(terms)}
_SENTENCE = re.compile(r"[.!?\n]+")


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in range(3, 7) if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """text -> score; remembers what the words it has seen contribute."""

        class Known(dict):
            def __missing__(own, chunk: str) -> tuple[str, ...]:  # noqa: N805
                if len(own) > 500_000:
                    own.clear()
                own[chunk] = got = tuple({f for w in _WORD.findall(chunk) for f in features(w) if f in self.weights})
                return got

        known, weights, bias = Known(), self.weights, self.bias

        def score(text: str | None) -> float:
            hits: set[str] = set()
            for chunk in set((text or "").lower().split()):
                if found := known[chunk]:
                    hits.update(found)
            z = bias + math.fsum(weights[f] for f in hits)
            return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))

        return score


def learnable(id_col: str) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 4, isn't 2."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2


def swaps(text: str) -> list[tuple[set[str], set[str]]]:
    """For each sentence that names a group: the features it loses and gains by the swap."""
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        words = set(_WORD.findall(sentence))
        if named := words & _SWAP.keys():
            other = (words - named) | {_SWAP[t] for t in named}
            before = {f for w in words for f in features(w)}
            after = {f for w in other for f in features(w)}
            if before != after:
                out.append((before - after, after - before))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, vocabulary: int = VOCABULARY, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Learns from the labelled rows that learnable() allows.

    Rows without id, text or label teach nothing; of repeated labels of an id the larger
    counts, of an id's rows the smallest text. Without rows of both labels the model gives
    every text the share of label 1 (0 with no rows). At most sample rows are learnt from;
    the vocabulary, not texts, goes to the driver.
    """
    spark = prepare(docs.sparkSession)
    marks = labels.select(F.col(id_col).cast("long").alias("__i"), F.col(label_col).cast("int").alias("y")).dropna()
    marks = marks.where(learnable("__i")).groupBy("__i").agg(F.max("y").alias("y"))
    marks = marks.orderBy(F.xxhash64("__i"), "__i").limit(sample)
    ids = {r[0]: r[1] for r in marks.collect()}
    if not ids:
        return Model({}, -50.0)
    chosen = F.broadcast(spark.createDataFrame(list(ids.items()), "__i long, y int"))
    taught = docs.select(F.col(id_col).cast("long").alias("__i"), F.col(text_col).alias("t")).join(chosen, "__i").dropna()
    taught = stage(taught.groupBy("__i").agg(F.max("y").alias("y"), F.min("t").alias("t")).select("y", "t"), "taught")

    def count(batches: Iterator[list[list]]) -> Iterator[list]:
        n = (Counter(), Counter())

        def out() -> list:
            every = list(n[0].keys() | n[1].keys())
            return [every, [n[0][f] for f in every], [n[1][f] for f in every]]

        for ys, texts in batches:
            for y, t in zip(ys, texts, strict=True):
                n[y > 0].update({f for w in set(_WORD.findall(t.lower())) for f in features(w)} | {""})
            if len(n[0]) + len(n[1]) > 400_000:
                yield out()
                n = (Counter(), Counter())
        yield out()

    counts = stage(map_columns(taught, "f string, n0 long, n1 long", count).groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "word-counts")
    total = counts.where("f = ''").first()
    n0, n1 = (total["n0"], total["n1"]) if total else (0, 0)
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return Model({}, math.log(share / (1 - share)) if 0 < share < 1 else 50.0 if share else -50.0)
    # chi-squared of the feature against the label, cut to the strongest
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    chi = (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n0 + n1 - a - b) + 1e-9)
    terms = sorted(_SWAP)
    picked = counts.where((F.col("f") != "") & (a + b >= MIN_ROWS)).orderBy(chi.desc(), "f").limit(vocabulary)
    odds = {r["f"]: math.log((r["n1"] + 0.5) / (n1 + 1)) - math.log((r["n0"] + 0.5) / (n0 + 1)) for r in picked.collect()}
    names = sorted(odds.keys() | set(terms))
    index = {f: i for i, f in enumerate(names)}
    # a feature's size is its log odds: weak ones, mostly chance, must earn a large weight
    scale = np.array([max(0.1, abs(odds.get(f, 1.0))) ** SHARPNESS for f in names])

    def rows(batches: Iterator[list[list]]) -> Iterator[list]:
        for ys, texts in batches:
            out = [[], [], []]
            for y, t in zip(ys, texts, strict=True):
                own = {f for w in set(_WORD.findall(t.lower())) for f in features(w)}
                out[0].append(int(y > 0))
                out[1].append(sorted(index[f] for f in own if f in index))
                out[2].append([x for lost, won in swaps(t) for x in [*(-1 - index[f] for f in sorted(lost) if f in index), *(1 + index[f] for f in sorted(won) if f in index), 0]])
            yield out

    got = map_columns(taught, "y int, x array<int>, c array<int>", rows).toArrow()
    y = np.array(got.column("y").to_pylist(), dtype=float)
    order = sorted(range(len(y)), key=lambda i: (y[i], xs[i])) if (xs := got.column("x").to_pylist()) else []
    deltas, one = [], []
    for flat in got.column("c").to_pylist():
        for v in flat:
            if v:
                one.append((abs(v) - 1, math.copysign(1, v)))
            else:
                deltas.append(sorted(one))
                one = []
    w, bias = _train([xs[i] for i in order], y[order], sorted(deltas), scale, counterfactual)
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-9}, float(bias))


def _train(xs: list[list[int]], y: np.ndarray, deltas: list[list[tuple[int, float]]], scale: np.ndarray, counterfactual: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Full-batch Adam on logistic loss, ridge and counterfactual penalty."""
    size = len(scale)
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    col = np.fromiter((i for x in xs for i in x), dtype=np.int64, count=len(row))
    drow = np.repeat(np.arange(len(deltas)), [len(d) for d in deltas]) if deltas else np.zeros(0, np.int64)
    dcol = np.array([i for d in deltas for i, _ in d], dtype=np.int64)
    dval = np.array([v for d in deltas for _, v in d], dtype=float)
    # a rarer label weighs more, up to four times, so short texts with one strong word count
    weight = np.where(y > 0, min(4.0, max(1.0, (y == 0).sum() / max(1, (y > 0).sum()))), 1.0)
    weight /= weight.sum()
    w, bias = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, weights=(w * scale)[col], minlength=len(xs))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(scale * np.bincount(col, weights=g[row], minlength=size) + RIDGE * w, g.sum())
        if len(deltas):
            change = np.bincount(drow, weights=(w * scale)[dcol] * dval, minlength=len(deltas))
            grad[:-1] += 2 * counterfactual / len(deltas) * scale * np.bincount(dcol, weights=change[drow] * dval, minlength=size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w * scale, bias


def score_column(model: Model, text: Column) -> Column:
    """Scores of whole texts, 0 to 1; a null text counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    return run(text)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted. A null id is never held out."""
    prepare(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias(id_col), score_column(model, F.col(text_col)).alias("score"))
    held = F.coalesce(~learnable(id_col), F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
