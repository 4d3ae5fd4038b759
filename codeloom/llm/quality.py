"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. With no
true label known, expectation-maximisation estimates how often each labeller votes each
way on good and on bad documents, and from that the probability that a document is
good. Documents with equal votes are alike to it, so it runs on counts of vote patterns
over all documents. The posterior labels then train a linear scorer on hashed word
shapes, which sees more than the votes and scores every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_columns, row_key
from codeloom.runtime import prepare, stage

#: Hashed features, and documents the scorer learns from at most (those with the smallest row keys).
DIMENSIONS, SAMPLE = 2_048, 20_000
#: Score from which a document is kept.
THRESHOLD = 0.5
#: Share of good documents that the estimation begins with.
PRIOR = 0.8
#: Votes on bad (0) and good (1) documents that it begins with.
START = ({"g": 0.4, "b": 0.3, "-": 0.3}, {"g": 0.6, "b": 0.02, "-": 0.38})

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_REPEAT = re.compile(rb"(.)\1+")
_PLAIN = bytes(c for c in range(256) if chr(c) in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\t\r.,;:'\"-()?!" or c >= 128)
_CAPITALS = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])


def statistics(text: str) -> dict[str, float]:
    data = text.encode()
    words = data.split()
    n, size = len(words), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = size - len(data.translate(None, _LETTERS))
    top = Counter(words).most_common(1)[0][1] if words else 0
    return {
        "words": n,
        "symbols": len(data.translate(None, _PLAIN)) / size,
        "capitals": (size - len(data.translate(None, _CAPITALS))) / max(1, letters),
        "letters": letters / size,
        "echo": sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n - 1),
        "top": top / max(1, n),
        "distinct": len(set(words)) / max(1, n),
        "length": sum(map(len, words)) / max(1, n),
        "shouts": data.count(b"!") / max(1, n),
        "bars": (data.count(b"|") + data.count(b"\t")) / max(1, n),
        "ended": sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines) / max(1, len(lines)),
        "same_lines": 1 - len(set(lines)) / max(1, len(lines)),
    }


def _vote(bad: bool, good: bool = False) -> str:
    return "b" if bad else "g" if good else "-"


#: The labellers: statistics -> g(ood), b(ad) or - (abstains). Those that look for one kind
#: of junk abstain where they don't see it.
LABELLERS = (
    ("symbols", lambda s: _vote(s["symbols"] > 0.03)),
    ("capitals", lambda s: _vote(s["capitals"] > 0.25)),
    ("echo", lambda s: _vote(s["echo"] > 0.1)),
    ("top_word", lambda s: _vote(s["words"] >= 10 and s["top"] > 0.2)),
    ("shouts", lambda s: _vote(s["shouts"] > 0.15)),
    ("bars", lambda s: _vote(s["bars"] > 0.1)),
    ("lines", lambda s: _vote(s["same_lines"] > 0.4)),
    ("size", lambda s: _vote(s["words"] < 3)),
    ("variety", lambda s: _vote(s["words"] >= 20 and s["distinct"] < 0.15, s["words"] >= 20 and s["distinct"] > 0.4)),
    ("word_length", lambda s: _vote(s["length"] > 14 or s["length"] < 2, 3 < s["length"] < 9)),
    ("letters", lambda s: _vote(s["letters"] < 0.7, s["letters"] > 0.76)),
    ("endings", lambda s: _vote(s["ended"] < 0.2, s["ended"] > 0.6)),
)


def votes(text: str | None) -> str:
    s = statistics(text or "")
    return "".join(f(s) for _, f in LABELLERS)


@dataclass
class Accuracies:
    """P(vote | good or bad) for each labeller, and the share of good documents."""

    prior: float
    table: dict[tuple[int, str, int], float]

    def posterior(self, pattern: str) -> float:
        good, bad = math.log(max(self.prior, 1e-12)), math.log(max(1 - self.prior, 1e-12))
        for i, v in enumerate(pattern):
            good += math.log(self.table[i, v, 1])
            bad += math.log(self.table[i, v, 0])
        return 1 / (1 + math.exp(min(700, max(-700, bad - good))))


def estimate(counts: dict[str, int], rounds: int = 100) -> Accuracies:
    """Expectation-maximisation over (pattern -> documents).

    It starts from labellers that rarely call a good document bad but often miss a bad one.
    A thousandth of the documents is added as votes like that start, which keeps votes that
    never occur possible and the classes from changing places.
    """
    size = len(next(iter(counts))) if counts else len(LABELLERS)
    start = {(i, v, c): START[c][v] for i in range(size) for v in "gb-" for c in (0, 1)}
    total = sum(counts.values())
    acc = Accuracies(PRIOR, dict(start))
    extra = max(1.0, 0.001 * total)
    for _ in range(rounds if total else 0):
        mass = {k: extra * p for k, p in start.items()}
        sums = [extra, extra]
        good = 0.0
        for pattern, n in sorted(counts.items()):
            g = acc.posterior(pattern)
            good += n * g
            for c, w in ((1, n * g), (0, n * (1 - g))):
                sums[c] += w
                for i, v in enumerate(pattern):
                    mass[i, v, c] += w
        new = Accuracies((good + extra * PRIOR) / (total + extra), {(i, v, c): m / sums[c] for (i, v, c), m in mass.items()})
        change = max(abs(new.table[k] - acc.table[k]) for k in start)
        acc = new
        if change < 1e-6:
            break
    return acc


def featurizer():
    """text -> (places, values): hashed shapes of words and of pairs of them, scaled by log share."""

    class Known(dict):
        def __missing__(own, shape: bytes) -> int:  # noqa: N805
            if len(own) > 200_000:
                own.clear()
            own[shape] = got = zlib.crc32(_REPEAT.sub(rb"\1", shape)) % DIMENSIONS
            return got

    known = Known()

    def run(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        data = (text or "").encode()
        shapes = data.translate(_SHAPE).split()
        if not shapes:
            return np.zeros(1, np.int32), np.ones(1, np.float32)
        h = np.fromiter(map(known.__getitem__, shapes), dtype=np.int64, count=len(shapes))
        words = data.split()
        same = np.fromiter(map(bytes.__eq__, words, words[1:]), dtype=bool, count=len(words) - 1)
        pair = (h[:-1] * 31 + h[1:] * 17 + same * 977 + 5) % DIMENSIONS
        n = np.bincount(np.concatenate((h, pair)), minlength=DIMENSIONS)
        at = np.flatnonzero(n)
        return at.astype(np.int32), np.log1p(100 * n[at] / len(shapes)).astype(np.float32)

    return run


def train(rows: list[tuple[list[int], list[float]]], target: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam."""
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    col = np.fromiter((i for a, _ in rows for i in a), dtype=np.int64, count=len(row))
    val = np.fromiter((v for _, b in rows for v in b), dtype=float, count=len(row))
    w, bias, m, v = np.zeros(DIMENSIONS), 0.0, np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    share = float(np.clip(target.mean(), 0.01, 0.99)) if len(target) else 0.5
    weight = target / (2 * share) + (1 - target) / (2 * (1 - share))  # both classes weigh the same
    for t in range(1, steps + 1 if len(rows) else 1):
        z = bias + np.bincount(row, weights=w[col] * val, minlength=len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        grad = np.append(np.bincount(col, weights=g[row] * val, minlength=DIMENSIONS) + ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: id, votes, posterior, score (0 to 1, higher: better), kept.

    Votes and the accuracies use every document. Null texts count as empty, get votes and
    a score like any text and are mostly found bad. An empty table gives no rows. The
    scorer learns from at most sample documents, with the posterior as a soft label.
    """
    spark = prepare(docs.sparkSession)

    def vote(batches: Iterator[list[list]]) -> Iterator[list]:
        run = featurizer()
        for ids, rows, texts in batches:
            made = [run(t) for t in texts]
            yield [ids, rows, [votes(t) for t in texts], [a for a, _ in made], [b for _, b in made]]

    src = docs.select(F.col(id_col).cast("long").alias("i"), row_key(id_col, text_col), F.col(text_col).alias("t"))
    seen = map_columns(src, "i long, row binary, votes string, at array<int>, v array<float>", vote)
    seen = stage(seen, "quality-votes")
    counts = {r[0]: r[1] for r in seen.groupBy("votes").count().collect()}  # 3 ** labellers at most
    accuracies = estimate(counts)
    posterior = {p: accuracies.posterior(p) for p in counts}
    # the smallest keys, each once: rows of one key are equal in id and text, and so in votes and features
    keys = seen.groupBy("row").agg(F.count("*").alias("n")).orderBy("row").limit(sample)
    cut = [r[0] for r in keys.collect()]
    learnt = seen.where(F.col("row") <= F.lit(cut[-1])).groupBy("row").agg(F.min(F.struct("votes", "at", "v")).alias("x")).select("x.votes", "x.at", "x.v").toArrow() if cut else None
    rows, target = [], np.zeros(0)
    if learnt is not None:
        got = sorted(zip(learnt.column("votes").to_pylist(), learnt.column("at").to_pylist(), learnt.column("v").to_pylist(), strict=True))
        rows, target = [(a, b) for _, a, b in got], np.array([posterior[p] for p, _, _ in got])
    w, bias = train(rows, target)
    shared = spark.sparkContext.broadcast((w, bias, posterior))

    def score(batches: Iterator[list[list]]) -> Iterator[list]:
        w, bias, posterior = shared.value
        for ids, patterns, at, v in batches:
            z = [bias + float(w[np.array(a, dtype=np.int64)] @ np.array(b)) for a, b in zip(at, v, strict=True)]
            s = [1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in z]
            yield [ids, patterns, [posterior[p] for p in patterns], s, [x >= THRESHOLD for x in s]]

    return map_columns(seen.select("i", "votes", "at", "v"), f"`{id_col}` long, votes string, posterior double, score double, kept boolean", score)
