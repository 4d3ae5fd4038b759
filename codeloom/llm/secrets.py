"""Secret scanning: patterns, and a battery of randomness tests with false-discovery control.

Beside three patterns, any run of key-like characters is a candidate (an equals sign
belongs to one only as padding at its end). Its encoding is inferred from its characters.
Three tests look at it: chi-squared uniformity over the encoding's alphabet, the number of
runs above and below the middle of the alphabet, and the serial correlation of neighbours.
Each is read twice:

* against a random string of that alphabet: by Fisher's combination, a candidate that is
  clearly not random is no secret (p-value 1, but it still counts as a test);
* against ordinary writing in that encoding, whose letters are less even, whose neighbours
  more often stand on one side of the middle (characters are in code order, so digits,
  capitals and small letters stand together) and whose separators leave a negative serial
  correlation: Stouffer's weighted combination of the three gives the probability that
  ordinary writing of this length looks as random.

Over all candidates of the corpus, those that failed included, the Benjamini-Hochberg rule
picks the p-values that count as discoveries, for each encoding and class of lengths on its
own, since short candidates are many and prove little.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_columns
from codeloom.runtime import prepare, stage

# The three base patterns, with group 2 of the first and the lengths that count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "random")
#: Characters of a candidate at least, false discoveries accepted, combined p-value of randomness at least.
LEAST, RATE, PASS = 20, 0.05, 0.01
#: Negative decimal exponents of p-values are counted in bins of this width, up to this many.
BIN_WIDTH, BINS = 0.05, 2_000

# an equals sign parts candidates, as in name=value, unless it pads the end
_PAD = r"(?![A-Za-z0-9+/_=-])"
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}(?:={{1,2}}{_PAD})?|[A-Za-z0-9+/_-]{{{LEAST - 1}}}={{1,2}}{_PAD}|[A-Za-z0-9+/_-]{{{LEAST - 2}}}=={_PAD}")
_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
#: Alphabets of encodings in code order, narrowest first.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
ENCODINGS = list(ALPHABETS)
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS.items()]
#: Of ordinary writing by encoding: the probability that two characters are equal, and that
#: neighbours lie on two sides of the middle. Letters have 0.066 in ordinary writing, parted
#: by case 0.05; long ordinary numbers are padded or repeat, so twice an even share. Measured
#: on identifiers of public Python code: 0.049 to 0.064 and 0.03 to 0.28 in mixed case, 0.3
#: and more in digits; on joined words of the test documents 0.056 to 0.083 and 0.17 to 0.43.
ORDINARY = {"decimal": (0.2, 0.5), "hex": (0.125, 0.5), "HEX": (0.125, 0.5), "base32": (0.066, 0.5), "upper": (0.066, 0.5), "lower": (0.066, 0.5), "base62": (0.05, 0.35), "base64": (0.05, 0.35), "base64url": (0.05, 0.35)}
#: Serial correlation of ordinary writing.
ORDINARY_SERIAL = -0.15
#: Weights of the three tests where ordinary writing has fewer runs than random strings, and where not.
WEIGHTS = {True: (1.0, 0.7, 0.2), False: (1.0, 0.1, 0.1)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _upper(z: float) -> float:
    """P(N > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _score(p: float) -> float:
    """z with P(N > z) = p, by the tail's asymptotic series refined by Newton's method."""
    p = min(max(p, 1e-12), 1 - 1e-12)
    if p > 0.5:
        return -_score(1 - p)
    z = math.sqrt(max(0.0, -2 * math.log(2 * p))) * 0.8
    for _ in range(8):
        z += (_upper(z) - p) / max(1e-300, math.exp(-z * z / 2) / math.sqrt(2 * math.pi))
    return z


def battery(token: str) -> tuple[str, float, float]:
    """(encoding, combined p-value of randomness, discovery p-value) of a candidate.

    Strings of one character, or of an alphabet none of the encodings holds, get ("", 0, 1).
    """
    body = token.rstrip("=")
    chars = set(body)
    name, found, at = next(((e, a, at) for e, a, at in _SETS if chars <= a), ("", None, {}))
    n = len(body)
    if found is None or n < 2 or len(chars) < 2:
        return "", 0.0, 1.0
    k = len(found)
    v = [at[c] for c in body]
    squares = sum(c * c for c in Counter(v).values())
    chi = k * squares / n - n
    # Wilson and Hilferty's cube root brings chi-squared near to normal
    df = k - 1
    z_chi = ((max(chi, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p_chi = _upper(z_chi)
    # runs above and below the middle of the alphabet
    high = [x >= k // 2 for x in v]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _upper(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    # serial correlation at distance one
    m = sum(v) / n
    d = sum((x - m) ** 2 for x in v)
    r = sum((x - m) * (y - m) for x, y in zip(v, v[1:], strict=False)) / d if d else 1.0
    off = abs(r + 1 / n) * math.sqrt(n)
    p_serial = min(1.0, 2 * _upper(off))
    # Fisher: -2 sum(ln p) has six degrees of freedom
    f = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi, min(1.0, p_runs), p_serial))
    combined = math.exp(-f / 2) * (1 + f / 2 + f * f / 8)
    # against ordinary writing: pairs of equal characters are about a gamma variable, whose
    # variance counts pairs that share a character; its cube root is near to normal
    rate, change = ORDINARY[name]
    pairs = n * (n - 1) / 2
    mean = pairs * rate
    shape = mean * mean / (mean * (1 - rate) + 0.3 * n * (n - 1) * (n - 2) * rate * rate)
    z1 = ((1 - 1 / (9 * shape)) - (max(squares - n, 1) / 2 / mean) ** (1 / 3)) * math.sqrt(9 * shape)
    z2 = (runs - 1.5 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change))
    # the probability that ordinary writing is as near to a random string's correlation
    shift = (ORDINARY_SERIAL + 1 / n) * math.sqrt(n)
    z3 = _score(_upper(-off - shift) - _upper(off - shift))
    weights = WEIGHTS[change < 0.5]
    z = sum(w * x for w, x in zip(weights, (z1, z2, z3), strict=True)) / math.hypot(*weights)
    return name, combined, _upper(z)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, discovery p-value) of all candidates outside base spans; 1 for those that fail the battery."""
    ends, starts = [], []  # base spans, overlapping ones united
    for s, e, _ in sorted(base):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        i = bisect_right(ends, s)  # the first span that ends behind the candidate's start
        if i < len(starts) and starts[i] < e:
            continue
        name, random, p = battery(m[0])
        out.append((s, e, name, p if random >= PASS else 1.0))
    return out


def _bin(p: float) -> int:
    """Down to the bin's edge, so a threshold never accepts a larger p-value than meant."""
    return min(BINS, int(-math.log10(max(p, 1e-300)) / BIN_WIDTH))


def test_class(encoding: str, n: int) -> int:
    """The encoding and the class of lengths, whose classes double in width, as one number."""
    return n.bit_length() * 16 + (ENCODINGS.index(encoding) if encoding else 15)


def thresholds(counts: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """Benjamini and Hochberg's rule by class, from (class, bin, number)."""
    out = {}
    for c in {x[0] for x in counts}:
        own = sorted(((b, n) for k, b, n in counts if k == c), reverse=True)
        total, below, best = sum(n for _, n in own), 0, None
        for b, n in own:  # from the smallest p-values on
            below += n
            if 10 ** (-b * BIN_WIDTH) <= rate * below / total:
                best = b
        if best is not None:
            out[c] = best
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are kind:start:end in code points, by start and then kind. Null and empty texts
    have none; repeated rows give repeated results; a very long text is one row's work, linear
    in its length. All candidates of the corpus take part in the false-discovery control;
    only their counts by class and p-value bin, at most a few thousand numbers for each
    power of two in length, go to the driver.
    """
    spark = prepare(docs.sparkSession)

    def scan(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts in batches:
            out = [ids, [], [], [], [], []]
            for t in texts:
                base = base_spans(t or "")
                own = candidates(t or "", base)
                out[1].append([f"{k}:{s}:{e}" for s, e, k in base])
                out[2].append([s for s, _, _, _ in own])
                out[3].append([e for _, e, _, _ in own])
                out[4].append([test_class(k, e - s) for s, e, k, _ in own])
                out[5].append([_bin(p) for _, _, _, p in own])
            yield out

    schema = "i long, base array<string>, s array<int>, e array<int>, c array<int>, b array<int>"
    found = stage(map_columns(docs.select(F.col(id_col).cast("long"), F.col(text_col)), schema, scan), "secrets")
    seen = found.where(F.size("c") > 0).select(F.explode(F.arrays_zip("c", "b")).alias("x")).groupBy("x.c", "x.b").count()
    limit = thresholds([(r[0], r[1], r[2]) for r in seen.collect()], rate)

    def join(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, base, s, e, c, b in batches:
            out = [ids, [], [], [], [], [], []]
            for x, *own in zip(base, s, e, c, b, strict=True):
                kinds = [v.split(":")[0] for v in x]
                more = [f"random:{p}:{q}" for p, q, k, n in zip(*own, strict=True) if k in limit and n >= limit[k]]
                every = sorted(x + more, key=lambda v: (int(v.split(":")[1]), KINDS.index(v.split(":")[0])))
                for i, kind in enumerate(KINDS[:3]):
                    out[i + 1].append(kinds.count(kind))
                out[4].append(len(more))
                out[5].append(hashlib.sha256(",".join(x).encode()).hexdigest())
                out[6].append(",".join(every))
            yield out

    return map_columns(found, f"`{id_col}` long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string", join)
