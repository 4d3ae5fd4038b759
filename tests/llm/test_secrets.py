import hashlib
import random
import re

from codeloom.llm import secrets as S


def test_base_patterns_by_plain_search():
    slow = {
        "assign": lambda t: [m.span() for m in re.finditer(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8],
        "access": lambda t: [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16],
        "hex": lambda t: [m.span() for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32],
    }
    rng = random.Random(1)
    parts = ["token", "=", ":", " ", '"', "password", "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "secret", "é", "\n", "x", "API_KEY", "Apıkey", "toKen"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        for kind, find in slow.items():
            assert [(s, e) for s, e, k in S.base_spans(t) if k == kind] == find(t), t


def draw(rng, name, n):
    return "".join(rng.choice(S.ALPHABETS[name]) for _ in range(n))


def ordinary(rng):
    """Words of ordinary letter frequencies, joined as identifiers and paths are."""
    letters, weights = "etaoinshrdlucmwfgypbvkjxqz", [127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1]
    parts = ["".join(rng.choices(letters, weights, k=rng.randint(2, 10))) for _ in range(9)]
    style = rng.choice("-_/c ")
    text = "".join(w.capitalize() for w in parts) if style == "c" else style.strip().join(parts)
    return text[: rng.randint(20, 60)]


def test_battery_parts_keys_from_words():
    rng = random.Random(3)
    keys = [draw(rng, "base62", 40) for _ in range(200)]
    assert sum(p >= S.PASS for _, p, _ in map(S.battery, keys)) > 185
    assert sum(q < 1e-2 for *_, q in map(S.battery, keys)) > 190  # ordinary writing varies more than the first version assumed
    for bad in ("a" * 30, "ab" * 20, "0123456789" * 4):
        assert S.battery(bad)[1] < S.PASS
    assert S.battery("") == ("", 0.0, 1.0)


def test_discovery_p_values_are_no_smaller_than_chance_on_ordinary_writing():
    rng = random.Random(9)
    p = [x[3] for _ in range(4000) for x in S.candidates(ordinary(rng), [])]
    for level in (0.05, 0.01, 0.001):
        assert sum(x <= level for x in p) <= 1.5 * level * len(p) + 4, level


def test_recall_by_encoding_and_false_discoveries():
    """Planted keys beside ordinary candidates; the bounds are what README states."""
    rng = random.Random(7)
    for name, n, least in (("base62", 24, 0.75), ("base62", 40, 0.9), ("base64", 40, 0.9), ("base32", 32, 0.7), ("HEX", 32, 0.8), ("HEX", 64, 0.95), ("hex", 24, 0.6), ("upper", 40, 0.9), ("base62", 20, 0.5)):
        tokens = [(draw(rng, name, n), 1) for _ in range(200)] + [(ordinary(rng), 0) for _ in range(3000)]
        rows = []
        for t, key in tokens:
            e, random_, p = S.battery(t)
            rows.append((S.test_class(e, len(t)), S._bin(p if random_ >= S.PASS else 1.0), key))
        counts = {}
        for c, b, _ in rows:
            counts[c, b] = counts.get((c, b), 0) + 1
        limit = S.thresholds([(c, b, m) for (c, b), m in counts.items()])
        found = [key for c, b, key in rows if c in limit and b >= limit[c]]
        assert sum(found) >= least * 200, (name, n, sum(found))
        assert found.count(0) <= 2 * S.RATE * len(found) + 2, (name, n)


def test_key_free_text_gives_next_to_nothing(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(ordinary(rng) for _ in range(20))) for i in range(100)]
    got = S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_random for r in got) <= 3


def test_false_discovery_rule():
    assert S.thresholds([]) == {}
    # nothing but chance: uniform p-values
    per = round(1 / S.BIN_WIDTH)
    assert S.thresholds([(5, b, round(1000 * (10 ** (-b / per) - 10 ** (-(b + 1) / per)) + 1)) for b in range(2 * per)]) == {}
    got = S.thresholds([(5, 0, 100), (5, 10 * per, 50), (6, 0, 10)])
    assert got == {5: 10 * per}


def brute(texts):
    """Spans by sorting all p-values of the corpus, class by class."""
    tests = []
    for d, t in texts.items():
        base = S.base_spans(t or "")
        for m in S._CANDIDATE.finditer(t or ""):
            if not any(m.start() < e and s < m.end() for s, e, _ in base):
                name, ok, p = S.battery(m[0])
                tests.append((S.test_class(name, len(m[0])), 10 ** (-S._bin(p if ok >= S.PASS else 1.0) * S.BIN_WIDTH), d, m.span()))
    out = {d: [(s, S.KINDS.index(k), e) for s, e, k in S.base_spans(t or "")] for d, t in texts.items()}
    for c in {x[0] for x in tests}:
        own = sorted(x for x in tests if x[0] == c)
        good = [x[1] for i, x in enumerate(own) if x[1] <= S.RATE * (1 + max(j for j, y in enumerate(own) if y[1] == x[1])) / len(own)]
        for _, p, d, (s, e) in own:
            if good and p <= max(good):
                out[d].append((s, 3, e))
    return {d: ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(x)) for d, x in out.items()}


def test_equals_brute_force(spark):
    rng = random.Random(14)
    texts = {}
    for i in range(150):
        parts = [ordinary(rng) for _ in range(rng.randint(0, 4))]
        parts += [draw(rng, rng.choice(S.ENCODINGS), rng.choice((20, 24, 33, 64))) for _ in range(rng.randint(0, 2))]
        parts += rng.sample(["token=abcdefghij", "AKIA" + "Q7" * 8, "api_key: '" + draw(rng, "base62", 30) + "'", draw(rng, "hex", 40)], rng.randint(0, 2))
        rng.shuffle(parts)
        texts[i] = " é ".join(parts)
    texts |= {150: None, 151: "", 152: texts[1]}
    got = {r.doc_id: r.spans for r in S.find_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts) and sum(x.count("random") for x in got.values()) > 50


def test_key_dump_is_linear():
    import time

    rng = random.Random(15)
    text = "\n".join(f"token={draw(rng, 'base62', 12)} {draw(rng, 'base62', 32)}" for _ in range(20_000))
    began = time.process_time()
    assert len(S.candidates(text, S.base_spans(text))) == 20_000
    assert time.process_time() - began < 20


def test_documents(spark, hard, empty):
    rng = random.Random(8)
    keys = ["".join(rng.choice(S.ALPHABETS["base62"]) for _ in range(48)) for _ in range(30)]
    rows = [(i, f"say {k} aloud, token: abcdefgh1 é") for i, k in enumerate(keys)] + [(99, None), (100, "")]
    got = {r.doc_id: r for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 32 and got[99].spans == "" and got[99].base_sha256 == hashlib.sha256(b"").hexdigest()
    found = [i for i in range(30) if f"random:4:{4 + 48}" in got[i].spans]
    assert len(found) >= 25
    at = f"say {keys[0]} aloud, ".__len__()
    assert got[0].n_assign == 1 and got[0].base_sha256 == hashlib.sha256(f"assign:{at}:{at + 16}".encode()).hexdigest()
    assert S.find_secrets(hard).count() == hard.count()
    assert S.find_secrets(empty).count() == 0


def test_every_run_of_key_characters_is_tested():
    rng = random.Random(12)
    spans = lambda t: [x[:2] for x in S.candidates(t, S.base_spans(t)) if x[3] < 1]
    for name in ("auth", "sig", "aws_secret_access_key"):
        found = 0
        for _ in range(50):
            key = draw(rng, "base62", 40)
            found += (len(name) + 1, len(name) + 41) in spans(f"{name}={key} x")
        assert found > 45, name
    for kind, letters in (("decimal", "0123456789"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("base62", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        keys = ["".join(rng.choice(letters) for _ in range(24)) for _ in range(50)]
        assert sum((0, 24) in spans(k) for k in keys) > 30, kind
    pads = ["".join(rng.choice(S.ALPHABETS["base64"]) for _ in range(18)) + "==" for _ in range(50)]
    assert sum((0, 20) in spans(p) for p in pads) > 40


def test_failed_candidates_count_as_tests():
    assert S.candidates("ab" * 20, []) == [(0, 40, "hex", 1.0)]
