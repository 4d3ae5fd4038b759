"""Ranked search on small tables and by the rules it states."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import search as S


@pytest.fixture(scope="module")
def symbols(spark):
    names = ["parse_request", "ParseRequest", "parse_request_body", "request_parser", "getUser", "fetch_user", "HTTPServer", "user", "read", "b_in_a"]
    rows = [(i, n, "function", "Type" if i == 8 else None, f"src/{'net' if i % 2 else 'core'}.py", i, 1, "python") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "symbol_id long, name string, kind string, parent string, relative_path string, line int, col int, language string")


def names(df, order=S.ORDER):
    return [r["name"] for r in (df.orderBy(*order) if order else df).collect()]


def test_words_of_queries_equal_those_of_names(spark):
    samples = ["parseRequestBody", "HTTPServer", "IOError", "HTTP2Server", "base64Encode", "a_b-c d", "", "__", "ÉtatCivil", "x9Y"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    assert [r[0] for r in df.select(T.split_identifier(df.t)).collect()] == [S.split_words(s) for s in samples]


def test_tiers_and_fallback(symbols):
    assert names(S.search_symbols(symbols, "parse_request")) == ["parse_request", "ParseRequest", "parse_request_body", "request_parser"]
    assert names(S.search_symbols(symbols, "parse req"))[:2] == ["parse_request", "ParseRequest"]
    assert names(S.search_symbols(symbols, "server of the http"), None) == ["HTTPServer"]
    assert names(S.search_symbols(symbols, "a of !")) == [] and names(S.search_symbols(symbols, "")) == []


def test_synonyms_and_qualifiers(symbols):
    assert set(names(S.search_symbols(symbols, "get user"))) == {"getUser"}
    assert names(S.search_symbols(symbols, "get user", synonyms=True)) == ["getUser", "fetch_user"]
    assert S.qualified("A::b") == (["a"], "b") and S.qualified("x.y->z") == (["x", "y"], "z") and S.qualified("a b") is S.qualified("a.") is None
    got = S.search_symbols(symbols, "Type::read", qualifiers=True).collect()
    assert [(r.name, r.tier, r.outside) for r in got] == [("read", 0, False)]


def test_phrases(symbols):
    assert names(S.search_phrase(symbols, "parse request"), ["tier", "score", "relative_path", "line"]) == ["parse_request", "ParseRequest", "parse_request_body"]
    tiers = {n: t for n, t in symbols.select("name", S.phrase_tier(F.col("name"), "parse_request();")).collect()}
    assert [tiers[n] for n in ("parse_request", "ParseRequest", "parse_request_body", "request_parser")] == [0, 1, 2, 3]


def test_literals(spark):
    df = spark.createDataFrame([(1, "Café  is OPEN now"), (2, "the open cafe"), (3, "cafe is opened"), (4, "cafe, is open; cafe is open")], "id long, text string")
    got = [r.id for r in S.search_literals(df, "id", "text", "café is open", ["id"]).collect()]
    assert sorted(got) == [1, 4] and S.search_literals(df, "id", "text", " -", ["id"]).count() == 0


@pytest.mark.parametrize(
    ("query", "kind"),
    [("parse_go_mod", "identifier"), ("Type::member toon.decode", "identifier"), ("how to read files", "natural_language"), ("read", "mixed"), ("read parseHTTP now", "mixed"), ('"a b"', "exact_phrase"), ("", "mixed"), ("e.g", "mixed")],
)
def test_intents(query, kind):
    assert S.intent(query) == kind and S.ALPHA[kind] <= 0.75


def test_hybrid(symbols, spark):
    embed = S.hashed_embedder(16)
    rows = [(r.symbol_id, "m", v) for r, v in zip(symbols.collect(), embed([r.name for r in symbols.collect()]), strict=True)]
    vectors = spark.createDataFrame(rows, "symbol_id long, model string, vector array<float>")
    q = embed(["fetch user"])[0]
    got = S.hybrid_search(symbols, "fetch user", vectors, q).collect()
    assert got[0].name == "fetch_user" and got[0].semantic_rank == 1 and got[0].lexical_rank == 1
    assert abs(got[0].score - (0.25 / 11 + 0.75 / 11)) < 1e-12 and len(got) == symbols.count()
    assert [r.semantic_rank for r in S.hybrid_search(symbols, "fetch user", vectors, q, alpha=0).collect()] == [None, None]
    quoted = S.hybrid_search(symbols, '"parse request"', vectors, q).collect()
    assert [r.score > 1 for r in quoted] == [True, True, False] and quoted[0].name in ("parse_request", "ParseRequest")


def test_embedding_text_and_refresh(spark, symbols):
    df = symbols.withColumn("signature", F.lit("def  f(a,\n b)")).withColumn("doc", F.lit(None).cast("string")).withColumn("calls", F.array(F.lit("openFile"), F.lit("openFile")))
    text = df.where("symbol_id = 8").select(S.embedding_text(df)).first()[0]
    assert text == "[language: python] [scope: core::type] [symbol: read is function] [signature: def f(a, b)] [calls: open file]"
    empty = spark.createDataFrame([], "symbol_id long, model string, text_hash long, vector array<float>")
    made = S.refresh_embeddings(df, S.embedding_text(df), empty, "m1", S.hashed_embedder(8)).cache()
    assert made.count() == 10 and S.embedding_coverage(df, made, "m1").first() == (10, 10) and S.embedding_coverage(df, made, "m2").first() == (0, 10)

    def never(texts):
        raise AssertionError(texts)

    assert S.refresh_embeddings(df, S.embedding_text(df), made, "m1", never).count() == 10
    assert S.refresh_embeddings(df.where("symbol_id < 4"), S.embedding_text(df), made, "m1", never).count() == 4
