import pytest

from codeloom.functions import versions


@pytest.mark.parametrize(
    ("version", "constraints", "met"),
    [("5.3", ">= 5.1, < 5.4", True), ("5.4", ">= 5.1, < 5.4", False), ("1.2-3", "1.2-3", True), ("1.2-3", "== 1.2", True), ("1.2-3", ">= 1.2.1", False), ("1.2", "== 1.2.0", False),
     ("2.3.9", "~> 2.3", True), ("2.4", "~> 2.3", False), ("1.0", "~= 1.0", False), ("1.0", "!= 1.0", False), ("1.0", "= 1.0", True), ("1.0", "@1.0", True), ("scm-1", ">= 1.0", True), ("1.0-1", "scm", False),
     ("1.0rc1-1", ">= 1.0", False), ("1.0beta2", "< 1.0rc1", True), ("1.0alpha", "< 1.0beta", True), ("3.1.3-0", "3.1.3-1", False), ("3.1.3-0", "> 3.1.3-1", False), ("1.5-2", "< 1.5-3", True),
     ("1", ">>> 1", None), ("1", ">=", None), (None, "", True), ("1", None, True), (None, "> 1", None), ("", "> 1", None)],
)
def test_satisfies(version, constraints, met):
    assert versions.satisfies(version, constraints) is met


def test_satisfaction_column(spark):
    from codeloom.runtime import prepare

    prepare(spark)
    df = spark.createDataFrame([("1.5", "> 1"), ("x", ">> 1"), ("1", "> 1"), (None, None)], "v string, c string")
    assert [r[0] for r in df.select(versions.satisfaction(df.v, df.c)).collect()] == [True, None, False, True]
