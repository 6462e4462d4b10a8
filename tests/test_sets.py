import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.functions import sets as S

X = F.col("x")
STRINGS = T.ArrayType(T.StringType())


def test_code_set(values):
    assert values(["86011", "-9", "", None, "86011;86012"], S.code_set(X, T.StringType())) == [["86011"], [], [], [], ["86011;86012"]]
    assert values([["86012", "86011", "-9", None, "", "86011"], [], None], S.code_set(X, STRINGS), "array<string>") == [["86011", "86012"], [], []]
    assert values([-9, 86011], S.code_set(X, T.IntegerType()), "int") == [[], ["86011"]]
    assert values([[86001, 86000]], S.code_set(X, T.ArrayType(T.IntegerType())), "array<int>") == [["86000", "86001"]]


A, B, AB, BC, NONE = ["a"], ["b"], ["a", "b"], ["b", "c"], []
#           truth, model, OO,    OM,    MO,    MM
TRUTH_TABLE = [
    (A, A, True, True, True, True),
    (A, B, False, False, False, False),
    (A, AB, False, True, False, True),
    (AB, A, False, False, True, True),
    (AB, BC, False, False, False, True),
    (AB, ["c"], False, False, False, False),
    (NONE, A, False, False, False, False),
    (A, NONE, False, False, False, False),
    (NONE, NONE, False, False, False, False),
]


def test_codes_match(spark):
    rows = spark.createDataFrame([(i, t, m) for i, (t, m, *_) in enumerate(TRUTH_TABLE)], "i int, t array<string>, m array<string>")
    found = rows.select("i", *[S.codes_match(F.col("t"), F.col("m"), k).alias(k) for k in ("OO", "OM", "MO", "MM")]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in found] == [row[2:] for row in TRUTH_TABLE]


def test_unknown_method_fails_at_once():
    with pytest.raises(ValueError):
        S.codes_match(X, X, "INVALID")


def test_jaccard_and_friends(spark):
    rows = spark.createDataFrame(
        [(0, ["a", None], ["a", "b"]), (1, [], []), (2, [None], [None]), (3, ["a"], ["b"]), (4, ["a", "b"], ["b"])],
        "i int, t array<string>, m array<string>",
    )
    t, m = F.col("t"), F.col("m")
    found = rows.select(
        "i", S.jaccard(t, m).alias("j"), S.only_member(m).alias("only"), S.fill_empty(t, m).alias("filled"), S.is_ambiguous(t).alias("amb"),
        S.few_but_not_single(t, m).alias("few"),
    ).orderBy("i").collect()
    assert [r.j for r in found] == [0.5, 1.0, 1.0, 0.0, 0.5]
    assert [r.only for r in found][3:] == ["b", "b"]
    assert found[1].filled == [] and found[1].amb and not found[3].amb
    assert [r.few for r in found] == [True, True, False, False, True]
