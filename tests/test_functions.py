"""Literal rows for functions and operators."""

from pyspark.sql import functions as F

from termloom.functions import slots as S
from termloom.functions import text as X
from termloom.operators import analytics as A
from termloom.operators import graph as G
from termloom.operators import intervals as I
from termloom.operators import planning


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def mask(spark, a, b):
    return one(spark, S.slot_mask(F.lit(a), F.lit(b)))


def test_masks(spark):
    assert mask(spark, 540, 660) & mask(spark, 660, 780) == 0
    assert mask(spark, 540, 690) & mask(spark, 660, 780) == 1 << 6
    assert mask(spark, 540, 710) & mask(spark, 710, 780) != 0  # ends are rounded up
    assert mask(spark, 300, 400) == 0 and mask(spark, 600, 600) == 0
    assert one(spark, S.mask_text(F.lit(5).cast("long"))) == "101" + "0" * 23


def test_times(spark):
    assert one(spark, S.hhmm(F.lit(570))) == "09:30"
    assert one(spark, S.to_minutes(F.lit("9.30"))) == 570 and one(spark, S.to_minutes(F.lit("x"))) is None
    assert str(one(spark, S.first_weekday(F.lit("2024-01-03").cast("date"), F.lit(0)))) == "2024-01-08"


def test_islands(spark):
    df = spark.createDataFrame([("u", 0b1101)], "k string, mask long")
    assert sorted((r["first"], r["after"]) for r in I.islands(df, ["k"], "mask", 26).collect()) == [(0, 1), (2, 4)]


def test_text(spark):
    assert one(spark, X.normal_code(F.lit(" c01–62 "))) == "C01-62"
    assert tuple(one(spark, X.credits(F.lit("3(2-2-5)")))) == (3, 2, 2, 5)
    assert tuple(one(spark, X.credits(F.lit("3")))) == (3, None, None, None)
    assert one(spark, X.chunks(F.lit("abcdefghij"), 4, 1)) == ["abcd", "defg", "ghij"]
    assert one(spark, X.ngrams(F.lit("abcd"), 3)) == ["abc", "bcd"] and one(spark, X.ngrams(F.lit("a"), 3)) == ["a"] and one(spark, X.ngrams(F.lit(""), 3)) == []
    assert one(spark, X.scrub(F.lit("call 081-234-5678 or a.b@c.org"))) == "call [PHONE] or [EMAIL]"
    assert one(spark, X.looks_like_id(F.lit("123456789-0"))) and not one(spark, X.looks_like_id(F.lit("12345")))
    assert one(spark, X.search_normal(F.lit("Sooo, GOOD!!"))) == "soo good"
    assert one(spark, X.escape_calendar(F.lit("a;b,c\nd\\"))) == "a\\;b\\,c\\nd\\\\"


def test_ingest_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, n int")
    assert sorted(r["n"] for r in A.ingest(df, "k", [F.col("n")]).filter("accepted").collect()) == [1, 3, 4]


def test_critical_path(spark):
    df = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("A", "E")], "a string, b string")
    assert {r["node"]: r["score"] for r in G.critical(df).collect()} == {"A": 34, "B": 22, "C": 11, "D": 0, "E": 0}


def test_cycles_raise(spark):
    df = spark.createDataFrame([("A", "B"), ("B", "A")], "a string, b string")
    try:
        G.reach(df, most=6)
        raise AssertionError("a cycle passed")
    except ValueError:
        pass


def test_greedy(spark):
    df = spark.createDataFrame([("u", 1, 3.0, 1, "x"), ("u", 2, 3.0, 1, "y"), ("u", 3, 2.0, 2, "z"), ("u", 4, 9.0, 4, "w")], "who string, rank int, cost double, mask long, item string")
    assert planning.greedy(df, "who", ["rank"], "cost", "mask", "item", 6.0).first()["chosen"] == "x,z"
