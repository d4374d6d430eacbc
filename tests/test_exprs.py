"""Column functions in both modes."""

import itertools

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x, kind="int"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize("a,b", list(itertools.product((None, 1, 2), repeat=2)))
def test_comparisons(spark, a, b):
    low = lambda x: -1 if x is None else x  # noqa: E731  null is the smallest
    want = {"eq": low(a) == low(b), "ne": low(a) != low(b), "lt": low(a) < low(b), "gt": low(a) > low(b), "le": low(a) <= low(b), "ge": low(a) >= low(b)}
    got = spark.range(1).select(*[getattr(X, k)(lit(a), lit(b), compat=True).alias(k) for k in want]).first().asDict()
    assert got == want
    plain = one(spark, X.lt(lit(a), lit(b)))
    assert plain == (None if a is None or b is None else a < b)


@pytest.mark.parametrize("start,end", list(itertools.product((None, -2, 0, 1, 3, 9), repeat=2)))
def test_slice(spark, start, end):
    items = [1, 2, 3]
    column = X.slice_(F.array(*map(F.lit, items)), None if start is None else F.lit(start), None if end is None else F.lit(end))
    assert one(spark, column) == items[max(start or 0, 0) : 3 if end is None else max(end, 0)]


def test_logic_and_lists(spark):
    null = lit(None, "boolean")
    assert one(spark, X.not_(null, compat=True)) is True and one(spark, X.not_(null)) is None
    assert one(spark, X.and_(null, F.lit(True), compat=True)) is False and one(spark, X.xor(null, F.lit(True), compat=True)) is True
    items, none = F.array(F.lit(1), F.lit(2)), lit(None, "array<int>")
    big = lambda x: x > 1
    assert [one(spark, f(items, big)) for f in (X.any_, X.all_, X.none, X.single)] == [True, False, False, True]
    assert [one(spark, f(none, big)) for f in (X.any_, X.all_, X.none, X.single)] == [False] * 4
    assert one(spark, X.all_(F.array().cast("array<int>"), big)) is True
    assert one(spark, X.comprehension(items, big, lambda x: x * 10)) == [20] and one(spark, X.comprehension(none)) == []
    assert one(spark, X.index(items, F.lit(1))) == 2 and one(spark, X.index(items, F.lit(-1))) is None and one(spark, X.index(items, F.lit(7))) is None
    assert one(spark, X.in_list(lit(None), F.array(lit(None)), compat=True)) is True
    assert one(spark, X.keys(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == ["a", "b"]
    assert one(spark, X.size(lit(None, "array<int>"))) == 0 and one(spark, X.size(F.lit("héé"), "string")) == 3


def test_conversions_and_arithmetic(spark):
    assert [one(spark, X.to_integer(F.lit(x), compat=True)) for x in ("12", " 12", "1.5", "x")] == [12, 0, 0, 0]
    assert one(spark, X.to_integer(F.lit("x"))) is None and one(spark, X.to_float(F.lit("250m"), compat=True)) == 0.0
    assert one(spark, X.to_string(lit(None, "string"), compat=True)) == "null"
    assert one(spark, X.add(F.lit("a"), F.lit(2), compat=True)) == 2.0 and one(spark, X.add(lit(None), F.lit(2))) is None
    assert one(spark, X.divide(F.lit(1), F.lit(0))) is None and one(spark, X.modulo(F.lit(-7), F.lit(3))) == -1.0
    assert one(spark, X.power(F.lit(-8), F.lit(0.5))) is None and one(spark, X.negate(F.lit(3))) == -3.0
    assert one(spark, X.lower(F.lit("ÀB"), compat=True)) == "Àb" and one(spark, X.lower(lit(None, "string"), compat=True)) == ""
    assert one(spark, X.starts_with(F.lit(12), F.lit("1"), compat=True)) is True


def test_quantity(spark):
    got = {q: one(spark, X.quantity(F.lit(q), "Mi")) for q in ("128Mi", "1Gi", "134217728", "129e6", "250m", "x", "")}
    assert got["128Mi"] == 128 and got["1Gi"] == 1024 and got["134217728"] == 128 and got["x"] is None and got[""] is None
    assert round(got["129e6"], 3) == 123.024 and one(spark, X.quantity(F.lit("250m"))) == 0.25
    assert [one(spark, X.quantity(F.lit(q), legacy=True)) for q in ("2Gi", "512Ki", "129M", "7")] == [2048.0, 0.5, 0.0, 7.0]
