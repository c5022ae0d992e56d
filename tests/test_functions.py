import math
import random

import pytest
from karstline import operators as ops
from karstline.functions import floats, json
from karstline.harness.outcomes import float_rank, float_token
from karstline.plans.types import Schema
from karstline.sources import from_rows
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"b": 2, "a": [1, 2.0, null]}', '{"a":[1,2.0,null],"b":2}'), ("null", "null"), ("1.0", "1.0"), ("1e16", "1e16"), ("1e-7", "1e-7"), ('{"é":"ü"}', '{"é":"ü"}'),
        ('{"a":1,"a":2}', '{"a":2}'), ("not json", "not json"), ("NaN", "NaN"), ("1e999", "1e999"), (None, None), ("", ""), ("18446744073709551616", "18446744073709551616"), ("[" * 5000, "[" * 5000),
    ],
)
def test_canonical_json(text, want):
    assert json.canonical(text) == want


def test_json_eq_on_columns(spark):
    rows = [(1, '{"a":1,"b":2}', '{ "b":2, "a":1 }'), (2, "[1,2]", "[2,1]"), (3, None, "1"), (4, "null", "null")]
    frame = spark.createDataFrame(rows, "n int, a string, b string")
    got = {r.n: r.same for r in frame.select("n", json.json_eq(F.col("a"), F.col("b")).alias("same")).collect()}
    assert got == {1: True, 2: False, 3: None, 4: True}


def test_ieee_comparison(spark):
    values = [None, NAN, -INF, -0.0, 0.0, 1.0, INF]
    frame = spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double")
    for r in frame.select("a", "b", floats.ieee_eq(F.col("a"), F.col("b")).alias("eq"), floats.ieee_lt(F.col("a"), F.col("b")).alias("lt")).collect():
        known = r.a is not None and r.b is not None
        assert r.eq == ((r.a == r.b) if known else None) and r.lt == ((r.a < r.b) if known else None)


def test_orders(spark):
    rng = random.Random(6)
    values = [None, NAN, -INF, INF, -0.0, 0.0, *[rng.uniform(-9, 9) for _ in range(30)]]
    rng.shuffle(values)
    t = from_rows(spark, Schema.of(("f", "float64")), [(v,) for v in values[:20]], [(v,) for v in values[20:]])
    want = sorted((None if v is None else float_token(v) for v in values), key=float_rank)
    assert [None if v is None else float_token(v) for (v,) in ops.collect(ops.order_by_float64(t, 0))] == want
    ranked = sorted(ops.collect(ops.order_by_float64(t, 0, rank="place")), key=lambda r: r[1])
    assert [None if v is None else float_token(v) for v, _ in ranked] == want and [p for _, p in ranked] == list(range(1, len(values) + 1))


def test_collation_order_is_stable(spark):
    rows = [("b", 1), ("A", 2), (None, 3), ("a", 4), ("B", 5), ("A", 6), (None, 7)]
    t = from_rows(spark, Schema.of(("s", "utf8"), ("n", "int32")), rows)
    assert [n for _, n in ops.collect(ops.order_by_collation(t, 0, "unicode_ci"))] == [3, 7, 2, 6, 4, 5, 1]
    assert [n for _, n in ops.collect(ops.order_by_collation(t, 0, "binary"))] == [3, 7, 2, 6, 5, 4, 1]


def test_float_tokens():
    assert list(map(float_token, (1.0, -0.0, INF, -INF, NAN))) == ["1.0", "-0.0", "Infinity", "-Infinity", "NaN"]
    assert math.isclose(float(float_token(0.1)), 0.1)
