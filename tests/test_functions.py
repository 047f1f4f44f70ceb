from __future__ import annotations

import math

import model
import pytest

from incidentlens.functions import (
    bearing_difference,
    fold_case,
    guarded_distance_miles,
    haversine_miles,
    is_finite,
)


def test_haversine_matches_the_formula(spark):
    rows = [(52.0, -1.5, 52.1, -1.4), (0.0, 179.999, 0.0, -179.999), (89.9999, 0.0, 89.9999, 180.0)]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    got = df.selectExpr(f"{haversine_miles('a', 'b', 'c', 'd')} AS miles").collect()
    for row, out in zip(rows, got):
        want = model.miles((0, row[0], row[1]), (0, row[2], row[3]))
        assert out.miles == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize(
    "first, second, turn",
    [(0, 59, 59), (0, 60, 60), (350, 10, 20), (10, 350, 20), (0, 180, 180), (725, 5, 0)],
)
def test_bearing_difference(spark, first, second, turn):
    df = spark.createDataFrame([(first, second)], "a INT, b INT")
    assert df.selectExpr(f"{bearing_difference('a', 'b')} AS t").first().t == turn


def test_fold_case(spark):
    rows = [("A1 North", "a1 NORTH"), (None, ""), ("ı", "I"), ("ab", "ac")]
    # a letter whose capital is longer than itself
    rows += [("Stra\u00dfe", "sTRA\u00dfe"), ("stra\u00dfe", "STRASSE"), ("STRASSE", "strasse")]
    df = spark.createDataFrame(rows, "a STRING, b STRING")
    got = df.selectExpr(f"{fold_case('a')} = {fold_case('b')} AS same").collect()
    assert [r.same for r in got] == [True, True, True, False, True, False, True]


def test_guarded_distance(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a")], "k STRING, l STRING")
    sql = guarded_distance_miles("k", "1D", "1D", "l", "1D", "1D")
    assert [r.m for r in df.selectExpr(f"{sql} AS m").collect()] == [-1.0, 0.0]


def test_is_finite(spark):
    values = [(1.0,), (math.nan,), (math.inf,), (-math.inf,)]
    df = spark.createDataFrame(values, "v DOUBLE")
    got = df.selectExpr(f"{is_finite('v', '0D')} AS ok").collect()
    assert [r.ok for r in got] == [True, False, False, False]
