"""Levels of sweeps, sensitivities, ranks, interactions and photographs made linear, case by case."""

import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import sweeps


def test_levels_hold_both_ends_and_the_nominal(spark):
    rows = [("even", 0.0, 8.0, 3.0), ("odd", 0.0, 8.0, 2.5), ("log", 0.01, 0.15, 0.05), ("four", 1.0, 4.0, 2.0), ("below", -1.0, 7.0, -2.0), ("flat", 2.0, 2.0, 2.0), ("close", 0.0, 8.0, 3.0 + 1e-10), ("none", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double, n double")
    got = {r["k"]: r["l"] for r in df.select("k", sweeps.sweep_levels(F.col("a"), F.col("b"), F.col("n")).alias("l")).collect()}
    assert got["even"] == [float(i) for i in range(9)]
    assert got["odd"] == [0.0, 1.0, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    assert got["log"][0] == 0.01 and got["log"][-1] == 0.15 and 0.05 in got["log"] and len(got["log"]) == 10
    steps = [v for v in got["log"] if v != 0.05]
    assert all(math.isclose(b / a, 15 ** (1 / 8), rel_tol=1e-9) for a, b in zip(steps, steps[1:], strict=False))
    assert len(got["four"]) == 9 and got["four"][4] == 2.0
    assert got["below"][:2] == [-2.0, -1.0] and got["flat"] == [2.0] * 9 and got["close"][3] == 3.0 + 1e-10 and got["none"] is None


def _found(spark, points, parameters=(("p", 2.0),), responses=(("r", 10.0, True),)):
    df = spark.createDataFrame(points, "parameter string, response string, level double, value double")
    return sweeps.sensitivities(df, spark.createDataFrame(parameters, "parameter string, nominal double"), spark.createDataFrame(responses, "response string, gate double, scored boolean"))


@pytest.mark.parametrize("values, want", [
    ([1.0, 2.0, 3.0], (1.0, 3.0, 2.0, 0.2, 1.0, 3.0, 2.0, True, None)),
    ([1.0, 11.0, 3.0], (1.0, 11.0, 10.0, 1.0, 1.0, 3.0, 11.0, False, 2.0)),
    ([1.0, 1001.0, 1000.5], (1.0, 1001.0, 1000.0, 100.0, 1.0, 1000.5, 1001.0, True, 2.0)),
    ([5.0, 5.0, 5.0], (5.0, 5.0, 0.0, 0.0, 5.0, 5.0, 5.0, True, None)),
    ([1.0, None, 3.0], (1.0, 3.0, 2.0, 0.2, 1.0, 3.0, None, True, None)),
    ([float("nan"), float("inf"), 3.0], (3.0, 3.0, 0.0, 0.0, None, 3.0, None, True, 2.0)),
    ([None, float("nan"), None], (None, None, None, None, None, None, None, True, None)),
])
def test_sensitivities(spark, values, want):
    got = _found(spark, [("p", "r", i + 1.0, v) for i, v in enumerate(values)]).collect()
    assert [tuple(r)[2:-1] for r in got] == [want]


def test_what_is_not_listed_is_left_out_and_levels_may_repeat(spark):
    points = [("p", "r", 1.0, 1.0), ("p", "r", 1.0, 4.0), ("p", "r", 1.0, float("nan")), ("p", "r", 2.0, 2.0), ("p", "r", None, 99.0), ("p", "x", 1.0, 1.0), ("q", "r", 1.0, 1.0), (None, "u", 1.0, 3.0), (None, "u", 2.0, 1.0)]
    got = {(r["parameter"], r["response"]): (r["swing"], r["swing_over_gate"], r["at_first"], r["scored"]) for r in _found(spark, points, [("p", 2.0), (None, None)], [("r", 4.0, True), ("u", None, None)]).collect()}
    assert got == {("p", "r"): (2.0, 0.5, 4.0, True), (None, "u"): (2.0, None, 3.0, None)}
    assert _found(spark, []).count() == 0


def test_ranks(spark):
    points = [(p, r, level, v) for p, r, v in [("a", "r", 5.0), ("a", "s", 5.0), ("b", "r", 50.0), ("c", "u", 900.0), ("d", "r", 5.0)] for level, v in [(1.0, 0.0), (2.0, v)]]
    found = _found(spark, points, [(p, 1.0) for p in "abcd"], [("r", 10.0, True), ("s", 10.0, True), ("u", 1.0, False)])
    parameters = spark.createDataFrame([("a", 0.0, 2.0, "x"), ("b", 1.0, 1.0, "x"), ("c", 0.0, 1.0, "x"), ("d", 0.0, 1.0, "y"), ("e", 0.0, 1.0, "x"), (None, 0.0, 1.0, "x")], "parameter string, least double, greatest double, kind string")
    got = {r["parameter"]: tuple(r)[4:] for r in sweeps.rank_parameters(found, parameters, "kind").collect()}
    assert got == {"b": (5.0, "r", None, True, 1), "a": (0.5, "r", 0.25, False, 2), "c": (0.0, None, 0.0, True, 3), "e": (0.0, None, 0.0, False, 4), None: (0.0, None, 0.0, False, 5), "d": (0.5, "r", 0.5, False, 1)}


def test_interactions(spark):
    corners = lambda k, *v: [(k, bool(i & 1), bool(i & 2), x) for i, x in enumerate(v)]
    rows = corners("add", 0.0, 1.0, 2.0, 3.0) + corners("both", 0.0, 0.0, 0.0, 2.0) + corners("flat", 1.0, 1.0, 1.0, 1.0) + corners("gone", 1.0, 1.0, 1.0) + corners("nan", 1.0, 1.0, 1.0, float("nan")) + corners(None, 0.0, 1.0, 2.0, 3.0) + [("add", True, True, -9.0), ("add", None, True, 99.0)]
    got = {r["k"]: tuple(r)[1:] for r in sweeps.interactions(spark.createDataFrame(rows, "k string, a boolean, b boolean, v double"), ["k"], "a", "b", "v").collect()}
    assert got == {"add": (1.0, 2.0, 0.0, 0.0), None: (1.0, 2.0, 0.0, 0.0), "both": (1.0, 1.0, 1.0, 1.0), "flat": (0.0, 0.0, 0.0, None)}


def test_photographs_made_linear(spark):
    one = spark.createDataFrame([(0.0,), (0.04045,), (0.5,), (1.0,), (-0.5,)], "v double")
    rows = one.select(sweeps.linear(F.col("v"), "srgb"), sweeps.linear(F.col("v"), "linear"), sweeps.linear(F.col("v"), 2.0)).collect()
    assert [round(r[0], 6) for r in rows] == [0.0, 0.003131, 0.214041, 1.0, -0.0387] and [r[1] for r in rows] == [0.0, 0.04045, 0.5, 1.0, -0.5] and [r[2] for r in rows] == [0.0, 0.04045**2, 0.25, 1.0, 0.0]
    pixels = spark.createDataFrame([("w", 255, 10, 10), ("w", 10, 10, 0), ("w", None, 0, 255), ("w", 51, 51, 51), ("k", 0, 0, 0), ("n", None, 1, 1)], "p string, r int, g int, b int")
    got = {r["p"]: tuple(r)[1:] for r in sweeps.exposure_reports(pixels, ["p"], ["r", "g", "b"], 255, "linear").collect()}
    assert got["w"] == (3, 1 / 3, 1 / 3, pytest.approx(448 / 255 / 9), 0.0, 1.0) and got["k"] == (1, 0.0, 1.0, 0.0, 0.0, 0.0) and "n" not in got
    for maximum, channels in ((0, ["r"]), (255, ["r", "g"])):
        with pytest.raises(ValueError):
            sweeps.exposure_reports(pixels, ["p"], channels, maximum, "linear")


def test_reference_frames_need_light_between_them(spark):
    rows = [("good", "white", 0.5), ("good", "black", 0.25), ("same", "white", 0.5), ("same", "black", 0.5), ("one", "white", 0.5), ("one", None, 0.1), ("nan", "white", float("nan")), ("nan", "black", 0.1), ("two", "white", 0.1), ("two", "white", 0.3), ("two", "black", 0.2)]
    got = {r["k"]: (r["light_range"] and round(r["light_range"], 9), r["usable"], r["problem"]) for r in sweeps.reference_ranges(spark.createDataFrame(rows, "k string, role string, mean double"), ["k"], "role").collect()}
    assert got == {"good": (0.25, True, None), "same": (0.0, False, "not-brighter"), "one": (None, False, "missing"), "nan": (None, False, "missing"), "two": (0.1, True, None)}
