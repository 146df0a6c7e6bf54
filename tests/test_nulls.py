"""Nulls, values that aren't finite, repeated keys and clashing names in statistics, pairs, bursts and ranks."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import noise, pairing, quantiles, sequences, statistics

NAN, INF = float("nan"), float("inf")


def test_step_estimate_of_a_null_group(spark):
    rows = [(g, float(s), 2.0 + (8 if abs(s) < 2 and s == 1 else 0)) for g in ("a", None) for s in range(-6, 7)] + [("b", 3.0, 1.0)]
    got = {r["g"]: r["band"] for r in statistics.step_estimate(spark.createDataFrame(rows, "g string, s double, v double"), ["g"], "s", "v", 2, 6).collect()}
    assert got == {"a": 8.0, None: 8.0, "b": 0.0}
    assert statistics.step_estimate(spark.createDataFrame(rows, "g string, s double, v double").where("g = 'a'"), [], "s", "v", 2, 6).first()["band"] == 8.0


def test_normal_equations_leave_whole_rows_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (3.0, NAN), (INF, 1.0), (2.0, 1.0)], "x double, y double")
    got = {(r["i"], r["j"]): r["value"] for r in statistics.normal_equations(df, ["x"], "y").collect()}
    assert got == {(0, 0): 2.0, (0, 1): 3.0, (0, 2): 3.0, (1, 1): 5.0, (1, 2): 4.0, (2, 2): 5.0}


def test_statistics_of_what_is_finite(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 4.0), ("a", NAN, 4.0), ("a", 3.0, INF), ("a", None, 2.0), (None, 1.0, 2.0)], "g string, x double, y double")
    assert {r["g"]: r["sxx"] for r in statistics.covariance_axes(df, ["g"], "x", "y").collect()} == {"a": 0.25, None: 0.0}
    assert {r["g"]: r["n"] for r in statistics.between_bins(df, ["g"], "x", "y").collect()} == {"a": 4, None: 1}
    slopes = {r["g"]: r["slope"] for r in statistics.log_slope(df, ["g"], "x", "y").collect()}
    assert slopes["a"] == pytest.approx(2.0) and slopes[None] is None


def test_pairs_of_finite_values_and_one_row_a_key(spark):
    before = spark.createDataFrame([(1, 8.0), (1, 2.0), (2, NAN), (3, 5.0), (4, INF), (None, 1.0)], "k int, v double")
    after = spark.createDataFrame([(1, 1.0), (1, 4.0), (2, 1.0), (3, 10.0), (4, 2.0), (None, 1.0)], "k int, v double")
    assert tuple(pairing.paired(before, after, ["k"], "v").first()) == (2, 1.0, 1)
    assert pairing.paired(before.limit(0), after, ["k"], "v").first()["n"] == 0


def test_names_of_callers_dont_clash(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, None), (1, 4, True)], "_g int, _i int, _f boolean")
    assert tuple(sequences.longest_burst(df, ["_g"], ["_i"], F.col("_f")).first()) == (1, 2, 3, 0)
    curve = spark.createDataFrame([("a", 1.0, 1.0), ("a", 4.0, 16.0), ("b", 1.0, 9.0), ("c", 1.0, 1.0)], "_hit string, _px double, _py double")
    got = {r["_hit"]: r["crossing"] for r in sequences.threshold_crossing(curve, ["_hit"], "_px", "_py", 4.0).collect()}
    assert got == {"a": pytest.approx(2.0), "b": 0.0, "c": INF}


@pytest.mark.parametrize("gather", [quantiles.GATHER, 3])
def test_both_ways_of_order_statistics_agree(spark, monkeypatch, gather):
    monkeypatch.setattr(quantiles, "GATHER", gather)
    rows = [("a", float(i * 37 % 101)) for i in range(101)] + [("a", NAN), ("b", None), (None, 3.0), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: (r["n"], r["low"], r["mid"], r["seen"]) for r in quantiles.nearest_rank(df, ["g"], "v", {"low": 0.1, "mid": 0.5}, [F.count("_raw").alias("seen")]).collect()}
    assert got == {"a": (101, 10.0, 50.0, 102), "b": (0, None, None, 0), None: (3, 1.0, 3.0, 3)}
    whole = quantiles.linear_quantiles(df, [], "v", {"q": 0.25}).first()
    assert (whole["n"], whole["q"]) == (104, pytest.approx(22.75))
    assert quantiles.nearest_rank(df.limit(0), ["g"], "v", {"q": 0.5}).count() == 0
    assert quantiles.nearest_rank(df.limit(0), [], "v", {"q": 0.5}).first()["n"] == 0


def test_phase_noise_of_bins(spark):
    rows = [(i, float(i % 640), float(i * 7 % 640) / 10) for i in range(640)] + [(9999, NAN, 1.0), (9998, 1.0, None)]
    df = spark.createDataFrame(rows, "i int, x double, r double").repartition(3)
    got = sorted(tuple(r) for r in noise.phase_noise(df, "x", "r", ["i"], 4, 5).collect())
    want = []
    for b in range(5):
        inside = sorted((x, r) for _, x, r in rows[:640])[b * 128 : (b + 1) * 128]
        want.append((b, 128, inside[64][0], pytest.approx(sorted(r for _, r in inside)[64] / noise.chi_median(1))))
    assert got == want
    assert noise.phase_noise(df.limit(10), "x", "r", ["i"], 4, 5).count() == 0
