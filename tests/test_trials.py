"""Exposures, designs, verdicts and fits, case by case: nulls, ties, empty tables, clashing names and degenerate groups."""

import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import exposures, fits, trials


def test_parts_of_exposures(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0, "x"), (2, 1.5, 1.0, "x"), (3, 1.0, 1.0, "x"), (4, None, 1.0, "x"), (5, 1.0, 0.0, "x"), (6, float("nan"), 1.0, "x"), (7, -0.5, 1.0, "x")], "k int, a double, len double, step string")
    got = sorted((r["k"], r["step"], r["weight"]) for r in exposures.blend(df, "a", "len", 2.0).collect())
    assert got == [(1, 0, 1.0), (2, 0, 0.5), (2, 1, 0.5), (3, 0, 1.0), (7, -1, 0.5), (7, 0, 0.5)]
    late = sorted((r["k"], r["step"], r["weight"]) for r in exposures.blend(df.where("k = 2"), "a", "len", 2.0, jitter=lambda m: F.lit(0.25)).collect())
    assert late == [(2, 0, 0.75), (2, 1, 0.25)]
    assert exposures.blend(df.where("false"), "a", "len", 2.0).count() == 0
    with pytest.raises(ValueError):
        exposures.blend(df, "a", "len", 0.0)


def test_a_shutter_that_opens_or_closes_on_the_step_straddles_nothing(spark):
    rows = spark.createDataFrame([(0.0, 2.0), (2.0, 1.0), (1.5, 0.5), (1.5, 0.6), (None, 1.0)], "a double, e double")
    assert [r[0] for r in rows.select(exposures.straddles(F.col("a"), F.col("e"), 2.0)).collect()] == [False, False, False, True, None]


def test_majority_needs_more_than_half(spark):
    parts = spark.createDataFrame([(1, 0, 4, 0.5), (1, 0, 5, 0.5), (2, 0, 4, 1.0), (2, 1, 5, 1.0), (2, 2, 4, 0.75), (2, 2, 5, 0.25), (None, 0, 1, 1.0)], "photo int, row int, step int, weight double")
    got = {r["photo"]: (r["step"], round(r["share"], 6)) for r in exposures.content_majority(parts, ["photo"], "row").collect()}
    assert got == {2: (4, 0.583333), None: (1, 1.0)}


@pytest.mark.parametrize(("phase", "low", "high"), [("uniform", 0.0, 2.0), ("aimed", 0.5, 1.5), ("on-tick", 0.0, 2.0)])
def test_starts_of_shots(spark, phase, low, high):
    shots = exposures.shot_times(spark.range(200).withColumnRenamed("id", "seed"), "seed", 1, 3, 2.0, phase).collect()
    starts = [r["opened"] for r in shots if r["filed_step"] == 0]
    assert len(shots) == 600 and len(set(starts)) == 200 and all(low <= s < high for s in starts)
    assert all(math.isclose(r["opened"] - s, 2.0 * r["filed_step"], abs_tol=1e-12) for r in shots for s in [next(q["opened"] for q in shots if q["seed"] == r["seed"] and q["filed_step"] == 0)])


def test_broken_captures(spark):
    shots = spark.createDataFrame([(c, i, "x") for c in range(30) for i in range(c % 6 + 1)], "capture int, i int, copy_of string")
    for drops, dupes in ((2, 0), (0, 2), (9, 3)):
        sizes = {r["capture"]: r["count"] for r in exposures.break_capture(shots, ["capture"], "i", F.col("capture"), drops, dupes).groupBy("capture").count().collect()}
        assert sizes == {c: max(1, c % 6 + 1 - drops) + dupes for c in range(30)}


def test_designs(spark):
    rows = [tuple(r) for r in trials.factor_design(spark, {"a": [1, 2], "b": ["x", "y", "z"]}, 2).orderBy("point", "replicate").collect()]
    assert rows == [(p, a, b, r) for p, (a, b) in enumerate((a, b) for a in (1, 2) for b in "xyz") for r in (0, 1)]
    assert trials.factor_design(spark, {"a": [1], "b": []}, 2).count() == 0


def test_recovered_needs_an_excess(spark):
    rows = spark.createDataFrame([(30.0, 20.0, 10.0), (10.5, 5.0, 10.0), (float("nan"), 1.0, 1.0), (None, 1.0, 1.0), (5.0, 5.0, 0.0)], "f double, s double, c double")
    assert [r[0] for r in rows.select(trials.recovered(F.col("f"), F.col("s"), F.col("c"))).collect()] == [50.0, None, None, None, 0.0]


def test_mechanisms_with_and_without_pairs(spark):
    rows = [(k, arm, float(10 * (i + 1) + k), None) for k in range(5) for i, arm in enumerate(("c", "s", "f"))] + [(9, "c", 1.0, 1.0), (9, "s", 1.0, 1.0)]
    runs = spark.createDataFrame(rows, "k int, arm string, v double, w double")
    got = {r["value"]: r for r in trials.mechanism_rows(runs, ["k"], "arm", ["v", "w"], "f", "s", "c").collect()}
    assert tuple(got["v"])[1:] == (5, 32.0, 22.0, 12.0, 50.0, 5, pytest.approx(2 / 32))
    assert tuple(got["w"])[1:] == (0, None, None, None, None, 0, 1.0)


def test_failing_pairs(spark):
    rows = spark.createDataFrame([([0.1, 0.2, None],), ([0.1, None, 0.15],), ([0.1, 0.15],), ([],), ([None, 0.3],)], "w array<double>")
    assert [r[0] for r in rows.select(trials.failing_pair(F.col("w"))).collect()] == [1, 1, -1, -1, 1]


def test_positions_and_captures(spark):
    # position, touched, attributable, placed, flagged
    runs = [("a", False, True, True, False), ("b", None, True, True, True), ("c", True, False, True, False), ("d", True, True, True, False), ("e", True, True, False, False), ("f", True, True, False, False), ("f", True, True, True, False)]
    df = spark.createDataFrame(runs, "p string, t boolean, a boolean, ok boolean, f boolean")
    got = {r["p"]: r["category"] for r in trials.classify_positions(df, ["p"], F.col("t"), F.col("a"), F.col("ok"), F.col("f")).collect()}
    assert got == {"a": "UNTOUCHED", "b": "UNCHANGED", "c": "INVISIBLE-ONLY", "d": "PLACED", "e": "REFUSED-ALL", "f": "MIXED"}
    positions = spark.createDataFrame([(1, "PLACED"), (1, "MIXED"), (2, "PLACED"), (3, "PLACED"), (4, "MIXED"), (5, "UNTOUCHED"), (5, "UNCHANGED"), (None, "INVISIBLE-ONLY")], "c int, category string")
    harms = spark.createDataFrame([(1, "BIASED"), (2, "HARMLESS"), (4, "BIASED")], "c int, harm string")
    under = lambda p: {r["c"]: (r["class"], r["loud_and_silent"], r["harm"]) for r in trials.classify_captures(positions, ["c"], harms, p).collect()}
    want = {1: ("LOUD", True, "BIASED"), 2: ("SILENT-HARMLESS", False, "HARMLESS"), 3: ("SILENT-UNSOLVED", False, None), 4: ("LOUD", False, None), 5: ("UNCHANGED", False, None), None: ("INVISIBLE-ONLY", False, None)}
    assert under("P") == want
    assert under("A") == want | {4: ("LOUD", True, "BIASED")}


def test_contributors(spark):
    rows = spark.createDataFrame([(1, "none", -9.0), (1, "b", 2.0), (1, "a", 2.0), (2, "a", 7.0), (3, "a", None), (3, None, 1.0)], "g int, part string, v double")
    got = {r["g"]: (r["contributor"], r["drop"]) for r in trials.largest_contributor(rows, ["g"], "part", "v", 5.0).collect()}
    assert got == {1: ("a", 3.0), 2: (None, 0.0), 3: (None, 0.0)}


def test_trends_of_every_degree(spark):
    rows = [(g, float(s), 3 - 2 * s / 10 + (0.5 * (s / 10) ** 2 if g == "b" else 0)) for g in ("a", "b") for s in range(-10, 11)] + [("c", 1.0, 1.0), ("c", 2.0, None), ("d", 1.0, 1.0), ("d", 1.0, 2.0), ("d", 1.0, 3.0), ("d", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, s double, v double")
    two = {r["g"]: r for r in fits.trend_fit(df, ["g"], "s", "v", 2, 10.0).collect()}
    assert [two["b"][c] for c in ("c0", "c1", "c2")] == pytest.approx([3, -2, 0.5]) and two["b"]["residual_rms"] == pytest.approx(0, abs=1e-9)
    assert two["c"]["n"] == 1 and two["c"]["c0"] is None and two["d"]["c2"] is None
    one = {r["g"]: r for r in fits.trend_fit(df, ["g"], "s", "v", 1, 10.0).collect()}
    assert one["a"]["c1"] == pytest.approx(-2) and one["b"]["residual_rms"] > 0.01
    assert fits.trend_fit(df.where("false"), ["g"], "s", "v", 2, 10.0).count() == 0
    assert fits.trend_fit(df.where("g = 'a'"), [], "s", "v", 1, 10.0).first()["n"] == 21


def test_rotations_of_few_directions(spark):
    # a quarter turn about z; one pair, one direction, two directions, opposite vectors
    turn = lambda x, y, z: (-y, x, z)
    groups = {"one": [(1, 0, 0)], "line": [(1, 0, 0), (2, 0, 0)], "two": [(1, 0, 0), (0, 1, 0)], "four": [(1, 0, 0), (0, 0, 1), (1, 1, 1), (-1, 2, 0)]}
    rows = [(g, *map(float, v), *map(float, turn(*v))) for g, vs in groups.items() for v in vs] + [("two", None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, d double, e double, f double")
    got = {r["g"]: [round(r[f"r{i}{j}"], 6) + 0.0 for i in range(3) for j in range(3)] for r in fits.rotation_fit(df, ["g"], "abc", "def").collect()}
    quarter, identity = [0, -1, 0, 1, 0, 0, 0, 0, 1], [1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert got == {"one": identity, "line": identity, "two": quarter, "four": quarter}
    assert fits.rotation_fit(df.where("false"), [], "abc", "def").count() == 0


def test_cones_and_bounds(spark):
    rays = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 0.0), (2, -1.0, 0.0, 0.0), (2, None, 0.0, 0.0)], "g int, x double, y double, z double")
    got = {r["g"]: r for r in fits.ray_cone(rays, ["g"], "xyz").collect()}
    assert got[1]["half_angle"] == pytest.approx(math.pi / 4) and (got[2]["n"], got[2]["half_angle"]) == (2, None)
    vertices = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 2.0, 0.0, 0.0), ("m", 2, 99.0, 0.0, 0.0), ("n", 0, 3.0, 4.0, 0.0)], "mesh string, i int, x double, y double, z double")
    corners = spark.createDataFrame([("m", 0), ("m", 1), ("m", 1)], "mesh string, i int")
    box = {r["mesh"]: (r["max_x"], r["centre_x"], r["radius"], r["origin_radius"]) for r in fits.mesh_bounds(vertices, corners, "mesh", "i").collect()}
    assert box == {"m": (2.0, 1.0, 1.0, 2.0), "n": (3.0, 3.0, 0.0, 5.0)}


def test_regions_touch_at_corners(spark):
    pixels = [("a", 1, 1), ("a", 2, 2), ("a", 2, 2), ("a", 4, 0), ("a", 9, 9), ("a", None, 1), ("b", 1, 1)]
    got = sorted((r["image"], r["seed"], r["area"], r["touches_border"], r["fill"]) for r in fits.pixel_regions(spark.createDataFrame(pixels, "image string, x int, y int"), "image", 5, 5).collect())
    assert got == [("a", 4, 1, True, 1.0), ("a", 6, 2, False, 0.5), ("b", 6, 1, False, 1.0)]
