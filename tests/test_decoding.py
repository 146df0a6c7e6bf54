"""Fingerprints, indexing by them and decoding, case by case."""

import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import decoding, indexing, sequences
from gaugeworks.operators.decoding import Axis, Limits

NAN = float("nan")


def test_fingerprint_of_uneven_masked_and_empty_blocks(spark):
    rows = [("a", x, y, float(10 * y + x), 1) for x in range(5) for y in range(2)] + [("a", 9, 0, 99.0, 1), ("a", 0, 0, NAN, 1), ("a", 1, 1, 50.0, 0), ("b", 0, 0, None, 1), (None, 4, 1, 7.0, 1)]
    pixels = spark.createDataFrame(rows, "frame string, x int, y int, v double, _b int")
    got = {r["frame"]: r for r in indexing.fingerprints(pixels, ["frame"], "x", "y", "v", 2, 5, 2, F.col("_b") == 1).collect()}
    assert got["a"]["values"] == [1.0, 3.5, 11.0, 13.5] and all(got["a"]["measured"])
    assert got["b"]["values"] == [0.0] * 4 and not any(got["b"]["measured"])
    assert got[None]["measured"] == [False, False, False, True]
    assert indexing.fingerprints(pixels.limit(0), ["frame"], "x", "y", "v", 2, 5, 2).count() == 0
    with pytest.raises(ValueError):
        indexing.fingerprints(pixels, ["frame"], "x", "y", "v", 0, 5, 2)


PLAN = ["white", "black", "patterned", "patterned", "patterned", "patterned"]
GOOD = {"w": [1.0, 1.0, 1.0, 1.0], "k": [0.0] * 4, "g": [0.0, 1.0, 0.0, 1.0], "G": [1.0, 0.0, 1.0, 0.0], "h": [0.0, 0.0, 1.0, 1.0], "H": [1.0, 1.0, 0.0, 0.0]}
LIT = {"w": 0.8, "k": 0.0}


def capture(spark, shots, blocks=2):
    rows = [(k, i, LIT.get(c, 0.4), blocks, GOOD.get(c, [0.5] * 4) if c != "?" else [0.0] * 4, [c != "?"] * 4) for k, text in shots.items() for i, c in enumerate(text)]
    return spark.createDataFrame(rows, "capture string, i int, lit double, blocks int, values array<double>, measured array<boolean>")


def by_run(found):
    return {k: [next(iter({r["problem"] for r in rows}), None) for rows in (found_of(found, k, 0), found_of(found, k, 1))] for k in {r["capture"] for r in found}}


def found_of(found, k, run):
    return [r for r in found if r["capture"] == k and r["i"] // 6 == run]


def test_index_by_fingerprint(spark):
    shots = {
        "good": "wkgGhHwkgGhH",
        "swapped": "wkggGhwkgGhH",  # a drop and a duplicate that cancel out: counts and kinds are right
        "dark": "wk?GhHwkgGhH",
        "both": "wk?GhhwkgGhH",  # a broken pair is told before one without evidence
        "short": "wkgGhwkgGhHh",
        "order": "wkgGhHwkGghH",  # still complements, so nothing is known against it
    }
    args = (["capture"], "i", PLAN, 2, [(2, 3), (4, 5)], 2)
    found = indexing.index_by_fingerprint(capture(spark, shots), *args).collect()
    assert by_run(found) == {"good": [None, None], "swapped": ["pair", None], "dark": ["unmeasured", None], "both": ["pair", None], "short": ["length", "length"], "order": [None, None]}
    assert [r["assigned"] for r in sorted(found_of(found, "swapped", 1), key=lambda r: r["i"])] == [6, 7, 8, 9, 10, 11]
    assert {r["residual"] for r in found_of(found, "swapped", 0)} == {1.0}
    assert all(r["assigned"] is None for r in found_of(found, "swapped", 0))


def test_index_by_fingerprint_refuses_captures(spark):
    good = capture(spark, {"c": "wkgGhHwkgGhH"})
    problem = lambda frames, pairs=((2, 3),), plan=PLAN, least=2: {r["problem"] for r in indexing.index_by_fingerprint(frames, ["capture"], "i", plan, 2, pairs, least).collect()}
    assert problem(good) == {None}
    assert problem(good, pairs=()) == {"no-pairs"}
    assert problem(good, pairs=((2, 6),)) == {"outside"}
    assert problem(good, least=3) == {"coarse"}
    assert problem(good.withColumn("blocks", F.when(F.col("i") == 3, 3).otherwise(2))) == {"shape"}
    other = good.withColumn("blocks", F.when(F.col("i") == 3, 1).otherwise(2)).withColumn("values", F.when(F.col("i") == 3, F.array(F.lit(1.0))).otherwise(F.col("values"))).withColumn("measured", F.when(F.col("i") == 3, F.array(F.lit(True))).otherwise(F.col("measured")))
    assert problem(other) == {"grids"}
    assert problem(good.withColumn("values", F.when(F.col("i") == 0, F.lit(None)).otherwise(F.col("values")))) == {"shape"}
    assert problem(capture(spark, {"c": "wgGhHgwgGhHg"}), plan=["white", *["patterned"] * 5]) == {"no-reference"}
    assert indexing.index_by_fingerprint(good.limit(0), ["capture"], "i", PLAN, 2, [(2, 3)], 2).count() == 0


def test_null_keys_are_captures(spark):
    frames = capture(spark, {"c": "wkgGhHwkgGhH"}).withColumn("capture", F.lit(None).cast("string"))
    found = indexing.index_by_fingerprint(frames, ["capture"], "i", PLAN, 2, [(2, 3)], 2).collect()
    assert sorted(r["assigned"] for r in found) == list(range(12))


def test_margin_without_black_or_patterned_frames(spark):
    frames = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.9, 0.45, 0.44] * 2)] + [("b", 0, 0.9), ("b", 1, 0.0), ("c", 0, 0.0), ("d", 0, 0.8), ("d", 1, 0.5), ("d", 2, 0.02)], "g string, i int, lit double")
    margins = {r["g"]: round(r["margin"], 6) for r in sequences.classify_frames(frames, ["g"]).select("g", "margin").distinct().collect()}
    assert margins == {"a": 0.5, "b": 0.0, "c": 0.0, "d": 0.375}
    placed = sequences.index_by_bookends(frames.where("g = 'a'"), ["g"], "i", ["white", "patterned", "patterned"], 2).collect()
    assert sorted(r["assigned"] for r in placed) == [0, 1, 2, 3, 4, 5]


def test_heads_that_begin_inside_each_other(spark):
    lit = {"w": 0.9, "k": 0.0, "p": 0.45}
    frames = spark.createDataFrame([(k, i, lit[c]) for k, s in {"x": "wkwkwpp", "y": "wkwppwkwpp", "z": "wwwwppp"}.items() for i, c in enumerate(s)], "g string, i int, lit double")
    got = lambda key, plan, runs: {r["problem"] for r in sequences.index_by_bookends(frames.where(F.col("g") == key), ["g"], "i", plan, runs).collect()}
    plan = ["white", "black", "white", "patterned", "patterned"]
    assert got("x", plan, 1) == {"length"} and got("x", plan, 2) == {"runs"}
    assert got("y", plan, 2) == {None}
    assert got("z", ["white", "white", "patterned"], 2) == {"length"}


# Decoding

U, V = Axis(32, [2, 4, 6], [3, 5, 7], 4, [8, 9, 10, 11], 8), Axis(16, [12, 14], [13, 15], 4)


def shine(u, v, m=0.5, black=0.1, shift=0.0, depth=0.5, **wrong):
    g = lambda i: i ^ (i >> 1)
    out = [1.0, 0.0]
    for bits, i in ((3, g(int(u // 4))), (0, 0)):
        out += [x for j in range(bits) for x in ((i >> (bits - 1 - j) & 1), 1 - (i >> (bits - 1 - j) & 1))]
    out += [0.5 + depth * math.cos(2 * math.pi * (u + shift) / 8 - math.pi / 2 * n) for n in range(4)]
    out += [x for j in range(2) for x in ((g(int(v // 4)) >> (1 - j) & 1), 1 - (g(int(v // 4)) >> (1 - j) & 1))]
    out = [black + m * x for x in out]
    for k, x in wrong.items():
        out[int(k[1:])] = x
    return out


@pytest.mark.parametrize(
    ("stack", "reason"),
    [
        (shine(13.3, 5), None),
        (shine(13.3, 5, m=0.01), "modulation"),
        (shine(13.3, 5, f0=NAN), "modulation"),
        (shine(13.3, 5, f0=None), "modulation"),
        (shine(13.3, 5, f4=0.35, f5=0.35), "gray"),
        (shine(13.3, 5, f4=NAN), "gray"),
        (shine(13.3, 5, f12=None), "gray"),
        (shine(13.3, 5, depth=0.1), "phase"),
        (shine(13.3, 5, f9=NAN), "phase"),
        (shine(15.9, 5, shift=4), None),  # 4 from the truth, 2.1 from the address: within the tolerance
        (shine(14.1, 5, shift=3.99), "disagree"),
        (shine(31.9, 5, shift=0.5), "range"),
        (shine(13.3, 15), None),
        (shine(3.3, 5), "segment"),
        (shine(13.3, 1), "mask"),
    ],
)
def test_decode_reasons(spark, stack, reason):
    pixels = spark.createDataFrame([(1, [None if x is None else float(x) for x in stack])], "id int, stack array<double>")
    mask = F.lit(reason != "mask")
    found = decoding.decode(pixels, U, V, white=0, black=1, mask=mask, segment=F.col("proj_u") > 5).first()
    assert found["reason"] == reason
    assert (found["proj_u"] is None) == (reason is not None)


def test_decode_coordinates_and_sigma(spark):
    places = [(0.1 + i * 0.37, (i * 0.91) % 16) for i in range(80)]
    pixels = spark.createDataFrame([(i, shine(u, v)) for i, (u, v) in enumerate(places)], "id int, stack array<double>")
    for white, black in ((0, 1), (None, None)):  # without both, Gray frames give white and black
        for r in decoding.decode(pixels, U, V, white=white, black=black).collect():
            u, v = places[r["id"]]
            assert r["reason"] is None and r["proj_u"] == pytest.approx(u, abs=1e-6) and r["proj_v"] == (v // 4 + 0.5) * 4
            assert r["sigma_u"] == 0.01 and r["sigma_v"] == pytest.approx(4 / math.sqrt(12)) and r["modulation"] == pytest.approx(0.5)
    model = spark.createDataFrame([(0.0, 0.02), (1.0, 0.12)], "level double, sigma double")
    r = decoding.decode(pixels, U, V, white=0, black=1, model=model).first()
    assert r["sigma_u"] == pytest.approx(8 / (2 * math.pi) * math.sqrt(0.5) * (0.02 + 0.35 * 0.1) / 0.25)


def test_axes_without_gray_or_without_frames(spark):
    pixels = spark.createDataFrame([(1, shine(5.5, 5))], "id int, stack array<double>")
    one = lambda u: decoding.decode(pixels, u, V, white=0, black=1).first()
    assert one(Axis(8, steps=[8, 9, 10, 11], period=8))["proj_u"] == pytest.approx(5.5)
    assert one(Axis(32, steps=[8, 9, 10, 11], period=8))["reason"] == "missing"
    assert one(Axis(32))["reason"] == "missing"
    assert one(Axis(32, steps=[8, 9, 10], period=8, patterns=[2, 4, 6], inverses=[3, 5, 7], stride=4))["reason"] in (None, "disagree")
    assert decoding.epochs(U) == 9.5 and decoding.epochs(V) == 13.5 and decoding.epochs(Axis(1)) == 0.0


def test_counts_and_stacks(spark):
    rows = [(p, f, x) for p, (u, v, m) in enumerate([(13.3, 5, 0.5), (9.1, 5, 0.5), (9.1, 5, 0.001)]) for f, x in enumerate(shine(u, v, m=m))] + [(0, 99, 1.0), (0, 3, NAN)]
    stacks = decoding.pixel_stacks(spark.createDataFrame(rows, "p int, f int, x double"), ["p"], "f", "x", 16)
    counts = decoding.decode_counts(decoding.decode(stacks, U, V, white=0, black=1, limits=Limits()), []).first()
    assert (counts["considered"], counts["accepted"], counts["rejected_modulation"]) == (3, 2, 1)
    assert decoding.decode(stacks.limit(0), U, V, white=0, black=1).count() == 0


def test_pixels_of_one_line_are_shuffled_once_and_decoded_in_compiled_steps(spark, tmp_path):
    from gaugeworks.plans.decoding import decode_counters, decoded_pixels

    rows = [(k, 7 * k, k % 5, k % 8, 0.05, 0.02) for k in range(40)] + [(3, 8, 0, 3, 0.05, 0.02)]  # a pixel of two lines
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    pixels = decoded_pixels(spark, str(tmp_path))
    plan = pixels._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert plan.count("lambdafunction") >= 8  # steps outside the one method of a whole stage
    assert pixels.count() == 39 and sum(r["considered"] for r in decode_counters(spark, str(tmp_path)).collect()) == 39
