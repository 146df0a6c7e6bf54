"""Verdicts in which what is missing counts: owed values, failed runs, silent cameras; dealt designs and keyed constants."""

import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import impact, trials
from gaugeworks.operators import scenarios as C

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [
        ("a", "m", 1.0, False, 9), ("b", "m", 5.0, None, 9), ("c", "m", 5.0, False, None), ("d", "m", 99.0, False, 0), ("e", "m", NAN, False, 9), ("f", "m", 2.0, True, 9), ("off", "m", 1e9, False, 9), ("gone", "m", 1e9, False, 9), (None, "m", 1e9, False, 9), ("a", None, 1e9, False, 9),
        ("a", "few", 0.5, False, 9), ("a", "few", 0.7, False, 9),
    ]
    return spark.createDataFrame(rows, "scenario string, metric string, value double, censored boolean, samples int")


@pytest.fixture(scope="module")
def scenarios(spark):
    return spark.createDataFrame([*((s, True) for s in "abcdefg"), ("off", False), (None, True)], "scenario string, measurable boolean")


def test_gate_summary_tells_owed_from_nothing_to_measure(spark, metrics, scenarios):
    rules = spark.createDataFrame([("g", "m", 4.0), ("h", "few", 1.0), ("i", "none", 1.0), ("free", "m", None)], "gate string, metric string, limit double")
    got = {r["gate"]: r for r in C.gate_summary(metrics, rules, scenarios).collect()}
    g = got["g"]
    # b and c are over; e and f are failed and owe; g has no row; d had nothing to measure, off isn't measurable
    assert (g["scored"], g["failed"], g["unmeasured"], g["not_measurable"]) == (3, 4, 3, 2)
    assert (g["worst"], g["worst_scenario"], g["verdict"]) == (5.0, "b", "not-measured")
    h = got["h"]
    assert (h["scored"], h["failed"], h["unmeasured"], h["worst"]) == (1, 0, 6, 0.7)  # a repeats, and counts once
    assert (got["i"]["scored"], got["i"]["unmeasured"], got["i"]["verdict"]) == (0, 7, "not-measured")
    assert got["free"]["failed"] == 0
    whole = C.gate_summary(metrics.where("scenario IN ('a', 'd')"), rules, scenarios.where("scenario IN ('a', 'd', 'off')"))
    assert {r["gate"]: r["verdict"] for r in whole.collect()}["g"] == "pass"  # d owes nothing
    none = C.gate_summary(metrics, rules, scenarios.where("scenario = 'off'"))
    assert none.count() == 0  # only scenarios that aren't measurable: no gate is this run's business
    assert C.gate_summary(metrics, rules.limit(0), scenarios).count() == 0


def test_unscorable(spark):
    tracked = spark.createDataFrame([("x", "g"), ("y", "h"), ("z", "i")], "key string, gate string")
    gates = spark.createDataFrame([("g", None), ("h", True)], "gate string, provisional boolean")
    assert {r["key"]: r["problem"] for r in C.unscorable(tracked, gates).collect()} == {"y": "provisional", "z": "missing"}


def test_scenario_series_keeps_its_denominator(spark, metrics, scenarios):
    extra = metrics.withColumns({"n": F.lit(1), "_all": F.lit(2)})
    got = {r["metric"]: r for r in C.scenario_series(extra, scenarios, "metric", "value").collect()}
    assert {k: r["n"] + r["missing"] for k, r in got.items()} == {"m": 8, "few": 8, None: 8}
    assert (got["m"]["n"], got["m"]["max"], got["few"]["mean"], got["few"]["missing"]) == (6, 1e9, 0.5, 7)


def test_cells_count_failed_runs(spark):
    runs = spark.createDataFrame([(None, 2, 20.0, 1.0, None, 4.0), (None, 1, 10.0, 3.0, None, 2.0), (None, 3, 30.0, NAN, "threw", None), ("k", 1, 5.0, None, "threw", 1.0)], "cell string, seed int, x double, v double, error string, sec double")
    got = {r["cell"]: r for r in C.cells(runs, ["cell"], "seed", "x", ["v"], "error", "sec").collect()}
    r = got[None]
    assert (r["runs"], r["failed"], r["x"], r["median_seconds"], r["n"], r["n_non_finite"], r["q2"]) == (3, 1, 10.0, 3.0, 2, 1, 2.0)
    assert (got["k"]["runs"], got["k"]["failed"], got["k"]["n"], got["k"]["q2"]) == (1, 1, 0, None)
    assert C.cells(runs, [], "seed", "x", ["v", "x"], "error", "sec").count() == 2
    assert C.cells(runs.limit(0), ["cell"], "seed", "x", ["v"], "error", "sec").count() == 0


def test_quadrature(spark):
    rows = [("a", "none", 3.0), ("a", "p", 7.0), ("a", "q", 1.0), ("a", "all", 10.0), ("b", "none", 3.0), ("b", "p", 7.0), ("b", "q", NAN), ("b", "all", 10.0)]
    got = C.quadrature_check(spark.createDataFrame(rows, "g string, level string, v double"), ["g"], "level", "v", "none", ["p", "q"], "all").collect()
    assert [(r["g"], r["excess_p"], r["excess_q"], r["predicted"], r["ratio"]) for r in got] == [("a", 4.0, 0.0, 5.0, 2.0)]


def test_gate_flips(spark):
    rows = [("r", True, 1.0, False), ("r", False, 3.0, False), ("r", None, 1.5, None), ("r", False, 9.0, True), ("over", True, 3.0, False), ("over", False, 4.0, False), ("lone", True, 0.1, False), ("none", False, 9.0, False), ("bad", True, NAN, False), ("bad", False, 9.0, False)]
    got = C.gate_flips(spark.createDataFrame(rows, "rig string, twin boolean, v double, c boolean"), [], "rig", "twin", "v", "c", 2.0).first()
    assert (got["flips"], got["of"], got["twin_low"], got["twin_high"]) == (1, 3, 1.0, 3.0)


def _worth(spark, rows, cameras=None, projectors=None):
    pairs = spark.createDataFrame(rows, "s string, camera int, projector int, ok long, seen long, dim long, off long")
    extra = {"cameras": cameras and spark.createDataFrame(cameras, "s string, camera int"), "projectors": projectors and spark.createDataFrame(projectors, "s string, projector int")}
    got = C.capture_worth(pairs, ["s"], "camera", "projector", "ok", "seen", ["dim", "off"], **extra)
    return {r["s"]: r for r in got.collect()}, C.unheard(pairs, ["s"], "camera", "projector", "ok", **extra)


def test_capture_worth(spark):
    good = [("a", c, p, 5, 10, 2, 2) for c in (0, 1) for p in (0, 1)]
    got, silent = _worth(spark, good)
    a = got["a"]
    assert (a["pairs"], a["accepted"], a["considered"], a["cameras"], a["projectors"], a["dominant"], a["dominant_share"], a["usable"], a["refusal"]) == (4, 20, 40, 2, 2, "dim", 0.5, True, None)
    assert silent.count() == 0
    # A projector that no pair names is underseen once the rig is known; a camera without pairs is silent once it is handed in
    got, silent = _worth(spark, good, [("a", 7)], [("a", p) for p in range(3)])
    assert (got["a"]["underseen"], got["a"]["silent_cameras"], got["a"]["refusal"]) == (1, 1, "underseen")
    assert sorted((r["kind"], r["camera"], r["projector"], r["views"]) for r in silent.collect()) == [("camera", 7, None, 0), ("projector", None, 2, 0)]
    # Two cameras, each with a projector of its own
    got, silent = _worth(spark, [("a", 0, 0, 5, 9, 0, 0), ("a", 1, 1, 5, 9, 0, 0), ("a", 0, 1, 0, 9, 0, 0)])
    assert (got["a"]["underseen"], got["a"]["silent_pairs"], got["a"]["dominant"], got["a"]["refusal"]) == (2, 1, None, "underseen")
    assert sorted(r["kind"] for r in silent.collect()) == ["pair", "projector", "projector"]
    rows = [("one", 0, 0, 5, 9, 0, 3), ("one", 1, 0, 0, 9, None, 1), ("zero", 0, 0, 0, None, 1, 0), (None, None, 0, 4, 9, 0, 0), (None, 1, None, 4, 9, 0, 0)]
    got, _ = _worth(spark, rows, [("empty", 1)])
    assert {k: r["refusal"] for k, r in got.items()} == {"one": "one-camera", "zero": "nothing-decoded", None: "one-camera", "empty": "nothing-decoded"}
    assert (got["one"]["dominant"], got["one"]["dominant_count"], got[None]["accepted"], got[None]["pairs"], got["empty"]["pairs"]) == ("off", 4, 8, 0, 0)
    assert _worth(spark, rows[:0] or [("x", 0, 0, 0, 0, 0, 0)])[0]["x"]["refusal"] == "nothing-decoded"


def test_design_dealt_to_units(spark):
    units = spark.createDataFrame([(0, 9), (1, 9), (5, 9), (6, 9), (-1, 9), (None, 9)], "i int, point int")
    got = {r["i"]: (r["block"], r["point"], r["a"], r["b"], r["replicate"]) for r in trials.deal_design(units, "i", {"a": [1, 2, 3], "b": ["x"]}, 2).collect()}
    none = (None,) * 5
    assert got == {0: (0, 0, 1, "x", 0), 1: (0, 0, 1, "x", 1), 5: (0, 2, 3, "x", 1), 6: (1, 0, 1, "x", 0), -1: none, None: none}
    assert trials.deal_design(units, "i", {"a": []}, 2).where("point IS NOT NULL").count() == 0


def test_constants_follow_their_key(spark):
    rows = spark.createDataFrame([(3,), (3,), (4,), (None,)], "id long").repartition(3)
    got = sorted(impact.constants_of(rows, "id", {"c": (1.0, 2.0)}, 7).collect(), key=lambda r: (r["draw"] is None, r["draw"]))
    same = impact.draw_constants(spark, {"c": (1.0, 2.0)}, 5, 7).where("draw >= 3").orderBy("draw").collect()
    assert got[0] == got[1] == same[0] and got[2] == same[1] and got[3]["c"] is None
    assert all(math.isfinite(r["c"]) for r in got[:3])
