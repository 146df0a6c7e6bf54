"""Capture plans, settings patches, crossings, clauses, bets, quarters and coverage, case by case."""

import json
import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import claims
from gaugeworks.sources import alignments, manifests, patches

GOOD = {"version": 1, "plan": {"grayBits": 2, "phaseSteps": 4, "phasePeriodStrides": 2, "includeWhiteBlack": True}, "projectorRes": {"x": 8, "y": 6}, "projectors": 2, "framesPerRun": 18, "dwellS": 0.5, "written": "now"}


def plan(**changes):
    made = json.loads(json.dumps(GOOD))
    for at, value in changes.items():
        *path, last = at.split("__")
        place = made
        for step in path:
            place = place[step]
        if value is ...:
            del place[last]
        else:
            place[last] = value
    return json.dumps(made)


def test_problems_of_plans(spark):
    cases = {
        "good": (plan(), []), "whole": (plan(projectors=2.0), []), "unstated": (plan(framesPerRun=...), []), "odd-stated": (plan(framesPerRun=-3), []), "no-dwell": (plan(dwellS=-1, written=4), []),
        "text": ("hello", ["not-json"]), "null": (None, ["not-json"]), "empty": ("", ["not-json"]), "two": (plan() + "," + plan(), ["not-json"]), "junk": (plan() + " x", ["not-json"]), "list": ("[]", ["not-object"]), "number": ("3", ["not-object"]), "nil": ("null", ["not-object"]),
        "version": (plan(version=2), ["version"]), "quoted": (plan(version="1"), ["version"]), "unversioned": (plan(version=...), ["version"]), "no-plan": (plan(plan=...), ["no-plan"]), "nil-plan": (plan(plan=None), ["no-plan"]),
        "bits": (plan(plan__grayBits=100000000), ["gray_bits"]), "half": (plan(plan__grayBits=1.5), ["gray_bits"]), "steps": (plan(plan__phaseSteps=3), ["phase_steps"]), "strides": (plan(plan__phasePeriodStrides=1), ["phase_period_strides"]),
        "odd": (plan(plan__phasePeriodStrides=3), ["odd"]), "white": (plan(plan__includeWhiteBlack=1), ["white_black"]), "res": (plan(projectorRes__x=0), ["projector_res"]), "no-res": (plan(projectorRes=...), ["projector_res"]), "none": (plan(projectors=0), ["projectors"]),
        "frames": (plan(framesPerRun=19), ["frames_per_run"]), "several": (plan(plan__grayBits=9, projectors="2", framesPerRun=19), ["gray_bits", "projectors"]), "bare": (plan(plan={}), ["gray_bits", "phase_steps", "phase_period_strides", "white_black"]),
    }
    found = manifests.parse_plans(spark.createDataFrame([(n, t, 1) for n, (t, _) in cases.items()], "path string, text string, problems int"))
    got = {r["path"]: r for r in found.collect()}
    assert {n: r["problems"] for n, r in got.items()} == {n: p for n, (_, p) in cases.items()}
    assert (got["whole"]["projectors"], got["unstated"]["frames_per_run"], got["no-dwell"]["dwell_s"], got["no-dwell"]["written"], got["frames"]["gray_bits"]) == (2, 18, 0.0, "", None)
    assert manifests.parse_plans(spark.createDataFrame([], "path string, text string")).count() == 0


def test_plans_are_read_as_written(spark):
    made = spark.createDataFrame([("a", 2, 4, 2, True), ("b", 8, 12, 16, False), ("c", None, 4, 2, True)], "path string, bits int, steps int, strides int, wb boolean")
    text = manifests.plan_text(F.col("bits"), F.col("steps"), F.col("strides"), F.col("wb"), F.lit(8), F.lit(6), F.lit(2), F.lit(0.25), F.lit("x"))
    plans = manifests.parse_plans(made.select("path", text.alias("text")))
    got = {r["path"]: (r["gray_bits"], r["phase_steps"], r["phase_period_strides"], r["white_black"], r["frames_per_run"], r["problems"]) for r in plans.collect()}
    assert got == {"a": (2, 4, 2, True, 18, []), "b": (8, 12, 16, False, 56, []), "c": (None, None, None, None, None, ["gray_bits"])}
    frames = [tuple(r)[1:] for r in manifests.plan_frames(plans).where("path = 'a'").orderBy("frame").collect()]
    gray = [(2 + 4 * a + 2 * j + i, ("gray", "grayInverse")[i], "uv"[a], j, "patterned", 2 + 4 * a + 2 * j + 1 - i) for a in range(2) for j in range(2) for i in range(2)]
    phase = [(10 + 4 * a + j, "phase", "uv"[a], j, "patterned", None) for a in range(2) for j in range(4)]
    assert frames == [(0, "white", None, 0, "white", None), (1, "black", None, 0, "black", None), *gray, *phase]
    assert manifests.plan_frames(plans).groupBy("path").count().collect().__len__() == 2


def test_only_the_numbers_that_change_are_edited(spark):
    text = '{\r\n "a \\"x\\"": {"note": "\\"value\\": 9", "inner": {"value": 5}, "value" : 1.0, "envName": "p1_dist_inches"},\n "b": {"envName": "P1_HEIGHT_INCHES", "value": -2e1 },  "value": {"value": 7, "envName": "OTHER"}}  '
    assert {k: text[i:j] for k, (i, j) in patches.value_spans(text).items()} == {'a "x"': "1.0", "b": "-2e1", "value": "7"}
    documents = spark.createDataFrame([("d", text), ("e", text), ("n", None), ("o", '{"b": {"value": "x", "envName": "P1_HEIGHT_INCHES"}, "a": {"value": 1, "envName": "P1_DIST_INCHES"}}')], "path string, text string")
    wanted = [("d", "P1_DIST_INCHES", 211.0), ("d", "p1_height_inches", -20.001), ("d", "GONE", 1.0), ("e", "P1_HEIGHT_INCHES", 3.456), ("e", "P1_DIST_INCHES", 1.0), ("e", "OTHER", None), ("o", "P1_HEIGHT_INCHES", 1.0), ("o", "P1_DIST_INCHES", 4.0)]
    patch = patches.settings_patch(alignments.parse_settings(documents), spark.createDataFrame(wanted, "path string, env_name string, to double"))
    got = {(r["path"], r["env_name"]): (r["from"], r["state"]) for r in patch.collect()}
    assert got == {
        ("d", "P1_DIST_INCHES"): (1.0, "changed"), ("d", "P1_HEIGHT_INCHES"): (-20.0, "same"), ("d", "GONE"): (None, "missing"), ("e", "P1_HEIGHT_INCHES"): (-20.0, "changed"),
        ("e", "P1_DIST_INCHES"): (1.0, "same"), ("e", "OTHER"): (7.0, "missing"), ("o", "P1_HEIGHT_INCHES"): (None, "changed"), ("o", "P1_DIST_INCHES"): (1.0, "changed"),
    }
    done = {r["path"]: (r["text"], r["problem"]) for r in patches.patched_documents(documents, patch).collect()}
    assert done == {"d": (text.replace("1.0", "211.0"), None), "e": (text.replace("-2e1", "3.46"), None), "n": (None, None), "o": (None, "no-number: b")}


def test_proposals_keep_the_number_of_a_projector(spark):
    rows = [("r", "P1", 3.0, 4.0, 0.5, 1.0), ("r", "P3", 1.0, 0.0, 0.0, 1.0), ("r", "P04", float("nan"), 0.0, 0.0, 1.0), ("r", "left", 1.0, 1.0, 1.0, 1.0)]
    got = {r["env_name"]: r["to"] and round(r["to"] * 0.0254, 6) for r in patches.rig_proposals(spark.createDataFrame(rows, "path string, id string, x double, y double, z double, centre_height double")).collect()}
    assert got == {"SPHERE_HEIGHT_AT_EQUATOR_INCHES": 1.0, "P1_DIST_INCHES": 5.0, "P1_HEIGHT_INCHES": 1.5, "P3_DIST_INCHES": 1.0, "P3_HEIGHT_INCHES": 1.0, "P4_DIST_INCHES": None, "P4_HEIGHT_INCHES": 1.0, "left_DIST_INCHES": None, "left_HEIGHT_INCHES": None}


def test_alignments_are_read_as_written(spark):
    made = spark.createDataFrame([("a", [(2.0, 1.0, 1.0), (1.0, -1.0, 1.0), (4.0, 1.0, -1.0), (3.0, -1.0, -0.5)]), ("b", None)], "path string, v array<struct<index:double,x:double,y:double>>")
    text = patches.alignment_text((F.lit(0.5), F.lit(0)), (F.lit(1), F.lit(2.25)), F.lit(-90), F.col("v"))
    got = {r["path"]: r for r in alignments.parse_alignments(made.select("path", text.alias("text"))).collect()}
    a = got["a"]
    assert (a["problem"], a["translate_x"], a["scale_y"], a["rotate"], a["side"], a["unrecognised"]) == (None, 0.5, 2.25, -90.0, 2, [])
    assert [tuple(v) for v in a["vertices"]] == [(1.0, -1.0, 1.0), (2.0, 1.0, 1.0), (3.0, -1.0, -0.5), (4.0, 1.0, -1.0)]
    assert got["b"]["problem"] == "translate"


def plain_failing(residuals, limit):
    over = [i for i, r in enumerate(residuals) if r is not None and r > limit]
    unknown = [i for i, r in enumerate(residuals) if r is None or math.isnan(r)]
    return (over or unknown or [None])[0]


def test_failing_pairs(spark):
    nan, inf = float("nan"), float("inf")
    cases = [[0.1, 0.3], [None, 0.3], [None, 0.1], [nan, None], [0.2, 0.2], [inf], [], [-inf, nan, inf]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)] + [(99, None)], "i int, r array<double>")
    got = {r["i"]: r["p"] for r in rows.select("i", claims.failing_pair(F.col("r"), 0.2).alias("p")).collect()}
    assert got == {**{i: plain_failing(c, 0.2) for i, c in enumerate(cases)}, 99: None}


@pytest.mark.parametrize("step, top, resolution", [(0.005, 0.5, 0.0005), (0.1, 1.0, 0.1), (0.25, 0.5, 0.01)])
def test_crossings_of_curves(spark, step, top, resolution):
    rows = [(k, a, b, c) for k, (a, b, c) in enumerate([(1.0, 0.0, 0.0), (0.1, 0.0, 0.0), (0.01, 0.0, 0.0), (0.0, 0.05, 0.3), (0.5, 0.05, 0.06), (0.0, 0.3, 0.0), (0.3, 0.05, 0.2)])]

    def plain(a, b, c):
        at = lambda s: plain_failing([a * s, b - (s - c) * (s - c)], 0.048)
        if at(0.0) is not None:
            return 0.0, at(0.0), False
        scan = [at(i * step) is not None for i in range(1, round(top / step) + 1)]
        if True not in scan:
            return None, None, False
        first = scan.index(True) + 1
        lo, hi = (first - 1) * step, first * step
        while hi - lo > resolution * (1 + 1e-9):
            lo, hi = (lo, (lo + hi) / 2) if at((lo + hi) / 2) is not None else ((lo + hi) / 2, hi)
        return (lo + hi) / 2, at(hi), False in scan[first:]

    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    curve = lambda s: F.array(F.col("a") * s, F.col("b") - (s - F.col("c")) * (s - F.col("c")))
    got = {r["k"]: tuple(r["x"]) for r in df.select("k", claims.crossing(curve, 0.048, step, top, resolution).alias("x")).collect()}
    assert got == {k: plain(*r) for k, *r in rows}
    assert any(v[2] for v in got.values()) or step > 0.2


def test_crossings_of_measured_levels(spark):
    rows = [("a", 0.0, 1, 0.1), ("a", 0.1, 2, 0.3), ("a", 0.1, 1, 0.4), ("a", 0.2, 1, 0.0), ("b", 0.0, 1, None), ("b", 0.5, 1, 9.0), ("c", 0.1, 1, 0.1), ("d", None, 1, 9.0), ("e", 0.1, 1, 0.0), ("e", 0.3, 1, float("nan")), ("e", 0.3, 2, 0.5), (None, 0.2, 1, 0.9), (None, 0.2, 1, None)]
    df = spark.createDataFrame(rows, "run string, s double, p int, r double")
    got = {r["run"]: tuple(r)[1:] for r in claims.scanned_crossing(df, ["run"], "s", "p", "r", 0.2).collect()}
    assert got == {"a": (0.0, 0.1, 0.05, 1, True), "b": (None, 0.0, 0.0, 1, False), "c": (None, None, None, None, False), "e": (0.1, 0.3, 0.2, 2, False), None: (None, 0.2, 0.2, 1, False)}
    assert claims.scanned_crossing(df.limit(0), ["run"], "s", "p", "r", 0.2).count() == 0


def test_what_cannot_be_tested_is_never_held(spark):
    rows = [("dark", "r1", "no pixel", "x"), ("dark", "r1", "no pixel", None), ("flip", "r1", None, None), ("flip", "r2", "old", None), ("lit", "r1", None, "b"), ("lit", "r1", None, "a"), ("lit", "r2", None, None), ("else", "r1", None, "x"), (None, "r1", None, None)]
    runs = claims.clause_runs(spark.createDataFrame(rows, "clause string, run string, why string, failure string"), "clause", "run", "why", "failure")
    got = {(r["clause"], r["run"]): tuple(r)[2:] for r in runs.collect()}
    assert got[("dark", "r1")] == (2, 2, 0, "no pixel", None) and got[("lit", "r1")] == (2, 0, 2, None, "a")
    claimed = spark.createDataFrame([("dark", 1), ("flip", 2), ("lit", 3), ("unread", 4), (None, 5)], "clause string, checks_note int")
    total = {r["clause"]: tuple(r)[2:] for r in claims.clause_totals(runs, claimed, "clause").collect()}
    assert total == {"dark": (2, 0, 2, 0, 0, 1, "untested"), "flip": (2, 1, 1, 0, 0, 1, "held"), "lit": (3, 3, 0, 2, 1, 0, "failed"), "unread": (0, 0, 0, 0, 0, 0, "untested"), None: (1, 1, 0, 0, 0, 0, "held")}


def test_bets_that_were_not_read_are_not_won(spark):
    rows = [("over", 3.0, True), ("over", None, True), ("exact", 1.0, True), ("exact", 1.0, True), ("exact", 9.0, False), ("exact", 9.0, None), ("partly", 1.0, True), ("partly", float("inf"), True), ("unread", 9.0, False), ("gone", 1.0, True), ("loose", 1.0, True)]
    bets = spark.createDataFrame([("over", 2.0), ("exact", 2.0), ("partly", 2.0), ("unread", 2.0), ("never", 0.0), ("loose", None)], "bet string, most double")
    found = claims.judge_bets(spark.createDataFrame(rows, "bet string, v double, read boolean"), bets, "bet", "v", "read", "most")
    assert {r["bet"]: tuple(r)[2:] for r in found.collect()} == {"over": (2, 1, 3.0, True), "exact": (2, 0, 2.0, False), "partly": (2, 1, 1.0, None), "unread": (0, 0, None, None), "never": (0, 0, None, None), "loose": (1, 0, 1.0, None)}


def test_quarters_and_coverage(spark):
    rows = [("a", 1.0, 0.0, 0.0, 0.0), ("a", 1.0, 0.0, 0.0, 1.0), ("a", 1.0, 0.0, 1.0, 1.0), ("a", 1.0, 0.0, 1.0, 0.0), ("a", 0.5, 0.0, 0.25, 0.5), ("a", 0.05, 0.0, 0.0, 0.0), ("a", 9.0, 0.0, None, 0.0), ("a", float("inf"), 0.0, 0.0, 0.0), ("b", 1.0, 1.0, 1.0, 1.0), (None, 2.0, 1.0, 3.0, -1.0)]
    found = claims.quarter_masses(spark.createDataFrame(rows, "run string, w double, k double, g double, m double"), ["run"], "w", "k", "g", "m")
    assert {r["run"]: tuple(r)[1:] for r in found.collect()} == {"a": (5, 1.0, 1.25, 1.25, 1.0), "b": (0, 0.0, 0.0, 0.0, 0.0), None: (1, 0.0, 0.0, 0.0, 1.0)}
    shots = [("a", 3.0, 4.0, True), ("a", 9.0, 9.0, False), ("b", 1.0, 1.0, None), ("b", None, 1.0, True), (None, 0.0, 0.0, True)]
    found = claims.coverage_rms(spark.createDataFrame(shots, "p string, u double, v double, f boolean"), ["p"], "u", "v", "f")
    assert {r["p"]: tuple(r)[1:] for r in found.collect()} == {"a": (2, 1, 10.0), "b": (2, 0, math.inf), None: (1, 1, 0.0)}


def test_arms_are_judged_by_the_bar_of_their_own_scope(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("near", 1, "clean", 5.0), ("near", 2, "clean", 8.0), ("near", 1, "room", 80.0), ("near", 2, "room", 8.0), ("near", 3, "room", None), ("far", 1, "clean", 600.0), ("far", 1, "room", 601.0), ("far", 2, "room", 1.0), ("bare", 1, "room", 1.0), ("lost", 1, "clean", nan), ("lost", 1, "room", 1.0), (None, 1, "clean", 2.0), (None, 1, "room", inf)]
    df = spark.createDataFrame(rows, "place string, seed int, arm string, v double")
    got = {(r["place"], r["arm"]): tuple(r)[2:] for r in claims.arm_shares(df, "place", "arm", "v", "clean").collect()}
    assert got == {
        ("near", "clean"): (2, 2, 1.0, 8.0), ("near", "room"): (3, 1, 1 / 3, 8.0), ("far", "clean"): (1, 1, 1.0, 600.0), ("far", "room"): (2, 1, 0.5, 600.0), ("bare", "room"): (1, 0, None, None),
        ("lost", "clean"): (1, 0, None, None), ("lost", "room"): (1, 0, None, None), (None, "clean"): (1, 1, 1.0, 2.0), (None, "room"): (1, 0, 0.0, 2.0),
    }
    found = {(r["place"], r["before"]): tuple(r)[3:] for r in claims.arm_recovery(df, "place", "seed", "arm", "v", [("room", "clean"), ("clean", "room")]).collect()}
    assert found == {("near", "room"): (2, pytest.approx(4.0), 1, False), ("near", "clean"): (2, pytest.approx(0.25), 0, False), ("far", "room"): (1, pytest.approx(601 / 600), 1, True), ("far", "clean"): (1, pytest.approx(600 / 601), 0, False)}
    assert claims.arm_shares(df.limit(0), "place", "arm", "v", "clean").count() == claims.arm_recovery(df.limit(0), "place", "seed", "arm", "v", [("room", "clean")]).count() == 0


def test_runs_of_one_scope_are_never_dealt_to_one_task(spark):
    runs = spark.range(1000).select(F.lit("one").alias("place"), F.when(F.col("id") % 2 == 0, "clean").otherwise("room").alias("arm"), F.col("id").cast("double").alias("v"))
    found = claims.arm_shares(runs, "place", "arm", "v", "clean")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # that of the counts
    assert sorted(map(tuple, found.collect())) == [("one", "clean", 500, 500, 1.0, 998.0), ("one", "room", 500, 499, 0.998, 998.0)]
