"""Whole camera positions: runs found by their light and numbered by counting, fault by fault."""

import math

import pytest

from gaugeworks.operators.folders import PositionPlan, index_position, position_projectors

PLAN = PositionPlan(("white", "black", *["patterned"] * 8), 4, ((2, 3), (4, 5)), ((6, 7, 8, 9),), 4)
LENGTH, CELLS = 10, 16
#: The blocks each projector lights: halves of a 4 x 4 grid
LIGHTS = [[b for b in range(CELLS) if rule(b)] for rule in (lambda b: b < 8, lambda b: b >= 8, lambda b: b % 4 < 2, lambda b: b % 4 >= 2)]
DARK = [0.05] * CELLS


def frame(projector, place, lights=LIGHTS):
    on = lights[projector]
    out = [0.05] * CELLS
    for i, b in enumerate(on):
        part = [1.0, 0.0, float(i < 4), float(i >= 4), float(i % 2), float(i % 2 == 0), *(0.5 + 0.5 * math.cos(math.pi / 4 * i - math.pi / 2 * k) for k in range(4))][place]
        out[b] += 0.6 * part
    return out


def run(projector, lights=LIGHTS):
    return [frame(projector, i, lights) for i in range(LENGTH)]


def folder(*parts):
    return [f for part in parts for f in part]


WHOLE = [run(p) for p in range(4)]
BROKEN = [*run(1)[:5], run(1)[4], *run(1)[6:]]  # a plane in its complement's place: the pair no longer adds up
THIN = [LIGHTS[0], LIGHTS[1][:4], LIGHTS[2], LIGHTS[3]]

CASES = {
    "clean": folder(*WHOLE),
    "extras": folder([DARK] * 3, *WHOLE, [DARK] * 5),
    "preroll": folder([frame(0, 0)] * 4, *WHOLE),
    "unseen": folder(WHOLE[0], [DARK] * 10, WHOLE[2], WHOLE[3]),
    "last": folder(*WHOLE[:3], [DARK] * 12),
    "broken": folder(WHOLE[0], BROKEN, *WHOLE[2:]),
    "again": folder(WHOLE[0], BROKEN, *WHOLE[2:], [DARK] * 4, run(1)),
    "better": folder(*WHOLE, [DARK] * 4, run(1)),
    "stray": folder(WHOLE[0], [DARK], *WHOLE[1:]),
    "gap": folder(WHOLE[0], WHOLE[1], [DARK] * 5, *WHOLE[2:]),
    "barely": folder(WHOLE[0], run(1, THIN), *WHOLE[2:]),
    "unread": folder(WHOLE[0], [frame(1, i % 6) for i in range(10)], *WHOLE[2:]),
    "few": folder(*WHOLE[:3]),
    "dark": [DARK] * 44,
    "ends": folder([DARK] * 10, WHOLE[1], WHOLE[2], [DARK] * 10, [DARK] * 10),
    "allowance": folder([DARK] * 13, *WHOLE),
    "numbering": folder(*WHOLE, run(0, [LIGHTS[0][:6] + LIGHTS[1][:6], *LIGHTS[1:]])),
    "back": folder(WHOLE[0], WHOLE[1], run(0), WHOLE[2], WHOLE[3]),
    "extra": folder(WHOLE[0], [frame(0, 0)], *WHOLE[1:]),
}
ALL = {p: "used" for p in range(4)}
STATUS = {
    **{k: ALL for k in ("clean", "extras", "preroll", "again", "better", "stray")}, "unseen": ALL | {1: "unseen"}, "last": ALL | {3: "unseen"}, "broken": ALL | {1: "pair"}, "barely": ALL | {1: "barely"}, "unread": ALL | {1: "unread"},
    "gap": {0: "used", 1: "used", 2: "uncounted", 3: "uncounted"}, "extra": ALL | {0: "extra"},
}
REFUSED = {"few": "few", "dark": "no-runs", "ends": "ends", "allowance": "allowance", "numbering": "numbering", "back": "stepped-back"}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(k, i, 4, v, [True] * CELLS) for k, shots in CASES.items() for i, v in enumerate(shots)]
    rows += [(None, i, 4, v, [True] * CELLS) for i, v in enumerate(CASES["clean"])]
    return spark.createDataFrame(rows, "folder string, i int, blocks int, values array<double>, measured array<boolean>").repartition(5)


@pytest.fixture(scope="module")
def placed(frames):
    out = {}
    for r in index_position(frames, ["folder"], "i", PLAN).collect():
        out.setdefault(r["folder"], {})[r["i"]] = r
    return out


def test_projectors(frames):
    got = {}
    for r in position_projectors(frames, ["folder"], "i", PLAN).collect():
        got.setdefault(r["folder"], {})[r["projector"]] = r["status"]
    assert got == STATUS | {None: ALL}


def test_places(placed):
    starts = {k: [min((i for i, r in rows.items() if r["projector"] == p), default=None) for p in range(4)] for k, rows in placed.items()}
    assert starts["clean"] == starts[None] == [0, 10, 20, 30]
    assert (starts["extras"], starts["preroll"], starts["stray"]) == ([3, 13, 23, 33], [4, 14, 24, 34], [0, 11, 21, 31])
    assert (starts["unseen"], starts["last"], starts["broken"]) == ([0, None, 20, 30], [0, 10, 20, None], [0, None, 20, 30])
    assert starts["again"] == starts["better"] == [0, 44, 20, 30]  # the run shot again is used
    assert [placed["better"][i]["problem"] for i in (10, 19, 40, 44)] == ["replaced", "replaced", "outside", None]
    assert [placed["again"][i]["problem"] for i in (10, 19)] == ["pair", "pair"] and placed["again"][10]["residual"] == pytest.approx(1.0)
    assert [placed["clean"][i]["place"] for i in range(40)] == list(range(10)) * 4
    assert {r["problem"] for i, r in placed["gap"].items() if i >= 25} == {"uncounted"}
    assert all(len(placed[k]) == len(shots) for k, shots in CASES.items())


def test_refusals(placed):
    assert {k: {r["problem"] for r in placed[k].values()} for k in REFUSED} == {k: {p} for k, p in REFUSED.items()}
    assert all(r["projector"] is None for k in REFUSED for r in placed[k].values())


def test_faults_of_plans_and_fingerprints(spark, frames):
    clean = frames.where("folder = 'clean'")
    problem = lambda df, plan=PLAN: {r["problem"] for r in index_position(df, ["folder"], "i", plan).collect()}
    with_ = lambda **change: PositionPlan(**{**{k: getattr(PLAN, k) for k in ("kinds", "projectors", "pairs", "phases", "least_blocks")}, **change})
    plans = {
        "no-pairs": with_(pairs=()), "no-projectors": with_(projectors=0), "outside": with_(pairs=((2, 10),)), "no-reference": with_(kinds=("white", *["patterned"] * 9)),
        "no-phases": with_(phases=()), "phases": with_(phases=((6, 7),)), "coarse": with_(least_blocks=5),
    }
    assert {k: problem(clean, p) for k, p in plans.items()} == {k: {k} for k in plans}
    assert with_(phases=((2, 6, 7),)).fault() == with_(phases=((6, 6, 7),)).fault() == "phases"
    assert problem(clean.selectExpr("folder", "i", "if(i = 3, 3, blocks) AS blocks", "values", "measured")) == {"shape"}
    assert problem(clean.selectExpr("folder", "i", "blocks", "if(i = 3, null, values) AS values", "measured")) == {"shape"}
    assert index_position(frames.limit(0), ["folder"], "i", PLAN).count() == 0
    # Blocks that aren't measured, null or not finite are never read
    torn = clean.selectExpr("folder", "i", "blocks", "transform(values, (v, b) -> if(b = 0, null, if(b = 1, double('NaN'), v))) AS values", "transform(measured, (m, b) -> b <> 15) AS measured", "'x' AS problem", "1 AS projector")
    assert {r["problem"] for r in index_position(torn, [], "i", PLAN).collect()} == {"barely"}  # every projector lost a block of its eight
    one = clean.selectExpr("folder", "i", "blocks", "transform(values, (v, b) -> if(b = 0, null, v)) AS values", "measured")
    assert [r["status"] for r in position_projectors(one, [], "i", PLAN).orderBy("projector").collect()] == ["barely", "used", "barely", "used"]


def test_odd_steps(spark):
    plan = PositionPlan(("white", "black", *["patterned"] * 5), 1, ((2, 3),), ((4, 5, 6),), 4)
    def shot(k, spoil):
        part = lambda i: [1.0, 0.0, float(i < 8), float(i >= 8), *(0.5 + 0.5 * math.cos(math.pi / 2 * i - 2 * math.pi / 3 * j) for j in range(3))][k]
        return [0.05 + 0.6 * (1.0 if spoil and k == 5 else part(i)) for i in range(CELLS)]

    rows = [(s, k, 4, shot(k, s), [True] * CELLS) for s in (False, True) for k in range(7)]
    got = index_position(spark.createDataFrame(rows, "spoilt boolean, i int, blocks int, values array<double>, measured array<boolean>"), ["spoilt"], "i", plan).collect()
    assert {(r["spoilt"], r["problem"]) for r in got} == {(False, None), (True, "no-runs")}
