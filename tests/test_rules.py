"""The published rules of the operators, case by case: constants, nulls, ties, infinities, clashing names and empty tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import draws, gray, photometry
from gaugeworks.functions import geometry as G
from gaugeworks.operators import colour, gates, ledger, pairing, quantiles, sequences
from gaugeworks.operators import statistics as S
from gaugeworks.sources.amendments import parse_amendments, parse_waivers
from gaugeworks.sources.ledger import list_projects, read_transcripts


def column(spark, values, kind="v double"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], kind)


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_of_every_size_and_of_ties(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(g, float(rng.randint(0, 9) if g % 2 else rng.random())) for g in range(8) for _ in range(g * 40 + 1)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r for r in quantiles.linear_quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.75, "e": 1.0}).collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", [0.0, 0.05, 0.5, 0.75, 1.0]).alias("q")).collect()}
    for g, q in want.items():
        assert [got[g][c] for c in "abcde"] == pytest.approx(q)


def test_quantiles_of_nothing_and_of_what_is_not_finite(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", float("nan")), ("b", float("inf")), ("b", 2.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["m"]) for r in quantiles.linear_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {None: (2, 2.0), "a": (0, None), "b": (1, 2.0)}
    assert quantiles.nearest_rank(df.where("false"), ["k"], "v", {"m": 0.5}).count() == 0
    assert quantiles.nearest_rank(df.where("false"), [], "v", {"m": 0.5}).first()["n"] == 0


@pytest.mark.parametrize(("values", "want"), [([0, 255], 0.0), ([7, 7, 7], 7.0), ([], 0.0), ([0, 0, 10, 10, float("nan"), None], 0.0)])
def test_histogram_cut(spark, values, want):
    assert S.otsu(column(spark, values), "v").first()["threshold"] == want


def test_rejection_keeps_a_share(spark):
    r = S.reject_outliers(column(spark, [1, 1, 1, 1, 50, 100]), [], "v", k=1.0, most_share=0.25).first()
    assert (r["threshold"], r["kept"], r["rejected"]) == (1.0, 4, 2)
    r = S.reject_outliers(column(spark, [1, 2, 3, 4, float("nan"), float("inf"), None]), [], "v", k=3.0, most_share=0.5).first()
    assert (r["kept"], r["rejected"]) == (4, 2)
    assert S.reject_outliers(column(spark, [None]), [], "v").count() == 0


def test_movements(spark):
    rows = [(1, 10.0, 1.0), (2, 8.0, 1.0), (3, 8.5, 1.0), (4, 12.0, 1.0), (5, None, 1.0), (6, 5.0, 1.0), (7, 4.0, None), (8, 3.0, float("nan")), (9, float("nan"), 1.0)]
    got = sequences.movement(spark.createDataFrame(rows, "i int, v double, s double"), [], "i", "v", "s").orderBy("i").collect()
    assert [r["movement"] for r in got] == ["flat", "improved", "flat", "regressed", "lost", "flat", "unqualified", "unqualified", "lost"]


def test_gates(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 2.0, False), (-inf, 2.0, False), (inf, 2.0, None), (float("nan"), 2.0, False), (None, 2.0, False), (1.0, 2.0, True), (1.0, None, False), (2.0, 2.0, None)], "v double, l double, c boolean")
    assert [r[0] for r in df.select(gates.passes(F.col("v"), F.col("l"), F.col("c"))).collect()] == [True, False, False, False, False, False, None, True]
    failed = spark.createDataFrame([("a", "fail", None), ("b", "fail", None), ("c", "fail", 5.0), ("d", "pass", 1.0)], "gate string, verdict string, worst double")
    waivers = spark.createDataFrame([("a", "OPEN", "2099-01-01", None), ("b", "OPEN", "2099-01-01", 3.0), ("c", "OPEN", "2020-01-01", 9.0)], "gate string, status string, expires string, ceiling double")
    assert {r["gate"]: r["outcome"] for r in gates.judge_waived(failed, waivers, "2026-01-01").collect()} == {"a": "waived", "b": "fail:above-ceiling", "c": "fail:expired", "d": "pass"}


def test_gate_rollup_sums_before_it_joins(spark):
    metrics = spark.range(1000).select("id", F.lit("m").alias("metric"), F.col("id").cast("double").alias("value"), F.lit(False).alias("censored")).withColumnRenamed("id", "scenario")
    rules = spark.createDataFrame([("g", "m", 1e9), ("h", "none", 1.0)], "gate string, metric string, limit double")
    got = gates.gate_rollup(metrics, rules)
    assert {r["gate"]: (r["scored"], r["worst"], r["verdict"]) for r in got.collect()} == {"g": (1000, 999.0, "pass"), "h": (0, None, "not-measured")}


def test_functions(spark):
    one = spark.range(1)
    big = [5, 2**31, 2**40, 2**52 + 12345]
    assert [one.select(gray.from_gray(gray.to_gray(F.lit(n).cast("long")))).first()[0] for n in big] == big
    assert one.select(photometry.ramp("gaussian", F.lit(0.0)), photometry.ramp("gaussian", F.lit(1.0))).first()[:] == (0.0, 1.0)
    with pytest.raises(ValueError, match="unknown ramp"):
        photometry.ramp("power", F.lit(0.5))
    with pytest.raises(ValueError, match="gamma"):
        photometry.ramp_weight("linear", F.lit(0.5), 0.0)
    assert math.isnan(one.select(photometry.signal_for(F.lit(2.0), 2.2, 1.0, 0.0)).first()[0])
    # Known values of the published finaliser
    assert [one.select(draws.hash_word(F.lit(n))).first()[0] for n in (0, 1, 2**32 - 1)] == [0, 0x514E28B7, 0x81F16F39]
    assert one.select(draws.radical_inverse(F.lit(6), 2)).first()[0] == 0.375
    assert one.select(*G.lat_lon(G.vector(0, 0, 0)), *G.normalise(G.vector(0, 0, 0))).first()[:] == (0.0, 0.0, 0.0, 0.0, 0.0)
    up = G.euler_angles(G.rotation_matrix(F.lit(30.0), F.lit(90.0), F.lit(0.0)))
    assert one.select(*up).first()[:] == pytest.approx((30.0, 90.0, 0.0))


def test_extra_columns_with_clashing_names_stay(spark):
    df = spark.createDataFrame([(i, float(i % 3), "a", 50.0, 1.0, 2.0) for i in range(6)], "i int, _n double, _t string, _g double, _c double, _h double")
    assert sequences.decimate(df, [], ["i"], 3).columns == df.columns
    assert pairing.normalised(df, ["_t"], "_n", "w").columns == [*df.columns, "w"]
    assert S.equal_count_bins(df, "_n", ["i"], 2).columns == [*df.columns, "bin"]
    out = colour.delta_e2000(df, ("_g", "_c", "_h"), ("_g", "_h", "_c"), "d")
    assert out.columns == [*df.columns, "d"] and out.first()["_g"] == 50.0


def test_ranks_leave_out_what_has_none(spark):
    got = S.global_rank(column(spark, [3, None, 1, float("nan"), 2]), "v", []).collect()
    assert sorted((r["v"], r["_rank"], r["_n"]) for r in got) == [(1.0, 0, 3), (2.0, 1, 3), (3.0, 2, 3)]


def test_differences_match_null_keys(spark):
    old = spark.createDataFrame([(None, 1), (1, 1), (2, 2)], "k int, v int")
    new = spark.createDataFrame([(None, 1), (1, None), (3, 3)], "k int, v int")
    assert {tuple(r) for r in pairing.differences(old, new, ["k"], ["v"]).collect()} == {(1, "changed"), (2, "removed"), (3, "added")}


def test_worst_pair_and_bootstrap_of_little(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, 1.0), ("c", 4, 1.0), ("c", 3, 9.0), ("c", 5, None)], "g string, n int, v double")
    assert {tuple(r) for r in pairing.worst_pair(df, ["g"], "n", "v").collect()} == {("a", 1, 2, 0.0), ("c", 3, 4, 8.0)}
    assert pairing.cluster_bootstrap(df.where("false"), "g", "v").count() == 0
    assert pairing.cluster_bootstrap(df, "g", "v", draws=7).count() == 7


def test_transcripts(spark, tmp_path):
    def line(i, out, **extra):
        return json.dumps({"message": {"id": i, "role": "assistant", "model": extra.pop("model", "m"), "usage": {"input_tokens": 3, "output_tokens": out, "cache_creation": {"ephemeral_1h_input_tokens": 2}}}, "timestamp": "2026-01-01T00:00:00Z", **extra})

    root = tmp_path / "one"
    (root / "s" / "subagents" / "workflows").mkdir(parents=True)
    (root / "a.jsonl").write_text("\n".join([line("x", 1, sessionId="s1"), line("x", 9, sessionId="s1"), "not json", line("y", 4)[:-3], line("z", 1, model="<synthetic>")]))
    (root / "s" / "subagents" / "b.jsonl").write_text(line("w", 2))
    (root / "s" / "subagents" / "workflows" / "b.jsonl").write_text(line("w", 2))
    lines = read_transcripts(spark, f"file://{root}")
    merged = {r["id"]: (r["bucket"], r["uncached"], r["write_1h"], r["output"]) for r in ledger.messages(lines).collect()}
    assert merged == {"x": ("main", 3, 2, 9), "w": ("workflow", 3, 2, 2)}
    assert [tuple(r) for r in ledger.agents(lines).collect()] == [("workflow", 1)]
    assert ledger.messages(ledger.in_scope(lines, session="s1")).count() == 1 and ledger.in_scope(lines, since="2027").count() == 0
    assert read_transcripts(spark, f"file://{tmp_path}/absent").count() == 0
    assert [r["project"] for r in list_projects(spark, f"file://{tmp_path}").collect()] == ["one"]
    rates = spark.createDataFrame([("m", 1e6, 2e6, None, None, None, None, None)], "model string, input double, output double, fast_input double, fast_output double, intro_input double, intro_output double, intro_until string")
    priced = ledger.price_classes(ledger.messages(lines), rates)
    assert ledger.blended_rates(priced).first()["total"] == pytest.approx(2 * 3 + 2 * 2 * 2 + 2 * 11)
    empty = ledger.price_lines(ledger.blended_rates(priced.where("false"))).collect()
    assert len(empty) == 5 and all(r["amount"] == 0 and r["share"] == 0 for r in empty)


def test_amendments_and_waivers(spark):
    page = "# x\n## A-01 - One\n**Status:** OPEN.\n**Status:** APPLIED.\n## A-02 — Two \ntext\n## Not one\n**Status:** **SUPERSEDED by it**"
    docs = spark.createDataFrame([("p", page), ("q", None), ("r", "")], "path string, text string")
    assert sorted(tuple(r) for r in parse_amendments(docs).collect()) == [("p", "A-01", "One", "OPEN", 2), ("p", "A-02", "Two", "SUPERSEDED", 5)]
    waiver = {"gate": "g", "amendment": "A-01", "amendmentTitle": "one", "reason": "r", "expires": "2099-01-01", "ceiling": None, "ceilingBasis": "b", "scenarios": None}
    text = lambda w, schema="s/1": spark.createDataFrame([(json.dumps({"schema": schema, "waivers": [w]}),)], "text string")
    assert parse_waivers(text(waiver), "s/1").first()["title"] == "one"
    for bad in (text(waiver | {"reason": ""}), text(waiver | {"expires": "soon"}), text(waiver, "s/2")):
        with pytest.raises(Exception, match="waiver"):
            parse_waivers(bad, "s/1").collect()
