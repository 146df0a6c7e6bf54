import json
import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import gates, graph, pairing, sequences
from gaugeworks.operators import statistics as S
from gaugeworks.sources.ledger import read_ledger
from gaugeworks.streaming.ledger import merged, start_max_merge


def test_missing_is_never_a_pass(spark):
    df = spark.createDataFrame([(1.0, 2.0, False), (2.0, 2.0, False), (float("nan"), 2.0, False), (None, 2.0, False), (1.0, 2.0, True), (1.0, None, False)], "v double, m double, c boolean")
    assert [r[0] for r in df.select(gates.passes(F.col("v"), F.col("m"), F.col("c"))).collect()] == [True, True, False, False, False, None]


def test_dispersion_ignores_non_finite(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", float("inf")), ("a", None)], "k string, v double")
    r = S.dispersion(df, ["k"], "v").head()
    assert (r["n"], r["mean"], r["median"], r["sd"]) == (2, 2.0, 2.0, 1.0)
    assert S.sample_dispersion(df, ["k"], "v").head()["n_non_finite"] == 3


def test_nearest_rank_with_ties(spark):
    values = [1.0, 2.0, 2.0, 2.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = S.nearest_rank(df, [], "v", {"a": 0.3, "b": 0.99}).head()
    assert (r["a"], r["b"]) == (2.0, 2.0)


@pytest.mark.parametrize("n,bins", [(7, 3), (10, 4), (3, 5)])
def test_equal_count_bins(spark, n, bins):
    df = spark.createDataFrame([(float(i * i), i) for i in range(n)], "v double, i int")
    got = dict(S.equal_count_bins(df, "v", ["i"], bins).select("i", "bin").collect())
    want = {i: next(b for b in range(bins) if b * n // bins <= i < (b + 1) * n // bins) for i in range(n)}
    assert got == want


def test_global_rank_of_equal_values(spark):
    df = spark.createDataFrame([(1.0, i) for i in range(5)], "v double, i int")
    assert sorted(r["_rank"] for r in S.global_rank(df, "v", ["i"]).collect()) == [0, 1, 2, 3, 4]


def test_sign_test(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (3, 6), (0, 300)], "w long, n long")
    p = [r[0] for r in df.select(pairing.sign_test(F.col("w"), F.col("n"))).collect()]
    assert p[0] == 1.0 and p[1] == pytest.approx(2 / 32) and p[2] == 1.0 and p[3] < 1e-80


def test_threshold_crossing_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 10.0, 100.0), ("b", 1.0, 50.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = dict(sequences.threshold_crossing(df, ["k"], "x", "y", 10.0).collect())
    assert got["a"] == pytest.approx(math.sqrt(10)) and got["b"] == 0.0 and got["c"] == math.inf


def test_decimate_matches_floor_rule(spark):
    for n in (3, 4, 5, 9, 10, 17):
        df = spark.createDataFrame([(1, i) for i in range(n)], "k int, i int")
        got = sorted(r["i"] for r in sequences.decimate(df, ["k"], ["i"], 4).collect())
        assert got == (list(range(n)) if n <= 4 else [i * n // 4 for i in range(4)])


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60)
    edges = spark.range(58).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r["id"]: r["component"] for r in graph.connected_components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(59)) and got[59] == 59


def test_unreachable_has_no_distance(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (3, 4, 1.0)], "src int, dst int, length double")
    got = dict(graph.shortest_paths(edges, spark.createDataFrame([(0,)], "id int")).collect())
    assert got == {0: 0.0, 1: 1.0, 2: 2.0}


def test_ledger_reader_and_stream(spark, tmp_path):
    line = lambda i, out, role="assistant": json.dumps({"id": i, "role": role, "model": "m", "usage": {"output": out}})
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([line("x", 1), line("x", 179), line("u", 5, "user"), '{"id": "torn', line("y", 5)]))
    (tmp_path / "in" / "sub" / "b.jsonl").write_text(line("x", 20) + "\n")
    rows = read_ledger(spark, str(tmp_path / "in"))
    assert sorted((r["id"], r["output"], r["input"]) for r in rows.collect()) == [("x", 1, 0), ("x", 20, 0), ("x", 179, 0), ("y", 5, 0)]
    rows.select("id", "output").write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema("id string, output long").parquet(str(tmp_path / "rows"))
    for _ in range(2):  # the second run finds nothing new
        start_max_merge(stream, ["id"], ["output"], str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination(60)
    got = merged(spark, str(tmp_path / "table"), ["id"], ["output"])
    assert sorted(map(tuple, got.collect())) == [("x", 179), ("y", 5)]


def test_differences_treat_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (4, "y")], "k int, v string")
    assert sorted(map(tuple, pairing.differences(a, b, ["k"], ["v"]).collect())) == [(2, "changed"), (3, "removed"), (4, "added")]


def test_delta_e2000_of_published_pairs(spark):
    from gaugeworks.operators.colour import delta_e2000

    pairs = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 2.5, 0.0, 56.0, -27.0, -3.0, 31.9030), (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669)]
    df = spark.createDataFrame(pairs, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    got = delta_e2000(df, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "delta").collect()
    assert [round(r.delta, 4) for r in got] == [r.want for r in got]
