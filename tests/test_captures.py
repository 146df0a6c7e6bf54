"""Alignment and settings files, phase noise, complementary frames and welded meshes, case by case."""

import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import graph, noise
from gaugeworks.sources import alignments
from gaugeworks.sources.amendments import read_amendments


def test_problems_of_alignment_files(spark, tmp_path):
    head = "translate 0 0\nscale 1 1\nrotate 90\n"
    square = "1 -1 1\n2 1 1\n3 -1 -1\n4 1 -0.5\n"
    files = {
        "good": ("TRANSLATE 9 9\n" + head + "  hello there\n# c\n" + square, None), "none": ("", "translate"), "noscale": ("translate 0 0\nrotate 1\n" + square, "scale"), "norotate": ("translate 0 0\nscale 1 1\n" + square, "rotate"),
        "bare": (head, "vertices"), "twice": (head + "1 0 0\n1 0 0\n", "duplicate"), "gap": (head + "1 0 0\n3 0 0\n", "missing"), "odd": (head + "1 0 0\n2 0 0\n", "not-square"), "zero": (head + "0 0 0\n", "malformed"),
        "half": (head + "1.5 0 0\n", "malformed"), "short": (head + "1 0\n", "malformed"), "word": ("translate x 0\nscale 1 1\nrotate 90\n" + square, "malformed"),
    }
    for name, (text, _) in files.items():
        (tmp_path / name).write_text(text)
    found = alignments.parse_alignments(alignments.read_documents(spark, str(tmp_path)))
    got = {r["path"].rsplit("/", 1)[1]: r for r in found.collect()}
    # An empty file gives no row; an empty text does, see below.
    assert {n: r["problem"] for n, r in got.items()} == {n: p for n, (t, p) in files.items() if t}
    good = got["good"]
    assert (good["translate_x"], good["rotate"], good["side"], good["unrecognised"]) == (0.0, 90.0, 2, [5])
    shifts = {r["index"]: (r["dx"], r["dy"]) for r in alignments.vertex_shifts(found).collect()}
    assert shifts == {1: (0.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.5)}
    nothing = spark.createDataFrame([(None, None), ("e", "")], "path string, text string")
    assert [r["problem"] for r in alignments.parse_alignments(nothing).collect()] == ["translate", "translate"]


def test_amendments_are_read_from_whole_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# All\n\n## A-01 - First\ntext\n**Status:** OPEN\n## A-02 - Second\n")
    (tmp_path / "b.md").write_text("**Status:** APPLIED\n## A-09 - Other\n")
    got = sorted((r["path"].rsplit("/", 1)[1], r["id"], r["title"], r["status"], r["line"]) for r in read_amendments(spark, str(tmp_path)).collect())
    assert got == [("a.md", "A-01", "First", "OPEN", 3), ("a.md", "A-02", "Second", "UNKNOWN", 6), ("b.md", "A-09", "Other", "UNKNOWN", 2)]


def test_settings(spark):
    texts = [("a", '{"R": {"value": 3.5, "envName": "ball", "description": "x. default value:<br><br> -7"}, "N": {"value": "3 ft"}, "Z": {"envName": "q"}}'), ("b", "not json"), ("c", None), ("d", "[1]"), ("e", "{}")]
    rows = alignments.parse_settings(spark.createDataFrame(texts, "path string, text string"))
    assert sorted(map(tuple, rows.collect())) == [("a", "N", None, None, None), ("a", "R", "BALL", 3.5, -7.0)]
    assert alignments.settings_geometry(rows, {"r": "BALL", "s": "OTHER"}).collect()[0].asDict() == {"path": "a", "r": 3.5, "r_default": -7.0, "s": None, "s_default": None}


def test_medians_of_lengths():
    # Closed forms: the half normal, Rayleigh and Maxwell distributions
    assert noise.chi_median(1) == pytest.approx(0.674489750196082)
    assert noise.chi_median(2) == pytest.approx(math.sqrt(2 * math.log(2)))
    assert noise.chi_median(3) == pytest.approx(1.5381722544550522)


def test_a_pure_sine_leaves_nothing(spark):
    waves = spark.range(5).select(*((2 + F.col("id") * F.cos(F.lit(2 * math.pi * i / 6) - 0.3)).alias(f"s{i}") for i in range(6)))
    level, residual = noise.phase_residual([F.col(f"s{i}") for i in range(6)])
    for r in waves.select(level.alias("level"), residual.alias("residual")).collect():
        assert r["level"] == pytest.approx(2) and r["residual"] == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize(("n", "bins"), [(63, 0), (64, 1), (200, 3), (1000, 4)])
def test_noise_bins(spark, n, bins):
    rows = [(i, float(i * 7 % 13), float(i * 11 % 17)) for i in range(n)] + [(-1, None, 1.0), (-2, 1.0, float("nan"))]
    got = {r["bin"]: (r["n"], r["level"], r["sigma"]) for r in noise.phase_noise(spark.createDataFrame(rows, "i int, x double, r double"), "x", "r", ["i"], 5, 4).collect()}
    order, want = sorted((x, r) for i, x, r in rows if i >= 0), {}
    for b in range(bins):
        part = order[b * n // bins : (b + 1) * n // bins]
        want[b] = (len(part), part[len(part) // 2][0], sorted(r for _, r in part)[len(part) // 2] / math.sqrt(2 * math.log(2)))
    assert got == {b: (c, x, pytest.approx(s)) for b, (c, x, s) in want.items()}


def test_no_freedom_no_noise(spark):
    rows = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("r"), "id")
    assert noise.phase_noise(rows, "x", "r", ["id"], 3, 4).count() == 0
    levels = spark.createDataFrame([(None,), (5.0,)], "x double")
    assert [r["noise"] for r in noise.noise_at(levels, spark.createDataFrame([], "level double, sigma double"), "x").collect()] == [None, None]
    assert [r["noise"] for r in noise.noise_at(levels, spark.createDataFrame([(1.0, 2.0)], "level double, sigma double"), "x").collect()] == [None, 2.0]


def test_complements(spark):
    rows = [("exact", 3.0, 8.0, 10.0, 1.0), ("exact", 0.0, 0.0, 0.5, 0.0), ("off", 3.0, 9.0, 10.0, 1.0), ("off", None, 9.0, 99.0, 1.0), ("dark", 1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, w double, k double")
    got = {r["g"]: (r["blocks"], r["residual"]) for r in noise.complement_residual(df, ["g"], "a", "b", "w", "k").collect()}
    assert got == {"exact": (1, 0.0), "off": (1, pytest.approx(1 / 9)), "dark": (0, None), None: (1, 0.0)}
    assert noise.complement_residual(df.where("g = 'exact'"), [], "a", "b", "w", "k").collect()[0]["blocks"] == 1


def test_paths_over_a_welded_seam(spark):
    # Two triangles that share an edge only by place: vertices 3 and 4 repeat 1 and 2.
    vertices = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 0.0, 1.0, 0.0), ("m", 3, 1.0 + 1e-9, 0.0, 0.0), ("m", 4, 0.0, 1.0, 0.0), ("m", 5, 1.0, 1.0, 0.0)], "mesh string, i long, x double, y double, z double")
    triangles = spark.createDataFrame([("m", 0, 1, 2), ("m", 3, 4, 5), ("m", 1, 3, 1)], "mesh string, a long, b long, c long")
    edges = noise.mesh_edges(vertices, triangles, "mesh", "i", 1e-6)
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [(0, 1), (0, 2), (1, 0), (1, 2), (1, 5), (2, 0), (2, 1), (2, 5), (5, 1), (5, 2)]
    far = {r["id"]: r["distance"] for r in graph.shortest_paths(edges, spark.createDataFrame([(0,)], "id long")).collect()}
    assert far[5] == pytest.approx(2)
