"""Queries over exposures, designs, verdicts on runs, and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import exposures, fits, trials
from .ledgers import normal_sql, uniform_sql
from .registry import query, rounded, t
from .verdicts import _matrix_sql

# Exposures: eight orders in a row are the read-out rows of a photograph

_SHOTS = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey // 8 AS photo, CAST((o_orderkey // 8 % 500) * 0.75 + (o_orderkey % 8) * 0.25 AS DOUBLE) AS a, 0.5 + 0.5 * (o_orderkey // 8 % 3) AS len FROM orders),
m AS (SELECT *, a + len AS b, unnest(range(CAST(floor(a / 2) AS BIGINT) - 1, CAST(floor((a + len) / 2) AS BIGINT) + 1)) AS step FROM o),
p AS (SELECT k, photo, step, (least(b, step * 2.0 + 2 + CASE WHEN step + 1 > 0 THEN ((step + 1) % 3) * 0.25 ELSE 0 END) - greatest(a, step * 2.0 + CASE WHEN step > 0 THEN (step % 3) * 0.25 ELSE 0 END)) / len AS weight FROM m)
"""


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    photo = F.floor(k / 8)
    return t(spark, sf_dir, "orders").select(k.alias("k"), photo.alias("photo"), ((photo % 500) * 0.75 + (k % 8) * 0.25).alias("a"), (0.5 + 0.5 * (photo % 3)).alias("len"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposures.blend(_shots(spark, sf_dir), "a", "len", 2.0, jitter=lambda m: (m % 3) * 0.25)


@query(_SHOTS + "SELECT k, step, round(weight, 6) AS weight FROM p WHERE weight > 0")
def exposure_blend(spark, sf_dir):
    return rounded(_parts(spark, sf_dir).select("k", "step", "weight"), 6, "weight")


@query(_SHOTS + "SELECT photo, count(*) AS n, count(*) FILTER (floor(a / 2) * 2 + 2 < a + len) AS straddled FROM o GROUP BY 1")
def straddle_counts(spark, sf_dir):
    return _shots(spark, sf_dir).groupBy("photo").agg(F.count("*").alias("n"), F.count_if(exposures.straddles(F.col("a"), F.col("len"), 2.0)).alias("straddled"))


@query(_SHOTS + ", s AS (SELECT photo, step, sum(weight) / any_value(n) AS share FROM p JOIN (SELECT photo, count(*) AS n FROM o GROUP BY 1) USING (photo) WHERE weight > 0 GROUP BY ALL) SELECT photo, step, round(share, 6) AS share FROM s WHERE share > 0.5 + 1e-9")
def content_majority(spark, sf_dir):
    found = exposures.content_majority(_parts(spark, sf_dir), ["photo"], "k")
    return rounded(found.where("share > 0.5 + 1e-9"), 6, "share")


_U, _SIGN, _SHAKE = uniform_sql("s_suppkey", "1", "pos"), uniform_sql("s_suppkey", "0"), normal_sql("s_suppkey", "2", "pos", "j")


@query(f"""
WITH s AS (SELECT s_suppkey, CAST(pos AS INTEGER) AS pos, {_U} AS u, {_SIGN} AS g FROM supplier, range(0, 2) p(pos))
SELECT s_suppkey, pos AS position, CAST(j AS INTEGER) AS filed_step, round(j * 2.0::DOUBLE / (1 + CASE WHEN g < 0.5 THEN -40.0 ELSE 40.0 END::DOUBLE / 1e6) + 1 + (u - 0.5) + 0.01::DOUBLE * {_SHAKE}, 6) AS opened FROM s, range(0, 4) f(j)""")
def shot_times(spark, sf_dir):
    found = exposures.shot_times(t(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 2, 4, 2.0, "aimed", 40.0, 0.01)
    return rounded(found, 6, "opened")


@query(f"""
WITH s AS (SELECT s_suppkey, CAST(pos AS BIGINT) AS pos FROM supplier, range(0, 12) p(pos)),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY {uniform_sql('s_suppkey', '3', 'pos')}, pos) - 4 AS place FROM s),
p AS (SELECT s_suppkey, CAST(floor({uniform_sql('s_suppkey', '4', 'd')} * 9) AS BIGINT) AS place FROM supplier, range(0, 3) q(d)),
k AS (SELECT r.s_suppkey, pos, (SELECT count(*) FROM p WHERE p.s_suppkey = r.s_suppkey AND p.place = r.place) AS extra FROM r WHERE r.place >= 0)
SELECT s_suppkey, pos, CAST(unnest(range(0, extra + 1)) AS INTEGER) AS copy FROM k""")
def broken_captures(spark, sf_dir):
    shots = t(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("pos"))
    return exposures.break_capture(shots, ["s_suppkey"], "pos", F.col("s_suppkey"), 3, 3)


# Designs and verdicts


@query("""
WITH s AS (SELECT s_suppkey, s_suppkey AS i FROM supplier)
SELECT s_suppkey, i // 24 AS block, i % 24 // 2 AS point, CAST(i % 24 // 8 + 1 AS INTEGER) AS cameras, ['large', 'small'][i % 8 // 4 + 1] AS size, CASE WHEN i % 4 // 2 = 0 THEN 0.0::DOUBLE ELSE 0.5 END AS noise, CAST(i % 2 AS INTEGER) AS replicate FROM s""")
def factor_design(spark, sf_dir):
    """The suppliers dealt to the points of a design of three factors, block after block."""
    units = t(spark, sf_dir, "supplier").select("s_suppkey")
    return trials.deal_design(units, "s_suppkey", {"cameras": [1, 2, 3], "size": ["large", "small"], "noise": [0.0, 0.5]}, 2)


def _mechanism_sql(value: str) -> str:
    return f"""SELECT '{value}' AS value, count(*) AS pairs, median(f) AS f, median(s) AS s, median(c) AS c, count(*) FILTER (s < f) AS wins, count(*) FILTER (s <> f) AS decided FROM
    (SELECT min({value}) FILTER (a = 'HIGH') AS f, min({value}) FILTER (a = 'MEDIUM') AS s, min({value}) FILTER (a = 'LOW') AS c FROM o GROUP BY o_custkey HAVING f IS NOT NULL AND s IS NOT NULL AND c IS NOT NULL)"""


@query(f"""
WITH o AS (SELECT o_custkey, o_totalprice, CAST(o_orderkey % 1000 AS DOUBLE) AS turn, CASE o_orderpriority[1:1] WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '5' THEN 'LOW' END AS a FROM orders),
m AS ({_mechanism_sql('o_totalprice')} UNION ALL {_mechanism_sql('turn')})
SELECT value, pairs, round(f, 4) AS facet_median, round(s, 4) AS smooth_median, round(c, 4) AS control_median, round(CASE WHEN f - c > abs(c) * 0.1::DOUBLE THEN (f - s) / (f - c) * 100 END, 4) AS recovered, wins,
  round(least(1.0, 2 * list_sum(list_transform(range(0, least(wins, decided - wins) + 1), lambda i: exp(lgamma(decided + 1) - lgamma(i + 1) - lgamma(decided - i + 1) - decided * ln(2.0))))), 6) AS p FROM m""")
def mechanism_rows(spark, sf_dir):
    runs = t(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", (F.col("o_orderkey") % 1000).cast("double").alias("turn"), F.get(F.array(*map(F.lit, ("", "", "HIGH", "MEDIUM", "", "LOW"))), F.substring("o_orderpriority", 1, 1).cast("int")).alias("arm"))
    found = trials.mechanism_rows(runs, ["o_custkey"], "arm", ["o_totalprice", "turn"], "HIGH", "MEDIUM", "LOW")
    return rounded(rounded(found, 4, "facet_median", "smooth_median", "control_median", "recovered"), 6, "p")


@query("""
WITH r AS (SELECT c_nationkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_nationkey) AS place, count(*) OVER () AS n FROM customer)
SELECT c_nationkey, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) FILTER (place <= ceil(n * 0.1::DOUBLE)) AS largest FROM r GROUP BY 1""")
def yardstick_ranges(spark, sf_dir):
    return trials.yardstick(t(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal")


@query("""
WITH r AS (SELECT p_partkey, [CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size / 300.0 END, p_partkey % 40 / 200.0, CASE WHEN p_partkey % 11 = 3 THEN NULL ELSE 0.1 END]::DOUBLE[] AS w, p_partkey % 5 > 0 AS placed, p_partkey % 400 AS matches FROM part)
SELECT p_partkey, CAST(coalesce(list_min(list_filter(range(0, 3), lambda i: w[i + 1] > 0.15::DOUBLE)), list_min(list_filter(range(0, 3), lambda i: w[i + 1] IS NULL)), -1) AS INTEGER) AS pair, coalesce(placed AND w[1] > 0.1::DOUBLE, false) AS marginal, matches < 200 AS minor,
  coalesce(w[1] >= 0.15::DOUBLE - 0.02::DOUBLE - 0.03::DOUBLE AND w[1] <= 0.15::DOUBLE + 0.03::DOUBLE, true) AS in_band FROM r""")
def run_verdicts(spark, sf_dir):
    k = F.col("p_partkey")
    first, residuals = F.when(k % 7 != 0, F.col("p_size") / 300.0), [(k % 40) / 200.0, F.when(k % 11 != 3, 0.1)]
    runs = t(spark, sf_dir, "part").select("p_partkey", F.array(first, *residuals).alias("w"), (k % 5 > 0).alias("placed"), (k % 400).alias("matches"))
    w0 = F.get("w", F.lit(0))
    return runs.select("p_partkey", trials.failing_pair(F.col("w")).alias("pair"), trials.marginal(F.col("placed"), w0).alias("marginal"), trials.minor(F.col("matches")).alias("minor"), trials.in_band(w0, F.lit(0.02), 0.03).alias("in_band"))


_POSITIONS = """
WITH r AS (SELECT l_orderkey, l_returnflag = 'R' AS touched, l_linestatus = 'F' AND l_tax < 0.07 AS attributable, l_discount < 0.05 AS placed, l_quantity > 45 AS flagged, l_linenumber = 2 AS out FROM lineitem),
g AS (SELECT l_orderkey, bool_or(touched) AS t, bool_or(flagged) AS f, count(*) FILTER (touched AND attributable AND NOT out) AS n, count(*) FILTER (touched AND attributable AND NOT out AND NOT placed) AS x FROM r GROUP BY 1),
c AS (SELECT l_orderkey, CASE WHEN NOT t THEN CASE WHEN f THEN 'UNCHANGED' ELSE 'UNTOUCHED' END WHEN n = 0 THEN 'INVISIBLE-ONLY' WHEN x = 0 THEN 'PLACED' WHEN x = n THEN 'REFUSED-ALL' ELSE 'MIXED' END AS category FROM g)
"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return trials.classify_positions(t(spark, sf_dir, "lineitem"), ["l_orderkey"], c("l_returnflag") == "R", (c("l_linestatus") == "F") & (c("l_tax") < 0.07), c("l_discount") < 0.05, c("l_quantity") > 45, c("l_linenumber") == 2)


@query(_POSITIONS + "SELECT l_orderkey, category FROM c")
def position_classes(spark, sf_dir):
    return _positions(spark, sf_dir)


@query(_POSITIONS + """
, h AS (SELECT p_partkey AS capture, CASE WHEN p_partkey % 9 > 0 AND p_size <= 25 AND p_retailprice / 40 > 25 THEN 'GATE-BREAKING' WHEN p_partkey % 6 > 2 THEN 'BIASED' ELSE 'HARMLESS' END AS harm FROM part WHERE p_partkey % 5 > 0),
k AS (SELECT l_orderkey % 997 AS capture, list(DISTINCT category) AS q FROM c WHERE l_orderkey % 4 = 1 GROUP BY 1),
j AS (SELECT capture, policy, harm, q, list_contains(q, 'REFUSED-ALL') OR list_contains(q, 'MIXED') AS loud, list_contains(q, 'PLACED') AS placed, list_contains(q, 'PLACED') OR policy = 'A' AND list_contains(q, 'MIXED') AS silent FROM k LEFT JOIN h USING (capture), (VALUES ('P'), ('A')) v(policy))
SELECT capture, policy, CASE WHEN loud THEN 'LOUD' WHEN placed THEN 'SILENT-' || coalesce(harm, 'UNSOLVED') WHEN list_contains(q, 'INVISIBLE-ONLY') THEN 'INVISIBLE-ONLY' WHEN list_contains(q, 'UNCHANGED') THEN 'UNCHANGED' ELSE 'UNTOUCHED' END AS class, loud AND silent AS loud_and_silent, CASE WHEN silent THEN harm END AS harm FROM j""")
def capture_classes(spark, sf_dir):
    k = F.col("p_partkey")
    positions = _positions(spark, sf_dir).where("l_orderkey % 4 = 1").select((F.col("l_orderkey") % 997).alias("capture"), "category")
    harms = t(spark, sf_dir, "part").where("p_partkey % 5 > 0").select(k.alias("capture"), trials.harm(F.col("p_size"), F.col("p_retailprice") / 40, k % 9 == 0, F.lit(False), k % 6, F.lit(2), 25.0).alias("harm"))
    both = [trials.classify_captures(positions, ["capture"], harms, p).withColumn("policy", F.lit(p)) for p in ("P", "A")]
    return both[0].union(both[1])


@query("""
WITH d AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0.0 ELSE p_retailprice END AS fine, p_retailprice * (1 + p_size / 400.0::DOUBLE) AS coarse FROM part WHERE p_size <> 20)
SELECT p_partkey, round(abs(fine - coarse), 6) AS absolute, CASE WHEN fine = 0 THEN 'nan'::DOUBLE ELSE round(abs(fine - coarse) / abs(fine), 6) END AS relative, abs(fine - coarse) <= 20 OR (fine <> 0 AND abs(fine - coarse) / abs(fine) <= 0.05::DOUBLE) AS converged FROM d""")
def density_convergence(spark, sf_dir):
    part = t(spark, sf_dir, "part").where("p_size <> 20")
    fine = F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice")).otherwise(0.0)
    absolute, relative, converged = trials.convergence(fine, F.col("p_retailprice") * (1 + F.col("p_size") / 400.0), 20.0)
    return part.select("p_partkey", F.round(absolute, 6).alias("absolute"), F.when(F.isnan(relative), float("nan")).otherwise(F.round(relative, 6)).alias("relative"), converged.alias("converged"))


@query("""
WITH m AS (SELECT c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'none' WHEN 'MACHINERY' THEN 'all' ELSE c_mktsegment END AS part, min(c_acctbal) AS v FROM customer GROUP BY ALL)
SELECT c_nationkey, arg_min(part, (v, part)) FILTER (v < 100 AND part NOT IN ('none', 'all')) AS contributor, round(coalesce(max(100 - v) FILTER (v < 100 AND part NOT IN ('none', 'all')), 0), 4) AS drop FROM m GROUP BY 1""")
def largest_contributor(spark, sf_dir):
    part = F.when(F.col("c_mktsegment") == "BUILDING", "none").when(F.col("c_mktsegment") == "MACHINERY", "all").otherwise(F.col("c_mktsegment"))
    values = t(spark, sf_dir, "customer").groupBy("c_nationkey", part.alias("part")).agg(F.min("c_acctbal").alias("v"))
    return rounded(trials.largest_contributor(values, ["c_nationkey"], "part", "v", 100.0), 4, "drop")


# Fits


@query("""
WITH r AS (SELECT l_returnflag AS g, (l_orderkey % 25 - 12) / 12.0::DOUBLE AS x, l_extendedprice AS v FROM lineitem),
s AS (SELECT g, count(*)::DOUBLE AS n, sum(x) AS a, sum(x*x) AS b, sum(x*x*x) AS c, sum(x*x*x*x) AS d, sum(v) AS p, sum(x*v) AS q, sum(x*x*v) AS r FROM r GROUP BY 1),
t AS (SELECT *, n*(b*d-c*c) - a*(a*d-b*c) + b*(a*c-b*b) AS det FROM s),
f AS (SELECT g, n, (p*(b*d-c*c) - a*(q*d-c*r) + b*(q*c-b*r)) / det AS c0, (n*(q*d-c*r) - p*(a*d-b*c) + b*(a*r-q*b)) / det AS c1, (n*(b*r-q*c) - a*(a*r-q*b) + p*(a*c-b*b)) / det AS c2 FROM t)
SELECT g AS l_returnflag, CAST(n AS BIGINT) AS n, round(c0, 3) AS c0, round(c1, 3) AS c1, round(c2, 3) AS c2, round(sqrt(avg(pow(v - c0 - c1 * x - c2 * x * x, 2))), 3) AS residual_rms FROM r JOIN f USING (g) GROUP BY ALL""")
def quadratic_trend(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") % 25 - 12).alias("at"), "l_extendedprice")
    return rounded(fits.trend_fit(rows, ["l_returnflag"], "at", "l_extendedprice", 2, 12.0), 3, "c0", "c1", "c2", "residual_rms")


_RAYS = """
WITH v AS (SELECT c_nationkey AS k, radians(c_custkey * 37 % 160 - 80) AS lat, radians(c_custkey * 53 % 360 - 180) AS lon FROM customer WHERE c_nationkey < 20),
d AS (SELECT k, cos(lat) * cos(lon) AS x, cos(lat) * sin(lon) AS y, sin(lat) AS z FROM v)
"""


def _rays(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple]:
    k = F.col("c_custkey")
    return t(spark, sf_dir, "customer").where("c_nationkey < 20"), G.direction((k * 37 % 160 - 80).cast("double"), (k * 53 % 360 - 180).cast("double"))


_TURN = _matrix_sql("(k * 17 - 170)", "(k * 5 - 50)", "(k * 3 - 30)")


@query(_RAYS + f", c AS (SELECT k, count(*) AS n, count(*) > 1 AS turned FROM d GROUP BY 1), m AS (SELECT k, n, CASE WHEN turned THEN {_TURN}::DOUBLE[] ELSE [1, 0, 0, 0, 1, 0, 0, 0, 1]::DOUBLE[] END AS m FROM c) SELECT k, n, " + ", ".join(f"round(m[{3 * i + j + 1}], 5) + 0.0 AS r{i}{j}" for i in range(3) for j in range(3)) + " FROM m")
def rotation_fit(spark, sf_dir):
    """Vectors that are turned by each group's own rotation give it back."""
    rows, d = _rays(spark, sf_dir)
    k = F.col("c_nationkey")
    turned = G.matrix_vector(G.rotation_matrix(k * 17 - 170, k * 5 - 50, k * 3 - 30), d)
    pairs = rows.select(k.alias("k"), *(c.alias(f"a{i}") for i, c in enumerate(d)), *(c.alias(f"b{i}") for i, c in enumerate(turned)))
    return rounded(fits.rotation_fit(pairs, ["k"], ["a0", "a1", "a2"], ["b0", "b1", "b2"]), 5, *(f"r{i}{j}" for i in range(3) for j in range(3)))


@query(_RAYS + """
, s AS (SELECT k, count(*) AS n, sum(x) AS a, sum(y) AS b, sum(z) AS c FROM d GROUP BY 1), u AS (SELECT k, n, a / sqrt(a*a + b*b + c*c) AS a, b / sqrt(a*a + b*b + c*c) AS b, c / sqrt(a*a + b*b + c*c) AS c FROM s)
SELECT k, n, round(a, 6) AS axis_x, round(b, 6) AS axis_y, round(c, 6) AS axis_z, round(max(acos(greatest(-1, least(1, x * a + y * b + z * c)))), 6) AS half_angle FROM d JOIN u USING (k) WHERE n > 1 GROUP BY ALL""")
def ray_cone(spark, sf_dir):
    rows, d = _rays(spark, sf_dir)
    found = fits.ray_cone(rows.select(F.col("c_nationkey").alias("k"), *(c.alias(a) for a, c in zip("xyz", d, strict=True))), ["k"], ["x", "y", "z"])
    return rounded(found.where("n > 1"), 6, "axis_x", "axis_y", "axis_z", "half_angle")


@query("""
WITH p AS (SELECT l_suppkey % 20 AS camera, l_linenumber AS projector, count(*) AS n, sum(coalesce(CASE WHEN l_orderkey % 9 > 0 THEN l_quantity END, 0)) AS u, sum(l_extendedprice / 1000) AS v FROM lineitem GROUP BY ALL),
e AS (SELECT camera, projector, n, u / n - sum(u + v) OVER w / (2 * sum(n) OVER w) AS eu, v / n - sum(u + v) OVER w / (2 * sum(n) OVER w) AS ev FROM p WINDOW w AS (PARTITION BY camera))
SELECT camera, projector, n, round(eu, 6) AS epoch_u, round(ev, 6) AS epoch_v, round(max(greatest(eu, ev)) OVER w - min(least(eu, ev)) OVER w, 6) AS spread FROM e WINDOW w AS (PARTITION BY camera)""")
def epoch_table(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("c"), "l_linenumber", F.when(F.col("l_orderkey") % 9 > 0, F.col("l_quantity")).alias("u"), (F.col("l_extendedprice") / 1000).alias("v"))
    return rounded(fits.epoch_table(rows, "c", "l_linenumber", "u", "v"), 6, "epoch_u", "epoch_v", "spread")


@query("""
WITH v AS (SELECT c_nationkey AS mesh, c_custkey AS i, c_acctbal AS x, c_custkey % 100 AS y, c_nationkey + c_custkey % 7 AS z FROM customer),
u AS (SELECT * FROM v WHERE mesh % 5 = 0 OR i % 3 > 0), b AS (SELECT mesh, min(x) AS ax, min(y) AS ay, min(z) AS az, max(x) AS bx, max(y) AS by_, max(z) AS bz FROM u GROUP BY 1)
SELECT mesh, ax AS min_x, ay AS min_y, az AS min_z, bx AS max_x, by_ AS max_y, bz AS max_z, round((ax + bx) / 2, 4) AS centre_x, round((ay + by_) / 2, 4) AS centre_y, round((az + bz) / 2, 4) AS centre_z,
  round(sqrt(max(pow(x - (ax + bx) / 2, 2) + pow(y - (ay + by_) / 2, 2) + pow(z - (az + bz) / 2, 2))), 4) AS radius, round(sqrt(max(x * x + y * y + z * z)), 4) AS origin_radius FROM u JOIN b USING (mesh) GROUP BY ALL""")
def mesh_bounds(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    vertices = t(spark, sf_dir, "customer").select(n.alias("mesh"), k.alias("i"), F.col("c_acctbal").alias("x"), (k % 100).alias("y"), (n + k % 7).alias("z"))
    found = fits.mesh_bounds(vertices, vertices.where("mesh % 5 <> 0 AND i % 3 > 0").select("mesh", "i"), "mesh", "i")
    return rounded(found, 4, "centre_x", "centre_y", "centre_z", "radius", "origin_radius")


@query("""
WITH RECURSIVE p AS (SELECT DISTINCT c_nationkey % 5 AS image, CAST(c_custkey * 7 % 16 AS INTEGER) AS x, CAST(c_custkey // 16 % 16 AS INTEGER) AS y FROM customer WHERE c_custkey % 11 < 4),
r AS (SELECT image, x, y, y * 16 + x AS seed FROM p UNION SELECT p.image, p.x, p.y, r.seed FROM r JOIN p ON p.image = r.image AND abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1),
l AS (SELECT image, x, y, min(seed) AS seed FROM r GROUP BY ALL)
SELECT image, seed, count(*) AS area, bool_or(x IN (0, 15) OR y IN (0, 15)) AS touches_border, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round(count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)), 6) AS fill FROM l GROUP BY ALL""")
def pixel_regions(spark, sf_dir):
    k = F.col("c_custkey")
    lit = t(spark, sf_dir, "customer").where("c_custkey % 11 < 4").select((F.col("c_nationkey") % 5).alias("image"), (k * 7 % 16).alias("x"), (F.floor(k / 16) % 16).alias("y"))
    return rounded(fits.pixel_regions(lit, "image", 16, 16), 6, "fill")
