"""Queries over photographed patterns: block fingerprints, indexing by them, and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decoding, indexing
from ..operators.decoding import REASONS, Axis
from .registry import query, rounded, t

# Fingerprints: lines of an order are pixels of a frame a supplier; some lie outside it, some are masked


@query("""
WITH p AS (SELECT l_suppkey AS frame, l_partkey % 70 AS x, l_orderkey % 47 AS y, l_quantity AS v FROM lineitem WHERE true),
f AS (SELECT DISTINCT frame FROM p),
c AS (SELECT frame, least(4, y * 5 // 47) * 5 + least(4, x * 5 // 64) AS block, avg(v) AS mean FROM p WHERE x < 64 AND v <> 13 GROUP BY ALL)
SELECT f.frame, CAST(b AS INTEGER) AS block, round(coalesce(mean, 0), 6) AS value, mean IS NOT NULL AS measured FROM f, range(25) r(b) LEFT JOIN c ON c.frame = f.frame AND c.block = b""")
def pattern_fingerprints(spark, sf_dir):
    pixels = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 70).alias("x"), (F.col("l_orderkey") % 47).alias("y"), F.col("l_quantity").alias("v"))
    found = indexing.fingerprints(pixels, ["frame"], "x", "y", "v", 5, 64, 47, F.col("v") != 13)
    cells = found.select("frame", F.posexplode(F.arrays_zip("values", "measured")).alias("block", "c"))
    return rounded(cells.select("frame", "block", F.col("c.values").alias("value"), F.col("c.measured").alias("measured")), 6, "value")


# Captures of two runs of eight photographs, sixteen customers each; faults keep every count and kind as it should be

_SHOTS = """
WITH f AS (SELECT c_custkey // 16 AS capture, CAST(c_custkey % 16 AS INTEGER) AS i FROM customer WHERE c_custkey // 16 < (SELECT count(*) // 16 FROM customer)),
s AS (SELECT *, CASE WHEN capture % 5 = 1 AND i BETWEEN 11 AND 13 THEN i - 1 WHEN capture % 5 = 2 AND i = 15 THEN 14 ELSE i END % 8 AS slot FROM f),
v AS (SELECT s.*, CAST(b AS INTEGER) AS b, CASE WHEN capture % 5 = 3 AND i = 4 THEN NULL ELSE 0.05 + (0.5 + b * 0.1::DOUBLE) * CASE slot WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN b % 2 WHEN 3 THEN 1 - b % 2 WHEN 4 THEN b // 2 WHEN 5 THEN 1 - b // 2 ELSE 0.5 END END AS val FROM s, range(4) r(b)),
"""


@query(_SHOTS + """
q AS (SELECT x.capture, x.i // 8 AS run, x.i % 8 AS place, sum(abs(x.val + y.val - w.val - k.val)) / sum(w.val - k.val) FILTER (x.val + y.val IS NOT NULL) AS residual
  FROM v x JOIN v y ON y.capture = x.capture AND y.b = x.b AND y.i = x.i + 1 JOIN v w ON w.capture = x.capture AND w.b = x.b AND w.i = x.i // 8 * 8 JOIN v k ON k.capture = x.capture AND k.b = x.b AND k.i = w.i + 1 WHERE x.i % 8 IN (2, 4) GROUP BY ALL),
r AS (SELECT capture, run, bool_or(residual > 0.15) AS broken, bool_or(residual IS NULL) AS unanswered, min_by(residual, place) FILTER (residual > 0.15) AS residual FROM q GROUP BY ALL)
SELECT capture, i, CASE WHEN coalesce(broken, false) OR unanswered THEN NULL ELSE i END AS assigned, CASE WHEN broken THEN 'pair' WHEN unanswered THEN 'unmeasured' END AS problem, round(residual, 6) AS residual FROM f JOIN r USING (capture) WHERE r.run = i // 8""")
def fingerprint_index(spark, sf_dir):
    customer = t(spark, sf_dir, "customer")
    whole = customer.agg(F.floor(F.count("*") / 16).alias("_n"))
    i, capture = (F.col("c_custkey") % 16).cast("int"), F.floor(F.col("c_custkey") / 16)
    frames = customer.select(capture.alias("capture"), i.alias("i")).crossJoin(F.broadcast(whole)).where("capture < _n").drop("_n")  # one row
    slot = F.when((F.col("capture") % 5 == 1) & F.col("i").between(11, 13), F.col("i") - 1).when((F.col("capture") % 5 == 2) & (F.col("i") == 15), 14).otherwise(F.col("i")) % 8
    plane = lambda b: F.when(F.col("slot") == 0, 1).when(F.col("slot") == 1, 0).when(F.col("slot") == 2, b % 2).when(F.col("slot") == 3, 1 - b % 2).when(F.col("slot") == 4, F.floor(b / 2)).when(F.col("slot") == 5, 1 - F.floor(b / 2)).otherwise(0.5)
    dark = (F.col("capture") % 5 == 3) & (F.col("i") == 4)
    shots = frames.withColumn("slot", slot).select(
        "capture", "i", F.when(F.col("slot") == 0, 0.8).when(F.col("slot") == 1, 0.0).otherwise(0.4).alias("lit"), F.lit(2).alias("blocks"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.when(dark, 0.0).otherwise(0.05 + (0.5 + b * 0.1) * plane(b))).alias("values"), F.array(*[~dark] * 4).alias("measured"),
    )
    plan = ["white", "black", *["patterned"] * 6]
    found = indexing.index_by_fingerprint(shots, ["capture"], "i", plan, 2, [(2, 3), (4, 5)], 2)
    return rounded(found.select("capture", "i", "assigned", "problem", "residual"), 6, "residual")


# Decoding: a line is a pixel that sees 8 Gray bins of 4 and fringes of 8 projector pixels across, 4 bins of 4 down

_U, _V = Axis(32, [2, 4, 6], [3, 5, 7], 4, [12, 13, 14, 15], 8), Axis(14, [8, 10], [9, 11], 4)
_PIXELS = """
WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS camera, l_tax AS black, l_tax + l_discount AS white, l_discount AS m, (l_partkey % 320) / 10 + 0.03::DOUBLE AS u, (l_orderkey % 160) / 10 + 0.03::DOUBLE AS v FROM lineitem),
b AS (SELECT *, xor(CAST(floor(u / 4) AS INTEGER), CAST(floor(u / 4) AS INTEGER) >> 1) AS gu, xor(CAST(floor(v / 4) AS INTEGER), CAST(floor(v / 4) AS INTEGER) >> 1) AS gv,
  2 * pi() * u / 8 + CASE WHEN l_linenumber = 6 THEN pi() ELSE 0 END AS phi, CASE WHEN l_linenumber = 7 THEN 0.1::DOUBLE ELSE 0.5 END AS depth FROM a),
c AS (SELECT *, black + m * (0.5 + depth * cos(phi)) AS s0, black + m * (0.5 + depth * cos(phi - pi() / 2)) AS s1, black + m * (0.5 + depth * cos(phi - pi())) AS s2, black + m * (0.5 + depth * cos(phi - 3 * pi() / 2)) AS s3 FROM b),
d AS (SELECT *, (s0 - s2) / 2 AS bc, (s1 - s3) / 2 AS bs, (floor(u / 4) + 0.5) * 4 AS coarse, (floor(v / 4) + 0.5) * 4 AS vc, white - black AS mod FROM c),
e AS (SELECT *, sqrt(bc * bc + bs * bs) AS amp, CASE WHEN atan2(bs, bc) < 0 THEN atan2(bs, bc) + 2 * pi() ELSE atan2(bs, bc) END / (2 * pi()) * 8 AS frac FROM d),
g AS (SELECT *, floor((coarse - frac) / 8 + 0.5) * 8 + frac AS coord FROM e),
h AS (SELECT *, CASE WHEN NOT mod >= 0.02 THEN 'modulation' WHEN l_linenumber = 5 THEN 'gray' WHEN NOT amp >= 0.15 * mod THEN 'phase' WHEN abs(coord - coarse) > 3.2 THEN 'disagree' WHEN coord < 0 OR coord > 32 THEN 'range' WHEN vc > 14 THEN 'range' WHEN coord < 2 THEN 'segment' END AS reason FROM g)
"""


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of pixels of one line each as rows, a stack for each pixel, and what it decodes to."""
    from ..functions.gray import pattern_bit

    # Lines are counted before they are frames, by the key of the stacks: those then need no further shuffle.
    keys = ["l_orderkey", "l_linenumber", "camera"]
    values = ["l_partkey", "l_tax", "l_discount"]
    lines = t(spark, sf_dir, "lineitem").withColumn("camera", F.col("l_suppkey") % 3)
    line = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in values)).where("n = 1")
    u, v = (F.col("l_partkey") % 320) / 10 + 0.03, (F.col("l_orderkey") % 160) / 10 + 0.03
    at = {"u": F.floor(u / 4), "v": F.floor(v / 4)}
    shine = lambda part: F.col("l_tax") + F.col("l_discount") * part
    bit = {(name, j): pattern_bit(at[name], n, j) for name, n in (("u", 3), ("v", 2)) for j in range(n)}
    phi = u / 8 * 2 * F.pi() + F.when(F.col("l_linenumber") == 6, F.pi()).otherwise(0.0)
    depth = F.when(F.col("l_linenumber") == 7, 0.1).otherwise(0.5)
    shown = [shine(F.lit(1.0)), shine(F.lit(0.0))]
    for (name, j), b in bit.items():
        equal = (F.col("l_linenumber") == 5) if (name, j) == ("u", 1) else F.lit(False)
        shown += [shine(b), shine(F.when(equal, b).otherwise(1 - b))]
    shown += [shine(0.5 + depth * F.cos(phi - F.pi() / 2 * n)) for n in range(4)]
    rows = line.select(*keys, F.posexplode(F.array(*shown)).alias("frame", "light"))
    stacks = decoding.pixel_stacks(rows, keys, "frame", "light", 16)
    return decoding.decode(stacks, _U, _V, white=0, black=1, segment=F.col("proj_u") >= 2)


@query(_PIXELS.replace("FROM lineitem)", "FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_suppkey % 3) * FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey % 3) AS n FROM lineitem) WHERE n = 1))") + """
SELECT l_orderkey, l_linenumber, camera, CASE WHEN reason IS NULL THEN round(coord, 5) END AS proj_u, CASE WHEN reason IS NULL THEN round(vc, 5) END AS proj_v, CASE WHEN reason IS NULL THEN round(least(amp / mod, mod), 5) END AS modulation, reason FROM h""")
def decoded_pixels(spark, sf_dir):
    return rounded(_decoded(spark, sf_dir).select("l_orderkey", "l_linenumber", "camera", "proj_u", "proj_v", "modulation", "reason"), 5, "proj_u", "proj_v", "modulation")


@query(_PIXELS.replace("FROM lineitem)", "FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey % 3) AS n FROM lineitem) WHERE n = 1)") + "SELECT camera, count(*) AS considered, count(*) FILTER (reason IS NULL) AS accepted, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS rejected_{r}" for r in REASONS) + " FROM h GROUP BY camera")
def decode_counters(spark, sf_dir):
    return decoding.decode_counts(_decoded(spark, sf_dir), ["camera"])
