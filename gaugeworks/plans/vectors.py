"""Queries of the Column functions: vectors, rotations, colour, photometry and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import geometry as G
from ..functions import gray, photometry, text
from .registry import query, t


def _customers(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return t(spark, sf_dir, "customer").select("c_custkey", *((F.round(c, 5) + F.lit(0.0)).alias(n) for n, c in columns.items()))


def _vectors() -> tuple[Column, G.Vec, G.Vec]:
    k = F.col("c_custkey")
    return k, G.vector(k % 11 - 5.0, k % 7 - 3.0, k % 5 - 2.0), G.vector(k % 4 + 1.0, k % 6 - 2.5, k % 9 - 4.0)


_AB = "WITH v AS (SELECT c_custkey, c_custkey % 11 - 5.0::DOUBLE AS ax, c_custkey % 7 - 3.0::DOUBLE AS ay, c_custkey % 5 - 2.0::DOUBLE AS az, c_custkey % 4 + 1.0::DOUBLE AS bx, c_custkey % 6 - 2.5::DOUBLE AS \"by\", c_custkey % 9 - 4.0::DOUBLE AS bz FROM customer), n AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS la FROM v)"


@query(_AB + """
SELECT c_custkey, round(ax + bx, 5) AS add_x, round(ay - "by", 5) AS sub_y, round(az * 2.5, 5) + 0.0 AS scale_z, round(-ax, 5) + 0.0 AS negate_x, round(ay + "by" * 0.5, 5) AS scaled_y, round(ax * bx + ay * "by" + az * bz, 5) AS dot, round(ay * bz - az * "by", 5) AS cross_x, round(la, 5) AS length, round(la * la, 5) AS length_squared,
  round(CASE WHEN la > 0 THEN az / la ELSE 0 END, 5) + 0.0 AS unit_z, round(sqrt((ax - bx) ** 2 + (ay - "by") ** 2 + (az - bz) ** 2), 5) AS distance, round(degrees(atan2(sqrt((ay * bz - az * "by") ** 2 + (az * bx - ax * bz) ** 2 + (ax * "by" - ay * bx) ** 2), ax * bx + ay * "by" + az * bz)), 5) AS angle FROM n""")
def vector_algebra(spark, sf_dir):
    _, a, b = _vectors()
    return _customers(spark, sf_dir, add_x=G.add(a, b)[0], sub_y=G.sub(a, b)[1], scale_z=G.scale(a, 2.5)[2], negate_x=G.negate(a)[0], scaled_y=G.add_scaled(a, b, 0.5)[1], dot=G.dot(a, b), cross_x=G.cross(a, b)[0], length=G.norm(a), length_squared=G.norm_squared(a), unit_z=G.normalise(a)[2], distance=G.distance(a, b), angle=G.angle_between_deg(a, b))


@query(_AB + """
, w AS (SELECT *, c_custkey * 53 % 1440 - 720.5 AS deg FROM n)
SELECT c_custkey, round(CASE WHEN deg % 360 <= -180 THEN deg % 360 + 360 WHEN deg % 360 > 180 THEN deg % 360 - 360 ELSE deg % 360 END, 5) AS wrapped, round(degrees(asin(coalesce(CASE WHEN la > 0 THEN az / la END, 0))), 5) + 0.0 AS lat, round(degrees(atan2(ay, ax)), 5) + 0.0 AS lon, round(degrees(acos(least(1, greatest(-1, ax / 3)))), 5) AS acos,
  round(1.5 * cos(radians(ay * 10)) * sin(radians(ax * 20)), 5) + 0.0 AS surface_y, round(degrees(atan2("by" - ay, bx - ax)), 5) + 0.0 AS aim_yaw, round(degrees(asin(coalesce((bz - az) / nullif(sqrt((ax - bx) ** 2 + (ay - "by") ** 2 + (az - bz) ** 2), 0), 0))), 5) + 0.0 AS aim_pitch, round(1.5 / sin(0.1 + abs(ax) / 10), 5) AS away FROM w""")
def angles_and_aims(spark, sf_dir):
    k, a, b = _vectors()
    lat, lon = G.lat_lon(a)
    yaw, pitch = G.aim(a, b)
    return _customers(spark, sf_dir, wrapped=G.wrap180(k * 53 % 1440 - 720.5), lat=lat, lon=lon, acos=G.acos_deg(a[0] / 3), surface_y=G.surface_point(a[1] * 10, a[0] * 20, 1.5)[1], aim_yaw=yaw, aim_pitch=pitch, away=G.distance_from_angular_radius(1.5, 0.1 + F.abs(a[0]) / 10))


@query("WITH d AS (SELECT c_custkey, (c_custkey * 37 % 340) - 170.0 AS yaw, (c_custkey * 11 % 160) - 80.0 AS pitch, (c_custkey * 5 % 300) - 150.0 AS roll FROM customer) SELECT c_custkey, round(yaw, 5) + 0.0 AS yaw, round(pitch, 5) + 0.0 AS pitch, round(roll, 5) + 0.0 AS roll, 0.0::DOUBLE AS self_angle, 1.0::DOUBLE AS axis_length, 0.0::DOUBLE AS transpose_error, round(abs(yaw), 5) AS yaw_angle FROM d")
def rotation_round_trip(spark, sf_dir):
    """Angles to a matrix and back, the turn that its axis and angle make again, and the transpose as its inverse."""
    k = F.col("c_custkey")
    yaw, pitch, roll = k * 37 % 340 - 170.0, k * 11 % 160 - 80.0, k * 5 % 300 - 150.0
    m = G.rotation_matrix(yaw, pitch, roll)
    base = t(spark, sf_dir, "customer").select("c_custkey", yaw.alias("w"), *(c.alias(f"m{i}") for i, c in enumerate(m)))
    m = tuple(F.col(f"m{i}") for i in range(9))
    back = G.euler_angles(m)
    axis, angle = G.axis_angle(m)
    again = base.select("*", *(c.alias(f"a{i}") for i, c in enumerate(axis)), angle.alias("angle"))
    axis = tuple(F.col(f"a{i}") for i in range(3))
    turned = G.rodrigues(G.scale(axis, F.radians("angle")))
    error = F.greatest(*(F.abs(a - b) for a, b in zip(turned, m, strict=True)))
    lost = G.distance(G.matrix_t_vector(m, G.matrix_vector(m, axis)), axis)
    plain = (F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    out = {"yaw": back[0], "pitch": back[1], "roll": back[2], "self_angle": error, "axis_length": G.norm(axis), "transpose_error": lost, "yaw_angle": G.rotation_angle(G.rotation_z(F.radians("w")), plain)}
    return again.select("c_custkey", *((F.round(c, 5) + F.lit(0.0)).alias(n) for n, c in out.items()))


_LAB = "CASE WHEN {0} > 216 / 24389.0 THEN pow({0}, 1 / 3.0) ELSE (24389 / 27.0 * greatest({0}, 0) + 16) / 116 END"


@query(f"""
WITH p AS (SELECT p_partkey, p_partkey % 11 / 10.0::DOUBLE AS r, p_partkey % 7 / 6.0::DOUBLE AS g, p_partkey % 13 / 12.0::DOUBLE AS b FROM part),
x AS (SELECT *, 0.4123907992659595 * r + 0.35758433938387796 * g + 0.18048078840183429 * b AS x, 0.21263900587151036 * r + 0.7151686787677559 * g + 0.07219231536073371 * b AS y, 0.01933081871559185 * r + 0.11919477979462599 * g + 0.9505321522496607 * b AS z FROM p),
f AS (SELECT *, {_LAB.format('(x / 0.9504559270516716)')} AS fx, {_LAB.format('y')} AS fy, {_LAB.format('(z / 1.0890577507598784)')} AS fz FROM x),
l AS (SELECT *, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM f)
SELECT p_partkey, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, round(l, 4) + 0.0 AS l, round(a, 4) + 0.0 AS a, round(bb, 4) + 0.0 AS b, round(r, 5) AS red, round(sqrt((l - 50) ** 2 + a * a + bb * bb), 4) AS delta FROM l""")
def colour_spaces(spark, sf_dir):
    k = F.col("p_partkey")
    rgb = tuple(k % n / float(n - 1) for n in (11, 7, 13))
    xyz = C.rgb_to_xyz(rgb)
    lab = C.xyz_to_lab(xyz)
    red = C.xyz_to_rgb(xyz)[0]
    out = {"x": (xyz[0], 5), "y": (xyz[1], 5), "z": (xyz[2], 5), "l": (lab[0], 4), "a": (lab[1], 4), "b": (lab[2], 4), "red": (red, 5), "delta": (C.delta_e76(lab, G.vector(50, 0, 0)), 4)}
    return t(spark, sf_dir, "part").select("p_partkey", *((F.round(c, d) + F.lit(0.0)).alias(n) for n, (c, d) in out.items()))


@query("""
WITH k AS (SELECT p_partkey, least(greatest(p_partkey * 97 % 30000, 1667), 25000)::DOUBLE AS t FROM part),
x AS (SELECT *, CASE WHEN t <= 4000 THEN -0.2661239e9 / (t * t * t) - 0.2343589e6 / (t * t) + 0.8776956e3 / t + 0.17991 ELSE -3.0258469e9 / (t * t * t) + 2.1070379e6 / (t * t) + 0.2226347e3 / t + 0.24039 END AS x FROM k),
y AS (SELECT *, CASE WHEN t <= 2222 THEN ((-1.1063814 * x - 1.3481102) * x + 2.18555832) * x - 0.20219683 WHEN t <= 4000 THEN ((-0.9549476 * x - 1.37418593) * x + 2.09137015) * x - 0.16748867 ELSE ((3.081758 * x - 5.8733867) * x + 3.75112997) * x - 0.37001483 END AS y FROM x),
n AS (SELECT *, (x - 0.332) / (0.1858 - y) AS n, 0.3 / y * x AS bx, 0.3 / y * (1 - x - y) AS bz FROM y),
r AS (SELECT *, 3.240969941904523 * bx - 1.5373831775700939 * 0.3 - 0.498610760293003 * bz AS red, -0.9692436362808796 * bx + 1.8759675015077204 * 0.3 + 0.0415550574071756 * bz AS green, 0.05563007969699366 * bx - 0.2039769588889765 * 0.3 + 1.0569715142428784 * bz AS blue FROM n)
SELECT p_partkey, round(x, 6) AS x, round(y, 6) AS y, round(((437 * n + 3601) * n + 6861) * n + 5517, 3) AS kelvin, round(greatest(red, 0), 5) AS red, round(greatest(green, 0), 5) AS green, round(greatest(blue, 0), 5) AS blue, red < 0 OR green < 0 OR blue < 0 AS cut FROM r""")
def black_body_light(spark, sf_dir):
    kelvin = F.col("p_partkey") * 97 % 30000
    x, y = C.planckian_xy(kelvin)
    base = t(spark, sf_dir, "part").select("p_partkey", kelvin.alias("k"), x.alias("x"), y.alias("y"))
    rgb, cut = C.ambient(F.lit(0.3), F.col("k"))
    return base.select("p_partkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(C.colour_temperature(F.col("x"), F.col("y")), 3).alias("kelvin"), *((F.round(c, 5) + F.lit(0.0)).alias(n) for n, c in zip(("red", "green", "blue"), rgb, strict=True)), cut.alias("cut"))


@query("""
WITH x AS (SELECT p_partkey, p_partkey % 21 / 20.0::DOUBLE AS t, p_partkey % 41 / 8.0 - 2.5 AS s FROM part), w AS (SELECT *, (1 - cos(t * pi())) / 2 AS c, (1 - cos((1 - t) * pi())) / 2 AS d FROM x),
g AS (SELECT *, CASE WHEN c = 0 THEN 0 ELSE pow(c, 0.8) END AS a, CASE WHEN d = 0 THEN 0 ELSE pow(d, 0.8) END AS b FROM w)
SELECT p_partkey, round(a, 5) AS ramp, round(a + b, 5) AS fade_sum, round(a / (a + b), 5) AS fade, CASE WHEN (t / 0.9 - 0.02) / 0.98 BETWEEN 0 AND 1 THEN round(pow((t / 0.9 - 0.02) / 0.98, 1 / 2.4), 5) ELSE 'NaN'::DOUBLE END AS signal, round(CASE WHEN abs(s) <= 1.86 THEN s * s ELSE 1.86 * (2 * abs(s) - 1.86) END, 5) AS huber, round(CASE WHEN abs(s) <= 1.86 THEN 1 ELSE 1.86 / abs(s) END, 5) AS huber_weight,
  round(2.3849 * 2.3849 * ln(1 + s * s / (2.3849 * 2.3849)), 5) AS cauchy, round(1 / (1 + s * s / (2.3849 * 2.3849)), 5) AS cauchy_weight, CAST((xor(p_partkey, p_partkey >> 1) >> 9) & 1 AS BIGINT) AS bit FROM g""")
def weights_and_losses(spark, sf_dir):
    k = F.col("p_partkey")
    x, s = k % 21 / 20.0, k % 41 / 8.0 - 2.5
    (huber, hw), (cauchy, cw) = photometry.robust_loss(s), photometry.robust_loss(s, "cauchy")
    out = {"ramp": photometry.ramp_weight("cosine", x, 0.8), "fade_sum": photometry.crossfade_sum("cosine", 0.8, x), "fade": photometry.crossfade_weight("cosine", 0.8, x), "signal": photometry.signal_for(x, 2.4, 0.9, 0.02), "huber": huber, "huber_weight": hw, "cauchy": cauchy, "cauchy_weight": cw}
    return t(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 5).alias(n) for n, c in out.items()), gray.pattern_bit(k, 10, 0).cast("bigint").alias("bit"))


@query("""
SELECT page_id, replace(url, '/', '-') AS slug, 'https://host.x/' || page_id || '/r' AS address, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'unit' END AS name, CASE WHEN page_id % 3 = 0 THEN NULL ELSE CAST(page_id AS INTEGER) END AS number, strftime(TIMESTAMP '2026-01-01' + to_days(CAST(page_id AS INTEGER)), '%Y-%m-%d') AS day FROM pages WHERE url IS NOT NULL""")
def names_and_labels(spark, sf_dir):
    k = F.col("page_id")
    remote = F.when(k % 2 == 0, F.concat(F.lit("git@host.x:"), k, F.lit("/r.git"))).otherwise(F.concat(F.lit("https://host.x/"), k, F.lit("/r")))
    name, number = text.parse_unit(F.when(k % 3 == 0, "nothing").otherwise(F.concat(F.lit("unit:"), k)))
    day = F.timestamp_seconds(F.lit(1767225600) + k * 86400)
    return t(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", text.project_slug(F.col("url")).alias("slug"), text.repository_url(remote).alias("address"), name.alias("name"), number.alias("number"), text.iso_day(day).alias("day"))
