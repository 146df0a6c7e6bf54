"""Vectors as (x, y, z) tuples of Columns, in metres and degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def direction(lat_deg: Column, lon_deg: Column) -> Vec:
    """The unit vector of a latitude and longitude, z up."""
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def yaw(a: Vec, deg: Column) -> Vec:
    """Turn about the z axis."""
    c, s = F.cos(F.radians(deg)), F.sin(F.radians(deg))
    return c * a[0] - s * a[1], s * a[0] + c * a[1], a[2]


def angle_between(a: Vec, b: Vec) -> Column:
    """In radians, stable for small angles."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def ray_sphere(origin: Vec, ray: Vec, radius: float) -> Column:
    """The distance to the near intersection of a unit ray, null on a miss or behind."""
    b = dot(origin, ray)
    disc = b * b - (dot(origin, origin) - radius * radius)
    t = -b - F.sqrt(F.when(disc >= 0, disc))
    return F.when(t >= 0, t)


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def rotate(a: Vec, yaw_deg: Column, pitch_deg: Column, roll_deg: Column) -> Vec:
    """Roll about x, then pitch (nose up) about y, then yaw about z."""
    (cp, sp), (cr, sr) = ((F.cos(F.radians(d)), F.sin(F.radians(d))) for d in (pitch_deg, roll_deg))
    x, y, z = a[0], cr * a[1] - sr * a[2], sr * a[1] + cr * a[2]
    return yaw((cp * x - sp * z, y, sp * x + cp * z), yaw_deg)


def lattice_point(i: Column, n: Column | int) -> tuple[Column, Column]:
    """(z, longitude in degrees) of point ``i`` of ``n`` that share the sphere equally: midpoints of bands of equal height, turned by the golden angle."""
    return 1 - (2 * i + 1) / n, F.degrees((i * (math.pi * (3 - math.sqrt(5)))) % (2 * math.pi)) - 180


# Vectors


def vector(*parts: Column | float) -> Vec:
    x, y, z = (p if isinstance(p, Column) else F.lit(float(p)) for p in parts)
    return x, y, z


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def scale(a: Vec, s: Column | float) -> Vec:
    return a[0] * s, a[1] * s, a[2] * s


def negate(a: Vec) -> Vec:
    return -a[0], -a[1], -a[2]


def add_scaled(a: Vec, b: Vec, s: Column | float) -> Vec:
    return add(a, scale(b, s))


def norm_squared(a: Vec) -> Column:
    return dot(a, a)


def normalise(a: Vec) -> Vec:
    """The unit vector; the zero vector stays zero."""
    n = norm(a)
    safe = F.when(n > 0, n)
    x, y, z = (F.coalesce(c / safe, F.lit(0.0)) for c in a)
    return x, y, z


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def direction_to(a: Vec, b: Vec) -> Vec:
    return normalise(sub(b, a))


def clamp(x: Column, low: float, high: float) -> Column:
    """A number cut to a range; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def safe_acos(x: Column) -> Column:
    return F.acos(clamp(x, -1, 1))


def acos_deg(x: Column) -> Column:
    return F.degrees(safe_acos(x))


def wrap180(deg: Column) -> Column:
    """The same angle in (-180, 180]."""
    d = F.when(deg % 360 <= -180, deg % 360 + 360).otherwise(deg % 360)
    return F.when(d > 180, d - 360).otherwise(d)


def angle_between_deg(a: Vec, b: Vec) -> Column:
    return F.degrees(angle_between(a, b))


def lat_lon(a: Vec) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of a point; 0, 0 for the centre."""
    n = norm(a)
    return F.coalesce(F.degrees(F.asin(clamp(a[2] / F.when(n > 0, n), -1, 1))), F.lit(0.0)), F.degrees(F.atan2(a[1], a[0]))


def surface_point(lat_deg: Column, lon_deg: Column, radius: float) -> Vec:
    return scale(direction(lat_deg, lon_deg), radius)


def geodesic_mm(a: Vec, b: Vec, radius: float) -> Column:
    """The length of the arc between two directions on a sphere of ``radius`` metres, in millimetres."""
    return angle_between(a, b) * (radius * 1000)


def distance_from_angular_radius(radius: float, half_angle: Column) -> Column:
    """How far away a sphere of ``radius`` is seen under a half angle (radians)."""
    return F.lit(float(radius)) / F.sin(half_angle)


# Rotations: matrices are nine Columns, row by row

Matrix = tuple[Column, ...]


def rotation_x(rad: Column) -> Matrix:
    c, s, one, zero = F.cos(rad), F.sin(rad), F.lit(1.0), F.lit(0.0)
    return one, zero, zero, zero, c, -s, zero, s, c


def rotation_y(rad: Column) -> Matrix:
    c, s, one, zero = F.cos(rad), F.sin(rad), F.lit(1.0), F.lit(0.0)
    return c, zero, s, zero, one, zero, -s, zero, c


def rotation_z(rad: Column) -> Matrix:
    c, s, one, zero = F.cos(rad), F.sin(rad), F.lit(1.0), F.lit(0.0)
    return c, -s, zero, s, c, zero, zero, zero, one


def transpose(m: Matrix) -> Matrix:
    return tuple(m[3 * c + r] for r in range(3) for c in range(3))


def matrix_product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(sum((a[3 * r + k] * b[3 * k + c] for k in range(1, 3)), a[3 * r] * b[c]) for r in range(3) for c in range(3))


def matrix_vector(m: Matrix, v: Vec) -> Vec:
    x, y, z = (m[3 * r] * v[0] + m[3 * r + 1] * v[1] + m[3 * r + 2] * v[2] for r in range(3))
    return x, y, z


def matrix_t_vector(m: Matrix, v: Vec) -> Vec:
    return matrix_vector(transpose(m), v)


def rotation_matrix(yaw_deg: Column, pitch_deg: Column, roll_deg: Column) -> Matrix:
    """The matrix of ``rotate``: roll about x, then pitch (nose up) about y, then yaw about z."""
    return matrix_product(rotation_z(F.radians(yaw_deg)), matrix_product(rotation_y(-F.radians(pitch_deg)), rotation_x(F.radians(roll_deg))))


def euler_angles(m: Matrix) -> tuple[Column, Column, Column]:
    """(yaw, pitch, roll) in degrees of a matrix; straight up or down, all of the turn is yaw."""
    sin_pitch = clamp(m[6], -1, 1)
    up = F.sqrt(F.greatest(F.lit(0.0), 1 - sin_pitch * sin_pitch)) < 1e-9
    yaw_deg = F.when(up, F.degrees(F.atan2(-m[1], m[4]))).otherwise(F.degrees(F.atan2(m[3], m[0])))
    return yaw_deg, F.degrees(F.asin(sin_pitch)), F.when(up, 0.0).otherwise(F.degrees(F.atan2(m[7], m[8])))


def rodrigues(w: Vec) -> Matrix:
    """The rotation about ``w`` by its length in radians; the identity for a length below 1e-15."""
    theta = norm(w)
    still = theta < 1e-15
    k = tuple(F.coalesce(c / F.when(~still, theta), F.lit(0.0)) for c in w)
    c, s = F.cos(theta), F.sin(theta)
    t = 1 - c
    skew = (F.lit(0.0), -k[2], k[1], k[2], F.lit(0.0), -k[0], -k[1], k[0], F.lit(0.0))
    full = [t * k[i // 3] * k[i % 3] + s * skew[i] + (c if i % 4 == 0 else 0.0) for i in range(9)]
    return tuple(F.when(still, float(i % 4 == 0)).otherwise(x) for i, x in enumerate(full))


def rotation_angle(a: Matrix, b: Matrix) -> Column:
    """The angle in degrees of the rotation from one orientation to the other."""
    trace = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    return acos_deg((trace - 1) / 2)


def axis_angle(m: Matrix) -> tuple[Vec, Column]:
    """The unit axis and the angle in degrees of a rotation; the z axis where the angle leaves none."""
    angle = safe_acos((m[0] + m[4] + m[8] - 1) / 2)
    none = F.abs(F.sin(angle)) < 1e-12
    raw = normalise((m[7] - m[5], m[2] - m[6], m[3] - m[1]))
    x, y, z = (F.when(none, float(i == 2)).otherwise(c) for i, c in enumerate(raw))
    return (x, y, z), F.degrees(angle)


def aim(origin: Vec, target: Vec) -> tuple[Column, Column]:
    """(yaw, pitch) in degrees that point from one place at another; 0, 0 where they are one."""
    d = direction_to(origin, target)
    return F.degrees(F.atan2(d[1], d[0])), F.degrees(F.asin(clamp(d[2], -1, 1)))


# Lattices on the sphere


def lattice_weight_sr(n: Column | int) -> Column | float:
    """The solid angle of each of ``n`` points that share the sphere."""
    return 4 * math.pi / n


def sphere_area(radius: float) -> float:
    return 4 * math.pi * radius * radius


def lattice_weight_m2(n: Column | int, radius: float) -> Column | float:
    return sphere_area(radius) / n
