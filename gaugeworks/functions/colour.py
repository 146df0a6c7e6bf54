"""Colour spaces, as tuples of Columns: linear Rec. 709 RGB, CIE XYZ, xy and Lab."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Vec, matrix_vector

# The published Rec. 709 matrices for D65, that white, and the knees of Lab
RGB_TO_XYZ = (0.4123907992659595, 0.35758433938387796, 0.18048078840183429, 0.21263900587151036, 0.7151686787677559, 0.07219231536073371, 0.01933081871559185, 0.11919477979462599, 0.9505321522496607)
XYZ_TO_RGB = (3.240969941904523, -1.5373831775700939, -0.498610760293003, -0.9692436362808796, 1.8759675015077204, 0.0415550574071756, 0.05563007969699366, -0.2039769588889765, 1.0569715142428784)
D65 = (0.9504559270516716, 1.0, 1.0890577507598784)
LAB_EPSILON, LAB_KAPPA = 216 / 24389, 24389 / 27


def by_matrix(m: tuple[float, ...], v: Vec) -> Vec:
    return matrix_vector(tuple(map(F.lit, m)), v)


def rgb_to_xyz(rgb: Vec) -> Vec:
    return by_matrix(RGB_TO_XYZ, rgb)


def xyz_to_rgb(xyz: Vec) -> Vec:
    return by_matrix(XYZ_TO_RGB, xyz)


def xyz_to_lab(xyz: Vec, white: tuple[Column | float, ...] = D65) -> Vec:
    def part(t: Column) -> Column:
        return F.when(t > LAB_EPSILON, F.cbrt(t)).otherwise((LAB_KAPPA * F.greatest(t, F.lit(0.0)) + 16) / 116)

    x, y, z = (part(c / w) for c, w in zip(xyz, white, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def rgb_to_lab(rgb: Vec, white_rgb: Vec) -> Vec:
    return xyz_to_lab(rgb_to_xyz(rgb), rgb_to_xyz(white_rgb))


def delta_e76(a: Vec, b: Vec) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0])))


def planckian_xy(kelvin: Column) -> tuple[Column, Column]:
    """The chromaticity of a black body, by the published cubic fits from 1667 to 25000 K; beyond them the nearer end."""
    t = F.least(F.greatest(kelvin.cast("double"), F.lit(1667.0)), F.lit(25000.0))
    cold = -0.2661239e9 / (t * t * t) - 0.2343589e6 / (t * t) + 0.8776956e3 / t + 0.17991
    warm = -3.0258469e9 / (t * t * t) + 2.1070379e6 / (t * t) + 0.2226347e3 / t + 0.24039
    x = F.when(t <= 4000, cold).otherwise(warm)
    cubic = lambda a, b, c, d: ((a * x + b) * x + c) * x + d
    y = F.when(t <= 2222, cubic(-1.1063814, -1.3481102, 2.18555832, -0.20219683)).when(t <= 4000, cubic(-0.9549476, -1.37418593, 2.09137015, -0.16748867)).otherwise(cubic(3.081758, -5.8733867, 3.75112997, -0.37001483))
    return x, y


def xy_to_xyz(x: Column, y: Column, luminance: Column | float = 1.0) -> Vec:
    """XYZ of a chromaticity; all 0 where y isn't positive."""
    level = luminance if isinstance(luminance, Column) else F.lit(float(luminance))
    s = level / F.when(y > 0, y)
    return F.coalesce(s * x, F.lit(0.0)), F.when(y > 0, level).otherwise(0.0), F.coalesce(s * (1 - x - y), F.lit(0.0))


def colour_temperature(x: Column, y: Column) -> Column:
    """Kelvin of a chromaticity, by the published cubic."""
    n = (x - 0.332) / (0.1858 - y)
    return ((437 * n + 3601) * n + 6861) * n + 5517


def ambient(level: Column, kelvin: Column) -> tuple[Vec, Column]:
    """Linear RGB of light of a level and colour temperature, with negative parts cut to 0, and whether any was."""
    raw = xyz_to_rgb(xy_to_xyz(*planckian_xy(kelvin), level))
    r, g, b = (F.greatest(c, F.lit(0.0)) for c in raw)
    return (r, g, b), (raw[0] < 0) | (raw[1] < 0) | (raw[2] < 0)
