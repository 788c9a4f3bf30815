"""Plane geometry and geodesy as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean equatorial radius of the local projection; WGS84 axes and the UTM scale.
EARTH_RADIUS = 6_378_137.0
WGS84_A, WGS84_F, UTM_K0 = 6_378_137.0, 1 / 298.257223563, 0.9996


def project(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Point through a row-major 3x3 transform; null where the divisor vanishes."""
    w = m[6] * x + m[7] * y + m[8]
    safe = F.when(F.abs(w) >= 1e-12, w)
    return (m[0] * x + m[1] * y + m[2]) / safe, (m[3] * x + m[4] * y + m[5]) / safe


def square(x: Column, y: Column, half: float) -> Column:
    """Corners of a square around a point, as an array of (x, y)."""
    return F.array(*[F.struct((x + i * half).alias("x"), (y + j * half).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def inverse(m: list[Column]) -> list[Column]:
    """The inverse of a row-major 3x3 matrix, null where it has none."""
    cofactor = lambda i, j: m[3 * ((i + 1) % 3) + (j + 1) % 3] * m[3 * ((i + 2) % 3) + (j + 2) % 3] - m[3 * ((i + 1) % 3) + (j + 2) % 3] * m[3 * ((i + 2) % 3) + (j + 1) % 3]
    det = m[0] * cofactor(0, 0) + m[1] * cofactor(0, 1) + m[2] * cofactor(0, 2)
    safe = F.when(F.abs(det) >= 1e-12, det)
    return [cofactor(j, i) / safe for i in range(3) for j in range(3)]


def footprint(m: list[Column], width: Column, height: Column, roi: Column | None = None) -> Column:
    """Corners of an image, down to the rows ``roi`` if that is less, through a row-major 3x3 transform: an array of (x, y)."""
    low, no = height if roi is None else F.least(height, roi), F.lit(0.0)
    corners = [project(m, x, y) for x, y in ((no, no), (width, no), (width, low), (no, low))]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def along_across(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """Rotate into the frame of rows at ``angle`` (radians)."""
    return x * F.cos(angle) + y * F.sin(angle), y * F.cos(angle) - x * F.sin(angle)


def from_along_across(a: Column, c: Column, angle: Column) -> tuple[Column, Column]:
    return a * F.cos(angle) - c * F.sin(angle), a * F.sin(angle) + c * F.cos(angle)


def to_enu(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular metres east and north of an origin."""
    return F.radians(lon - lon0) * EARTH_RADIUS * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_RADIUS


def from_enu(east: Column, north: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return lat0 + F.degrees(north / EARTH_RADIUS), lon0 + F.degrees(east / (EARTH_RADIUS * F.cos(F.radians(lat0))))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def to_utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in the point's own zone, by the usual series of the transverse Mercator projection."""
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t = F.pow(F.tan(phi), 2)
    c = ep2 * F.pow(F.cos(phi), 2)
    a = F.radians(lon - ((utm_zone(lon) - 1) * 6 - 177)) * F.cos(phi)
    m = WGS84_A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = UTM_K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120) + 500_000
    north = UTM_K0 * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720))
    return east, F.when(lat < 0, north + 10_000_000).otherwise(north)


def from_utm(east: Column, north: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Latitude and longitude of an easting and northing, by the footpoint latitude's series; to well under a millimetre inside of a zone."""
    e2 = WGS84_F * (2 - WGS84_F)
    ep2, root = e2 / (1 - e2), math.sqrt(1 - e2)
    e1 = (1 - root) / (1 + root)
    held = north if south is None else F.when(south, north - 10_000_000).otherwise(north)
    mu = held / UTM_K0 / (WGS84_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = (
        mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    sine2 = F.pow(F.sin(foot), 2)
    n, r = WGS84_A / F.sqrt(1 - e2 * sine2), WGS84_A * (1 - e2) / F.pow(1 - e2 * sine2, 1.5)
    t, c, d = F.pow(F.tan(foot), 2), ep2 * F.pow(F.cos(foot), 2), (east - 500_000) / (n * UTM_K0)
    lat = foot - n * F.tan(foot) / r * (
        d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720
    )
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(foot)
    return F.degrees(lat), (zone - 1) * 6 - 177 + F.degrees(lon)


def affine_metrics(m: list[Column]) -> dict[str, Column]:
    """Determinant, scale, rotation in degrees and shift of a row-major 3x3 affine transform."""
    det = m[0] * m[4] - m[1] * m[3]
    return {"determinant": det, "scale": F.sqrt(F.abs(det)), "rotation_deg": F.degrees(F.atan2(m[3], m[0])), "translation_x": m[2], "translation_y": m[5]}


def rescaled(m: list[Column], sx: float, sy: float) -> list[Column]:
    """A row-major 3x3 transform of previews, which are sx and sy times as large as the images, for the images themselves."""
    s = (float(sx), float(sy), 1.0)
    return [m[3 * i + j] * (s[j] / s[i]) for i in range(3) for j in range(3)]


def shoelace(xs: Column, ys: Column) -> Column:
    """Signed area of a ring given as two arrays, closed or not."""
    n = F.size(xs)
    term = lambda i: F.element_at(xs, i + 1) * F.element_at(ys, (i + 1) % n + 1) - F.element_at(xs, (i + 1) % n + 1) * F.element_at(ys, i + 1)
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda s, v: s + v) / 2


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; a segment without length is a point."""
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / long, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def crosses(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """True if the ray from the point to the right crosses the edge; half-open in y, so a vertex counts once."""
    return ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)


def fov_axes(diagonal_deg: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Horizontal and vertical field of view, in degrees, from the diagonal one."""
    d = F.tan(F.radians(diagonal_deg) / 2)
    diagonal = F.hypot(width, height)
    return F.degrees(2 * F.atan(d * width / diagonal)), F.degrees(2 * F.atan(d * height / diagonal))


def euler(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw in degrees of a unit quaternion."""
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(F.least(F.greatest(2 * (w * y - z * x), F.lit(-1.0)), F.lit(1.0)))
    yaw = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    return F.degrees(roll), F.degrees(pitch), F.degrees(yaw)
