"""Camera and map geometry as column arithmetic; camera parameters are numbers known to the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Camera:
    """Position (x, y, z), angles in radians and focal length in pixels."""

    kappa: float
    phi: float
    omega: float
    x: float
    y: float
    z: float
    f: float

    def rows(self) -> list[tuple[float, float, float]]:
        """Coefficients that turn offsets from the camera into image height, image width and depth; phi is measured from
        the horizon. The height's second coefficient has the sign that the published fits were made with."""
        phi = self.phi + math.pi / 2
        (co, so), (cp, sp), (ck, sk) = ((math.cos(t), math.sin(t)) for t in (self.omega, phi, self.kappa))
        height = (cp * ck + sp * so * sk, cp * sk + sp * so * ck, sp * co)
        width = (-co * sk, co * ck, so)
        depth = (sp * ck + cp * so * sk, sp * sk - cp * so * ck, cp * co)
        return [height, width, depth]


def project(camera: Camera, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Centred image place (across, up) of a point in the world."""
    height, width, depth = ((a * (x - camera.x) + b * (y - camera.y) + c * (z - camera.z)) for a, b, c in camera.rows())
    return -camera.f * width / depth, camera.f * height / depth


def ray_slopes(camera: Camera, across: Column, up: Column) -> tuple[Column, Column]:
    """(dx/dz, dy/dz) of the ray through a centred image place: both image equations are linear in the offsets, which
    Cramer's rule solves for dz = 1."""
    height, width, depth = camera.rows()
    p = [d * across + camera.f * w for d, w in zip(depth, width, strict=True)]
    q = [d * up - camera.f * h for d, h in zip(depth, height, strict=True)]
    det = p[0] * q[1] - p[1] * q[0]
    return (p[1] * q[2] - p[2] * q[1]) / det, (p[2] * q[0] - p[0] * q[2]) / det


def at_height(camera: Camera, across: Column, up: Column, z: Column) -> tuple[Column, Column]:
    """(x, y) where the ray meets height z."""
    ex, ey = ray_slopes(camera, across, up)
    return ex * (z - camera.z) + camera.x, ey * (z - camera.z) + camera.y


def at_distance(camera: Camera, across: Column, up: Column, distance: Column) -> tuple[Column, Column, Column]:
    """(x, y, z) on the ray at a distance from the camera, downwards; image places are moved by a thousandth off zero."""
    ex, ey = ray_slopes(camera, across + 1e-3, up + 1e-3)
    dz = -distance / F.sqrt(1 + ex * ex + ey * ey)
    return ex * dz + camera.x, ey * dz + camera.y, dz + camera.z


def spherical(radius: Column, theta: Column, phi: Column, radius0: float = 0.0, theta0: float = 0.0, phi0: float = 0.0) -> tuple[Column, Column, Column]:
    """Cartesian coordinates; phi is the elevation over the horizon, all relative to the origin's."""
    r, t, e = radius - radius0, theta - theta0, phi - phi0
    return r * F.cos(e) * F.cos(t), r * F.cos(e) * F.sin(t), r * F.sin(e)


def centre_points(x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """Image points from the middle of the image, up positive."""
    return x - width // 2, height // 2 - y


class StatePlane:
    """Lambert conformal conic of New York, Long Island zone, in US survey feet, on the GRS80 ellipsoid."""

    #: Fixed values of EPSG 2263: semi-major axis, flattening, standard parallels, origin, false easting and northing, metres per foot.
    A, INVERSE_F = 6378137.0, 298.257222101
    LAT1, LAT2, LAT0, LON0 = 40 + 40 / 60, 41 + 2 / 60, 40 + 10 / 60, -74.0
    EAST, NORTH, FOOT = 300000.0, 0.0, 1200 / 3937

    def __init__(self):
        f = 1 / self.INVERSE_F
        self.e = math.sqrt(2 * f - f * f)
        m = [math.cos(math.radians(t)) / math.sqrt(1 - (self.e * math.sin(math.radians(t))) ** 2) for t in (self.LAT1, self.LAT2)]
        t = [self._t(math.radians(x)) for x in (self.LAT1, self.LAT2, self.LAT0)]
        self.n = math.log(m[0] / m[1]) / math.log(t[0] / t[1])
        self.scale = m[0] / (self.n * t[0] ** self.n) * self.A
        self.rho0 = self.scale * t[2] ** self.n

    def _t(self, lat: float) -> float:
        s = self.e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """(x, y) in feet of degrees."""
        phi = F.radians(lat)
        s = self.e * F.sin(phi)
        t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(self.e / 2))
        rho = self.scale * F.pow(t, F.lit(self.n))
        turn = self.n * F.radians(lon - self.LON0)
        return (self.EAST + rho * F.sin(turn)) / self.FOOT, (self.NORTH + self.rho0 - rho * F.cos(turn)) / self.FOOT

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lat, lon) in degrees of feet; five fixed-point rounds for the latitude."""
        dx, dy = x * self.FOOT - self.EAST, self.rho0 - (y * self.FOOT - self.NORTH)
        t = F.pow(F.hypot(dx, dy) / self.scale, F.lit(1 / self.n))
        phi = math.pi / 2 - 2 * F.atan(t)
        for _ in range(5):
            s = self.e * F.sin(phi)
            phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(self.e / 2)))
        return F.degrees(phi), F.degrees(F.atan2(dx, dy) / self.n) + self.LON0
