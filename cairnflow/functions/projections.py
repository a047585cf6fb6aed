"""Map projections as columns: closed formulas (Snyder, Map Projections - A Working Manual, USGS PP 1395, 1987).

Longitude and latitude in degrees, x and y in metres. Each projection gives ``forward(lon, lat)`` and ``inverse(x, y)``
as pairs of columns, which stay inside generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the WGS 84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
_E2 = WGS84_F * (2 - WGS84_F)
_E = math.sqrt(_E2)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)


def _t(phi: float) -> float:
    s = _E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


def _t_column(phi: Column) -> Column:
    s = F.lit(_E) * F.sin(phi)
    return F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _latitude_of_t(t: Column) -> Column:
    """Conformal latitude back to latitude, by its series."""
    chi = F.lit(math.pi / 2) - 2 * F.atan(t)
    e2, e4, e6, e8 = _E2, _E2**2, _E2**3, _E2**4
    return (
        chi
        + (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * chi)
        + (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * chi)
        + (7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * chi)
        + (4279 * e8 / 161280) * F.sin(8 * chi)
    )


@dataclass(frozen=True)
class LonLat:
    """No projection."""

    name: str = "lonlat"

    def forward(self, lon, lat) -> tuple[Column, Column]:
        return _c(lon), _c(lat)

    inverse = forward


@dataclass(frozen=True)
class WebMercator:
    name: str = "web_mercator"

    def forward(self, lon, lat) -> tuple[Column, Column]:
        return F.radians(_c(lon)) * WGS84_A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2)) * WGS84_A

    def inverse(self, x, y) -> tuple[Column, Column]:
        return F.degrees(_c(x) / WGS84_A), F.degrees(2 * F.atan(F.exp(_c(y) / WGS84_A)) - math.pi / 2)


@dataclass(frozen=True)
class LambertConic:
    """Conformal, two standard parallels; ``spherical`` takes a sphere of the ellipsoid's long radius."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    x0: float = 0.0
    y0: float = 0.0
    spherical: bool = False
    name: str = "lambert_conic"

    def _constants(self) -> tuple[float, float, float]:
        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        if self.spherical:
            tan = lambda p: math.tan(math.pi / 4 + p / 2)
            n = math.sin(p1) if p1 == p2 else math.log(math.cos(p1) / math.cos(p2)) / math.log(tan(p2) / tan(p1))
            f = math.cos(p1) * tan(p1) ** n / n
            return n, f, f / tan(p0) ** n
        n = math.sin(p1) if p1 == p2 else math.log(_m(p1) / _m(p2)) / math.log(_t(p1) / _t(p2))
        f = _m(p1) / (n * _t(p1) ** n)
        return n, f, f * _t(p0) ** n

    def forward(self, lon, lat) -> tuple[Column, Column]:
        n, f, rho0 = self._constants()
        phi, theta = F.radians(_c(lat)), F.lit(n) * F.radians(_c(lon) - self.lon0)
        rho = F.lit(f) / F.pow(F.tan(F.lit(math.pi / 4) + phi / 2), F.lit(n)) if self.spherical else F.lit(f) * F.pow(_t_column(phi), F.lit(n))
        return self.x0 + WGS84_A * rho * F.sin(theta), self.y0 + WGS84_A * (rho0 - rho * F.cos(theta))

    def inverse(self, x, y) -> tuple[Column, Column]:
        n, f, rho0 = self._constants()
        dx, dy = (_c(x) - self.x0) / WGS84_A, rho0 - (_c(y) - self.y0) / WGS84_A
        sign = 1.0 if n > 0 else -1.0
        rho, theta = sign * F.sqrt(dx * dx + dy * dy), F.atan2(sign * dx, sign * dy)
        if self.spherical:
            phi = 2 * F.atan(F.pow(F.lit(f) / rho, F.lit(1 / n))) - math.pi / 2
        else:
            phi = _latitude_of_t(F.pow(rho / f, F.lit(1 / n)))
        return F.degrees(theta / n) + self.lon0, F.degrees(phi)


@dataclass(frozen=True)
class Albers:
    """Equal-area conic, two standard parallels."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    x0: float = 0.0
    y0: float = 0.0
    name: str = "albers"

    def _constants(self) -> tuple[float, float, float]:
        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        n = math.sin(p1) if p1 == p2 else (_m(p1) ** 2 - _m(p2) ** 2) / (_q(p2) - _q(p1))
        c = _m(p1) ** 2 + n * _q(p1)
        return n, c, math.sqrt(c - n * _q(p0)) / n

    def forward(self, lon, lat) -> tuple[Column, Column]:
        n, c, rho0 = self._constants()
        s = F.sin(F.radians(_c(lat)))
        q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
        rho, theta = F.sqrt(F.lit(c) - n * q) / n, F.lit(n) * F.radians(_c(lon) - self.lon0)
        return self.x0 + WGS84_A * rho * F.sin(theta), self.y0 + WGS84_A * (rho0 - rho * F.cos(theta))

    def inverse(self, x, y) -> tuple[Column, Column]:
        n, c, rho0 = self._constants()
        dx, dy = (_c(x) - self.x0) / WGS84_A, rho0 - (_c(y) - self.y0) / WGS84_A
        rho, theta = F.sqrt(dx * dx + dy * dy), F.atan2(dx, dy) if n > 0 else F.atan2(-dx, -dy)
        beta = F.asin((F.lit(c) - rho * rho * n * n) / n / _q(math.pi / 2))
        e2, e4, e6 = _E2, _E2**2, _E2**3
        phi = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta)
        return F.degrees(theta / n) + self.lon0, F.degrees(phi)


@dataclass(frozen=True)
class TransverseMercator:
    """With the usual scale and false origin of a zone; ``utm`` gives one."""

    lon0: float
    k0: float = 0.9996
    x0: float = 500000.0
    y0: float = 0.0
    name: str = "transverse_mercator"

    @staticmethod
    def utm(zone: int, south: bool = False) -> TransverseMercator:
        return TransverseMercator(lon0=6.0 * zone - 183, y0=1e7 if south else 0.0)

    @staticmethod
    def _arc(phi: Column) -> Column:
        e2, e4, e6 = _E2, _E2**2, _E2**3
        return WGS84_A * (
            (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
            - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
            + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
            - (35 * e6 / 3072) * F.sin(6 * phi)
        )

    def forward(self, lon, lat) -> tuple[Column, Column]:
        phi, ep2 = F.radians(_c(lat)), _E2 / (1 - _E2)
        sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
        n = WGS84_A / F.sqrt(1 - _E2 * sin * sin)
        t, c, a = tan * tan, ep2 * cos * cos, cos * F.radians(_c(lon) - self.lon0)
        x = n * (a + (1 - t + c) * F.pow(a, F.lit(3)) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, F.lit(5)) / 120)
        y = self._arc(phi) + n * tan * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, F.lit(4)) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, F.lit(6)) / 720)
        return self.x0 + self.k0 * x, self.y0 + self.k0 * y

    def inverse(self, x, y) -> tuple[Column, Column]:
        ep2 = _E2 / (1 - _E2)
        e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
        mu = (_c(y) - self.y0) / self.k0 / (WGS84_A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
        p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
        sin, cos, tan = F.sin(p), F.cos(p), F.tan(p)
        n = WGS84_A / F.sqrt(1 - _E2 * sin * sin)
        r = WGS84_A * (1 - _E2) / F.pow(1 - _E2 * sin * sin, F.lit(1.5))
        t, c, d = tan * tan, ep2 * cos * cos, (_c(x) - self.x0) / (n * self.k0)
        lat = p - (n * tan / r) * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, F.lit(4)) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, F.lit(6)) / 720)
        lon = (d - (1 + 2 * t + c) * F.pow(d, F.lit(3)) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, F.lit(5)) / 120) / cos
        return F.degrees(lon) + self.lon0, F.degrees(lat)


Projection = LonLat | WebMercator | LambertConic | Albers | TransverseMercator


def transform(x, y, source: Projection, target: Projection) -> tuple[Column, Column]:
    """From one projection to another, through longitude and latitude; nothing is computed if they are equal."""
    if source == target:
        return _c(x), _c(y)
    lon, lat = source.inverse(x, y)
    return target.forward(lon, lat)
