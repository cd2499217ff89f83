"""Map geometry as Column arithmetic: affine grids, transverse Mercator, windows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _round(x: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.bround(x).cast("bigint")


@dataclass(frozen=True)
class TransverseMercator:
    """A transverse Mercator projection on an ellipsoid (WGS 84 by default)."""

    central_meridian: float = 33.0
    scale: float = 0.9996
    false_easting: float = 500_000.0
    false_northing: float = 0.0
    semi_major: float = 6_378_137.0
    inverse_flattening: float = 298.257223563

    @classmethod
    def utm(cls, zone: int, south: bool = False) -> TransverseMercator:
        return cls(central_meridian=6.0 * zone - 183.0, false_northing=10_000_000.0 if south else 0.0)

    @property
    def _n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def _radius(self) -> float:
        n = self._n
        return self.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def _alpha(self) -> tuple[float, ...]:
        n = self._n
        return (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )

    def _beta(self) -> tuple[float, ...]:
        n = self._n
        return (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )

    def _delta(self) -> tuple[float, ...]:
        n = self._n
        return (
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630,
        )

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """(x, y) by Krueger's series (millimetres within a zone)."""
        e = 2 * math.sqrt(self._n) / (1 + self._n)
        phi, lam = F.radians(lat), F.radians(lon - self.central_meridian)
        t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
        xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(self._alpha(), start=1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        k = self.scale * self._radius
        return self.false_easting + k * x, self.false_northing + k * y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lat, lon) in degrees."""
        k = self.scale * self._radius
        xi, eta = (y - self.false_northing) / k, (x - self.false_easting) / k
        xi1, eta1 = xi, eta
        for j, b in enumerate(self._beta(), start=1):
            xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        chi = F.asin(F.sin(xi1) / F.cosh(eta1))
        phi = chi
        for j, d in enumerate(self._delta(), start=1):
            phi = phi + d * F.sin(2 * j * chi)
        return F.degrees(phi), self.central_meridian + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))


@dataclass(frozen=True)
class Geographic:
    """Maps whose coordinates are degrees: x is the longitude, y the latitude."""

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        return lon, lat

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return y, x


@dataclass(frozen=True)
class GeoRaster:
    """A raster's place: affine (a b c; d e f) from pixels to the map's coordinates, the
    scale of the resized raster, and the projection."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    width_px: int
    height_px: int
    scale: float = 1.0
    projection: TransverseMercator | Geographic = TransverseMercator()

    @classmethod
    def resized(cls, affine: tuple[float, ...], width: int, height: int, resize_width: int | None, projection: TransverseMercator = TransverseMercator()) -> GeoRaster:
        """The raster scaled to ``resize_width`` pixels (None: as it is)."""
        scale = 1.0 if resize_width is None else resize_width / width
        shown = width if resize_width is None else resize_width
        return cls(*affine, width_px=shown, height_px=height if resize_width is None else max(1, round(height * scale)), scale=scale, projection=projection)

    def pixel_to_projected(self, x: Column, y: Column) -> tuple[Column, Column]:
        x0, y0 = x / self.scale, y / self.scale
        return self.a * x0 + self.b * y0 + self.c, self.d * x0 + self.e * y0 + self.f

    def projected_to_pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        det = self.a * self.e - self.b * self.d
        u, v = x - self.c, y - self.f
        return (self.e * u - self.b * v) / det * self.scale, (self.a * v - self.d * u) / det * self.scale

    def pixel_to_latlon(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.projection.inverse(*self.pixel_to_projected(x, y))

    def latlon_to_pixel(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        return self.projected_to_pixel(*self.projection.forward(lat, lon))


def window_origin(center: Column, size: int | Column) -> Column:
    """First pixel of a window of ``size`` around a centre."""
    size = size if isinstance(size, Column) else F.lit(size)
    return _round(center) - F.floor(size / 2).cast("bigint")


def window_padding(origin: Column, size: Column, length: Column) -> tuple[Column, Column]:
    """Pixels of padding before and after, where a window leaves the raster."""
    zero = F.lit(0).cast("bigint")
    return F.greatest(zero, -origin), F.greatest(zero, origin + size - length)


def fit_long_edge(width: Column, height: Column, limit: int) -> tuple[Column, Column]:
    """Size of a frame whose longer edge may be ``limit``; smaller ones stay."""
    edge = F.greatest(width, height)
    scale = F.lit(float(limit)) / edge
    one = F.lit(1).cast("bigint")
    return tuple(F.when(edge <= limit, side.cast("bigint")).otherwise(F.greatest(one, _round(side * scale))) for side in (width, height))


def letterbox(width: Column, height: Column, box_width: int, box_height: int) -> tuple[Column, Column, Column, Column]:
    """(width, height, x offset, y offset) of an image fitted into a box."""
    scale = F.least(F.lit(float(box_width)) / width, F.lit(float(box_height)) / height)
    one = F.lit(1).cast("bigint")
    w, h = F.greatest(one, _round(width * scale)), F.greatest(one, _round(height * scale))
    return w, h, F.floor((box_width - w) / 2).cast("bigint"), F.floor((box_height - h) / 2).cast("bigint")


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3 x 3 homography (array of 9, by rows)."""
    m = [F.get(h, F.lit(k)) for k in range(9)]
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def project_frame(h: Column, width: Column, height: Column) -> tuple[list[tuple[Column, Column]], tuple[Column, Column]]:
    """(corners, centre) of a frame through a homography."""
    zero, right, low = F.lit(0.0), (width - 1).cast("double"), (height - 1).cast("double")
    corners = [project(h, *p) for p in ((zero, zero), (right, zero), (right, low), (zero, low))]
    return corners, project(h, right * 0.5, low * 0.5)


def near_tile(x: Column, y: Column, tile_size: Column, margin: float = 0.15) -> Column:
    """Whether a projected centre lies in its tile or a margin around it."""
    edge = tile_size.cast("double") * margin
    return x.between(-edge, tile_size + edge) & y.between(-edge, tile_size + edge)
