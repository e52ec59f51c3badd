"""Universal transverse Mercator coordinates as column expressions, by the series in the third flattening."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the ellipsoid WGS 84 and the zones' scale and false origins
SEMI_MAJOR, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
FALSE_EAST, FALSE_NORTH_SOUTH = 500_000.0, 10_000_000.0
N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64) * SCALE
# fixed values: coefficients of N, N^2, N^3 and so on of each term: to the plane, from it, and from conformal to geodetic latitude
_TO = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
_FROM = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
_LATITUDE = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45), (0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315), (0, 0, 56 / 15, -136 / 35, -1262 / 105),
    (0, 0, 0, 4279 / 630, -332 / 35), (0, 0, 0, 0, 4174 / 315),
)


def series(rows: tuple[tuple[float, ...], ...]) -> list[float]:
    """The terms' factors."""
    return [sum(c * N ** (k + 1) for k, c in enumerate(row)) for row in rows]


def _let(use: Callable[[Column], Column], **values: Column) -> Column:
    """use() of a struct of values, each computed once: an expression that stands in several places is computed in each."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), use), F.lit(0))


def _central(zone: Column) -> Column:
    return F.radians(zone * 6 - 183)


def _south(south: Column | bool) -> Column:
    return F.when(F.lit(south) if isinstance(south, bool) else south, FALSE_NORTH_SOUTH).otherwise(0.0)


def to_plane(lon: Column, lat: Column, zone: Column, south: Column | bool = False) -> Column:
    """East x and north y in metres of a place in degrees, in a zone (1 to 60) of the north or the south, as a struct."""
    e = F.lit(ECCENTRICITY)

    def conformal(v: Column) -> Column:
        t = F.sinh(F.atanh(F.sin(v["phi"])) - e * F.atanh(e * F.sin(v["phi"])))
        return _let(sphere, t=t, away=v["away"])

    def sphere(v: Column) -> Column:
        return _let(plane, xi=F.atan2(v["t"], F.cos(v["away"])), eta=F.atanh(F.sin(v["away"]) / F.sqrt(F.lit(1.0) + v["t"] * v["t"])))

    def plane(v: Column) -> Column:
        x, y = v["eta"], v["xi"]
        for k, a in enumerate(series(_TO), 1):
            x = x + F.lit(a) * F.cos(v["xi"] * (2 * k)) * F.sinh(v["eta"] * (2 * k))
            y = y + F.lit(a) * F.sin(v["xi"] * (2 * k)) * F.cosh(v["eta"] * (2 * k))
        return F.struct((F.lit(FALSE_EAST) + F.lit(RADIUS) * x).alias("x"), (F.lit(RADIUS) * y + _south(south)).alias("y"))

    return _let(conformal, phi=F.radians(lat), away=F.radians(lon) - _central(zone))


def to_degrees(x: Column, y: Column, zone: Column, south: Column | bool = False) -> Column:
    """Longitude lon and latitude lat in degrees of a place in a zone, as a struct."""

    def sphere(v: Column) -> Column:
        p, q = v["xi"], v["eta"]
        for k, b in enumerate(series(_FROM), 1):
            p = p - F.lit(b) * F.sin(v["xi"] * (2 * k)) * F.cosh(v["eta"] * (2 * k))
            q = q - F.lit(b) * F.cos(v["xi"] * (2 * k)) * F.sinh(v["eta"] * (2 * k))
        return _let(conformal, p=p, q=q)

    def conformal(v: Column) -> Column:
        return _let(place, chi=F.asin(F.sin(v["p"]) / F.cosh(v["q"])), away=F.atan2(F.sinh(v["q"]), F.cos(v["p"])))

    def place(v: Column) -> Column:
        phi = v["chi"]
        for k, d in enumerate(series(_LATITUDE), 1):
            phi = phi + F.lit(d) * F.sin(v["chi"] * (2 * k))
        return F.struct(F.degrees(_central(zone) + v["away"]).alias("lon"), F.degrees(phi).alias("lat"))

    return _let(sphere, xi=(y - _south(south)) / F.lit(RADIUS), eta=(x - F.lit(FALSE_EAST)) / F.lit(RADIUS))


def change_zone(x: Column, y: Column, old: Column, new: Column, south: Column | bool = False) -> Column:
    """A place of one zone in the coordinates x, y of another one, as a struct."""
    return _let(lambda v: to_plane(v["at"]["lon"], v["at"]["lat"], new, south), at=to_degrees(x, y, old, south))


def densified(ring: Column, step: float) -> Column:
    """A closed ring with points on its edges, so that none is longer than step: straight edges bend when they are moved."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

    def along(e: Column) -> Column:
        dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        n = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / F.lit(float(step))), F.lit(1)).cast("int")
        at = lambda k: F.struct((e["p"]["x"] + dx * k / n).alias("x"), (e["p"]["y"] + dy * k / n).alias("y"))
        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return F.concat(F.flatten(F.transform(pairs, along)), F.slice(ring, -1, 1))


def reprojected(ring: Column, old: Column, new: Column, step: float, south: Column | bool = False) -> Column:
    """A closed ring of one zone in the coordinates of another one, its edges made denser first."""

    return F.transform(densified(ring, step), lambda p: change_zone(p["x"], p["y"], old, new, south))
