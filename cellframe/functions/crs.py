"""Coordinate systems in closed form: longitude and latitude (EPSG:4326, 4258), web mercator (3857), UTM zones on WGS 84 (32601 to 32660, 32701 to
32760) and ETRS89 (25828 to 25838), Europe's equal-area grid (3035), France's conic grid (2154) and the Dutch grid (28992). Others raise.

ETRS89 is taken to equal WGS 84, as is usual without a date. Transformations exist twice: on numbers for the driver and on columns for plans.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

R = 6378137.0
LIMIT = 85.0511287798066


class TransformException(Exception):
    """A coordinate can't be transformed."""


def normalise(crs: str) -> str:
    """'EPSG:<n>' in upper case; raises for what isn't known."""
    if not isinstance(crs, str):
        raise TypeError(f"a projection is a string, not {type(crs).__name__}")
    if m := re.fullmatch(r"\s*epsg:(\d+)\s*", crs, re.I):
        code = f"EPSG:{int(m[1])}"
    elif m := re.search(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]\s*\]\s*$', crs):
        code = f"EPSG:{m[1]}"
    elif "+" in crs:
        code = _of_proj(crs)
    else:
        raise ValueError(f"unknown projection: {crs[:80]}")
    if code not in TO_WGS:
        raise ValueError(f"projection {code} is not supported")
    return code


def _of_proj(text: str) -> str:
    """The code of a PROJ string of parameters: init, longitude and latitude, or UTM, on WGS 84 or GRS 80."""
    given = dict(re.findall(r"\+(\w+)(?:=(\S+))?", text.lower()))
    known = {"proj", "zone", "south", "datum", "ellps", "towgs84", "units", "no_defs", "type", "wktext"}
    figure = given.get("datum") or given.get("ellps") or "wgs84"
    shifted = any(float(v) for v in re.findall(r"[-.\d]+", given.get("towgs84", "")))
    if m := re.fullmatch(r"epsg:(\d+)", given.get("init", "")):
        return f"EPSG:{int(m[1])}"
    if given.keys() <= known and not shifted and given.get("units", "m") == "m" and figure in ("wgs84", "grs80"):
        kind, zone = given.get("proj"), given.get("zone", "")
        if kind in ("longlat", "latlong"):
            return "EPSG:4326" if figure == "wgs84" else "EPSG:4258"
        if kind == "utm" and zone.isdigit() and figure == "wgs84":
            return f"EPSG:{(32700 if 'south' in given else 32600) + int(zone)}"
        if kind == "utm" and zone.isdigit() and "south" not in given:
            return f"EPSG:{25800 + int(zone)}"
    raise ValueError(f"unknown projection: {text[:80]}")


def same(a: str, b: str) -> bool:
    return a.strip().upper() == b.strip().upper() or normalise(a) == normalise(b)


class _Numbers:
    sin, cos, tan, atan, atan2, exp, log, sqrt = math.sin, math.cos, math.tan, math.atan, math.atan2, math.exp, math.log, math.sqrt
    sinh, cosh, atanh, asinh = math.sinh, math.cosh, math.atanh, math.asinh

    @staticmethod
    def asin(x):
        return math.asin(x)

    @staticmethod
    def through(steps, x, y):
        for step in steps:
            x, y = step(_Numbers, x, y)
        return x, y


class _Columns:
    sin, cos, tan, atan, atan2, exp, log, sqrt, asin = F.sin, F.cos, F.tan, F.atan, F.atan2, F.exp, F.log, F.sqrt, F.asin
    sinh, cosh, atanh, asinh = F.sinh, F.cosh, F.atanh, F.asinh

    @staticmethod
    def through(steps, x, y):
        """One or two steps are plain expressions. More are a chain of lambdas, each of which names the pair that it gets: written out, a step's many uses of its input would multiply."""
        if len(steps) < 3:
            for step in steps:
                x, y = step(_Columns, x, y)
            return x, y
        chain = F.array(_pair(x, y))
        for step in steps:
            chain = F.transform(chain, lambda p: _pair(*step(_Columns, p["x"], p["y"])))  # noqa: B023 (called at once)
        return chain[0]["x"], chain[0]["y"]


def _pair(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def _mercator_to(m, x, y):
    return x * (180 / math.pi / R), (m.atan(m.exp(y / R)) * 2 - math.pi / 2) * (180 / math.pi)


def _mercator_from(m, lon, lat):
    return lon * (math.pi / 180 * R), m.log(m.tan(lat * (math.pi / 360) + math.pi / 4)) * R


# Fixed values of the Dutch grid: the polynomial approximation between it and WGS 84 around Amersfoort, good to under a metre.
RD_X0, RD_Y0, RD_LAT0, RD_LON0 = 155000.0, 463000.0, 52.15517440, 5.38720621
RD_LAT = ((0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.2475), (2, 1, -0.84978), (0, 3, -0.0655), (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.0053), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012))
RD_LON = ((1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594), (3, 1, -0.05607), (0, 1, 0.01199), (3, 2, -0.00256), (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026))
RD_X = ((0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.34), (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148))
RD_Y = ((1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054))


def _power(v, n):
    out = None
    for _ in range(n):
        out = v if out is None else out * v
    return 1.0 if out is None else out


def _poly(terms, a, b):
    out = 0.0
    for p, q, k in terms:
        out = _power(a, p) * _power(b, q) * k + out
    return out


def _rd_to(m, x, y):
    a, b = (x - RD_X0) * 1e-5, (y - RD_Y0) * 1e-5
    return _poly(RD_LON, a, b) / 3600 + RD_LON0, _poly(RD_LAT, a, b) / 3600 + RD_LAT0


def _rd_from(m, lon, lat):
    a, b = (lat - RD_LAT0) * 0.36, (lon - RD_LON0) * 0.36
    return _poly(RD_X, a, b) + RD_X0, _poly(RD_Y, a, b) + RD_Y0


DEG = math.pi / 180
#: Semi-major axis and flattening.
WGS84 = (6378137.0, 1 / 298.257223563)
GRS80 = (6378137.0, 1 / 298.257222101)


def _conformal(m, lat, e):
    """The tangent of the conformal latitude."""
    tau = m.tan(lat)
    sec = m.sqrt(tau * tau + 1)
    sigma = m.sinh(m.atanh(tau / sec * e) * e)
    return tau * m.sqrt(sigma * sigma + 1) - sigma * sec


def _geodetic(m, chi, n):
    """The latitude of a conformal latitude, by a series in the third flattening."""
    terms = (2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4)
    return sum((m.sin(chi * (2 * j)) * k for j, k in enumerate(terms, 1)), chi)


class TransverseMercator:
    """By Krüger's series to the fourth power of the third flattening: below a millimetre within some thousand kilometres of the meridian."""

    def __init__(self, ellipsoid, lon0, lat0, scale, east, north):
        a, f = ellipsoid
        n = self.n = f / (2 - f)
        self.e, self.lon0, self.east = math.sqrt(f * (2 - f)), lon0, east
        self.size = scale * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.out = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
        self.back = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4)
        self.north = 0.0
        self.from_wgs, self.to_wgs = [self._sphere, self._up, self._place], [self._plane, self._down, self._angles]
        self.north = north - _Numbers.through(self.from_wgs, lon0, lat0)[1]

    @staticmethod
    def _series(m, xi, eta, terms, sign):
        up = sum((m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * (sign * k) for j, k in enumerate(terms, 1)), xi)
        right = sum((m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * (sign * k) for j, k in enumerate(terms, 1)), eta)
        return up, right

    def _sphere(self, m, lon, lat):
        # the difference of longitudes enters by sine and cosine only, so the date line needs no care
        return (lon - self.lon0) * DEG, _conformal(m, lat * DEG, self.e)

    def _up(self, m, away, t):
        c = m.cos(away)
        return m.atan2(t, c), m.asinh(m.sin(away) / m.sqrt(t * t + c * c))

    def _place(self, m, xi, eta):
        up, right = self._series(m, xi, eta, self.out, 1)
        return right * self.size + self.east, up * self.size + self.north

    def _plane(self, m, x, y):
        return (y - self.north) / self.size, (x - self.east) / self.size

    def _down(self, m, xi, eta):
        return self._series(m, xi, eta, self.back, -1)

    def _angles(self, m, up, right):
        s, c = m.sinh(right), m.cos(up)
        return m.atan2(s, c) / DEG + self.lon0, _geodetic(m, m.atan(m.sin(up) / m.sqrt(s * s + c * c)), self.n) / DEG


class EqualArea:
    """Lambert's azimuthal equal-area projection, oblique."""

    def __init__(self, ellipsoid, lon0, lat0, east, north):
        a, f = ellipsoid
        self.e2, self.lon0, self.east, self.north = f * (2 - f), lon0, east, north
        self.pole = self._q(_Numbers, 1.0)
        self.radius = a * math.sqrt(self.pole / 2)
        sin0 = math.sin(lat0 * DEG)
        self.beta0 = math.asin(self._q(_Numbers, sin0) / self.pole)
        self.from_wgs, self.to_wgs = [self._sphere, self._place], [self._plane, self._turned, self._angles]
        self.stretch = a * math.cos(lat0 * DEG) / math.sqrt(1 - self.e2 * sin0**2) / (self.radius * math.cos(self.beta0))

    def _q(self, m, sine):
        e = math.sqrt(self.e2)
        return (sine / (1 - sine * sine * self.e2) + m.atanh(sine * e) / e) * (1 - self.e2)

    def _sphere(self, m, lon, lat):
        return (lon - self.lon0) * DEG, m.asin(self._q(m, m.sin(lat * DEG)) / self.pole)

    def _place(self, m, away, beta):
        s0, c0 = math.sin(self.beta0), math.cos(self.beta0)
        s, c, ca = m.sin(beta), m.cos(beta), m.cos(away)
        b = m.sqrt(2 / (s * s0 + c * ca * c0 + 1)) * self.radius
        return b * c * m.sin(away) * self.stretch + self.east, b * (s * c0 - c * ca * s0) / self.stretch + self.north

    def _plane(self, m, x, y):
        return (x - self.east) / self.stretch, (y - self.north) * self.stretch

    def _turned(self, m, dx, dy):
        # a micrometre is added, so that the centre divides by no zero
        rho = m.sqrt(dx * dx + dy * dy + 1e-12)
        c = m.asin(rho / (2 * self.radius)) * 2
        s0, c0, sc, cc = math.sin(self.beta0), math.cos(self.beta0), m.sin(c), m.cos(c)
        return m.atan2(dx * sc, rho * cc * c0 - dy * sc * s0) / DEG + self.lon0, m.asin(cc * s0 + dy * sc * c0 / rho)

    def _angles(self, m, lon, beta):
        e2 = self.e2
        terms = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
        return lon, sum((m.sin(beta * (2 * j)) * k for j, k in enumerate(terms, 1)), beta) / DEG


class Conic:
    """Lambert's conformal conic projection with two standard parallels."""

    def __init__(self, ellipsoid, lon0, lat0, lat1, lat2, east, north):
        a, f = ellipsoid
        self.e, self.n3, self.lon0, self.east = math.sqrt(f * (2 - f)), f / (2 - f), lon0, east
        self.from_wgs, self.to_wgs = [self._cone, self._place], [self._plane, self._turned, self._angles]
        widths = [math.cos(v * DEG) / math.sqrt(1 - (self.e * math.sin(v * DEG)) ** 2) for v in (lat1, lat2)]
        heights = [self._height(_Numbers, v) for v in (lat1, lat2)]
        self.cone = math.log(widths[0] / widths[1]) / (heights[1] - heights[0])
        self.size = a * widths[0] / self.cone * math.exp(self.cone * heights[0])
        self.top = north + self.size * math.exp(-self.cone * self._height(_Numbers, lat0))

    def _height(self, m, lat):
        """The isometric latitude."""
        return m.asinh(_conformal(m, lat * DEG, self.e))

    def _cone(self, m, lon, lat):
        return m.exp(self._height(m, lat) * -self.cone) * self.size, (lon - self.lon0) * (DEG * self.cone)

    def _place(self, m, r, turn):
        return r * m.sin(turn) + self.east, r * m.cos(turn) * -1 + self.top

    def _plane(self, m, x, y):
        return x - self.east, (y - self.top) * -1

    def _turned(self, m, dx, dy):
        height = m.log(m.sqrt(dx * dx + dy * dy) / self.size) / -self.cone
        return m.atan2(dx, dy) / (DEG * self.cone) + self.lon0, m.atan(m.sinh(height))

    def _angles(self, m, lon, chi):
        return lon, _geodetic(m, chi, self.n3) / DEG


def _utm(ellipsoid, zone, south=False):
    return TransverseMercator(ellipsoid, 6 * zone - 183, 0, 0.9996, 500_000, 10_000_000 if south else 0)


# Fixed values of the grids that are not zones.
GRIDS = {
    "EPSG:3035": EqualArea(GRS80, 10, 52, 4_321_000, 3_210_000),
    "EPSG:2154": Conic(GRS80, 3, 46.5, 49, 44, 700_000, 6_600_000),
}
GRIDS |= {f"EPSG:{32600 + z}": _utm(WGS84, z) for z in range(1, 61)}
GRIDS |= {f"EPSG:{32700 + z}": _utm(WGS84, z, True) for z in range(1, 61)}
GRIDS |= {f"EPSG:{25800 + z}": _utm(GRS80, z) for z in range(28, 39)}

#: Steps from x, y to longitude and latitude, and back.
TO_WGS = {"EPSG:4326": [], "EPSG:4258": [], "EPSG:3857": [_mercator_to], "EPSG:28992": [_rd_to]} | {k: g.to_wgs for k, g in GRIDS.items()}
FROM_WGS = {"EPSG:4326": [], "EPSG:4258": [], "EPSG:3857": [_mercator_from], "EPSG:28992": [_rd_from]} | {k: g.from_wgs for k, g in GRIDS.items()}


def _transform(m, x, y, source: str, target: str):
    if same(source, target):
        return x, y
    return m.through(TO_WGS[normalise(source)] + FROM_WGS[normalise(target)], x, y)


def transform_point(x: float, y: float, source: str, target: str) -> tuple[float, float]:
    try:
        found = _transform(_Numbers, x, y, source, target)
    except (ValueError, OverflowError, ZeroDivisionError) as e:
        if isinstance(e, ValueError) and "projection" in str(e):
            raise
        raise TransformException(f"({x}, {y}) from {source} to {target}") from e
    if not all(map(math.isfinite, found)):
        raise TransformException(f"({x}, {y}) from {source} to {target}")
    return found


def transform_columns(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    return _transform(_Columns, x, y, source, target)


def is_geographic(crs: str) -> bool:
    return normalise(crs) in ("EPSG:4326", "EPSG:4258")


def transform_length(size: float, bbox, source: str, target: str) -> float:
    """A length at a box in another projection: the geometric mean of how the sides scale."""
    if same(source, target):
        return size
    x, y = (bbox[0] + bbox[2]) / 2, (bbox[1] + bbox[3]) / 2
    h = size / 2
    (ax, ay), (bx, by) = transform_point(x - h, y - h, source, target), transform_point(x + h, y + h, source, target)
    return math.sqrt(abs((bx - ax) * (by - ay)))
