"""Geometries as columns: STRUCT<kind, rings: ARRAY<ARRAY<STRUCT<x, y>>>>.

kind is point, linestring, polygon or multipolygon; polygon rings are closed, and holes follow from counting crossings. All expressions here are built
in, so they run in generated code. WKT of constants is parsed on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import crs as crs_

TYPE = "struct<kind:string,rings:array<array<struct<x:double,y:double>>>>"


class WKTReadingError(ValueError):
    """A text that isn't well-known text of a kind known here."""


def parse_wkt(text: str) -> tuple[str, list[list[tuple[float, float]]]]:
    """(kind, rings) of POINT, LINESTRING, POLYGON, MULTIPOLYGON."""
    m = re.fullmatch(r"\s*(POINT|LINESTRING|POLYGON|MULTIPOLYGON)\s*(EMPTY|\(.*\))\s*", text or "", re.I | re.S)
    if not m:
        raise WKTReadingError(f"can't read {str(text)[:60]!r}")
    kind, body = m[1].lower(), m[2]
    if body.upper() == "EMPTY":
        return kind, []
    rings = []
    for part in re.findall(r"\(([^()]*)\)", body):
        try:
            rings.append([tuple(map(float, p.split()[:2])) for p in part.split(",")])
        except ValueError as e:
            raise WKTReadingError(f"can't read {part[:60]!r}") from e
    if not rings or any(len(p) != 2 for r in rings for p in r) or body.count("(") != body.count(")"):
        raise WKTReadingError(f"can't read {text[:60]!r}")
    if kind.endswith("polygon"):
        if any(len(r) < 4 or r[0] != r[-1] for r in rings):
            raise WKTReadingError("polygon rings have at least four points and are closed")
    elif kind == "point" and len(rings[0]) != 1 or kind == "linestring" and len(rings[0]) < 2:
        raise WKTReadingError(f"wrong number of points in a {kind}")
    return kind, rings


def to_wkt(kind: str, rings) -> str:
    """WKT of rings; of a multipolygon each ring becomes a polygon, or a hole of the one before it if it turns the other way."""
    if not rings:
        return f"{kind.upper()} EMPTY"
    text = ["(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in rings]
    if kind in ("point", "linestring"):
        return f"{kind.upper()} {text[0]}"
    if kind == "polygon":
        return f"POLYGON ({', '.join(text)})"
    turns = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) > 0 for r in rings]
    parts: list[list[str]] = []
    for t, turn in zip(text, turns):
        if parts and turn != turns[0]:
            parts[-1].append(t)
        else:
            parts.append([t])
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(p) + ")" for p in parts) + ")"


def box_rings(x1, y1, x2, y2):
    return [[(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]]


def literal(kind: str, rings) -> Column:
    """A constant geometry."""
    made = F.array(*(F.array(*(_point(F.lit(float(x)), F.lit(float(y))) for x, y in r)) for r in rings)) if rings else F.array()
    return F.struct(F.lit(kind).alias("kind"), made.alias("rings")).cast(TYPE)


def from_wkt(text: str) -> Column:
    return literal(*parse_wkt(text))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("point").alias("kind"), F.array(F.array(_point(x, y))).alias("rings"))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    ring = F.array(_point(x1, y1), _point(x2, y1), _point(x2, y2), _point(x1, y2), _point(x1, y1))
    return F.struct(F.lit("polygon").alias("kind"), F.array(ring).alias("rings"))


def _all(geom: Column) -> Column:
    return F.flatten(geom["rings"])


def bounds(geom: Column) -> dict[str, Column]:
    xs, ys = F.transform(_all(geom), lambda p: p["x"]), F.transform(_all(geom), lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def _edges(ring: Column) -> Column:
    """(p, q) of consecutive points."""
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def edges(geom: Column) -> Column:
    return F.flatten(F.transform(geom["rings"], _edges))


def _turn(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]


def _twice(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + _turn(e))


def _outer(geom: Column) -> Column:
    """The way the first ring turns: rings that turn the other way are holes."""
    return F.signum(_twice(F.get(geom["rings"], F.lit(0))))


def area(geom: Column) -> Column:
    """First ring and those that turn like it count, holes are taken off; a polygon's later rings are holes whichever way they turn."""
    parts = F.transform(geom["rings"], lambda r, k: F.when((k > 0) & ((geom["kind"] == "polygon") | (F.signum(_twice(r)) != _outer(geom))), -F.abs(_twice(r))).otherwise(F.abs(_twice(r))))
    return F.when(geom["kind"].isin("polygon", "multipolygon"), F.aggregate(parts, F.lit(0.0), lambda s, a: s + a) / 2).otherwise(F.when(geom["kind"].isNotNull(), F.lit(0.0)))


def centroid(geom: Column) -> Column:
    """STRUCT<x, y>: by area of the first ring for polygons (holes and parts weighed in by the way they turn), the mean of the points otherwise."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(edges(geom), zero, lambda s, e: F.struct((s["a"] + _turn(e)).alias("a"), (s["x"] + (e["p"]["x"] + e["q"]["x"]) * _turn(e)).alias("x"), (s["y"] + (e["p"]["y"] + e["q"]["y"]) * _turn(e)).alias("y")))
    points = _all(geom)
    mean = {c: F.try_divide(F.aggregate(F.transform(points, lambda p: p[c]), F.lit(0.0), lambda s, x: s + x), F.size(points)) for c in "xy"}
    weighed = geom["kind"].isin("polygon", "multipolygon") & (total["a"] != 0)
    return F.struct(*(F.when(weighed, F.try_divide(total[c], 3 * total["a"])).otherwise(mean[c]).alias(c) for c in "xy"))


def contains(geom: Column, x: Column, y: Column) -> Column:
    """Is a point inside, by counting crossings: left and lower edges belong to the polygon, right and upper ones don't."""
    crossed = F.filter(edges(geom), lambda e: _crosses(e, y) & (x < _x_at(e, y)))
    return F.size(crossed) % 2 == 1


def _crosses(e: Column, y: Column) -> Column:
    return (e["p"]["y"] > y) != (e["q"]["y"] > y)


def _x_at(e: Column, y: Column) -> Column:
    p, q = e["p"], e["q"]
    return F.when(q["y"] != p["y"], (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])


def transform(geom: Column, source: str, target: str) -> Column:
    """In another projection, point by point."""
    if crs_.same(source, target):
        return geom

    def move(p):
        x, y = crs_.transform_columns(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.when(geom.isNotNull(), F.struct(geom["kind"].alias("kind"), F.transform(geom["rings"], lambda r: F.transform(r, move)).alias("rings")))


def cover(geom: Column, grid, centroid_cell: bool = False) -> Column:
    """ARRAY<STRUCT<i, j0, j1>>: the cells whose centre is inside, as runs along rows, within the grid's window; of a line the cells it passes, of a point the one
    that owns it. With centroid_cell, a polygon without any cell has the cell under its centroid.

    Rows are found by scanning: the crossings of a row's centre line, in order, bound the runs.
    """
    b = bounds(geom)
    clip = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int")
    top, bottom = F.floor((F.lit(grid.y0) - b["maxy"]) / grid.dy), F.ceil((F.lit(grid.y0) - b["miny"]) / grid.dy)
    there = (bottom >= 0) & (top < grid.height) & (b["maxx"] >= grid.x0) & (b["minx"] <= grid.bbox[2])
    lines = edges(geom)

    def runs(i):
        y = F.lit(grid.y0) - (i + F.lit(0.5)) * grid.dy
        xs = F.array_sort(F.transform(F.filter(lines, lambda e: _crosses(e, y)), lambda e: _x_at(e, y)))
        cell = F.transform(xs, lambda x: F.ceil((x - F.lit(grid.x0)) / grid.dx - 0.5))
        odd = F.filter(cell, lambda _, k: k % 2 == 0)
        even = F.filter(cell, lambda _, k: k % 2 == 1)
        return F.zip_with(odd, even, lambda a, z: F.struct(i.cast("int").alias("i"), F.greatest(a, F.lit(0)).cast("int").alias("j0"), F.least(z - 1, F.lit(grid.width - 1)).cast("int").alias("j1")))

    found = F.when(there, F.filter(F.flatten(F.transform(F.sequence(clip(top, grid.height), clip(bottom, grid.height)), runs)), lambda r: r["j0"] <= r["j1"]))
    none = F.array().cast("array<struct<i:int,j0:int,j1:int>>")
    polygons = F.coalesce(found, none)
    own = F.transform(F.array(centroid(geom)), lambda p: _cell(p["x"], p["y"], grid))
    inside = lambda cells: F.filter(cells, lambda r: (r["i"] >= 0) & (r["i"] < grid.height) & (r["j0"] >= 0) & (r["j0"] < grid.width))
    if centroid_cell:
        polygons = F.when(F.size(polygons) > 0, polygons).otherwise(inside(own))
    points = inside(F.array_distinct(F.transform(_all(geom), lambda p: _cell(p["x"], p["y"], grid))))
    passed = inside(F.array_distinct(F.flatten(F.transform(lines, lambda e: _passed(e, grid)))))
    return F.when(geom["kind"] == "point", points).when(geom["kind"] == "linestring", passed).when(geom.isNotNull(), polygons).otherwise(none)


def _cell(x: Column, y: Column, grid) -> Column:
    j = F.floor((x - F.lit(grid.x0)) / grid.dx).cast("int")
    return F.struct(F.floor((F.lit(grid.y0) - y) / grid.dy).cast("int").alias("i"), j.alias("j0"), j.alias("j1"))


def _passed(e: Column, grid) -> Column:
    """Cells of a segment: as many steps as the longer axis has cells, each to the nearest cell."""
    i0, j0, i1, j1 = (F.floor(c) for c in ((F.lit(grid.y0) - e["p"]["y"]) / grid.dy, (e["p"]["x"] - F.lit(grid.x0)) / grid.dx, (F.lit(grid.y0) - e["q"]["y"]) / grid.dy, (e["q"]["x"] - F.lit(grid.x0)) / grid.dx))
    n = F.greatest(F.abs(i1 - i0), F.abs(j1 - j0))

    def at(k):
        j = F.floor(j0 + F.coalesce(F.try_divide((j1 - j0) * k, n), F.lit(0.0)) + 0.5).cast("int")
        return F.struct(F.floor(i0 + F.coalesce(F.try_divide((i1 - i0) * k, n), F.lit(0.0)) + 0.5).cast("int").alias("i"), j.alias("j0"), j.alias("j1"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), n), at)


def clip_to_box(geom: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Rings cut by a box, side by side (Sutherland and Hodgman); points outside and rings without area go, NULL if nothing is left."""

    def cut(ring, inside, meet):
        def both(e):
            a, b = e["p"], e["q"]
            return F.when(inside(b), F.when(inside(a), F.array(b)).otherwise(F.array(meet(a, b), b))).otherwise(F.when(inside(a), F.array(meet(a, b))).otherwise(F.array().cast("array<struct<x:double,y:double>>")))

        found = F.flatten(F.transform(_edges(ring), both))
        return F.when(F.size(found) > 0, F.concat(found, F.slice(found, 1, 1))).otherwise(found)

    def cutter(inside, meet):
        return lambda r: cut(r, inside, meet)

    def at_x(x):
        return lambda a, b: _point(F.lit(x), a["y"] + F.coalesce(F.try_divide((b["y"] - a["y"]) * (F.lit(x) - a["x"]), b["x"] - a["x"]), F.lit(0.0)))

    def at_y(y):
        return lambda a, b: _point(a["x"] + F.coalesce(F.try_divide((b["x"] - a["x"]) * (F.lit(y) - a["y"]), b["y"] - a["y"]), F.lit(0.0)), F.lit(y))

    rings = geom["rings"]
    for inside, meet in ((lambda p: p["x"] >= x1, at_x(x1)), (lambda p: p["x"] <= x2, at_x(x2)), (lambda p: p["y"] >= y1, at_y(y1)), (lambda p: p["y"] <= y2, at_y(y2))):
        rings = F.transform(rings, cutter(inside, meet))
    rings = F.filter(rings, lambda r: _twice(r) != 0)
    p = F.get(F.get(geom["rings"], F.lit(0)), F.lit(0))
    kept = (p["x"] >= x1) & (p["x"] <= x2) & (p["y"] >= y1) & (p["y"] <= y2)
    cut_area = F.when(F.size(rings) > 0, F.struct(geom["kind"].alias("kind"), rings.alias("rings")))
    return F.when(geom["kind"] == "point", F.when(kept, geom)).otherwise(cut_area)


def wkt(geom: Column) -> Column:
    """WKT text of points, lines and polygons (a multipolygon as its rings, each a polygon)."""
    text = F.transform(geom["rings"], lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")")))
    return F.when(geom["kind"].isin("point", "linestring"), F.concat(F.upper(geom["kind"]), F.lit(" "), F.get(text, F.lit(0)))).when(geom["kind"] == "polygon", F.concat(F.lit("POLYGON ("), F.array_join(text, ", "), F.lit(")"))).when(
        geom["kind"].isNotNull(), F.concat(F.lit("MULTIPOLYGON (("), F.array_join(text, "), ("), F.lit("))"))
    )
