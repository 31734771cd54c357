"""Geometry as plain structs and column expressions: distances, containment, boxes and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres.
EARTH_M = 6371008.8
#: WGS 84 ellipsoid.
WGS84_A, WGS84_E2 = 6378137.0, 0.0066943799901413165

POINT = "struct<lng:double,lat:double>"
#: parts: kind line or polygon; rings of one part belong together; coords in order.
GEOMETRY = f"struct<type:string,parts:array<struct<kind:string,part:int,ring:int,coords:array<{POINT}>>>>"


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Metres between two points on the mean sphere."""
    a = F.sin(F.radians(lat2 - lat1) / 2) * F.sin(F.radians(lat2 - lat1) / 2) + F.sin(F.radians(lng2 - lng1) / 2) * F.sin(
        F.radians(lng2 - lng1) / 2
    ) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def degrees_between(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Planar distance in degrees."""
    return F.sqrt((lng1 - lng2) * (lng1 - lng2) + (lat1 - lat2) * (lat1 - lat2))


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres of a degree of longitude and of latitude on the ellipsoid."""
    s = F.sin(F.radians(lat))
    w = F.sqrt(1 - F.lit(WGS84_E2) * s * s)
    east = F.lit(WGS84_A * math.pi / 180) * F.cos(F.radians(lat)) / w
    north = F.lit(WGS84_A * (1 - WGS84_E2) * math.pi / 180) / (w * w * w)
    return east, north


def coords_of(geometry: Column) -> Column:
    """All points of a geometry; null for a null geometry."""
    return F.flatten(F.transform(geometry["parts"], lambda p: p.coords))


def bounding_box(geometry: Column) -> Column:
    """struct<x0, y0, x1, y1>, null where there is no point."""
    c = coords_of(geometry)
    x, y = F.transform(c, lambda p: p.lng), F.transform(c, lambda p: p.lat)
    box = F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))
    return F.when(F.size(c) > 0, box)


def center(geometry: Column) -> Column:
    """Centre of the bounding box as a point."""
    b = bounding_box(geometry)
    return F.when(b.isNotNull(), F.struct(((b.x0 + b.x1) / 2).alias("lng"), ((b.y0 + b.y1) / 2).alias("lat")))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ring_distance2(px: Column, py: Column, coords: Column, sx: Column, sy: Column) -> Column:
    """Squared distance of a point to the line through coords, with axes scaled by sx and sy.

    Lambdas share no common parts, so what is used several times is a field of a struct.
    """
    moved = F.transform(coords, lambda c: F.struct(((c.lng - px) * sx).alias("x"), ((c.lat - py) * sy).alias("y")))

    def nearest(m: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            b = F.get(m, i + 1)  # none after the last, which is a step of no length
            return F.struct(a.x.alias("x"), a.y.alias("y"), F.coalesce(b.x - a.x, F.lit(0.0)).alias("dx"), F.coalesce(b.y - a.y, F.lit(0.0)).alias("dy"))

        def foot(s: Column) -> Column:
            along = _let(s.dx * s.dx + s.dy * s.dy, lambda d2: F.when(d2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(s.x * s.dx + s.y * s.dy) / d2))).otherwise(F.lit(0.0)))
            return _let(along, lambda t: F.struct((s.x + t * s.dx).alias("x"), (s.y + t * s.dy).alias("y")))

        return F.array_min(F.transform(F.transform(F.transform(m, step), foot), lambda p: p.x * p.x + p.y * p.y))

    return _let(moved, nearest)


def _crossings(px: Column, py: Column, coords: Column) -> Column:
    """Edges of a ring that a ray to the east crosses."""

    def crosses(i: Column) -> Column:
        a, b = F.get(coords, i), F.get(coords, i + 1)
        spans = (a.lat > py) != (b.lat > py)
        x = a.lng + (py - a.lat) / F.when(b.lat != a.lat, b.lat - a.lat) * (b.lng - a.lng)
        return F.when(spans & (px < x), F.lit(1)).otherwise(F.lit(0))

    n = F.aggregate(F.transform(F.sequence(F.lit(0), F.size(coords) - 2), crosses), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(coords) > 1, n).otherwise(F.lit(0))


def contains(geometry: Column, px: Column, py: Column) -> Column:
    """Whether a polygon part holds the point: an odd number of crossings over the part's rings."""
    polygons = F.filter(geometry["parts"], lambda p: p.kind == "polygon")
    parts = F.array_distinct(F.transform(polygons, lambda p: p.part))

    def odd(k: Column) -> Column:
        rings = F.filter(polygons, lambda p: p.part == k)
        n = F.aggregate(F.transform(rings, lambda r: _crossings(px, py, r.coords)), F.lit(0), lambda s, x: s + x)
        return n % 2 == 1

    return F.exists(parts, odd)


def distance(geometry: Column, px: Column, py: Column, sx: Column | None = None, sy: Column | None = None) -> Column:
    """Distance of a point to a geometry, zero inside a polygon; in degrees, or in the units of the scales."""
    sx, sy = (F.lit(1.0) if s is None else s for s in (sx, sy))
    nearest = F.sqrt(F.array_min(F.transform(geometry["parts"], lambda p: _ring_distance2(px, py, p.coords, sx, sy))))
    solid = F.exists(geometry["parts"], lambda p: p.kind == "polygon")  # only a polygon has an inside to look into
    return F.when(solid & contains(geometry, px, py), F.lit(0.0)).otherwise(nearest)


def distance_m(geometry: Column, lng: Column, lat: Column) -> Column:
    """Metres from a point to a geometry on a plane that touches the ellipsoid at the point's latitude."""
    return distance(geometry, lng, lat, *metres_per_degree(lat))


def as_box(geometry: Column) -> Column:
    """struct<x0, y0, x1, y1> of a geometry that is its bounding box: a line along an axis, or a rectangle along both; null for any other."""
    b, part = bounding_box(geometry), geometry["parts"][0]
    c = part.coords
    same = lambda axis, i, j: c[i][axis] == c[j][axis]
    turns = lambda p, q: same(p, 0, 1) & same(q, 1, 2) & same(p, 2, 3) & same(q, 3, 0)
    rectangle = (F.size(c) == 5) & same("lng", 0, 4) & same("lat", 0, 4) & (turns("lng", "lat") | turns("lat", "lng"))
    filled = F.when(part.kind == "line", (b.x0 == b.x1) | (b.y0 == b.y1)).otherwise(rectangle)
    return F.when((F.size(geometry["parts"]) == 1) & filled, b)


def box_distance(box: Column, px: Column, py: Column, sx: Column | None = None, sy: Column | None = None) -> Column:
    """Distance of a point to a box, as distance() has it for a geometry that is one."""
    sx, sy = (F.lit(1.0) if s is None else s for s in (sx, sy))
    x, y = F.greatest(box.x0 - px, px - box.x1, F.lit(0.0)) * sx, F.greatest(box.y0 - py, py - box.y1, F.lit(0.0)) * sy
    return F.sqrt(x * x + y * y)


def line(coords: Column) -> Column:
    """A line through an array of points; fewer than two points give a point."""
    part = F.struct(F.lit("line").alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("ring"), coords.alias("coords"))
    kind = F.when(F.size(coords) > 1, F.lit("LineString")).otherwise(F.lit("Point"))
    return F.struct(kind.alias("type"), F.array(part).alias("parts"))


def polygon(coords: Column) -> Column:
    """A polygon of one closed ring."""
    part = F.struct(F.lit("polygon").alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("ring"), coords.alias("coords"))
    return F.struct(F.lit("Polygon").alias("type"), F.array(part).alias("parts"))


def geojson_geometry(g: Column) -> Column:
    """A GeoJSON geometry given as JSON text, as GEOMETRY; null for types other than lines, polygons and points."""
    kind = F.get_json_object(g, "$.type")
    raw = F.get_json_object(g, "$.coordinates")
    pairs = lambda c: F.transform(c, lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat")))

    def part(name: str, coords: Column, k: Column, ring: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), k.cast("int").alias("part"), ring.cast("int").alias("ring"), pairs(coords).alias("coords"))

    zero = F.lit(0)
    one, two = F.from_json(raw, "array<array<double>>"), F.from_json(raw, "array<array<array<double>>>")
    three, single = F.from_json(raw, "array<array<array<array<double>>>>"), F.from_json(raw, "array<double>")
    parts = (
        F.when(kind == "Point", F.array(part("line", F.array(single), zero, zero)))
        .when(kind.isin("LineString", "MultiPoint"), F.array(part("line", one, zero, zero)))
        .when(kind == "MultiLineString", F.transform(two, lambda c, k: part("line", c, k, zero)))
        .when(kind == "Polygon", F.transform(two, lambda c, k: part("polygon", c, zero, k)))
        .when(kind == "MultiPolygon", F.flatten(F.transform(three, lambda p, k: F.transform(p, lambda c, r: part("polygon", c, k, r)))))
    )
    return F.when(parts.isNotNull(), F.struct(kind.alias("type"), parts.alias("parts")))
