"""Polygons as structs: parts, rings (the outer one first) and vertices; all functions are column expressions.

``geom STRUCT<kind, srid, parts ARRAY<ARRAY<ARRAY<STRUCT<x, y>>>>>``
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double>"
GEOM = f"struct<kind:string,srid:int,parts:array<array<array<{VERTEX}>>>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column, srid: int = 0) -> Column:
    ring = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    return F.struct(F.lit("Polygon").alias("kind"), F.lit(srid).alias("srid"), F.array(F.array(ring)).alias("parts"))


def ring_area(ring: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(ring) - 2)
    step = lambda a, i: a + ring[i]["x"] * ring[i + 1]["y"] - ring[i + 1]["x"] * ring[i]["y"]
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(places, F.lit(0.0), step)) / 2)


def area(geom: Column) -> Column:
    """Outer rings minus holes, over all parts."""
    one = lambda part: F.aggregate(F.transform(part, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.transform(geom["parts"], one), F.lit(0.0), lambda a, x: a + x)


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom["parts"]))


def bbox(geom: Column) -> Column:
    v = vertices(geom)
    of = lambda f, c: f(F.transform(v, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("xmin"), of(F.array_min, "y").alias("ymin"), of(F.array_max, "x").alias("xmax"), of(F.array_max, "y").alias("ymax"))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def segments(geom: Column) -> Column:
    each = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.struct(r[i].alias("a"), r[i + 1].alias("b")))
    return F.flatten(F.transform(F.flatten(geom["parts"]), each))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _within(a: Column, b: Column, p: Column) -> Column:
    return (F.least(a["x"], b["x"]) <= p["x"]) & (p["x"] <= F.greatest(a["x"], b["x"])) & (F.least(a["y"], b["y"]) <= p["y"]) & (p["y"] <= F.greatest(a["y"], b["y"]))


def segments_meet(s: Column, t: Column) -> Column:
    """Crossing, touching and overlapping segments."""
    p, q, u, v = s["a"], s["b"], t["a"], t["b"]
    d1, d2, d3, d4 = _turn(p, q, u), _turn(p, q, v), _turn(u, v, p), _turn(u, v, q)
    cross = (d1 * d2 < 0) & (d3 * d4 < 0)
    touch = ((d1 == 0) & _within(p, q, u)) | ((d2 == 0) & _within(p, q, v)) | ((d3 == 0) & _within(u, v, p)) | ((d4 == 0) & _within(u, v, q))
    return cross | touch


def inside(p: Column, edges: Column) -> Column:
    """Whether a point is in the polygon of these segments, by the parity of crossings over all rings (holes turn it back)."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        at = a["x"] + (p["y"] - a["y"]) * F.coalesce(F.try_divide(b["x"] - a["x"], b["y"] - a["y"]), F.lit(0.0))
        return spans & (p["x"] < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def corners(geom: Column) -> Column:
    """The first vertex of each ring."""
    return F.transform(F.flatten(geom["parts"]), lambda r: r[0])


def shape(geom: Column) -> Column:
    """What ``apart`` reads of a geometry, to be made once for each row: its box, segments and ring corners."""
    return F.struct(bbox(geom).alias("box"), segments(geom).alias("edges"), corners(geom).alias("corners"))


def apart(a: Column, b: Column) -> Column:
    """No common point, of two shapes."""
    edges = F.exists(a["edges"], lambda s: F.exists(b["edges"], lambda t: segments_meet(s, t)))
    holds = F.exists(a["corners"], lambda p: inside(p, b["edges"])) | F.exists(b["corners"], lambda p: inside(p, a["edges"]))
    return ~(boxes_meet(a["box"], b["box"]) & (edges | holds))


def disjoint(a: Column, b: Column) -> Column:
    """No common point. With a missing geometry the answer is false, so a missing geometry neighbours everything."""
    return F.when(a.isNull() | b.isNull(), F.lit(False)).otherwise(apart(shape(a), shape(b)))


def set_crs(geom: Column, srid: int) -> Column:
    """Names the reference system without moving coordinates; another one that is already set is an error."""
    wrong = F.raise_error(F.concat(F.lit("geometry already has srid "), geom["srid"].cast("string"))).cast("int")
    return geom.withField("srid", F.when(geom["srid"].isin(0, srid) | geom["srid"].isNull(), F.lit(srid)).otherwise(wrong))


#: Published constants (fixed values): the WGS 84 and Airy Modified ellipsoids, the Irish Grid, and the shift from
#: WGS 84 to TM65 as three translations in metres.
WGS84 = (6378137.0, 1 / 298.257223563)
AIRY_MODIFIED = (6377340.189, 1 / 299.3249646)
IRISH_GRID = {"lat0": 53.5, "lon0": -8.0, "k": 1.000035, "fe": 200000.0, "fn": 250000.0}
TO_TM65 = (-506.0, 122.0, -611.0)


def _project(lon: Column, lat: Column) -> Column:
    """Longitude and latitude (WGS 84) to the Irish Grid: datum shift, then transverse Mercator."""
    a, f = WGS84
    e2 = f * (2 - f)
    la, lo = F.radians(lat), F.radians(lon)
    n = F.lit(a) / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    x, y, z = n * F.cos(la) * F.cos(lo) + TO_TM65[0], n * F.cos(la) * F.sin(lo) + TO_TM65[1], n * (1 - e2) * F.sin(la) + TO_TM65[2]
    a, f = AIRY_MODIFIED
    e2 = f * (2 - f)
    p = F.sqrt(x * x + y * y)
    # Bowring's formula
    b = a * (1 - f)
    ep = e2 / (1 - e2)
    th = F.atan2(z * a, p * b)
    la = F.atan2(z + ep * b * F.pow(F.sin(th), 3), p - e2 * a * F.pow(F.cos(th), 3))
    lo = F.atan2(y, x)
    g = IRISH_GRID
    nu = F.lit(a) / F.sqrt(1 - e2 * F.pow(F.sin(la), 2))
    t, c = F.pow(F.tan(la), 2), ep * F.pow(F.cos(la), 2)
    w = (lo - math.radians(g["lon0"])) * F.cos(la)

    def arc(at):
        s = F.sin if isinstance(at, Column) else math.sin
        return a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * at - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * s(2 * at) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * s(4 * at) - 35 * e2**3 / 3072 * s(6 * at))

    east = g["fe"] + g["k"] * nu * (w + (1 - t + c) * F.pow(w, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(w, 5) / 120)
    north = g["fn"] + g["k"] * (arc(la) - arc(math.radians(g["lat0"])) + nu * F.tan(la) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(w, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(w, 6) / 720))
    return point(east, north)


def to_crs(geom: Column, srid: int = 29902) -> Column:
    """Moves WGS 84 coordinates to the Irish Grid (EPSG 29902)."""
    if srid != 29902:
        raise ValueError("only 29902 is known")
    moved = F.transform(geom["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: _project(p["x"], p["y"]))))
    return F.when(geom["srid"] == 29902, geom).otherwise(F.struct(geom["kind"].alias("kind"), F.lit(29902).alias("srid"), moved.alias("parts")))
