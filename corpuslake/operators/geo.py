"""Coordinates, distances and containment (GEO-*, JON-05, JON-06)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The province's padded bounding box, the earth's radius in km.
BOX = {"lng": (-139.5, -113.5), "lat": (47.5, 60.5)}
RADIUS = 6371.0


def in_box(lng: Column, lat: Column) -> Column:
    return lng.between(*BOX["lng"]) & lat.between(*BOX["lat"])


def in_view(lng: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a point lies in a viewport, edges included; no point lies in none."""
    return F.coalesce(lng.between(west, east) & lat.between(south, north), F.lit(False))


def repaired(lng: Column, lat: Column) -> Column:
    """A point within the box, with a lost sign put back; null where that doesn't help."""
    x, y = lng.try_cast("double"), lat.try_cast("double")
    x = F.when((x > 0) & in_box(-x, y), -x).otherwise(x)
    return F.when(in_box(x, y), F.struct(x.alias("lng"), y.alias("lat")))


def pick_centroid(first: Column, second: Column) -> Column:
    return F.coalesce(first, second)


def centroid(lng: Column, lat: Column, other: Column) -> Column:
    """The point of the first source, two texts, if it is valid or can be repaired; else that of the second, a pair of coordinates; else null."""
    pair = F.when(F.size(other) == 2, repaired(F.get(other, F.lit(0)), F.get(other, F.lit(1))))
    return pick_centroid(repaired(F.nullif(F.trim(lng), F.lit("")), F.nullif(F.trim(lat), F.lit(""))), pair)


def parse_centroid(a: Column, b: Column, default: tuple[float, float] = (-125.0, 54.0)) -> Column:
    """A pair in either order and with either sign; a default where it isn't in the box."""
    x, y = a.try_cast("double"), b.try_cast("double")
    options = [repaired(x, y), repaired(y, x)]
    return F.coalesce(*options, F.struct(F.lit(default[0]).alias("lng"), F.lit(default[1]).alias("lat")))


def point_or_default(coordinates: Column, default: tuple[float, float] = (-125.0, 54.0)) -> Column:
    """(lng, lat) of a pair of coordinates as it is stored; the default for anything but two finite numbers."""
    x, y = F.get(coordinates, F.lit(0)).try_cast("double"), F.get(coordinates, F.lit(1)).try_cast("double")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.coalesce(F.size(coordinates) == 2, F.lit(False)) & finite(x) & finite(y)
    return F.when(good, F.array(x, y)).otherwise(F.array(*map(F.lit, default)))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * RADIUS) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def near(places: DataFrame, fires: DataFrame, radius: float = 50.0) -> DataFrame:
    """For each place (id, lat, lng): fires within the radius, the least distance, fires of note.

    Fires and places of one point are one row with its counts. Each point of fires is put into all grid cells that
    its radius may reach, so that the join is on the cell and no pair beyond neighbouring cells is made.
    """
    step_lat = radius / 111.0
    step_lng = radius / (111.32 * 0.48)  # a degree of longitude at the box's northern edge, rounded down
    cell = lambda v, step: F.floor(v / step).cast("int")
    p = places.select("lat", "lng").distinct().select("lat", "lng", cell(F.col("lat"), step_lat).alias("r"), cell(F.col("lng"), step_lng).alias("c"))
    live = fires.filter((F.col("status") != "Out") & ((F.col("lat") != 0) | (F.col("lng") != 0)))
    f = live.groupBy(F.col("lat").alias("flat"), F.col("lng").alias("flng")).agg(F.count("*").alias("n"), F.count_if(F.col("of_note")).alias("noted"))
    around = lambda v, step: F.explode(F.sequence(cell(v, step) - 1, cell(v, step) + 1))
    f = f.withColumn("r", around(F.col("flat"), step_lat)).withColumn("c", around(F.col("flng"), step_lng))
    km = haversine(F.col("lat"), F.col("lng"), F.col("flat"), F.col("flng"))
    hits = p.join(f, ["r", "c"]).withColumn("km", km).filter(F.col("km") <= radius)
    at = hits.groupBy("lat", "lng").agg(F.sum("n").alias("fires"), F.min("km").alias("km"), F.sum("noted").alias("of_note"))
    found = places.select("id", "lat", "lng").join(at, ["lat", "lng"]).groupBy("id").agg(F.sum("fires").alias("fires"), F.round(F.min("km"), 1).alias("nearest_km"), F.sum("of_note").alias("of_note"))
    zero = F.lit(0).cast("long")
    return places.select("id").join(found, "id", "left").select("id", F.coalesce("fires", zero).alias("fires"), "nearest_km", F.coalesce("of_note", zero).alias("of_note"))


def in_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """Ray casting against one ring of (lng, lat) pairs."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(ring[i].alias("p"), ring[F.when(i == 0, n - 1).otherwise(i - 1)].alias("q")))

    def crosses(e: Column) -> Column:
        (px, py), (qx, qy) = (e["p"][0], e["p"][1]), (e["q"][0], e["q"][1])
        return ((py > lat) != (qy > lat)) & (lng < (qx - px) * (lat - py) / F.when(qy != py, qy - py) + px)

    return F.coalesce(F.when(n >= 3, F.size(F.filter(edges, crosses)) % 2 == 1), F.lit(False))


def in_polygon(lng: Column, lat: Column, polygon: Column) -> Column:
    """The outer ring alone decides; holes are ignored."""
    return in_ring(lng, lat, F.get(polygon, F.lit(0)))


def in_multi_polygon(lng: Column, lat: Column, polygons: Column) -> Column:
    return F.coalesce(F.exists(polygons, lambda p: in_polygon(lng, lat, p)), F.lit(False))


def within(places: DataFrame, areas: DataFrame, cell: float = 1.0) -> DataFrame:
    """(id, area) of places in areas (area, ring), joined on the grid cells that an area's box covers."""
    x, y = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    span = lambda v: F.explode(F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell)))
    a = areas.select("area", "ring", span(x).alias("cx"), y.alias("__y")).withColumn("cy", span(F.col("__y"))).drop("__y")
    p = places.withColumns({"cx": F.floor(F.col("lng") / cell), "cy": F.floor(F.col("lat") / cell)})
    return p.join(a, ["cx", "cy"]).filter(in_ring(F.col("lng"), F.col("lat"), F.col("ring"))).select("id", "area")


def thin_ring(ring: Column, step: int) -> Column:
    """Every step-th vertex, closed, neighbours that repeat dropped; null under four vertices."""
    kept = F.filter(ring, lambda p, i: i % step == 0)
    kept = F.filter(kept, lambda p, i: (i == 0) | (p != F.get(kept, i - 1)))
    closed = F.when(F.element_at(kept, -1) != kept[0], F.concat(kept, F.array(kept[0]))).otherwise(kept)
    return F.when(F.size(closed) >= 4, closed)


def _simplified(points: list, tolerance: float) -> list:
    """Ramer-Douglas-Peucker with an explicit stack."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        dx, dy = bx - ax, by - ay
        worst, at = 0.0, None
        for i in range(a + 1, b):
            px, py = points[i][0] - ax, points[i][1] - ay
            t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            d = (px - t * dx) ** 2 + (py - t * dy) ** 2
            if d > worst:
                worst, at = d, i
        if at is not None and worst > tolerance * tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def simplify(tolerance: float = 0.005, digits: int = 4):
    """A UDF: a ring simplified, rounded and closed."""

    @F.pandas_udf("array<array<double>>")
    def run(rings: pd.Series) -> pd.Series:
        out = []
        for ring in rings:
            points = [tuple(map(float, p)) for p in ring] if ring is not None else []
            if len(points) > 2:
                points = [(round(x, digits), round(y, digits)) for x, y in _simplified(points, tolerance)]
                if points[0] != points[-1]:
                    points.append(points[0])
            out.append([list(p) for p in points])
        return pd.Series(out, dtype=object)

    return run
