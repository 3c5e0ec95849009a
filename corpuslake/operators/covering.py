"""Points in polygons of any shape by a covering of grid cells, and the project filter that falls back on it (GEO-03, FLT-05, AGG-21).

A polygon's outer ring is laid over a grid. Cells that an edge passes are border cells, cells between
crossings that no edge passes are inner ones. Points meet cells by equality: in an inner cell they are inside, in a border cell they are
tested against the ring, and nowhere else. The covering is made by joins and aggregations over edges, whatever the number of polygons or vertices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.geo import in_ring

#: How much wider than an edge its cells are taken, in cells, for what doubles round off.
_WIDER = 1e-9


def polygons_of(areas: DataFrame, area: str = "area", shape: str = "shape") -> DataFrame:
    """(area, part, ring): the outer rings of multipolygons (arrays of polygons, which are arrays of rings). Holes are ignored."""
    parts = areas.select(F.col(area).alias("area"), F.posexplode(shape).alias("part", "polygon"))
    return parts.select("area", "part", F.get("polygon", F.lit(0)).alias("ring")).filter(F.size("ring") >= 3)


def _edges(parts: DataFrame, cell: float) -> DataFrame:
    """(area, part, ax, ay, bx, by) in units of a cell, from left to right; a ring closes itself."""
    n = F.size("ring")
    to = lambda i: F.col("ring")[F.when(i == n - 1, 0).otherwise(i + 1)]
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.col("ring")[i].alias("p"), to(i).alias("q")))
    rows = parts.select("area", "part", F.explode(sides).alias("e")).select("area", "part", "e.p", "e.q")
    turned = F.col("p")[0] > F.col("q")[0]
    first, second = F.when(turned, F.col("q")).otherwise(F.col("p")), F.when(turned, F.col("p")).otherwise(F.col("q"))
    return rows.select("area", "part", *(v[i].cast("double").__truediv__(cell).alias(f"{name}{axis}") for name, v in (("a", first), ("b", second)) for i, axis in ((0, "x"), (1, "y"))))


def _whole(value: Column) -> Column:
    return F.floor(value).cast("int")


def covering(parts: DataFrame, cell: float) -> DataFrame:
    """(area, part, cx, cy, border) of the polygons' cells."""
    edges = _edges(parts, cell)
    columns = edges.withColumn("cx", F.explode(F.sequence(_whole(F.col("ax") - _WIDER), _whole(F.col("bx") + _WIDER))))
    at = lambda x: F.when(F.col("bx") > F.col("ax"), F.col("ay") + (x - F.col("ax")) / (F.col("bx") - F.col("ax")) * (F.col("by") - F.col("ay")))
    left, right = F.greatest("ax", F.col("cx").cast("double")), F.least("bx", F.col("cx") + F.lit(1.0))
    low, high = F.coalesce(F.least(at(left), at(right)), F.least("ay", "by")), F.coalesce(F.greatest(at(left), at(right)), F.greatest("ay", "by"))
    rows = F.explode(F.sequence(_whole(low - _WIDER * (1 + F.abs(low))), _whole(high + _WIDER * (1 + F.abs(high)))))
    border = columns.withColumn("cy", rows).select("area", "part", "cx", "cy").distinct()

    spanned = F.sequence(_whole(F.least("ay", "by")), _whole(F.greatest("ay", "by")))
    crossed = edges.withColumn("cy", F.explode(spanned)).withColumn("y", F.col("cy") + F.lit(0.5)).filter((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y")))
    x = F.col("ax") + (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    row = Window.partitionBy("area", "part", "cy").orderBy("x")
    pairs = crossed.select("area", "part", "cy", x.alias("x")).withColumns({"k": F.row_number().over(row), "to": F.lead("x").over(row)}).filter("k % 2 = 1")
    inner = pairs.select("area", "part", F.explode(F.sequence(_whole(F.col("x")), _whole(F.col("to")))).alias("cx"), "cy").distinct()
    inner = inner.join(border, ["area", "part", "cx", "cy"], "left_anti")
    return border.withColumn("border", F.lit(True)).unionByName(inner.withColumn("border", F.lit(False)))


def contained(points: DataFrame, areas: DataFrame, cell: float = 0.25, key: str = "id", lng: str = "lng", lat: str = "lat") -> DataFrame:
    """(key, area) of points in areas (area, shape: a multipolygon), each pair once. Points without a coordinate are in none."""
    parts = polygons_of(areas)
    cells = covering(parts, cell)
    p = points.select(key, F.col(lng).cast("double").alias("lng"), F.col(lat).cast("double").alias("lat")).filter("lng IS NOT NULL AND lat IS NOT NULL")
    p = p.withColumns({"cx": _whole(F.col("lng") / cell), "cy": _whole(F.col("lat") / cell)})
    met = p.join(cells, ["cx", "cy"])
    sure = met.filter("NOT border").select(key, "area")
    tested = met.filter("border").join(parts, ["area", "part"]).filter(in_ring(F.col("lng"), F.col("lat"), F.col("ring"))).select(key, "area")
    return sure.unionByName(tested).distinct()


@dataclass(frozen=True)
class ProjectFilter:
    """What a caller picked; "all" is no filter. ``region`` and ``boundary`` name areas, whose shapes are looked up by these names."""

    staff: bool = False
    gating: str = "all"
    sector: str = "all"
    region: str = "all"
    layer: str = "none"
    boundary: str = "all"


# The tag of a project that names its area in a layer of boundaries.
TAGS = {"regionalDistricts": "regional_district", "municipalities": "municipality", "electoralDistricts": "electoral_district"}


def _by_tag_or_place(rows: DataFrame, tag: Column, name: str, shapes: DataFrame, key: str, cell: float) -> DataFrame:
    """Rows whose tag and the name contain one another, whatever their case. Where the tag is empty the place decides, if there are a shape of that name and a coordinate; else the row stays."""
    wanted = F.lit(name.lower())
    value = F.lower(F.coalesce(tag, F.lit("")))
    tagged = F.contains(value, wanted) | F.contains(wanted, value)
    shape = shapes.filter(F.col("area") == name)
    known = rows.filter(value != "").filter(tagged)
    rest = rows.filter(value == "")
    placed = F.col("lng").isNotNull() & F.col("lat").isNotNull()
    inside = contained(rest.filter(placed), shape, cell, key).select(key)
    drawn = shape.select(F.lit(True).alias("__drawn")).limit(1)
    open_ = rest.filter(~placed).unionByName(rest.filter(placed).join(drawn, F.lit(True), "left_anti"))
    return known.unionByName(open_).unionByName(rest.filter(placed).join(inside, key, "left_semi"))


def matching_projects(projects: DataFrame, f: ProjectFilter, shapes: DataFrame, skip_sector: bool = False, key: str = "id", cell: float = 0.25) -> DataFrame:
    """Projects (id, gating_state, sector, region, lng, lat and the tags) that pass; ``shapes`` are (area, shape). ``skip_sector``: by all filters but that one, for counts beside its options."""
    rows = projects if f.staff else projects.filter(F.coalesce(F.col("gating_state") == "admitted", F.lit(False)))
    if f.gating != "all":
        rows = rows.filter(F.coalesce(F.col("gating_state") == f.gating, F.lit(False)))
    if f.sector != "all" and not skip_sector:
        rows = rows.filter(F.trim(F.coalesce("sector", F.lit(""))) == f.sector)
    if f.region != "all":
        rows = _by_tag_or_place(rows, F.col("region"), f.region, shapes, key, cell)
    if f.boundary not in ("all", "") and f.layer != "none":
        tag = F.col(TAGS[f.layer]) if f.layer in TAGS else F.lit("")
        rows = _by_tag_or_place(rows, tag, f.boundary, shapes, key, cell)
    return rows


def project_counts(projects: DataFrame, matching: DataFrame, in_view: DataFrame, key: str = "id") -> DataFrame:
    """One row: staged projects of all, and matching ones in the viewport (``in_view`` has their keys)."""
    staged = projects.agg(F.count_if(F.coalesce(F.col("gating_state") == "staged", F.lit(False))).alias("staged"))
    seen = matching.join(in_view.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("in_viewport"))
    return staged.join(seen, F.lit(True))  # one row each
