"""Coverings against ray casting of all pairs; the project filter's fallbacks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import covering, geo


def ring(draw, x, y, corners):
    """A star-like ring, concave where radii alternate."""
    turn = draw.random()
    made = [[x + draw.uniform(0.3, 3) * math.cos(turn + 2 * math.pi * i / corners), y + draw.uniform(0.3, 3) * math.sin(turn + 2 * math.pi * i / corners)] for i in range(corners)]
    return [*made, made[0]] if draw.random() < 0.5 else made


def inside(px, py, corners):
    hit = False
    for (ax, ay), (bx, by) in zip(corners, [corners[-1], *corners[:-1]], strict=True):
        if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
            hit = not hit
    return hit


@pytest.mark.parametrize("cell", [0.2, 1.0, 7.0])
def test_containment_equals_ray_casting_of_all_pairs(spark, cell):
    draw = random.Random(int(cell * 10))
    shapes = {f"a{i}": [[ring(draw, draw.uniform(-6, 6), draw.uniform(-6, 6), draw.randrange(3, 14)), ring(draw, 0, 0, 4)] for _ in range(draw.randrange(1, 4))] for i in range(12)}
    shapes["square"] = [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]]]
    points = [(i, draw.uniform(-9, 9), draw.uniform(-9, 9)) for i in range(400)] + [(1000 + 10 * a + b, a / 2, b / 2) for a in range(-2, 6) for b in range(-2, 6)] + [(9999, None, 1.0)]
    want = {(i, a) for i, x, y in points if x is not None for a, parts in shapes.items() if any(inside(x, y, p[0]) for p in parts)}
    p = spark.createDataFrame(points, "id long, lng double, lat double")
    areas = spark.createDataFrame([*shapes.items(), ("none", []), ("line", [[[[0.0, 0.0], [1.0, 1.0]]]])], "area string, shape array<array<array<array<double>>>>")
    got = [tuple(r) for r in covering.contained(p, areas, cell).collect()]
    assert sorted(got) == sorted(want) and len(want) > 50


def test_only_border_cells_are_tested(spark):
    """Inner cells are those that no edge passes and that lie within; a fine grid has most of an area in them."""
    big = [[0.05, 0.05], [9.95, 0.05], [9.95, 9.95], [5.0, 5.0], [0.05, 9.95]]
    parts = spark.createDataFrame([("a", 0, big)], "area string, part int, ring array<array<double>>")
    cells = covering.covering(parts, 0.5).toPandas()
    assert not cells.duplicated(["cx", "cy"]).any()
    inner = cells[~cells.border]
    assert len(inner) > 150 and all(inside((x + a) * 0.5, (y + b) * 0.5, big) for x, y in zip(inner.cx, inner.cy, strict=True) for a in (0.01, 0.5, 0.99) for b in (0.01, 0.5, 0.99))
    assert len(cells) < 400 and len(cells[cells.border]) < 130


PROJECTS = "id int, gating_state string, sector string, region string, lng double, lat double, municipality string, regional_district string, electoral_district string"


def test_filters_fall_back_from_tags_to_places(spark):
    square = [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]]]
    shapes = spark.createDataFrame([("North", square), ("Old Town", square)], "area string, shape array<array<array<array<double>>>>")
    rows = [
        (1, "admitted", " Mines ", "the north coast", None, None, None, None, None), (2, "admitted", "Mines", "", 1.0, 1.0, "", None, None), (3, "admitted", "Mines", None, 5.0, 1.0, None, None, None),
        (4, "admitted", "Water", None, None, 1.0, "old town district", None, None), (5, "staged", "Mines", "NORTH", 1.0, 1.0, "old", None, None), (6, None, None, "south", 1.0, 1.0, "x", None, None),
    ]
    p = spark.createDataFrame(rows, PROJECTS)
    pick = lambda skip=False, **f: sorted(r["id"] for r in covering.matching_projects(p, covering.ProjectFilter(**f), shapes, skip).collect())
    assert pick() == [1, 2, 3, 4] and pick(staff=True) == [1, 2, 3, 4, 5, 6] and pick(staff=True, gating="staged") == [5]
    assert pick(sector="Mines") == [1, 2, 3] and pick(skip=True, sector="Mines") == [1, 2, 3, 4]
    assert pick(region="North") == [1, 2, 4]  # a project without tag and place stays
    assert pick(region="nowhere", staff=True) == [2, 3, 4]  # without a shape nothing is told by places
    assert pick(layer="municipalities", boundary="Old Town", staff=True) == [1, 2, 4, 5]
    assert pick(layer="none", boundary="Old Town") == [1, 2, 3, 4] and pick(layer="other", boundary="Old Town") == [1, 2, 4]
    counts = covering.project_counts(p, covering.matching_projects(p, covering.ProjectFilter(), shapes), p.filter(geo.in_view(F.col("lng"), F.col("lat"), 0, 0, 3, 3)))
    assert tuple(counts.first()) == (1, 1)
