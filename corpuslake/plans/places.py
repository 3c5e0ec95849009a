"""Queries of areas: containment in concave multipolygons, the project filter with its fallbacks, and its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators import covering, geo
from corpuslake.plans import views as v
from corpuslake.plans.views import query
from corpuslake.sources.readers import table

#: A star with four points and a triangle beside it, around the centre of an area.
_STAR = [(0, 3), (1, 1), (3, 0), (1, -1), (0, -3), (-1, -1), (-3, 0), (-1, 1)]
_SIDE = [(4, 0), (7, 1), (5, 3)]


def areas(spark: SparkSession, d: str) -> DataFrame:
    """(area, shape): a star and a triangle for every nation, spread over the places."""
    k = F.col("n_nationkey")
    x, y = F.lit(-138.0) + k % 5 * 5.2, F.lit(49.0) + F.floor(k / 5) * 2.4
    ring = lambda corners: F.array(*(F.array(x + a * 0.9, y + b * 0.9) for a, b in corners))
    return table(spark, d, "nation").select(F.col("n_name").alias("area"), F.array(F.array(ring(_STAR)), F.array(ring(_SIDE))).alias("shape"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Customers as projects with places, states and tags, some without them."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    lng, lat = v.point(k)
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    return rows.select(
        k.alias("id"), pick("admitted", "staged", "admitted", "refused").alias("gating_state"), F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("sector"),
        F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, "").alias("region"), F.when(k % 7 > 0, lng).alias("lng"), lat,
        F.when(k % 2 == 0, F.lower("n_name")).alias("municipality"), F.lit(None).cast("string").alias("regional_district"), F.lit("").alias("electoral_district"),
    )


_CORNERS = lambda corners: "[" + ", ".join(f"[{a}, {b}]" for a, b in corners) + "]"
#: Corners of all areas, and the places inside them by counted crossings.
_AREAS = f"""c AS (SELECT n_name AS area, part, i, -138.0::DOUBLE + n_nationkey % 5 * 5.2::DOUBLE + corners[i][1] * 0.9::DOUBLE AS x, 49.0::DOUBLE + n_nationkey // 5 * 2.4::DOUBLE + corners[i][2] * 0.9::DOUBLE AS y, len(corners) AS n
            FROM (SELECT *, unnest(range(1, len(corners) + 1)) AS i FROM (SELECT n_name, n_nationkey, unnest([0, 1]) AS part, unnest([{_CORNERS(_STAR)}, {_CORNERS(_SIDE)}]) AS corners FROM nation))),
          e AS (SELECT a.area, a.part, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM c a JOIN c b ON a.area = b.area AND a.part = b.part AND b.i = CASE WHEN a.i = 1 THEN a.n ELSE a.i - 1 END),
          inside AS (SELECT DISTINCT id, area FROM (SELECT id, area, part FROM points JOIN e ON (py > lat) <> (qy > lat) AND lng < (qx - px) * (lat - py) / (qy - py) + px GROUP BY ALL HAVING count(*) % 2 = 1))"""
_PROJECTS = """pr AS (SELECT c_custkey AS id, ['admitted', 'staged', 'admitted', 'refused'][c_custkey % 4 + 1] AS gating_state, c_mktsegment AS sector, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE '' END AS region,
            CASE WHEN c_custkey % 7 > 0 THEN -139.5::DOUBLE + (c_custkey * 7919 % 2600) / 100.0::DOUBLE END AS lng, 47.5::DOUBLE + (c_custkey * 104729 % 1300) / 100.0::DOUBLE AS lat, CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE '' END AS municipality
            FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_MATCH = """m AS (SELECT pr.* FROM pr WHERE {gate} AND CASE WHEN region <> '' THEN contains(lower(region), 'nation_3') OR contains('nation_3', lower(region)) WHEN lng IS NULL THEN true ELSE id IN (SELECT id FROM inside WHERE area = 'NATION_3') END
            AND CASE WHEN municipality <> '' THEN contains(municipality, 'nation_3') OR contains('nation_3', municipality) WHEN lng IS NULL THEN true ELSE id IN (SELECT id FROM inside WHERE area = 'NATION_3') END)"""
_POINTS = "points AS (SELECT id, lng, lat FROM pr WHERE lng IS NOT NULL)"

_PICKED = covering.ProjectFilter(region="NATION_3", layer="municipalities", boundary="NATION_3", sector="BUILDING")
_OF_STAFF = covering.ProjectFilter(staff=True, region="NATION_3")


@query(f"WITH points AS (SELECT s_suppkey AS id, lng, lat FROM (SELECT s_suppkey, -139.5::DOUBLE + (s_suppkey * 7919 % 2600) / 100.0::DOUBLE AS lng, 47.5::DOUBLE + (s_suppkey * 104729 % 1300) / 100.0::DOUBLE AS lat FROM supplier)), {_AREAS} SELECT id, area FROM inside")
def geo_03_concave_areas(spark: SparkSession, d: str) -> DataFrame:
    return covering.contained(v.places(spark, d), areas(spark, d))


@query(f"WITH {_PROJECTS}, {_POINTS}, {_AREAS}, {_MATCH.format(gate='''gating_state = 'admitted' ''')} SELECT id, true AS with_sector FROM m WHERE sector = 'BUILDING' UNION ALL SELECT id, false FROM m")
def flt_05_project_filter(spark: SparkSession, d: str) -> DataFrame:
    rows, shapes = projects(spark, d), areas(spark, d)
    ours = covering.matching_projects(rows, _PICKED, shapes).select("id", F.lit(True).alias("with_sector"))
    return ours.unionByName(covering.matching_projects(rows, _PICKED, shapes, skip_sector=True).select("id", F.lit(False).alias("with_sector")))


@query(f"""WITH {_PROJECTS}, {_POINTS}, {_AREAS}, m AS (SELECT * FROM pr WHERE CASE WHEN region <> '' THEN contains(lower(region), 'nation_3') OR contains('nation_3', lower(region)) WHEN lng IS NULL THEN true ELSE id IN (SELECT id FROM inside WHERE area = 'NATION_3') END)
          SELECT (SELECT count(*) FROM pr WHERE gating_state = 'staged') AS staged, (SELECT count(*) FROM m WHERE lng BETWEEN -132 AND -120 AND lat BETWEEN 49 AND 57) AS in_viewport""")
def agg_21_project_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = projects(spark, d)
    matching = covering.matching_projects(rows, _OF_STAFF, areas(spark, d))
    in_view = rows.filter(geo.in_view(F.col("lng"), F.col("lat"), -132, 49, -120, 57))
    return covering.project_counts(rows, matching, in_view)
