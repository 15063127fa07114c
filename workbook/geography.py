"""Zone joins, origin-destination lookups and polygon work on shapes derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareframe.operators import geo, joins, zones
from workbook import views as V
from workbook.registry import query, rounded


@query(
    "q_zone_roles",
    f"""WITH {V.LABELLED_SQL} SELECT PU_Borough, DO_Borough, PU_service_zone, count(*) AS n,
    round(avg(commission), 6) AS mean FROM labelled GROUP BY 1, 2, 3""",
)
def roles(spark, sf):
    df = joins.join_zone_roles(V.trips(spark, sf), V.zones(spark, sf))
    out = df.groupBy("PU_Borough", "DO_Borough", "PU_service_zone").agg(
        F.count(F.lit(1)).alias("n"), F.avg("commission").alias("mean")
    )
    return rounded(out, ["mean"])


@query(
    "q_membership_flag",
    f"WITH {V.LABELLED_SQL} SELECT PU_in_cbd, DO_in_cbd, count(*) AS n FROM labelled GROUP BY 1, 2",
)
def membership(spark, sf):
    members = V.cbd_zones(spark, sf)
    df = joins.flag_membership(V.trips(spark, sf), "PULocationID", members, "LocationID", "PU_in_cbd")
    df = joins.flag_in_list(df, "DOLocationID", [0, 4, 8, 12, 16, 20, 24], "DO_in_cbd")
    return df.groupBy("PU_in_cbd", "DO_in_cbd").agg(F.count(F.lit(1)).alias("n"))


LABEL_KEYS = ["trip_cbd_type", "is_cross_borough", "involves_manhattan", "involves_airport"]


@query(
    "q_trip_labels",
    f"WITH {V.LABELLED_SQL} SELECT {', '.join(LABEL_KEYS)}, count(*) AS n, round(avg(y_cpm), 6) AS cpm FROM labelled GROUP BY 1, 2, 3, 4",
)
def labels(spark, sf):
    out = V.labelled_trips(spark, sf).groupBy(*LABEL_KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("y_cpm").alias("cpm"))
    return rounded(out, ["cpm"])


OD_SQL = f"""{V.ZONES_SQL}, od AS (
  SELECT p.LocationID AS PULocationID, d.LocationID AS DOLocationID, p.Borough AS PU_Borough, d.Borough AS DO_Borough,
         p.Zone AS PU_Zone, d.Zone AS DO_Zone, p.service_zone AS PU_service_zone, d.service_zone AS DO_service_zone,
         p.in_cbd AS PU_in_cbd, d.in_cbd AS DO_in_cbd,
         CASE WHEN p.in_cbd = 1 AND d.in_cbd = 1 THEN 'intra_cbd' WHEN p.in_cbd = 1 THEN 'outbound_cbd'
              WHEN d.in_cbd = 1 THEN 'inbound_cbd' ELSE 'non_cbd' END AS trip_cbd_type,
         p.Borough <> d.Borough AS is_cross_borough, p.Borough = 'ASIA' OR d.Borough = 'ASIA' AS involves_manhattan,
         p.LocationID IN (1, 13, 18) OR d.LocationID IN (1, 13, 18) AS involves_airport
  FROM zones p, zones d)"""


def _od(spark, sf):
    return zones.build_od_features(V.zones(spark, sf), V.cbd_zones(spark, sf), airports=V.AIRPORTS, borough=V.BOROUGH)


@query(
    "q_od_pairs",
    f"""WITH {V.RAW_SQL}, {OD_SQL}, n AS (SELECT PULocationID, DOLocationID, count(*) AS n FROM raw GROUP BY 1, 2)
    SELECT PULocationID, DOLocationID, coalesce(n, 0) AS n FROM od LEFT JOIN n USING (PULocationID, DOLocationID)""",
)
def pairs(spark, sf):
    counts = V.raw_trips(spark, sf).groupBy("PULocationID", "DOLocationID").agg(F.count(F.lit(1)).alias("n"))
    df = joins.dim_left_profile(zones.od_pairs(V.zones(spark, sf)), counts, ["PULocationID", "DOLocationID"])
    return df.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


@query(
    "q_od_features",
    f"""WITH {V.RAW_SQL}, {OD_SQL}, n AS (SELECT PULocationID, DOLocationID, count(*) AS n FROM raw GROUP BY 1, 2)
    SELECT od.*, n.n FROM od LEFT JOIN n USING (PULocationID, DOLocationID)""",
)
def od_features(spark, sf):
    counts = V.raw_trips(spark, sf).groupBy("PULocationID", "DOLocationID").agg(F.count(F.lit(1)).alias("n"))
    return joins.dim_left_profile(_od(spark, sf), counts, ["PULocationID", "DOLocationID"])


@query(
    "q_join_od",
    f"""WITH {V.TRIPS_SQL}, {OD_SQL} SELECT trip_cbd_type, involves_airport, PU_Borough, count(*) AS n,
    round(avg(commission), 6) AS mean FROM trips LEFT JOIN od USING (PULocationID, DOLocationID) GROUP BY 1, 2, 3""",
)
def join_od(spark, sf):
    df = joins.join_od(V.trips(spark, sf), _od(spark, sf))
    out = df.groupBy("trip_cbd_type", "involves_airport", "PU_Borough").agg(
        F.count(F.lit(1)).alias("n"), F.avg("commission").alias("mean")
    )
    return rounded(out, ["mean"])


@query(
    "q_enrich",
    f"""WITH {V.WEATHER_TRIPS_SQL}, {V.ZONES_SQL} SELECT p.Borough AS PU_Borough, t.season, count(*) AS n,
    round(avg(commission), 6) AS mean FROM wtrips t LEFT JOIN zones p ON PULocationID = p.LocationID GROUP BY 1, 2""",
)
def enrich(spark, sf):
    df, _ = joins.enrich(
        V.trips(spark, sf), zones=V.zones(spark, sf), weather=V.daily_weather(spark, sf), holidays=V.holidays(spark)
    )
    out = df.groupBy("PU_Borough", "season").agg(F.count(F.lit(1)).alias("n"), F.avg("commission").alias("mean"))
    return rounded(out, ["mean"])


@query(
    "q_flag_count_by_group",
    """SELECT c_nationkey AS LocationID, count(*) AS n FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders)
    ON o_custkey = c_custkey GROUP BY 1""",
)
def flag_counts(spark, sf):
    active = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    people = V.table(spark, sf, "customer").withColumnRenamed("c_nationkey", "LocationID")
    return zones.flag_count_by_group(people, active, "c_custkey", "LocationID")


@query(
    "q_flag_share_by_group",
    """SELECT c_mktsegment, count(*) AS total, count(o) AS flagged, round(count(o) / count(*) * 100, 1) AS pct
    FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_totalprice > 300000) ON o = c_custkey GROUP BY 1""",
)
def flag_share(spark, sf):
    rich = V.table(spark, sf, "orders").where("o_totalprice > 300000")
    people = joins.flag_membership(V.table(spark, sf, "customer"), "c_custkey", rich, "o_custkey", "rich")
    return zones.flag_share_by_group(people, "c_mktsegment", "rich")


@query(
    "q_zones_with_flags",
    f"""WITH {V.ZONES_SQL} SELECT s_suppkey, Borough, Zone, service_zone, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END AS in_cbd
    FROM supplier JOIN zones ON s_nationkey = LocationID""",
)
def with_flags(spark, sf):
    s = V.table(spark, sf, "supplier")
    named = s.join(V.zones(spark, sf), F.col("s_nationkey") == F.col("LocationID")).drop("in_cbd")
    mapping = s.where("s_acctbal > 5000").select("s_suppkey", F.lit(1).alias("in_cbd"))
    names = named.select("s_suppkey", "Borough", "Zone", "service_zone")
    return zones.zones_with_flags(s.select("s_suppkey"), names, mapping, "s_suppkey")


@query(
    "q_dim_left_profile",
    """SELECT c_custkey, c_nationkey, n, spent FROM customer LEFT JOIN (
      SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS spent FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
    ON c_custkey = o_custkey""",
)
def left_profile(spark, sf):
    large = V.table(spark, sf, "orders").where("o_totalprice > 400000")
    profile = large.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("spent")
    )
    dim = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return joins.dim_left_profile(dim, rounded(profile, ["spent"]), "c_custkey")


# Each supplier is an L-shaped polygon on a 10-wide lattice; every nation is a triangle on the same plane.
L_SHAPE = [(0, 0), (8, 0), (8, 3), (4, 3), (4, 7), (0, 7)]


def _supplier_shapes(spark, sf):
    s = V.table(spark, sf, "supplier")
    x0 = (F.col("s_suppkey") % 20 * 10).cast("double")
    y0 = (F.floor(F.col("s_suppkey") / 20) * 10).cast("double")
    ring = F.array(*[F.struct((x0 + x).alias("x"), (y0 + y).alias("y")) for x, y in L_SHAPE])
    return s.select(F.col("s_suppkey").alias("LocationID"), ring.alias("ring"))


def _nation_shapes(spark, sf):
    n = V.table(spark, sf, "nation")
    x0, y0 = F.col("n_nationkey") % 5 * 40, F.floor(F.col("n_nationkey") / 5) * 40
    corners = [(3, 2), (3, 32), (33, 17)]
    ring = F.array(
        *[F.struct((x0 + x).cast("double").alias("x"), (y0 + y).cast("double").alias("y")) for x, y in corners]
    )
    return n.select(F.col("n_nationkey").alias("region_id"), ring.alias("ring"))


@query(
    "q_points_in_polygons",
    """WITH p AS (SELECT o_orderkey, (o_custkey * 7 % 20011) / 100 AS x, (o_orderkey * 13 % 20021) / 100 AS y FROM orders),
    s AS (SELECT s_suppkey, s_suppkey % 20 * 10 AS x0, floor(s_suppkey / 20) * 10 AS y0 FROM supplier)
    SELECT o_orderkey, s_suppkey AS LocationID FROM p JOIN s
      ON x >= x0 AND y >= y0 AND (x < x0 + 8 AND y < y0 + 3 OR x < x0 + 4 AND y < y0 + 7)""",
)
def points(spark, sf):
    p = V.table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") * 7 % 20011 / 100).alias("x"),
        (F.col("o_orderkey") * 13 % 20021 / 100).alias("y"),
    )
    hits = geo.points_in_polygons(p, _supplier_shapes(spark, sf), "LocationID", cell=10)
    return hits.select("o_orderkey", "LocationID")


# The height of a triangle's overlap with a rectangle is piecewise linear in x, so the oracle sums exact
# trapezoids between all its breakpoints, for each of the two rectangles that make up an L.
OVERLAP_SQL = """WITH l AS (SELECT s_suppkey, (s_suppkey % 20 * 10)::DOUBLE AS x0, (floor(s_suppkey / 20) * 10)::DOUBLE AS y0 FROM supplier),
rect AS (SELECT s_suppkey, x0 AS a, x0 + 8 AS b, y0 AS lo, y0 + 3 AS hi FROM l
         UNION ALL SELECT s_suppkey, x0, x0 + 4, y0 + 3, y0 + 7 FROM l),
tri AS (SELECT (n_nationkey % 5 * 40 + 3)::DOUBLE AS tx, (n_nationkey // 5 * 40 + 2)::DOUBLE AS ty FROM nation),
hit AS (SELECT *, greatest(a, tx) AS x0, least(b, tx + 30) AS x1 FROM rect JOIN tri ON a < tx + 30 AND b > tx AND lo < ty + 30 AND hi > ty),
pts AS (SELECT *, list_sort([greatest(x0, least(x1, v)) FOR v IN
    [x0, x1, tx + 2 * (lo - ty), tx + 2 * (hi - ty), tx + 2 * (ty + 30 - lo), tx + 2 * (ty + 30 - hi)]]) AS xs FROM hit),
fx AS (SELECT s_suppkey, xs, [greatest(0, least(ty + 30 - (v - tx) / 2, hi) - greatest(ty + (v - tx) / 2, lo)) FOR v IN xs] AS f FROM pts),
area AS (SELECT s_suppkey, sum(list_sum([(xs[i + 1] - xs[i]) * (f[i] + f[i + 1]) / 2 FOR i IN range(1, 6)])) AS v FROM fx GROUP BY 1)
SELECT s_suppkey AS LocationID, 40.0::DOUBLE AS area, round(coalesce(v, 0), 6) AS overlap_area,
       round(coalesce(v, 0) / 40, 6) AS overlap_ratio, CASE WHEN coalesce(v, 0) / 40 > 0.25 THEN 1 ELSE 0 END AS in_cbd
FROM supplier LEFT JOIN area USING (s_suppkey)"""


@query("q_zone_overlap", OVERLAP_SQL)
def overlap(spark, sf):
    df = geo.zone_overlap(_supplier_shapes(spark, sf), _nation_shapes(spark, sf), cell=10)
    return rounded(geo.overlap_flag(df, 0.25), ["area", "overlap_area", "overlap_ratio"])


SHIFTED = """shifted AS (SELECT s_suppkey, (s_suppkey % 20 * 10)::DOUBLE AS x0, (floor(s_suppkey / 20) * 10)::DOUBLE AS y0,
  (s_nationkey % 5)::DOUBLE AS dx, (s_nationkey // 5)::DOUBLE AS dy FROM supplier)"""


@query(
    "q_rectangle_overlap",
    f"""WITH {SHIFTED}, parts AS (
      SELECT s_suppkey, greatest(0, least(8, dx + 5) - dx) * greatest(0, least(3, dy + 5) - dy) AS low,
             greatest(0, least(4, dx + 5) - dx) * greatest(0, least(7, dy + 5) - greatest(3, dy)) AS high FROM shifted)
    SELECT s_suppkey AS LocationID, 40.0::DOUBLE AS area, round(low + high, 6) AS overlap_area,
           round((low + high) / 40, 6) AS overlap_ratio, CASE WHEN (low + high) / 40 > 0.25 THEN 1 ELSE 0 END AS in_cbd
    FROM parts""",
)
def rectangle_overlap(spark, sf):
    s = V.table(spark, sf, "supplier")
    x0 = (F.col("s_suppkey") % 20 * 10).cast("double") + F.col("s_nationkey") % 5
    y0 = (F.floor(F.col("s_suppkey") / 20) * 10).cast("double") + F.floor(F.col("s_nationkey") / 5)
    ring = F.array(*[F.struct((x0 + x).alias("x"), (y0 + y).alias("y")) for x, y in [(0, 0), (0, 5), (5, 5), (5, 0)]])
    boxes = s.select(F.col("s_suppkey").alias("region_id"), ring.alias("ring"))
    # Boxes of neighbouring cells never touch, so the parts are disjoint by construction.
    df = geo.zone_overlap(_supplier_shapes(spark, sf), boxes, cell=10, regions_disjoint=True)
    return rounded(geo.overlap_flag(df, 0.25), ["overlap_area", "overlap_ratio"])


@query(
    "q_centroids",
    """SELECT s_suppkey AS LocationID, 40.0::DOUBLE AS area, round(s_suppkey % 20 * 10 + 3.2::DOUBLE, 6) AS cx,
    round(floor(s_suppkey / 20) * 10 + 2.9::DOUBLE, 6) AS cy FROM supplier""",
)
def centroids(spark, sf):
    df = geo.centroids(geo.with_area(_supplier_shapes(spark, sf))).drop("ring")
    return rounded(df, ["cx", "cy"])
