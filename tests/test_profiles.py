import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fareframe.operators import geo, profile


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_ci_counts_all_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0)], "k string, v double")
    a, b = profile.agg_with_ci(df, ["k"], "v").orderBy("k").collect()
    assert (a["mean"], a["n"]) == (2.0, 3)
    assert a["se"] == pytest.approx(math.sqrt(2) / math.sqrt(3)) and a["hi"] == pytest.approx(2 + 1.96 * a["se"])
    assert b["sd"] is None and b["lo"] is None


@pytest.mark.parametrize("n", [24, 3, 1])
def test_circular_mean(spark, n):
    v = [float((i * 7) % 11) for i in range(n)]
    df = spark.createDataFrame([("x", i, v[i]) for i in range(n)] + [("y", 5, 2.0)], "p string, h int, v double")
    got = profile.circular_mean(df, ["p"], "h", ["v"]).where("p = 'x'").orderBy("h").collect()
    want = [np.mean([v[i - 1], v[i], v[(i + 1) % n]]) for i in range(n)]
    assert [r["v_s"] for r in got] == pytest.approx(want)


@pytest.mark.parametrize("n", [29, 30, 60])
def test_centred_mean_matches_pandas(spark, n):
    df = spark.createDataFrame([(i, float(i * i % 17)) for i in range(n)], "d int, v double")
    got = [r["v_rolling"] for r in profile.centred_mean(df, "d", "v").orderBy("d").collect()]
    want = pd.Series([float(i * i % 17) for i in range(n)]).rolling(30, center=True).mean()
    assert [g if g is not None else math.nan for g in got] == pytest.approx(want.tolist(), nan_ok=True)


def test_uplift_within_strata(spark):
    data = [(h, t, m, float(h + len(t) * m)) for h in range(3) for t in ("a", "bb") for m in (1.0, 6.0) for _ in range(h + 1)]
    df = spark.createDataFrame(data, "h int, t string, trip_miles double, v double")
    pdf = df.toPandas()
    got = {(r["h"], r["t"]): r["uplift"] for r in profile.uplift(df, "h", "t", "v").collect()}
    cell, hour = pdf.groupby(["h", "t"]).v.mean(), pdf.groupby("h").v.mean()
    assert got == pytest.approx({k: cell[k] - hour[k[0]] for k in cell.index})
    banded = profile.distance_uplift(df, "h", "t", "v").collect()
    assert len(banded) == 12 and {r["dist_band"] for r in banded} == {"0-2", "5-10"}
    assert all(abs(sum(r["uplift"] for r in banded if (r["dist_band"], r["h"]) == k)) < 1e-9 for k in [("0-2", 0), ("5-10", 2)])


def test_shares_sum_to_100_and_mode_ties(spark):
    df = spark.createDataFrame([(x,) for x in [3, 3, 1, 1, 2, None]], "v int")
    assert sum(r["pct"] for r in profile.value_shares(df, "v").collect()) == pytest.approx(100)
    assert profile.mode_of(df, "v").first()["v"] == 1


def test_baseline_and_peak(spark):
    df = spark.createDataFrame([(h, float(h)) for h in range(24)], "pickup_hour int, mean double")
    got = {r["pickup_hour"]: r["pct_vs_offpeak"] for r in profile.pct_vs_baseline(df).collect()}
    assert got[7] == pytest.approx(100.0) and got[0] == -100.0
    assert profile.peak(df, "pickup_hour").first()["pickup_hour"] == 23


def test_interaction_and_cross_counts(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (2, "b", 1.0)], "h int, t string, v double")
    assert rows(profile.interaction(df, "h", "t", "v", ["a", "b"]), "h", "a", "b") == [(1, 3.0, None), (2, None, 1.0)]
    assert rows(profile.cross_counts(df, "h", "t", ["a", "b"]), "h", "a", "b") == [(1, 2, 0), (2, 0, 1)]


def test_flag_profiles_match_separate_groups(spark):
    df = spark.range(200).select(
        (F.col("id") % 2).cast("int").alias("f"), (F.col("id") % 3 == 0).cast("int").alias("g"),
        F.col("id").cast("double").alias("commission"), F.when(F.col("id") % 5 > 0, F.col("id") / 7).alias("y_cpm"),
    )
    pdf = df.toPandas()
    for r in profile.flag_profiles(df, ["f", "g"]).collect():
        part = pdf[pdf[r["flag"]] == r["level"]]
        assert r["avg_commission"] == pytest.approx(part.commission.mean())
        assert r["avg_cpm"] == pytest.approx(part.y_cpm.mean()) and r["trips"] == len(part)


def test_n_distinct_and_rates(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (None, 4)], "a int, b int")
    assert rows(profile.n_distinct(df, ["a", "b"]), "column", "n_distinct") == [("a", 1), ("b", 3)]
    assert profile.share_rate(df, F.col("b") > 2).first()[0] == pytest.approx(2 / 3)


# Polygons


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def shapes(spark, items, key="LocationID"):
    return spark.createDataFrame([(k, ring(p)) for k, p in items], f"{key} int, ring array<struct<x:double,y:double>>")


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
ELL = [(0, 0), (8, 0), (8, 3), (4, 3), (4, 7), (0, 7)]
TRIANGLE = [(1, 1), (9, 2), (3, 8)]
STAR = [(5, 0), (6, 4), (10, 5), (6, 6), (5, 10), (4, 6), (0, 5), (4, 4)]


def inside(x, y, poly):
    hit = False
    for (x0, y0), (x1, y1) in zip(poly, poly[1:] + poly[:1]):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            hit = not hit
    return hit


def grid_area(a, b, step=0.02):
    n = int(11 / step)
    return sum(
        inside(i * step + step / 2 - 0.5, j * step + step / 2 - 0.5, a) and inside(i * step + step / 2 - 0.5, j * step + step / 2 - 0.5, b)
        for i in range(n) for j in range(n)
    ) * step * step


def test_areas_and_centroids(spark):
    df = geo.centroids(geo.with_area(shapes(spark, [(1, SQUARE), (2, ELL[::-1]), (3, SQUARE + SQUARE[:1]), (4, [(0, 0), (1, 1)])])))
    got = {r["LocationID"]: (r["area"], r["cx"], r["cy"]) for r in df.collect()}
    assert got[1] == got[3] == (16.0, 2.0, 2.0)
    assert got[2] == pytest.approx((40.0, 3.2, 2.9))
    assert got[4] == (0.0, None, None)


@pytest.mark.parametrize("a,b", [(ELL, TRIANGLE), (STAR, SQUARE), (STAR, TRIANGLE[::-1]), (ELL, STAR)])
def test_overlap_against_brute_force(spark, a, b):
    got = geo.zone_overlap(shapes(spark, [(1, a)]), shapes(spark, [(7, b)], "region_id"), cell=3.0).first()
    assert got["overlap_area"] == pytest.approx(grid_area(a, b), abs=0.12)


def test_overlap_exact_cases(spark):
    zones = shapes(spark, [(1, SQUARE), (2, [(10, 10), (12, 10), (12, 12), (10, 12)]), (3, [(0, 0), (1, 1), (2, 2)]), (4, [(-3, -2), (-1, -2), (-1, 1), (-3, 1)])])
    region = shapes(spark, [(1, [(-2, -1), (2, -1), (2, 2), (-2, 2)]), (2, [(3, 3), (3, 9), (9, 9), (9, 3)])], "region_id")
    table = geo.overlap_flag(geo.zone_overlap(zones, region, cell=1.5), 0.3125)
    got = {r["LocationID"]: (r["overlap_area"], r["overlap_ratio"], r["in_cbd"]) for r in table.collect()}
    assert got[1] == pytest.approx((5.0, 0.3125, 0))
    assert got[2] == (0.0, 0.0, 0) and got[3][1] == 0.0
    assert got[4] == pytest.approx((2.0, 1 / 3, 1))


def test_overlapping_region_parts_are_refused(spark):
    region = shapes(spark, [(1, SQUARE), (2, [(3, 3), (6, 3), (6, 6), (3, 6)])], "region_id")
    with pytest.raises(ValueError):
        geo.zone_overlap(shapes(spark, [(1, ELL)]), region, cell=2.0)


def test_points_in_polygons_with_a_hot_cell(spark):
    polys = [(1, STAR), (2, ELL), (3, TRIANGLE)]
    pts = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 5.0 + (F.col("id") % 7) / 10).otherwise(F.col("id") % 101 / 9.7).alias("x"),
        F.when(F.col("id") % 3 == 0, 5.05).otherwise(F.col("id") % 89 / 8.3).alias("y"),
    )
    got = sorted((r["id"], r["LocationID"]) for r in geo.points_in_polygons(pts, shapes(spark, polys), "LocationID", 2.0).collect())
    want = sorted((r["id"], k) for r in pts.collect() for k, p in polys if inside(r["x"], r["y"], p))
    assert got == want


def test_points_on_cell_borders_and_level_edges(spark):
    """Corners, level edges and points that lie on the grid itself, for several cell sizes."""
    rng = random.Random(5)
    polys = [(k, [(rng.randint(-6, 6) / 2, rng.randint(-6, 6) / 2) for _ in range(rng.randint(3, 12))]) for k in range(25)]
    polys += [(50, [(-3, -3), (3, -3), (3, 3), (1, 3), (1, 1), (-1, 1), (-1, 3), (-3, 3)]), (51, [(0, 0), (1, 1)]), (52, [])]
    pts = spark.range(900).select("id", ((F.col("id") % 30 - 15) / 4).alias("x"), (F.floor(F.col("id") / 30) / 4 - 3.75).alias("y"))
    pts = pts.unionByName(spark.createDataFrame([(-1, None, 1.0)], pts.schema))
    want = sorted((r["id"], k) for r in pts.collect() for k, p in polys if r["x"] is not None and inside(r["x"], r["y"], p))
    for cell in (0.1, 0.5, 1.0, 7.0):
        hits = geo.points_in_polygons(pts, shapes(spark, polys), "LocationID", cell)
        assert sorted((r["id"], r["LocationID"]) for r in hits.collect()) == want


def test_a_long_ring_is_never_copied(spark):
    """100,000 corners around the origin, so that the edge of a point's angle decides."""
    n = 100_000
    turn = F.col("id") * (2 * np.pi / n)
    far = 8 + F.sin(turn * 9) + (F.col("id") * 7919 % 13) / 1000
    corner = F.struct("id", (far * F.cos(turn)).alias("x"), (far * F.sin(turn)).alias("y"))
    ring = spark.range(n).agg(F.transform(F.array_sort(F.collect_list(corner)), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("ring"))
    shape = ring.select(F.lit(1).alias("LocationID"), "ring")
    cover = geo.cell_cover(shape, "LocationID", 0.05).agg(
        F.sum(F.size("_edges")), F.max(F.size("_edges")), F.max(F.size("_turns")), F.count_if(F.size("_edges") == 0)
    ).first()
    assert cover[0] < 2 * n and cover[1] < 600 and cover[2] < 200 and cover[3] > 10_000
    pts = spark.range(200_000).select("id", (F.rand(1) * 22 - 11).alias("x"), (F.rand(2) * 22 - 11).alias("y")).toPandas()
    corners = np.array([(c["x"], c["y"]) for c in ring.first()["ring"]])
    angle = np.arctan2(pts["y"], pts["x"]) % (2 * np.pi)
    i = np.minimum((angle / (2 * np.pi / n)).astype(int), n - 1)
    a, b = corners[i], corners[(i + 1) % n]
    side = (b[:, 0] - a[:, 0]) * (pts["y"] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (pts["x"] - a[:, 0])
    hits = geo.points_in_polygons(spark.createDataFrame(pts), shape, "LocationID", 0.05)
    assert sorted(r["id"] for r in hits.select("id").collect()) == pts["id"][side > 0].tolist()
