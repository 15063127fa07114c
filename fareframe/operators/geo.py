"""Polygon work on ring columns: ``ring ARRAY<STRUCT<x DOUBLE, y DOUBLE>>`` in planar units.

A ring may be closed (last point repeats the first) or open, in either direction.
Candidates meet on grid cells, so joins are equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareframe.operators.sizing import small_side


def ring_edges(ring: Column) -> Column:
    """Array of edges ``(x0, y0, x1, y1)``, closing the ring."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(
            a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")
        ),
    )


def _sum(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["x0"] * e["y1"] - e["x1"] * e["y0"]


def ring_area(edges: Column) -> Column:
    return F.abs(_sum(edges, _cross)) / 2.0


def with_area(df: DataFrame, ring: str = "ring", out: str = "area") -> DataFrame:
    return df.withColumn(out, ring_area(ring_edges(F.col(ring))))


def centroids(df: DataFrame, ring: str = "ring") -> DataFrame:
    """``cx``, ``cy`` of each polygon; null for a degenerate ring."""
    edges = ring_edges(F.col(ring))
    twice = _sum(edges, _cross)
    scale = F.when(twice != 0, 3.0 * twice)
    return df.withColumns(
        {
            "cx": _sum(edges, lambda e: (e["x0"] + e["x1"]) * _cross(e)) / scale,
            "cy": _sum(edges, lambda e: (e["y0"] + e["y1"]) * _cross(e)) / scale,
        }
    )


def _cell(value: Column, cell: float) -> Column:
    return F.floor(value / cell)


def _with_cells(df: DataFrame, ring: str, cell: float) -> DataFrame:
    """One row per grid cell of each polygon's bounding box."""
    xs = F.transform(ring, lambda p: p["x"])
    ys = F.transform(ring, lambda p: p["y"])
    spans = df.where(F.size(ring) > 0).withColumns(
        {
            "_x": F.sequence(_cell(F.array_min(xs), cell), _cell(F.array_max(xs), cell)),
            "_y": F.sequence(_cell(F.array_min(ys), cell), _cell(F.array_max(ys), cell)),
        }
    )
    return spans.withColumn("_cx", F.explode("_x")).withColumn("_cy", F.explode("_y")).drop("_x", "_y")


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Crossing-number parity."""

    def crosses(e: Column) -> Column:
        straddles = (e["y0"] > y) != (e["y1"] > y)
        at = (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]
        return F.when(straddles, F.when(x < at, 1).otherwise(0)).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1


def _band_edges(polygons: DataFrame, key: str, cell: float, ring: str) -> DataFrame:
    """One row per edge and band of cells that it passes: ``_cy``, the edge ``_e``, its cells ``_c0`` to ``_c1`` there.

    Level edges are no part of a crossing count and are left out.
    """
    e = F.col("_e")
    edges = polygons.select(key, F.explode(ring_edges(F.col(ring))).alias("_e")).where(e["y0"] != e["y1"])
    low, high = F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"])
    bands = edges.select(key, "_e", F.explode(F.sequence(_cell(low, cell), _cell(high, cell))).alias("_cy"))

    def at(y: Column) -> Column:
        x = e["x0"] + (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"])
        return F.greatest(F.least(x, F.greatest(e["x0"], e["x1"])), F.least(e["x0"], e["x1"]))

    # Wider than the rounding of band limits and places: an edge may count as passing one cell more.
    rise = (F.abs("_cy") + 1) * cell * 1e-12
    a, b = at(F.greatest(low, F.col("_cy") * cell - rise)), at(F.least(high, (F.col("_cy") + 1) * cell + rise))
    slack = (F.abs(e["x0"]) + F.abs(e["x1"])) * 1e-12
    return bands.select(key, "_cy", "_e", _cell(F.least(a, b) - slack, cell).alias("_c0"), _cell(F.greatest(a, b) + slack, cell).alias("_c1"))


def cell_cover(polygons: DataFrame, key: str, cell: float, ring: str = "ring") -> DataFrame:
    """Grid cells that a polygon touches: (key, _cx, _cy, _edges, _turns, _base).

    A point is inside when the edges to its right that span its height are odd in number. In a cell, ``_edges`` are those
    that pass the cell itself. Edges farther right need no test by place: an edge spans a height when one of its two
    ends is above it, so their number is odd or even with the number of their ends above the point. Ends at one height
    cancel in pairs, which leaves nothing of a chain but its ends: ``_turns`` are the heights left within the cell's
    band, ``_base`` (0 or 1) counts those above it. Cells without edges and turns are wholly inside, cells outside have
    no row. So a border cell carries its own edges only, never the ring, and each edge is repeated once per cell it
    passes. ``cell`` should be small enough for the edges of one cell to fit a row.
    """
    edges = _band_edges(polygons, key, cell, ring)
    own = edges.select(key, "_cy", F.explode(F.sequence("_c0", "_c1")).alias("_cx"), F.col("_e").alias("edge"))
    ends = edges.select(key, "_cy", "_c0", F.explode(F.array(F.col("_e")["y0"], F.col("_e")["y1"])).alias("y"))
    # Bands of ends and of points come from the same rounded division, so they never disagree.
    band = _cell(F.col("y"), cell)
    ends = ends.where(band >= F.col("_cy")).withColumn("y", F.when(band == F.col("_cy"), F.col("y")))
    # An end counts for the cells left of its edge. Of the edges that share a height an odd number is farther right
    # from each odd place in their order to the next; a closed ring has an even number of them.
    times = ends.groupBy(key, "_cy", "y", "_c0").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1")
    places = times.groupBy(key, "_cy", "y").agg(F.sort_array(F.collect_list("_c0")).alias("c"))
    runs = F.transform(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2)), lambda i: F.sequence(F.col("c")[i], F.col("c")[i + 1] - 1))
    reach = places.select(key, "_cy", "y", F.explode(F.flatten(runs)).alias("_cx"))
    own = own.select(key, "_cx", "_cy", "edge", F.lit(None).cast("double").alias("turn"), F.lit(0).alias("above"))
    reach = reach.select(
        key, "_cx", "_cy", F.lit(None).cast(own.schema["edge"].dataType).alias("edge"), F.col("y").alias("turn"), F.col("y").isNull().cast("int").alias("above")
    )
    return own.unionByName(reach).groupBy(key, "_cx", "_cy").agg(
        F.collect_list("edge").alias("_edges"), F.collect_list("turn").alias("_turns"), (F.sum("above") % 2).cast("int").alias("_base")
    )


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, key: str, cell: float, x: str = "x", y: str = "y", ring: str = "ring"
) -> DataFrame:
    """Points with the key of each polygon that holds them; points in none drop out.

    Points meet the cells of ``cell_cover``: inside a polygon without any edge test, at its border with the few edges of
    the cell. A crowded cell is safe: the polygon side is broadcast when it is checked small, and otherwise the join
    stays a sort-merge join whose hot partitions AQE splits. Points without a place drop out; keys of polygons are unique.
    """
    cover = cell_cover(polygons.select(key, F.col(ring).alias("_ring")), key, cell, "_ring")
    placed = points.withColumns({"_cx": _cell(F.col(x), cell), "_cy": _cell(F.col(y), cell)})
    hits = placed.join(small_side(cover), ["_cx", "_cy"])
    above = F.size(F.filter("_turns", lambda t: t > F.col(y)))
    odd = (F.col("_base") + above + inside(F.col(x), F.col(y), F.col("_edges")).cast("int")) % 2 == 1
    plain = (F.size("_edges") == 0) & (F.size("_turns") == 0)
    return hits.where(F.when(plain, F.col("_base") == 1).otherwise(odd)).drop("_cx", "_cy", "_edges", "_turns", "_base")


def _min_integral(e: Column, f: Column, base: Column, start: Column, stop: Column) -> Column:
    """Signed integral of the lower of two edges over their common x range from ``start`` to ``stop``, above ``base``."""
    left = F.greatest(F.least(e["x0"], e["x1"]), F.least(f["x0"], f["x1"]), start)
    right = F.least(F.greatest(e["x0"], e["x1"]), F.greatest(f["x0"], f["x1"]), stop)
    sign = F.signum(e["x0"] - e["x1"]) * F.signum(f["x0"] - f["x1"])

    def height(g: Column, at: Column) -> Column:
        return g["y0"] + (g["y1"] - g["y0"]) * (at - g["x0"]) / (g["x1"] - g["x0"]) - base

    def area(e0: Column, e1: Column, f0: Column, f1: Column) -> Column:
        gap0, gap1 = e0 - f0, e1 - f1
        low0, low1 = F.least(e0, f0), F.least(e1, f1)
        at = gap0 / (gap0 - gap1)
        meet = e0 + at * (e1 - e0)
        crossing = at * (low0 + meet) + (1 - at) * (meet + low1)
        return F.when(gap0 * gap1 < 0, crossing).otherwise(low0 + low1) * (right - left) / 2.0

    return F.when(
        (sign != 0) & (left < right),
        sign * area(height(e, left), height(e, right), height(f, left), height(f, right)),
    ).otherwise(F.lit(0.0))


def pair_overlap(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float, ring: str = "ring") -> DataFrame:
    """Exact intersection area of every polygon pair whose bounding boxes share a cell.

    The area of a polygon is the signed sum of the strips under its edges; that of an intersection
    is the signed sum, over edge pairs, of the strip under the lower edge. Edges meet by columns of cells, so
    only those above one another do, and no ring is copied.
    """
    left = _with_cells(a.select(F.col(a_key), F.col(ring).alias("_a")), "_a", cell)
    right = _with_cells(b.select(F.col(b_key), F.col(ring).alias("_b")), "_b", cell)
    pairs = (
        left.select(a_key, "_cx", "_cy")
        .join(small_side(right.select(b_key, "_cx", "_cy")), ["_cx", "_cy"])
        .select(a_key, b_key)
        .distinct()
    )

    def columns_of(df: DataFrame, key: str, out: str) -> DataFrame:
        """One row per edge and column of cells that it passes."""
        e = F.col(out)
        edges = df.select(key, F.explode(ring_edges(F.col(ring))).alias(out)).where(e["x0"] != e["x1"])
        reach = F.sequence(_cell(F.least(e["x0"], e["x1"]), cell), _cell(F.greatest(e["x0"], e["x1"]), cell))
        return edges.withColumn("_cx", F.explode(reach))

    base = a.select(a_key, F.array_min(F.transform(ring, lambda p: p["y"])).alias("_base"))
    met = pairs.join(base, a_key).join(columns_of(a, a_key, "_e"), a_key).join(columns_of(b, b_key, "_f"), [b_key, "_cx"])
    strip = _min_integral(F.col("_e"), F.col("_f"), F.col("_base"), F.col("_cx") * cell, (F.col("_cx") + 1) * cell)
    summed = met.groupBy(a_key, b_key).agg(F.sum(strip).alias("s"))
    return summed.select(a_key, b_key, F.abs("s").alias("overlap_area"))


def check_disjoint(regions: DataFrame, key: str, cell: float, ring: str = "ring", tolerance: float = 1e-9) -> None:
    """Action: raises when two region parts overlap."""
    other = regions.select(F.col(key).alias("_other"), ring)
    clash = pair_overlap(regions, other, key, "_other", cell, ring)
    if not clash.where((F.col(key) < F.col("_other")) & (F.col("overlap_area") > tolerance)).isEmpty():
        raise ValueError("region parts overlap; merge them first")


def zone_overlap(
    zones: DataFrame,
    regions: DataFrame,
    cell: float,
    zone_key: str = "LocationID",
    region_key: str = "region_id",
    ring: str = "ring",
    regions_disjoint: bool = False,
) -> DataFrame:
    """Zone area, area inside the region and their ratio (0 for a zone without area).

    The region may have several disjoint parts; pass ``regions_disjoint=True`` to skip that check.
    """
    if not regions_disjoint:
        check_disjoint(regions, region_key, cell, ring)
    covered = (
        pair_overlap(zones, regions, zone_key, region_key, cell, ring)
        .groupBy(zone_key)
        .agg(F.sum("overlap_area").alias("overlap_area"))
    )
    joined = with_area(zones.select(zone_key, ring), ring).drop(ring).join(covered, zone_key, "left")
    overlap = F.coalesce("overlap_area", F.lit(0.0))
    ratio = F.when(F.col("area") > 0, overlap / F.col("area")).otherwise(F.lit(0.0))
    return joined.select(zone_key, "area", overlap.alias("overlap_area"), ratio.alias("overlap_ratio"))


def overlap_flag(df: DataFrame, threshold: float, ratio: str = "overlap_ratio", out: str = "in_cbd") -> DataFrame:
    """1 where the ratio is strictly above the threshold."""
    return df.withColumn(out, F.when(F.col(ratio) > threshold, F.lit(1)).otherwise(F.lit(0)))
