"""Places: range joins, densities, nearest nodes, bounded shortest paths, pair tables, transitions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SpatialConfig
from ..functions.geo import bearing_deg, cell_id, direction_bin, distance_bin, haversine_m
from ..functions.timefn import gap_bin, seconds_between
from .preprocess import _cut, order_of

METRES_PER_DEGREE = 111_194.0


def _sides(radius_m: float, widest_lat: float) -> tuple[float, float]:
    """Height and width in degrees of grid cells that are radius_m at least everywhere up to the widest latitude.  A
    width of 360 puts all longitudes in two neighbouring cells."""
    up = radius_m / METRES_PER_DEGREE * 1.001
    side = up / max(1e-6, math.cos(math.radians(min(89.9, widest_lat + up))))
    return up, side if side <= 90 else 360.0


def range_join(left: DataFrame, right: DataFrame, radius_m: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs of rows within radius_m: equi-join on grid cells (left in its nine neighbours), then the exact distance.

    Columns come as l_* and r_*, with distance_m.  No inequality join is planned.  Right rows less than a
    cell from longitude 180 are put on both ends of the grid, which has four cells or more around or needs no ends.
    """
    widest = max(abs(float(x or 0)) for df in (left, right) for x in df.agg(F.min(lat), F.max(lat)).first())
    near = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    up, side = _sides(radius_m, widest)
    cell = lambda c, width: F.floor(c / F.lit(width)).cast("long")
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("_n", F.explode(F.array(*near)))
    a = a.withColumn("_y", cell(F.col(f"l_{lat}"), up) + F.col("_n.i")).withColumn("_x", cell(F.col(f"l_{lon}"), side) + F.col("_n.j")).drop("_n")
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    at, ends = F.col(f"r_{lon}"), 180.0 - side
    if side < 360:
        turns = F.when(at >= ends, F.array(F.lit(0.0), F.lit(-360.0))).when(at <= -ends, F.array(F.lit(0.0), F.lit(360.0))).otherwise(F.array(F.lit(0.0)))
        b = b.withColumn("_t", F.explode(turns))
        at = at + F.col("_t")
    b = b.withColumn("_y", cell(F.col(f"r_{lat}"), up)).withColumn("_x", cell(at, side)).drop("_t")
    d = haversine_m(f"l_{lat}", f"l_{lon}", f"r_{lat}", f"r_{lon}")
    return a.join(b, ["_y", "_x"]).drop("_y", "_x").withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m)


def density(places: DataFrame, radius_m: float = 100.0) -> DataFrame:
    """(poi, density_count): other places within radius_m, in great-circle metres."""
    pairs = range_join(places, places, radius_m).filter("l_poi <> r_poi").groupBy("l_poi").agg(F.count(F.lit(1)).alias("_n"))
    return places.select("poi").join(pairs.withColumnRenamed("l_poi", "poi"), "poi", "left").select("poi", F.coalesce("_n", F.lit(0)).cast("long").alias("density_count"))


def rank_bins(df: DataFrame, value: str, bins: int, letter: str, out: str) -> DataFrame:
    """Bin 1..bins by average-rank percentile, as D3; null as D_UNK.

    Ranks come from the table of different values, so ties cost nothing; the running sum is over those values alone.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_m"))
    w = Window.orderBy(value)
    values = values.withColumn("_upto", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mean_rank = F.col("_upto") - (F.col("_m") - 1) / 2.0
    at = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(mean_rank / total * bins).cast("int")))
    values = values.select(value, F.concat(F.lit(letter), at.cast("string")).alias(out))
    return df.join(values, value, "left").withColumn(out, F.coalesce(out, F.lit(f"{letter}_UNK")))


def nearest_node(places: DataFrame, nodes: DataFrame, radius_m: float = 1000.0, max_rings: int = 24) -> DataFrame:
    """(poi, node_id, node_distance_m): the nearest node; the range doubles until every place has one."""
    found, left = None, places
    for _ in range(max_rings):
        pairs = range_join(left, nodes, radius_m)
        best = pairs.groupBy("l_poi").agg(F.min(F.struct("distance_m", "r_node_id")).alias("_b"))
        best = _cut(best.select(F.col("l_poi").alias("poi"), F.col("_b.r_node_id").alias("node_id"), F.col("_b.distance_m").alias("node_distance_m")))
        found = best if found is None else found.unionByName(best)
        left = _cut(left.join(best, "poi", "left_anti"))
        if not left.limit(1).count() or radius_m > 2.1e7:
            break
        radius_m *= 2
    return found


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, the shortest of parallel ones."""
    both = edges.select("u", "v", "length").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length"))
    return both.filter("u <> v").groupBy("u", "v").agg(F.min("length").alias("length"))


def shortest_paths(sources: DataFrame, edges: DataFrame, cutoff: float, max_rounds: int = 10_000) -> DataFrame:
    """(src, node, distance) for all nodes within cutoff of each source along undirected edges.

    Rounds of relaxation: only pairs that got shorter go on; each round is a join and a min, and lineage is cut.
    """
    edges = _cut(undirected(edges))
    best = _cut(sources.select(F.col("node_id").alias("src"), F.col("node_id").alias("node"), F.lit(0.0).alias("distance")).distinct())
    front = best
    for _ in range(max_rounds):
        step = front.join(edges, front.node == edges.u).select("src", F.col("v").alias("node"), (F.col("distance") + F.col("length")).alias("distance")).filter(F.col("distance") <= cutoff)
        step = step.groupBy("src", "node").agg(F.min("distance").alias("new"))
        merged = best.join(step, ["src", "node"], "full_outer")
        better = F.col("new").isNotNull() & (F.col("distance").isNull() | (F.col("new") < F.col("distance")))
        merged = _cut(merged.select("src", "node", F.when(better, F.col("new")).otherwise(F.col("distance")).alias("distance"), better.alias("_moved")))
        best, front = merged.drop("_moved"), merged.filter("_moved").drop("_moved")
        if not front.limit(1).count():
            return best
    raise RuntimeError("the shortest paths did not settle")


def descriptors(places: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: SpatialConfig = SpatialConfig(), cell: Callable = cell_id) -> DataFrame:
    """One row a place: region tokens, density and its bin, nearest node, its degree and the degree's bin.

    The degree counts edges in and out of the directed multigraph; ``cell`` makes a region token of latitude, longitude
    and resolution."""
    degree = edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("node_degree"))
    out = places.join(density(places, cfg.density_radius_m), "poi").join(nearest_node(places, nodes).drop("node_distance_m"), "poi", "left").join(degree, "node_id", "left")
    out = out.withColumn("region_coarse_token", cell("lat", "lon", cfg.coarse_resolution)).withColumn("region_fine_token", cell("lat", "lon", cfg.fine_resolution))
    out = rank_bins(out, "density_count", cfg.density_bins, "D", "density_bin")
    out = rank_bins(out, "node_degree", cfg.connectivity_bins, "C", "connectivity_bin")
    return out.select("poi", "lat", "lon", "region_coarse_token", "region_fine_token", "density_count", "density_bin", F.col("node_id").alias("nearest_graph_node_id"), "node_degree", "connectivity_bin")


def pair_lookup(places: DataFrame, edges: DataFrame | None, cfg: SpatialConfig = SpatialConfig()) -> DataFrame:
    """Pairs of places up to pair_radius_m apart (not 0): road distance where a bounded path exists, else twice the
    great circle.  places has poi, lat, lon and node_id (null: no node)."""
    pairs = range_join(places, places, cfg.pair_radius_m).filter("distance_m > 0")
    base = pairs.select(F.col("l_poi").alias("src_POIId"), F.col("r_poi").alias("dst_POIId"), F.col("l_node_id").alias("src_node_id"), F.col("r_node_id").alias("dst_node_id"), F.col("distance_m").alias("haversine_distance_m"), bearing_deg("l_lat", "l_lon", "r_lat", "r_lon").alias("bearing_deg"))
    base = base.dropDuplicates(["src_POIId", "dst_POIId"])
    if edges is None:
        base = base.withColumn("road_distance_m", F.lit(None).cast("double"))
    else:
        paths = shortest_paths(places.filter("node_id is not null"), edges, cfg.pair_radius_m * cfg.path_stretch + cfg.path_slack_m)
        base = base.join(paths.select(F.col("src").alias("src_node_id"), F.col("node").alias("dst_node_id"), F.col("distance").alias("road_distance_m")), ["src_node_id", "dst_node_id"], "left")
    base = base.withColumn("used_haversine_fallback", F.col("road_distance_m").isNull())
    base = base.withColumn("final_distance_m", F.coalesce("road_distance_m", cfg.path_stretch * F.col("haversine_distance_m")))
    base = base.withColumn("distance_source", F.when(F.col("used_haversine_fallback"), "haversine_fallback").otherwise("road"))
    return base.withColumn("direction_bin", direction_bin("bearing_deg")).withColumn("distance_bin", distance_bin("final_distance_m", cfg.distance_edges_m))


def transitions(checkins: DataFrame, pairs: DataFrame, session: str = "SessionId", cfg: SpatialConfig = SpatialConfig()) -> DataFrame:
    """One row a move within a session: gap, distance, bearing and their bins.

    Pairs missing from the table get twice the great circle, and both bins are then made anew."""
    w = Window.partitionBy(session).orderBy(*order_of(checkins, "Time", "PId"))
    back = lambda c: F.lag(c).over(w)
    rows = checkins.select(session, F.col("PId").alias("dst_POIId"), back("PId").alias("src_POIId"), seconds_between(F.col("Time"), back("Time")).alias("gap_s"), back("Latitude").alias("_a"), back("Longitude").alias("_b"), F.col("Latitude").alias("_c"), F.col("Longitude").alias("_d"), (F.row_number().over(w) - 2).cast("long").alias("transition_index"))
    rows = rows.filter("transition_index >= 0")
    known = pairs.select("src_POIId", "dst_POIId", F.col("final_distance_m").alias("_m"), F.col("bearing_deg").alias("_g"), F.col("distance_bin").alias("_mb"), F.col("direction_bin").alias("_gb"))
    rows = rows.join(known, ["src_POIId", "dst_POIId"], "left")
    lost = F.col("_m").isNull() | F.col("_g").isNull()
    rows = rows.withColumn("final_distance_m", F.coalesce("_m", cfg.path_stretch * haversine_m("_a", "_b", "_c", "_d"))).withColumn("bearing_deg", F.coalesce("_g", bearing_deg("_a", "_b", "_c", "_d")))
    rows = rows.withColumn("distance_bin", F.when(lost, distance_bin("final_distance_m", cfg.distance_edges_m)).otherwise(F.col("_mb"))).withColumn("direction_bin", F.when(lost, direction_bin("bearing_deg")).otherwise(F.col("_gb")))
    return rows.select(session, "transition_index", "src_POIId", "dst_POIId", "gap_s", gap_bin("gap_s", cfg.gap_edges_min).alias("gap_bin"), "final_distance_m", "distance_bin", "bearing_deg", "direction_bin")
