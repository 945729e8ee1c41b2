"""Decision states: what is known at each stop of a session, and the place that came next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import decision_time_bin, seconds_between
from .preprocess import order_of

_BOS = {"gap_bin": "gap_bin", "distance_bin": "distance_bin", "direction_bin": "direction_bin"}
_RAW = {"gap_s": "gap_s", "distance_m": "final_distance_m", "bearing_deg": "bearing_deg"}


def _states(checkins: DataFrame, moves: DataFrame, recent_k: int, session: str) -> DataFrame:
    """All stops with their prefix columns and, where there is a next stop, the labels."""
    keys = order_of(checkins, "Time", "PId")
    w = Window.partitionBy(session).orderBy(*keys)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lambda c: (F.row_number().over(Window.partitionBy(session, c).orderBy(*keys)) == 1).cast("long")
    rows = checkins.withColumn("_fp", first("PId")).withColumn("_fc", first("Category"))
    rows = rows.select(
        session,
        "UId",
        (F.row_number().over(w) - 1).cast("long").alias("decision_index"),
        F.col("PId").alias("current_POIId"),
        F.lead("PId").over(w).alias("next_POIId"),
        F.col("Time").alias("current_timestamp"),
        F.lead("Time").over(w).alias("next_timestamp"),
        F.col("Category").alias("current_category"),
        F.lead("Category").over(w).alias("next_category"),
        F.col("Latitude").alias("curr_lat"),
        F.col("Longitude").alias("curr_lon"),
        decision_time_bin("Time").alias("current_time_bin"),
        (seconds_between(F.col("Time"), F.min("Time").over(Window.partitionBy(session))) / 60.0).alias("prefix_elapsed_min"),
        F.sum("_fp").over(upto).alias("prefix_unique_poi_count"),
        F.sum("_fc").over(upto).alias("prefix_unique_category_count"),
        F.count(F.lit(1)).over(Window.partitionBy(session)).alias("_stops"),
    )
    rows = rows.withColumn("prefix_len", F.col("decision_index") + 1)
    rows = rows.withColumn("prefix_repeat_ratio", 1.0 - F.col("prefix_unique_poi_count") / F.col("prefix_len"))
    steps = Window.partitionBy(session).orderBy("transition_index")
    recent = moves.select(session, (F.col("transition_index") + 1).alias("decision_index"), *[F.lag(src, k - 1).over(steps).alias(f"prev{k}_{name}") for k in range(1, recent_k + 1) for name, src in {**_BOS, **_RAW}.items()])
    rows = rows.join(recent, [session, "decision_index"], "left")
    for k in range(1, recent_k + 1):
        for name in _BOS:
            rows = rows.withColumn(f"prev{k}_{name}", F.coalesce(f"prev{k}_{name}", F.lit("BOS")))
    return rows


def _described(rows: DataFrame, places: DataFrame | None, prototypes: DataFrame | None, session: str) -> DataFrame:
    """With curr_* of the place (a place without descriptors is an error) and proto_* of the session."""
    if places is not None:
        one = places.dropDuplicates(["poi"]).drop("lat", "lon")
        rows = rows.join(one.select(F.col("poi").alias("current_POIId"), *[F.col(c).alias(f"curr_{c}") for c in one.columns if c != "poi"], F.lit(True).alias("_known")), "current_POIId", "left")
        rows = rows.withColumn("current_POIId", F.when(F.col("_known"), F.col("current_POIId")).otherwise(F.raise_error(F.concat(F.lit("no descriptors for place "), F.col("current_POIId"))))).drop("_known")
    if prototypes is not None:
        one = prototypes.dropDuplicates([session])
        rows = rows.join(one.select(session, *[F.col(c).alias(f"proto_{c}") for c in one.columns if c != session]), session, "left")
    return rows


def decision_states(checkins: DataFrame, moves: DataFrame, places: DataFrame | None = None, prototypes: DataFrame | None = None, recent_k: int = 2, session: str = "SessionId") -> DataFrame:
    """One row for each stop that has a next one, with that place, time and category as labels."""
    rows = _states(checkins, moves, recent_k, session).filter("_stops >= 2 and next_timestamp is not null").drop("_stops")
    return _described(rows, places, prototypes, session)


def current_states(checkins: DataFrame, moves: DataFrame, places: DataFrame | None = None, prototypes: DataFrame | None = None, recent_k: int = 2, session: str = "SessionId") -> DataFrame:
    """The last stop of each session, without labels: the state to predict from."""
    rows = _states(checkins, moves, recent_k, session).filter("next_timestamp is null").drop("_stops", "next_POIId", "next_timestamp", "next_category")
    return _described(rows, places, prototypes, session)
