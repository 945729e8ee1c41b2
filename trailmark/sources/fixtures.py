"""Check-ins, places, a street graph and metadata derived from the driver's tables, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MID_TO_ACTIVITY, taxonomy

CATEGORIES = ("Coffee Shop", "Subway", "Office", "Road", "Diner", "Train Station", "Bar", "Building", "Park", "Gym / Fitness Center", "Home (private)", "Unmapped Place")
MIDDLE = (
    ("Coffee Shop", "Café & Coffee"),
    ("Subway", "Transportation"),
    ("Office", "Work & Office"),
    ("Road", "Neutral / Generic"),
    ("Diner", "Food & Dining"),
    ("Train Station", "Transportation"),
    ("Bar", "Bars & Nightlife"),
    ("Building", "Neutral / Generic"),
    ("Park", "Outdoors & Recreation"),
    ("Gym / Fitness Center", "Sports & Fitness"),
    ("Home (private)", "Residential"),
)


def _position(k):
    lat = F.lit(40.70) + ((k * 37) % 100) * F.lit(0.0015)
    lon = F.lit(-74.02) + ((k * 61) % 100) * F.lit(0.0015)
    return lat, lon


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("long")
    lat, lon = _position(F.col("_k"))
    rows = events.select("event_id", F.col("user_id").alias("UId"), k.alias("_k"), F.col("ts").cast("timestamp").alias("Time"))
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("_k") % 12 + 1).cast("int"))
    return rows.select("event_id", "UId", F.col("_k").cast("string").alias("PId"), category.alias("Category"), lat.alias("Latitude"), lon.alias("Longitude"), "Time")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkins(spark, sf_dir).select(F.col("PId").alias("poi"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"))
    return rows.distinct()


def nodes(spark: SparkSession) -> DataFrame:
    lat, lon = _position(F.col("id"))
    return spark.range(100).select(F.col("id").alias("node_id"), lat.alias("lat"), lon.alias("lon"))


def edges(spark: SparkSession) -> DataFrame:
    i = spark.range(100)
    right = i.filter("id % 10 < 9").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    down = i.filter("id < 90").select(F.col("id").alias("u"), (F.col("id") + 10).alias("v"))
    return right.unionByName(down).withColumn("length", (150 + (F.col("u") * 17) % 50).cast("double"))


def place_meta(spark: SparkSession) -> DataFrame:
    k = spark.range(100)
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("id") % 12 + 1).cast("int"))
    return k.select(F.col("id").cast("string").alias("poi"), F.concat(F.lit("Place-"), "id").alias("name"), F.concat(F.col("id"), F.lit(" Main St")).alias("address"), category.alias("category"))


def taxonomy_table(spark: SparkSession) -> DataFrame:
    return taxonomy(spark, MIDDLE)


# ------------------------------------------------------------------ the same in DuckDB's SQL

_CASE = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES))
CHECKINS_SQL = f"""ck0 AS (SELECT event_id, user_id AS UId, CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS BIGINT) AS k, CAST(ts AS TIMESTAMP) AS Time FROM events),
ck AS (SELECT event_id, UId, CAST(k AS VARCHAR) AS PId, CASE k % 12 {_CASE} END AS Category,
  CAST(40.70 AS DOUBLE) + ((k * 37) % 100) * CAST(0.0015 AS DOUBLE) AS Latitude, CAST(-74.02 AS DOUBLE) + ((k * 61) % 100) * CAST(0.0015 AS DOUBLE) AS Longitude, Time FROM ck0)"""
TAXONOMY_SQL = "tax AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{m}', '{MID_TO_ACTIVITY[m]}')" for r, m in MIDDLE) + ") t(raw, mid, activity))"
PLACES_SQL = "pl AS (SELECT DISTINCT PId AS poi, Latitude AS lat, Longitude AS lon FROM ck)"
NODES_SQL = "nd AS (SELECT i AS node_id, CAST(40.70 AS DOUBLE) + ((i * 37) % 100) * CAST(0.0015 AS DOUBLE) AS lat, CAST(-74.02 AS DOUBLE) + ((i * 61) % 100) * CAST(0.0015 AS DOUBLE) AS lon FROM range(100) t(i))"
EDGES_SQL = "ed AS (SELECT u, v, CAST(150 + (u * 17) % 50 AS DOUBLE) AS length FROM (SELECT i AS u, i + 1 AS v FROM range(100) t(i) WHERE i % 10 < 9 UNION ALL SELECT i, i + 10 FROM range(100) t(i) WHERE i < 90))"
