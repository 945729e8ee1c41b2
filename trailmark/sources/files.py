"""CSV, JSON and Parquet tables with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import activities
from ..functions.timefn import local_time, parse_lenient, parse_strict, weekday_name


def read_csv(spark: SparkSession, path: str, ddl: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """A CSV file with a header and a given schema; rows that don't fit it are an error."""
    return spark.read.schema(ddl).option("header", True).option("mode", "FAILFAST").option("timestampFormat", timestamp_format).csv(path)


def read_raw_checkins(spark: SparkSession, path: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Check-ins from a raw file with UTC times and offsets in minutes, in local time."""
    return localise(read_csv(spark, path, schema.RAW_CHECKINS), timestamp_format)


def localise(raw: DataFrame, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    schema.require_columns(raw, ["userId", "venueId", "venueCategory", "latitude", "longitude", "timezoneOffset", "utcTimestamp"])
    time = local_time(parse_strict("utcTimestamp", timestamp_format), "timezoneOffset")
    out = raw.select(F.col("userId").alias("UId"), F.col("venueId").alias("PId"), F.col("venueCategory").alias("Category"), F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"), time.alias("Time"))
    return out.withColumn("Weekday", weekday_name("Time"))


def with_times(df: DataFrame, column: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """df with a text column read as timestamps; texts that don't fit are counted and are then an error."""
    out = df.withColumn(column, parse_lenient(column, timestamp_format))
    if bad := out.filter(F.col(column).isNull()).count() - df.filter(F.col(column).isNull()).count():
        raise ValueError(f"{bad} values of {column} are no times")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_split(checkins: DataFrame, sessions: DataFrame, folder: str) -> None:
    """Both tables as Parquet, a folder for each split tag, so that reading one split reads nothing else."""
    checkins.write.mode("overwrite").partitionBy("SplitTag").parquet(f"{folder}/checkins")
    sessions.write.mode("overwrite").partitionBy("SplitTag").parquet(f"{folder}/sessions")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Nested rows as JSON, one a line; nulls stay as nulls."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON document, written by Spark so that any file system will do."""
    spark.createDataFrame([(json.dumps(values, default=str, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The document that write_metadata wrote."""
    return json.loads(spark.read.text(path).first()[0])


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(raw, mid, activity) from a CSV file with the columns raw and mid."""
    return activities(read_csv(spark, path, "raw string, mid string"))
