"""Table schemas, column guards and column resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW_CHECKINS = "userId long, venueId string, venueCategory string, latitude double, longitude double, timezoneOffset int, utcTimestamp string"
CHECKINS = "UId long, PId string, Category string, Latitude double, Longitude double, Time timestamp, Weekday string"
ALIASES = {
    "poi_id": ("PoiId", "POIId", "PId", "VenueId", "venue_id", "poi_id"),
    "name": ("PoiName", "POIName", "VenueName", "venue_name", "name"),
    "address": ("Address", "address", "formatted_address", "PoiAddress"),
    "category": ("PoiCategoryName", "CategoryName", "Category", "category", "PoiCategory", "VenueCategory"),
    "time": ("Time", "UTCTimeOffset", "timestamp", "ts"),
    "session": ("SessionId", "pseudo_session_trajectory_id", "session"),
}


def require_columns(df: DataFrame, columns) -> DataFrame:
    """df, or an error that names the columns it lacks; no job runs."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve_column(df: DataFrame, kind: str, required: bool = True) -> str | None:
    """The first known name of a kind of column that df has."""
    found = next((c for c in ALIASES.get(kind, (kind,)) if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"no column for {kind}: one of {', '.join(ALIASES.get(kind, (kind,)))} is needed")
    return found


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or an error if a key occurs twice (one aggregate job)."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"duplicate keys: {', '.join(keys)}")
    return df


def require_no_nulls(df: DataFrame, *columns: str) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    if bad := {c: row[c] for c in columns if row[c]}:
        raise ValueError(f"nulls found: {bad}")
    return df
