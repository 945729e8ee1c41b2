"""Registered queries over the driver's tables, and the same in DuckDB's SQL where SQL can express them.

Floats are rounded to six places; arrays are joined to text, so that both engines hash alike.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CanonicalConfig, RetrievalConfig, Settings, SpatialConfig
from .functions import geo
from .functions import text as tx
from .functions import timefn as tf
from .operators import cases as cs
from .operators import features as ft
from .operators import preprocess as op
from .operators import prompts as pr
from .operators import prototypes as pt
from .operators import retrieval as rt
from .operators import spatial as sp
from .operators import states as st
from .plans import canonical, next_place, prototypes
from .sources import fixtures as fx
from .streaming.sessions import live_sessions

GAP = 6 * 3600
#: Settings of the decision and retrieval queries: day-long sessions, so that they hold several stops.
DAY = 24 * 3600
#: The sessions that ask; the others are the cases.
HELD_OUT = "SessionId % 3 = 0"
FREQUENT = CanonicalConfig(min_user_checkins=60, min_poi_unique_users=9)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def r6(x, name: str):
    return F.round(F.col(x) if isinstance(x, str) else x, 6).alias(name)


def _sessions(spark: SparkSession, d: str, gap: float = GAP) -> DataFrame:
    return op.assign_sessions(fx.checkins(spark, d), gap)


# ------------------------------------------------------------------ SQL shared by the oracles


def _session_sql(gap: int, source: str = "ck") -> str:
    return f"""s0 AS (SELECT *, lag(Time) OVER (PARTITION BY UId ORDER BY Time, PId, event_id) AS prev FROM {source}),
s1 AS (SELECT *, date_diff('microsecond', prev, Time) / CAST(1e6 AS DOUBLE) AS gap FROM s0),
s2 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY UId ORDER BY Time, PId, event_id ROWS UNBOUNDED PRECEDING) - 1 AS usi FROM s1),
ss AS (SELECT event_id, UId, PId, Category, Latitude, Longitude, Time, CAST(usi AS BIGINT) AS user_session_index, gap / 3600.0 AS PrevGapHours, dense_rank() OVER (ORDER BY UId, usi) - 1 AS SessionId FROM s2)"""


_CK = "WITH RECURSIVE " + fx.CHECKINS_SQL
_SS = f"{_CK}, {_session_sql(GAP)}"
_DD = f"{_CK}, {_session_sql(DAY)}"
_BOUNDS = """sb AS (SELECT SessionId, min(UId) AS UId, min(user_session_index) AS user_session_index, min(Time) AS session_start_time, max(Time) AS session_end_time, count(*) AS session_len,
  arg_min(PId, {'t': Time, 'p': PId, 'e': event_id}) AS first_poi, arg_max(PId, {'t': Time, 'p': PId, 'e': event_id}) AS last_poi FROM ss GROUP BY SessionId)"""


def _tag_sql(rank: str, total: str, train: str = "0.7", val: str = "0.1") -> str:
    t, v = f"CAST({train} AS DOUBLE)", f"CAST({val} AS DOUBLE)"
    return f"CASE WHEN {rank} < floor({total} * {t}) THEN 'train' WHEN {rank} < floor({total} * ({t} + {v})) THEN 'validation' ELSE 'test' END"


def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(sin((radians({lat2}) - radians({lat1})) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin((radians({lon2}) - radians({lon1})) / 2) ** 2)"


def _km(*at: str, radius: str = "6371.0088") -> str:
    return f"(2 * CAST({radius} AS DOUBLE) * asin(sqrt(least(1.0, {_hav(*at)}))))"


def _m(*at: str) -> str:
    return f"(2 * CAST(6371008.8 AS DOUBLE) * atan2(sqrt({_hav(*at)}), sqrt(greatest(0.0, 1 - {_hav(*at)}))))"


def _bearing(a: str, b: str, c: str, d: str) -> str:
    return f"fmod(degrees(atan2(sin(radians({d}) - radians({b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b})))) + 360.0, 360.0)"


def _dir_sql(b: str) -> str:
    return f"(['N','NE','E','SE','S','SW','W','NW'])[CAST(floor(fmod({b} + 22.5, 360.0) / 45.0) AS INT) + 1]"


def _bins_sql(x: str, edges, unit: str, null: str = "NULL") -> str:
    steps = " ".join(f"WHEN {x} <= {hi} THEN '{lo}-{hi}{unit}'" for lo, hi in zip((0, *edges), edges))
    return f"CASE WHEN {x} IS NULL THEN {null} {steps} ELSE '{edges[-1]}+{unit}' END"


DIST, GAPS = (250, 500, 1000, 2000, 5000), (15, 30, 60, 120, 240)


# ------------------------------------------------------------------ sources and scalar functions


@query("""SELECT CAST(user_id AS VARCHAR) AS userId, strftime(CAST(ts AS TIMESTAMP) + to_minutes(CAST((user_id % 25 - 12) * 60 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS local_text,
dayname(CAST(ts AS TIMESTAMP) + to_minutes(CAST((user_id % 25 - 12) * 60 AS BIGINT))) AS weekday,
CAST(isodow(CAST(ts AS TIMESTAMP) + to_minutes(CAST((user_id % 25 - 12) * 60 AS BIGINT))) - 1 AS INT) AS weekday_id, CAST(hour(CAST(ts AS TIMESTAMP)) AS INT) AS utc_hour FROM events""")
def local_times(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"), ((F.col("user_id") % 25 - 12) * 60).cast("string").alias("offset"))
    at = tf.local_time("ts", "offset")
    return e.select(F.col("user_id").cast("string").alias("userId"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("local_text"), tf.weekday_name(at).alias("weekday"), F.weekday(at).alias("weekday_id"), F.hour("ts").alias("utc_hour"))


@query(_CK + " SELECT event_id, UId, PId, Category, round(Latitude, 6) AS Latitude, round(Longitude, 6) AS Longitude, Time FROM ck")
def csv_round_trip(spark, d):
    """Check-ins written as CSV in the warehouse and read with a schema."""
    from .sources.files import read_csv, write_csv

    path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/trailmark_csv_" + str(zlib.crc32(d.encode()))
    rows = fx.checkins(spark, d).withColumn("Time", F.date_format("Time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    write_csv(rows, path)
    back = read_csv(spark, path, "event_id long, UId long, PId string, Category string, Latitude double, Longitude double, Time timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return back.select("event_id", "UId", "PId", "Category", r6("Latitude", "Latitude"), r6("Longitude", "Longitude"), "Time")


@query(f"{_CK}, p AS (SELECT a.PId AS a, b.PId AS b, {_m('a.Latitude', 'a.Longitude', 'b.Latitude', 'b.Longitude')} AS m, {_bearing('a.Latitude', 'a.Longitude', 'b.Latitude', 'b.Longitude')} AS g FROM (SELECT DISTINCT PId, Latitude, Longitude FROM ck) a JOIN (SELECT DISTINCT PId, Latitude, Longitude FROM ck) b ON a.PId <> b.PId) "
    f"SELECT a, b, round(m, 4) AS metres, round(g, 6) AS bearing, {_dir_sql('g')} AS direction, {_bins_sql('m', DIST, 'm')} AS distance_bin, round(exp(-m / 500.0), 6) AS kernel FROM p")
def distances_and_bearings(spark, d):
    p = fx.places(spark, d)
    both = p.select(F.col("poi").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("lo"), F.lit(1).alias("k")).join(p.select(F.col("poi").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("lp"), F.lit(1).alias("k")), "k").filter("a <> b")
    m, g = geo.haversine_m("la", "lo", "lb", "lp"), geo.bearing_deg("la", "lo", "lb", "lp")
    both = both.withColumn("m", m).withColumn("g", g)
    return both.select("a", "b", F.round("m", 4).alias("metres"), r6("g", "bearing"), geo.direction_bin("g").alias("direction"), geo.distance_bin("m").alias("distance_bin"), r6(geo.spatial_kernel("m"), "kernel"))


_TOD = "CASE WHEN hour(Time) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(Time) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(Time) BETWEEN 17 AND 21 THEN 'evening' ELSE 'late_night' END"
_DTB = "CASE WHEN hour(Time) BETWEEN 5 AND 10 THEN 'morning' WHEN hour(Time) BETWEEN 11 AND 14 THEN 'midday' WHEN hour(Time) BETWEEN 15 AND 18 THEN 'afternoon' WHEN hour(Time) BETWEEN 19 AND 23 THEN 'evening' ELSE 'night' END"


@query(f"{_SS} SELECT event_id, {_TOD} AS part_of_day, {_DTB} AS decision_bin, CASE WHEN isodow(Time) >= 6 THEN 1 ELSE 0 END AS weekend, {_bins_sql('PrevGapHours * 60.0', GAPS, 'min', chr(39) + 'BOS' + chr(39))} AS gap_bin FROM ss")
def time_bins(spark, d):
    rows = _sessions(spark, d)
    return rows.select("event_id", tf.part_of_day("Time").alias("part_of_day"), tf.decision_time_bin("Time").alias("decision_bin"), tf.is_weekend("Time").alias("weekend"), tf.gap_bin(F.col("PrevGapHours") * 3600).alias("gap_bin"))


@query(f"{_CK}, {fx.TAXONOMY_SQL} SELECT DISTINCT Category, regexp_replace(lower(trim(Category)), '\\s+', '_', 'g') AS token_a, replace(replace(lower(trim(Category)), ' ', '_'), '&', 'and') AS token_b, coalesce(mid, 'unknown') AS mid, coalesce(activity, 'unknown') AS activity FROM ck LEFT JOIN tax ON raw = Category")
def category_tokens(spark, d):
    rows = tx.with_taxonomy(fx.checkins(spark, d).select("Category").distinct(), fx.taxonomy_table(spark))
    return rows.select("Category", tx.token_a("Category").alias("token_a"), tx.token_b("Category").alias("token_b"), "mid", "activity")


# ------------------------------------------------------------------ preprocessing


def _pass_sql(n: int) -> str:
    """n unrolled passes of the frequency filter."""
    out, src = [], "ck"
    for i in range(n):
        out.append(f"u{i} AS (SELECT * FROM {src} WHERE UId IN (SELECT UId FROM {src} GROUP BY UId HAVING count(*) >= 60))")
        out.append(f"f{i} AS (SELECT * FROM u{i} WHERE PId IN (SELECT PId FROM u{i} GROUP BY PId HAVING count(DISTINCT UId) >= 9))")
        src = f"f{i}"
    return ", ".join(out)


@query(f"{_CK}, {_pass_sql(6)} SELECT event_id, UId, PId FROM f5")
def frequency_filter_fixpoint(spark, d):
    return op.frequency_filter(fx.checkins(spark, d), FREQUENT)[0].select("event_id", "UId", "PId")


@query(f"{_CK}, p AS (SELECT * FROM ck WHERE PId IN (SELECT PId FROM ck GROUP BY PId HAVING count(UId) > 95)) SELECT event_id, UId, PId FROM p WHERE UId IN (SELECT UId FROM p GROUP BY UId HAVING count(PId) > 30)")
def frequency_filter_single_pass(spark, d):
    return op.frequency_filter_once(fx.checkins(spark, d), 95, 30).select("event_id", "UId", "PId")


@query(f"{_SS} SELECT event_id, UId, PId, user_session_index, SessionId, round(PrevGapHours, 6) AS PrevGapHours FROM ss")
def sessionize_gap6h(spark, d):
    return _sessions(spark, d).select("event_id", "UId", "PId", "user_session_index", "SessionId", r6("PrevGapHours", "PrevGapHours"))


@query(f"{_SS}, {_BOUNDS} SELECT SessionId, UId, user_session_index, session_start_time, session_end_time, session_len, first_poi, last_poi, round(date_diff('microsecond', session_start_time, session_end_time) / CAST(3.6e9 AS DOUBLE), 6) AS session_duration_hours FROM sb")
def session_boundaries(spark, d):
    out = op.session_boundaries(_sessions(spark, d))
    return out.withColumn("session_duration_hours", F.round("session_duration_hours", 6))


@query(f"{_SS}, {_BOUNDS} SELECT event_id, ss.SessionId FROM ss JOIN sb ON ss.SessionId = sb.SessionId WHERE session_len >= 3")
def short_sessions_dropped(spark, d):
    rows = _sessions(spark, d)
    return op.drop_short_sessions(rows, op.session_boundaries(rows), 3)[0].select("event_id", "SessionId")


_SPLIT = f"sp AS (SELECT SessionId, {_tag_sql('(row_number() OVER (ORDER BY session_start_time, SessionId) - 1)', '(SELECT count(*) FROM sb)')} AS SplitTag FROM sb)"


@query(f"{_SS}, {_BOUNDS}, {_SPLIT} SELECT SessionId, SplitTag FROM sp")
def session_split(spark, d):
    return op.split_sessions(op.session_boundaries(_sessions(spark, d))).select("SessionId", "SplitTag")


@query(f"{_SS}, {_BOUNDS}, {_SPLIT} SELECT event_id, ss.SessionId, SplitTag, row_number() OVER (PARTITION BY ss.SessionId ORDER BY Time, PId, event_id) - 1 AS session_checkin_index, row_number() OVER (PARTITION BY UId ORDER BY Time, PId, event_id) - 1 AS user_checkin_index FROM ss JOIN sp ON ss.SessionId = sp.SessionId")
def split_checkins_by_session(spark, d):
    rows = _sessions(spark, d)
    out = op.attach_split(rows, op.split_sessions(op.session_boundaries(rows)))
    return out.select("event_id", "SessionId", "SplitTag", "session_checkin_index", "user_checkin_index")


@query(f"""{_CK}, {_pass_sql(6)}, {_session_sql(GAP, 'f5')}, {_BOUNDS.replace('FROM ss GROUP BY SessionId', 'FROM ss GROUP BY SessionId HAVING count(*) >= 3')}, {_SPLIT},
fin AS (SELECT ss.* FROM ss JOIN sp ON ss.SessionId = sp.SessionId)
SELECT (SELECT count(*) FROM ck) AS raw_checkins, (SELECT count(DISTINCT UId) FROM ck) AS raw_users, (SELECT count(DISTINCT PId) FROM ck) AS raw_pois,
(SELECT count(*) FROM f5) AS clean_checkins, (SELECT count(DISTINCT UId) FROM f5) AS clean_users, (SELECT count(DISTINCT PId) FROM f5) AS clean_pois,
(SELECT count(*) FROM fin) AS final_checkins, (SELECT count(DISTINCT UId) FROM fin) AS final_users, (SELECT count(DISTINCT PId) FROM fin) AS final_pois,
(SELECT count(*) FROM sp) AS sessions, (SELECT count(*) FROM sp WHERE SplitTag = 'train') AS train_sessions, (SELECT count(*) FROM sp WHERE SplitTag = 'validation') AS validation_sessions, (SELECT count(*) FROM sp WHERE SplitTag = 'test') AS test_sessions""")
def canonical_counters(spark, d):
    """The whole canonical pipeline, as the counters of its metadata document."""
    raw = fx.checkins(spark, d)
    run = canonical.run_canonical(raw, FREQUENT)
    return op.counters(raw, run.clean, run.sessions, run.checkins)


@query(f"{_SS}, {_BOUNDS}, {_SPLIT} SELECT event_id, ss.SessionId FROM ss JOIN sp ON ss.SessionId = sp.SessionId WHERE SplitTag = 'validation'")
def split_tables(spark, d):
    """Both tables written with a folder for each split tag; one split is read back."""
    from .sources.files import write_by_split

    path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/trailmark_splits_" + str(zlib.crc32(d.encode()))
    rows = op.held(_sessions(spark, d))
    sessions = op.split_sessions(op.session_boundaries(rows))
    write_by_split(op.attach_split(rows, sessions), sessions, path)
    return spark.read.parquet(f"{path}/checkins").filter("SplitTag = 'validation'").select("event_id", "SessionId")


_ISO = "iso AS (SELECT * FROM (SELECT *, coalesce(date_diff('microsecond', lag(Time) OVER w, Time), 1e18) AS b, coalesce(date_diff('microsecond', Time, lead(Time) OVER w), 1e18) AS a FROM {} WINDOW w AS (PARTITION BY UId ORDER BY Time, PId, event_id)) WHERE NOT (b > {} * 1e6 AND a > {} * 1e6))"


@query(f"{_CK}, {_ISO.format('ck', 43200, 43200)} SELECT event_id FROM iso")
def isolated_dropped(spark, d):
    return op.drop_isolated(fx.checkins(spark, d), 43_200).select("event_id")


@query(f"{_CK} SELECT event_id FROM (SELECT event_id, PId, lag(PId) OVER (PARTITION BY UId ORDER BY Time, PId, event_id) AS p FROM ck) WHERE p IS NULL OR p <> PId")
def consecutive_repeats_dropped(spark, d):
    return op.drop_consecutive_repeats(fx.checkins(spark, d)).select("event_id")


_CSPLIT = f"cs AS (SELECT *, {_tag_sql('(row_number() OVER (ORDER BY Time, UId, PId, event_id) - 1)', '(SELECT count(*) FROM ck)', '0.8', '0.1')} AS SplitTag FROM ck)"


@query(f"{_CK}, {_CSPLIT} SELECT event_id, SplitTag FROM cs")
def checkin_split(spark, d):
    return op.split_checkins(fx.checkins(spark, d)).select("event_id", "SplitTag")


_LB = f"{_CK}, {_CSPLIT}, {_session_sql(GAP, 'cs').replace('event_id, UId, PId, Category, Latitude, Longitude, Time, CAST', 'event_id, UId, PId, Category, Latitude, Longitude, Time, SplitTag, CAST')}, fl AS (SELECT * EXCLUDE SplitTag, CASE WHEN count(*) OVER (PARTITION BY SessionId) = 1 THEN 'ignore' ELSE SplitTag END AS SplitTag FROM ss)"
_SEEN = "se AS (SELECT * FROM fl WHERE SplitTag = 'train' OR (SplitTag IN ('validation', 'test') AND UId IN (SELECT UId FROM fl WHERE SplitTag = 'train') AND PId IN (SELECT PId FROM fl WHERE SplitTag = 'train')))"
_SQ = "sq AS (SELECT *, row_number() OVER (PARTITION BY UId ORDER BY Time, PId, event_id) AS sequence_id FROM se)"


def _flagged(spark, d):
    return op.flag_singletons(op.assign_sessions(op.split_checkins(fx.checkins(spark, d)), GAP))


def _sequenced(spark, d):
    return op.sequence_ids(op.drop_unseen(_flagged(spark, d)))


@query(f"{_LB} SELECT event_id, SessionId, SplitTag FROM fl")
def singletons_flagged(spark, d):
    return _flagged(spark, d).select("event_id", "SessionId", "SplitTag")


@query(f"{_LB}, {_SEEN}, {_SQ} SELECT event_id, SplitTag, sequence_id FROM sq")
def unseen_dropped(spark, d):
    return _sequenced(spark, d).select("event_id", "SplitTag", "sequence_id")


@query(f"{_LB}, {_SEEN}, {_SQ}, f AS (SELECT PId, min({{'t': Time, 'e': event_id, 'u': UId, 'p': PId}}) AS k FROM (SELECT Time, event_id, UId, PId FROM sq WHERE SplitTag = 'train') GROUP BY PId), "
    "ids AS (SELECT PId, row_number() OVER (ORDER BY k.t, k.u, k.p, k.e) AS id FROM (SELECT PId, arg_min({'t': Time, 'u': UId, 'p': PId, 'e': event_id}, {'t': Time, 'u': UId, 'p': PId, 'e': event_id}) AS k FROM sq WHERE SplitTag = 'train' GROUP BY PId)) SELECT event_id, coalesce(id, 0) AS PoiCode FROM sq LEFT JOIN ids ON sq.PId = ids.PId")
def ids_encoded(spark, d):
    rows = _sequenced(spark, d)
    return op.encode_ids(rows, "PId", op.id_map(rows.filter("SplitTag = 'train'"), "PId"), "PoiCode").select("event_id", "PoiCode")


@query(f"{_LB}, {_SEEN} SELECT UId, string_agg(PId, ',' ORDER BY Time, PId, event_id) AS pois, string_agg(Category, ',' ORDER BY Time, PId, event_id) AS categories FROM se GROUP BY UId")
def user_sequences(spark, d):
    out = op.user_sequences(op.drop_unseen(_flagged(spark, d)), ["PId", "Category"])
    return out.select("UId", F.array_join("PId", ",").alias("pois"), F.array_join("Category", ",").alias("categories"))


@query(f"{_LB}, {_SEEN}, {_SQ} SELECT UId, session_id, greatest(0, end_seq - 49) AS start_seq, end_seq FROM (SELECT min(UId) AS UId, SessionId AS session_id, min(sequence_id) AS s, max(sequence_id) AS end_seq FROM sq GROUP BY SessionId) WHERE s >= 10")
def session_windows(spark, d):
    return op.session_index(_sequenced(spark, d))


@query(f"{_CK}, h AS (SELECT PId, hour(Time) AS hr, count(*) AS n FROM ck GROUP BY ALL) SELECT h.PId, any_value(c.Category) AS Category, string_agg(hr || ':' || n, ',' ORDER BY n DESC, hr) AS hours FROM h JOIN (SELECT DISTINCT PId, Category FROM ck) c ON h.PId = c.PId GROUP BY h.PId")
def poi_hour_histogram(spark, d):
    out = op.poi_hours(fx.checkins(spark, d))
    return out.select("PId", "Category", F.array_join(F.transform("visit_time_and_count", lambda h: F.concat_ws(":", h["hour"], h["count"])), ",").alias("hours"))


@query(f"{_SS} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY SessionId ORDER BY Time, PId, event_id) AS r, count(*) OVER (PARTITION BY SessionId) AS n FROM ss) WHERE n >= 2 AND r < n")
def partial_sessions(spark, d):
    return op.partial_sessions(_sessions(spark, d)).select("event_id")


@query(f"{_SS} SELECT UId, min(Time) AS session_start_time, max(Time) AS session_end_time, count(*) AS stops FROM ss GROUP BY UId, SessionId")
def session_windows_live(spark, d):
    """The live operator over the batch table."""
    return live_sessions(fx.checkins(spark, d))


# ------------------------------------------------------------------ features


@query(f"""{_SS}, t AS (SELECT SessionId, avg(CASE WHEN {_TOD} = 'morning' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN {_TOD} = 'afternoon' THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN {_TOD} = 'evening' THEN 1.0 ELSE 0 END) AS c, avg(CASE WHEN {_TOD} = 'late_night' THEN 1.0 ELSE 0 END) AS e,
CASE WHEN isodow(min(Time)) >= 6 THEN 1 ELSE 0 END AS weekend, ln(1 + date_diff('microsecond', min(Time), max(Time)) / CAST(6e7 AS DOUBLE)) AS l FROM ss GROUP BY SessionId)
SELECT SessionId, round(a, 6) AS tod_morning, round(b, 6) AS tod_afternoon, round(c, 6) AS tod_evening, round(e, 6) AS tod_late_night, weekend, round((l - (SELECT avg(l) FROM t)) / (SELECT stddev_pop(l) FROM t), 6) AS duration_z FROM t""")
def temporal_features(spark, d):
    out = op.held(ft.temporal_features(_sessions(spark, d)))
    out = ft.scaled_duration(out, ft.duration_scale(out))
    return out.select("SessionId", *[r6(f"tod_{p}", f"tod_{p}") for p in ft.PARTS], "weekend", r6("duration_z", "duration_z"))


@query(f"""{_SS}, c AS (SELECT SessionId, avg(Latitude) AS a, avg(Longitude) AS o FROM ss GROUP BY SessionId),
rg AS (SELECT ss.SessionId, sqrt(avg({_km('Latitude', 'Longitude', 'a', 'o')} ** 2)) AS r FROM ss JOIN c ON ss.SessionId = c.SessionId GROUP BY ss.SessionId),
n AS (SELECT SessionId, Category, count(*) AS n FROM ss GROUP BY ALL), pp AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY SessionId) AS DOUBLE) AS p FROM n),
en AS (SELECT SessionId, CASE WHEN count(*) > 1 THEN -sum(p * ln(p + 1e-12)) / ln(count(*)) ELSE -sum(p * ln(p + 1e-12)) END AS h FROM pp GROUP BY SessionId),
o AS (SELECT *, row_number() OVER (PARTITION BY SessionId ORDER BY Time, PId, event_id) <= greatest(1, count(*) OVER (PARTITION BY SessionId) // 2) AS early FROM ss),
q AS (SELECT SessionId, avg(Latitude) FILTER (early) AS a, avg(Longitude) FILTER (early) AS b, avg(Latitude) FILTER (NOT early) AS c, avg(Longitude) FILTER (NOT early) AS d FROM o GROUP BY SessionId)
SELECT rg.SessionId, round(r, 6) AS radius_km, round(h, 6) AS token_entropy, round(coalesce({_km('a', 'b', 'c', 'd')}, 0), 6) AS displacement_km FROM rg JOIN en ON rg.SessionId = en.SessionId JOIN q ON rg.SessionId = q.SessionId""")
def spatial_features(spark, d):
    out = ft.spatial_features(_sessions(spark, d), F.col("Category"))
    return out.select("SessionId", r6("radius_km", "radius_km"), r6("token_entropy", "token_entropy"), r6("displacement_km", "displacement_km"))


_TOKENS = f"{_SS.replace(str(GAP), str(DAY))}, {fx.TAXONOMY_SQL}, tk AS (SELECT ss.*, regexp_replace(lower(trim(Category)), '\\s+', '_', 'g') AS v0, coalesce(mid, 'unknown') AS mid, coalesce(activity, 'unknown') AS activity FROM ss LEFT JOIN tax ON raw = Category)"


def _docs_sql(value: str) -> str:
    return f"{_TOKENS} SELECT SessionId, string_agg(regexp_replace(lower(trim({value})), '\\s+', '_', 'g'), ' ' ORDER BY Time, PId, event_id) AS document FROM tk GROUP BY SessionId"


def _docs(level: str):
    def f(spark, d):
        return ft.category_documents(_sessions(spark, d, DAY), fx.taxonomy_table(spark), level).select("SessionId", "document")

    f.__name__ = f"category_documents_{level}"
    return f


for _level, _value in (("raw", "Category"), ("mid", "mid"), ("activity", "activity")):
    query(_docs_sql(_value))(_docs(_level))


def _absorbed_sql(online: bool) -> str:
    other = "'transit_unresolved'" if online else "last_value(CASE WHEN activity <> 'Transit' THEN v0 END IGNORE NULLS) OVER b"
    return f"""{_TOKENS}, t1 AS (SELECT *, CASE WHEN activity = 'Transit' THEN coalesce(first_value(CASE WHEN activity <> 'Transit' THEN v0 END IGNORE NULLS) OVER f, {other}, v0) ELSE v0 END AS v1 FROM tk
WINDOW f AS (PARTITION BY SessionId ORDER BY Time, PId, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), b AS (PARTITION BY SessionId ORDER BY Time, PId, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ab AS (SELECT *, CASE WHEN activity = 'Neutral' THEN coalesce(last_value(CASE WHEN activity <> 'Neutral' THEN v1 END IGNORE NULLS) OVER b, first_value(CASE WHEN activity <> 'Neutral' THEN v1 END IGNORE NULLS) OVER f, v1) ELSE v1 END AS v2 FROM t1
WINDOW f AS (PARTITION BY SessionId ORDER BY Time, PId, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), b AS (PARTITION BY SessionId ORDER BY Time, PId, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _absorbed(online: bool):
    def f(spark, d):
        out = ft.category_documents(_sessions(spark, d, DAY), fx.taxonomy_table(spark), transit=True, neutral=True, online=online)
        return out.select("SessionId", "document")

    f.__name__ = "absorbed_online" if online else "absorbed_retrospective"
    return f


for _online in (False, True):
    query(_absorbed_sql(_online) + " SELECT SessionId, string_agg(v2, ' ' ORDER BY Time, PId, event_id) AS document FROM ab GROUP BY SessionId")(_absorbed(_online))


@query(_absorbed_sql(False) + ", dd AS (SELECT SessionId, string_agg(v0, ' ' ORDER BY Time, PId, event_id) AS before, string_agg(v2, ' ' ORDER BY Time, PId, event_id) AS after FROM ab GROUP BY SessionId) SELECT * FROM dd WHERE before <> after")
def absorption_report(spark, d):
    return ft.absorption_report(_sessions(spark, d, DAY), fx.taxonomy_table(spark))


@query(f"""{_TOKENS}, e AS (SELECT SessionId, row_number() OVER (PARTITION BY SessionId ORDER BY Time, PId, event_id) AS i, regexp_extract(v0, '\\w(?:\\S*\\w)?') AS w FROM tk),
g AS (SELECT SessionId, w AS term FROM e UNION ALL SELECT a.SessionId, a.w || ' ' || b.w FROM e a JOIN e b ON a.SessionId = b.SessionId AND b.i = a.i + 1),
c AS (SELECT SessionId, term, count(*) AS n FROM g GROUP BY ALL), df AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT SessionId) FROM c)) / (1.0 + count(*))) + 1.0 AS idf FROM c GROUP BY term),
w AS (SELECT c.SessionId, c.term, n * idf AS x FROM c JOIN df ON c.term = df.term) SELECT SessionId, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY SessionId)), 6) AS weight FROM w""")
def tfidf_weights(spark, d):
    docs = ft.category_documents(_sessions(spark, d, DAY), fx.taxonomy_table(spark))
    terms = op.held(ft.terms(docs))
    out = ft.tfidf(terms, ft.inverse_frequencies(terms, docs.count()))
    return out.select("SessionId", "term", r6("weight", "weight"))


@query()
def category_svd(spark, d):
    """Dense category vectors; signs and rotation have no SQL counterpart, lengths are 1."""
    docs = ft.category_documents(_sessions(spark, d, DAY), fx.taxonomy_table(spark))
    terms = op.held(ft.terms(docs))
    dense, _ = ft.truncated_svd(op.held(ft.tfidf(terms, ft.inverse_frequencies(terms, docs.count()))), 16)
    return dense


@query()
def prototypes_assigned(spark, d):
    """Mixture chosen by BIC over the session vectors, with the best three prototypes of each session."""
    _, assigned = prototypes.fit(_sessions(spark, d, DAY))
    return assigned.drop("probability")


@query()
def prefixes_routed(spark, d):
    rows = op.held(_sessions(spark, d, DAY))
    frozen, _ = prototypes.fit(rows)
    return prototypes.route(frozen, op.partial_sessions(rows)).drop("probability")


def _cell_sql(level: int) -> str:
    step = f"(360.0 / (1.0 * pow(7, {level / 2}) * 8))"
    return f"'g{level}:' || CAST(floor((lat + 90.0) / {step}) AS BIGINT) || ':' || CAST(floor((lon + 180.0) / {step}) AS BIGINT)"


def _vector_sql(stops: str) -> str:
    """The nine numbers of sessions without categories, scaled by the sessions that aren't held out; ``stops`` has the
    stops to look at."""
    times = {p: f"avg(CASE WHEN {_TOD} = '{p}' THEN 1.0 ELSE 0 END)" for p in ft.PARTS}
    return f"""st AS ({stops}), t AS (SELECT SessionId, {', '.join(f'{x} AS tod_{p}' for p, x in times.items())}, CASE WHEN isodow(min(Time)) >= 6 THEN 1.0 ELSE 0.0 END AS weekend, ln(1 + date_diff('microsecond', min(Time), max(Time)) / CAST(6e7 AS DOUBLE)) AS l FROM st GROUP BY SessionId),
c AS (SELECT SessionId, avg(Latitude) AS a, avg(Longitude) AS o FROM st GROUP BY SessionId),
rg AS (SELECT st.SessionId, sqrt(avg({_km('Latitude', 'Longitude', 'a', 'o')} ** 2)) AS radius_km FROM st JOIN c ON st.SessionId = c.SessionId GROUP BY st.SessionId),
cn AS (SELECT SessionId, {_cell_sql(8).replace('lat ', 'Latitude ').replace('lon ', 'Longitude ')} AS cell, count(*) AS n FROM st GROUP BY ALL), pp AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY SessionId) AS DOUBLE) AS p FROM cn),
en AS (SELECT SessionId, CASE WHEN count(*) > 1 THEN -sum(p * ln(p + 1e-12)) / ln(count(*)) ELSE -sum(p * ln(p + 1e-12)) END AS token_entropy FROM pp GROUP BY SessionId),
o AS (SELECT *, row_number() OVER (PARTITION BY SessionId ORDER BY Time, PId, event_id) <= greatest(1, count(*) OVER (PARTITION BY SessionId) // 2) AS early FROM st),
q AS (SELECT SessionId, avg(Latitude) FILTER (early) AS a, avg(Longitude) FILTER (early) AS b, avg(Latitude) FILTER (NOT early) AS c, avg(Longitude) FILTER (NOT early) AS d FROM o GROUP BY SessionId),
v0 AS (SELECT t.*, radius_km, token_entropy, coalesce({_km('q.a', 'q.b', 'q.c', 'q.d')}, 0) AS displacement_km FROM t JOIN rg ON t.SessionId = rg.SessionId JOIN en ON t.SessionId = en.SessionId JOIN q ON t.SessionId = q.SessionId),
v AS (SELECT SessionId, [tod_morning, tod_afternoon, tod_evening, tod_late_night, weekend, {', '.join(f"({x} - (SELECT avg({x}) FROM v0 WHERE SessionId % 3 <> 0)) / (SELECT stddev_pop({x}) FROM v0 WHERE SessionId % 3 <> 0)" for x in ('l', *ft.SPATIAL))}] AS f FROM v0)"""


_SHOW_VECTOR = "array_to_string(list_transform(f, lambda x: printf('%.5f', round(x, 5) + 0.0)), ' ')"


def _vectors(rows: DataFrame) -> tuple[DataFrame, prototypes.Scales]:
    """Vectors of all sessions without categories, by the scales of those that aren't held out."""
    _, scales, _ = prototypes.session_vectors(rows.filter("SessionId % 3 <> 0"), dense=False)
    return prototypes.session_vectors(rows, scales, dense=False)[0], scales


def _vector_text(rows: DataFrame) -> DataFrame:
    return rows.select("SessionId", F.array_join(F.transform("features", lambda x: F.format_string("%.5f", F.round(x, 5) + 0.0)), " ").alias("vector"))


_PREFIX_STOPS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY SessionId ORDER BY Time, PId, event_id) AS r, count(*) OVER (PARTITION BY SessionId) AS n FROM ss) WHERE n >= 2 AND r < n"


def _mixture() -> pt.Mixture:
    """A mixture of three by arithmetic, whose posterior SQL can compute."""
    means = np.array([[(3 * k + i) % 5 / 5 for i in range(9)] for k in range(3)])
    return pt.Mixture(np.array([0.5, 0.3, 0.2]), means, np.full((3, 9), 0.5) + np.arange(3)[:, None] / 4, "diag")


def _posterior_sql() -> str:
    m = _mixture()
    joint = [f"{math.log(w)} - 0.5 * ({len(mean) * math.log(2 * math.pi) + float(np.log(cov).sum())} + {' + '.join(f'(f[{i + 1}] - {x}) ** 2 / {c}' for i, (x, c) in enumerate(zip(mean, cov)))})" for w, mean, cov in zip(m.weights, m.means, m.covariances)]
    return f"""j AS (SELECT SessionId, unnest([0, 1, 2]) AS k, unnest([{', '.join(joint)}]) AS j FROM v), ps AS (SELECT SessionId, k, exp(j - max(j) OVER s) / sum(exp(j)) OVER s * exp(max(j) OVER s) AS p FROM j WINDOW s AS (PARTITION BY SessionId)),
pa AS (SELECT SessionId, list(k ORDER BY p DESC, k) AS ks, list(p ORDER BY p DESC, k) AS ps, -sum(p * ln(p + 1e-12)) AS h FROM ps GROUP BY SessionId)"""


@query(f"{_DD}, {_vector_sql('SELECT * FROM ss')} SELECT SessionId, {_SHOW_VECTOR} AS vector FROM v")
def session_vectors_without_categories(spark, d):
    return _vector_text(_vectors(op.held(_sessions(spark, d, DAY)))[0])


@query(f"{_DD}, {_vector_sql(_PREFIX_STOPS)} SELECT SessionId, {_SHOW_VECTOR} AS vector FROM v WHERE SessionId % 3 = 0")
def prefix_vectors_frozen(spark, d):
    """Prefixes of the held-out sessions, transformed alone by what the prefixes of the others were scaled by."""
    partial = op.held(op.partial_sessions(_sessions(spark, d, DAY)))
    _, scales, _ = prototypes.session_vectors(partial.filter("SessionId % 3 <> 0"), dense=False)
    return _vector_text(prototypes.session_vectors(partial.filter(HELD_OUT), scales, dense=False)[0])


@query(f"{_DD}, {_vector_sql('SELECT * FROM ss')}, {_posterior_sql()}, mt AS (SELECT SessionId, min(UId) AS UId, min(Time) AS session_start_time, count(*) AS session_len FROM ss GROUP BY SessionId) SELECT pa.SessionId, UId, session_start_time, session_len, CAST(ks[1] AS INT) AS prototype_id, round(ps[1], 5) AS confidence, round(ps[1] - ps[2], 5) AS top2_gap, CAST(ks[2] AS INT) AS second, CAST(ks[3] AS INT) AS third, round(ps[3], 5) AS third_prob FROM pa JOIN mt ON pa.SessionId = mt.SessionId")
def sessions_assigned(spark, d):
    """Posteriors of a given mixture, the best three prototypes, and the sessions' own columns beside them."""
    rows = op.held(_sessions(spark, d, DAY))
    meta = op.session_boundaries(rows).select("SessionId", "UId", "session_start_time", "session_len")
    out = pt.with_meta(pt.top_prototypes(pt.posteriors(_vectors(rows)[0], _mixture())), meta)
    return out.select("SessionId", "UId", "session_start_time", "session_len", "prototype_id", F.round("prototype_confidence", 5).alias("confidence"), F.round("prototype_top2_gap", 5).alias("top2_gap"), F.col("top2_prototype_id").alias("second"), F.col("top3_prototype_id").alias("third"), F.round("top3_prototype_prob", 5).alias("third_prob"))


@query(f"{_DD}, {_vector_sql('SELECT * FROM ss')}, {_posterior_sql()}, n AS (SELECT ks[1] AS k, count(*) AS n, avg(ps[1]) AS p FROM pa GROUP BY ALL), e AS (SELECT unnest([0, 1, 2]) AS k, unnest([0.5, 0.3, 0.2]) AS w) SELECT CAST(e.k AS INT) AS prototype_id, round(CAST(w AS DOUBLE), 6) AS mixture_weight, coalesce(n, 0) AS train_hard_count, round(coalesce(p, 0), 5) AS mean_self_posterior, round(coalesce(n, 0) / CAST((SELECT count(*) FROM pa) AS DOUBLE), 6) AS train_hard_fraction FROM e LEFT JOIN n ON e.k = n.k")
def prototypes_summarised(spark, d):
    assigned = pt.top_prototypes(pt.posteriors(_vectors(op.held(_sessions(spark, d, DAY)))[0], _mixture()))
    out = pt.prototype_summary(op.held(assigned), _mixture())
    return out.select("prototype_id", r6("mixture_weight", "mixture_weight"), "train_hard_count", F.round("mean_self_posterior", 5).alias("mean_self_posterior"), r6("train_hard_fraction", "train_hard_fraction"))


@query(f"{_DD}, {_vector_sql(_PREFIX_STOPS)}, {_posterior_sql()}, z AS (SELECT SessionId, count(*) >= 3 AS ok FROM st GROUP BY SessionId) SELECT pa.SessionId, ok AS routing_applied, CASE WHEN ok THEN CAST(ks[1] AS INT) END AS prototype_id, CASE WHEN ok THEN CAST(ks[2] AS INT) END AS second, CASE WHEN ok THEN round(h, 5) END AS entropy FROM pa JOIN z ON pa.SessionId = z.SessionId WHERE pa.SessionId % 3 = 0")
def prefixes_routed_by_given_mixture(spark, d):
    """Held-out prefixes through frozen scales and a given mixture; those of less than three stops aren't routed."""
    partial = op.held(op.partial_sessions(_sessions(spark, d, DAY)))
    _, scales, _ = prototypes.session_vectors(partial.filter("SessionId % 3 <> 0"), dense=False)
    frozen = prototypes.Frozen(scales, None, _mixture(), [], SpatialConfig.coarse_resolution)
    out = prototypes.route(frozen, partial.filter(HELD_OUT))
    return out.select("SessionId", "routing_applied", "prototype_id", F.col("top2_prototype_id").alias("second"), F.round("posterior_entropy", 5).alias("entropy"))


# ------------------------------------------------------------------ space

SPATIAL = SpatialConfig(density_radius_m=400.0)
_PL = f"{_CK}, {fx.PLACES_SQL}, {fx.NODES_SQL}, {fx.EDGES_SQL}"
_DENS = f"de AS (SELECT a.poi, count(b.poi) AS density_count FROM pl a LEFT JOIN pl b ON a.poi <> b.poi AND {_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 400 GROUP BY a.poi)"
_NEAR = f"nn AS (SELECT poi, node_id FROM (SELECT poi, node_id, row_number() OVER (PARTITION BY poi ORDER BY {_m('pl.lat', 'pl.lon', 'nd.lat', 'nd.lon')}, node_id) AS r FROM pl, nd) WHERE r = 1)"
_DEG = "dg AS (SELECT node_id, count(*) AS node_degree FROM (SELECT u AS node_id FROM ed UNION ALL SELECT v FROM ed) GROUP BY node_id)"


def _rank_sql(value: str, src: str, letter: str) -> str:
    ranked = f"(rank() OVER (PARTITION BY {value} IS NULL ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0) / count({value}) OVER ()"
    return f"CASE WHEN {value} IS NULL THEN '{letter}_UNK' ELSE '{letter}' || CAST(least(5, greatest(1, CAST(ceil({ranked} * 5) AS INT))) AS VARCHAR) END"


_DESC = f"{_DENS}, {_NEAR}, {_DEG}, dx AS (SELECT de.poi, density_count, nn.node_id, node_degree FROM de JOIN nn ON de.poi = nn.poi LEFT JOIN dg ON nn.node_id = dg.node_id)"


@query(f"{_PL}, {_DESC} SELECT poi, density_count, node_id AS nearest_graph_node_id, node_degree, {_rank_sql('density_count', 'dx', 'D')} AS density_bin, {_rank_sql('node_degree', 'dx', 'C')} AS connectivity_bin FROM dx")
def poi_descriptors(spark, d):
    out = sp.descriptors(fx.places(spark, d), fx.nodes(spark), fx.edges(spark), SPATIAL)
    return out.select("poi", "density_count", "nearest_graph_node_id", "node_degree", "density_bin", "connectivity_bin")


@query(f"{_PL} SELECT a.poi AS src, b.poi AS dst, round({_m('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) AS distance_m FROM pl a JOIN pl b ON a.poi <> b.poi AND {_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1000")
def range_pairs_1km(spark, d):
    p = fx.places(spark, d)
    return sp.range_join(p, p, 1000.0).filter("l_poi <> r_poi").select(F.col("l_poi").alias("src"), F.col("r_poi").alias("dst"), F.round("distance_m", 4).alias("distance_m"))


@query(f"{_CK}, {fx.PLACES_SQL} SELECT poi, {_cell_sql(8)} AS coarse, {_cell_sql(9)} AS fine FROM pl")
def region_cells(spark, d):
    return fx.places(spark, d).select("poi", geo.cell_id("lat", "lon", 8).alias("coarse"), geo.cell_id("lat", "lon", 9).alias("fine"))


_PATHS = "un AS (SELECT u, v, min(length) AS length FROM (SELECT u, v, length FROM ed UNION ALL SELECT v, u, length FROM ed) GROUP BY u, v), wk(src, node, dist) AS (SELECT node_id, node_id, CAST(0 AS DOUBLE) FROM nd UNION SELECT wk.src, un.v, wk.dist + un.length FROM wk JOIN un ON wk.node = un.u WHERE wk.dist + un.length <= {}), sh AS (SELECT src, node, min(dist) AS distance FROM wk GROUP BY src, node)"


@query(f"{_PL}, {_PATHS.format(1050)} SELECT src, node, round(distance, 6) AS distance FROM sh")
def bounded_paths(spark, d):
    return sp.shortest_paths(fx.nodes(spark), fx.edges(spark), 1050.0).select("src", "node", r6("distance", "distance"))


PAIRS = SpatialConfig(density_radius_m=400.0)
_PAIR = f"""{_NEAR}, {_PATHS.format(2050)}, pq AS (SELECT a.poi AS src_POIId, b.poi AS dst_POIId, na.node_id AS na, nb.node_id AS nb, {_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS h, {_bearing('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS bearing_deg
FROM pl a JOIN pl b ON {_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1000 AND {_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} > 0 JOIN nn na ON na.poi = a.poi JOIN nn nb ON nb.poi = b.poi),
pr AS (SELECT pq.*, distance AS road, coalesce(distance, 2 * h) AS fin FROM pq LEFT JOIN sh ON sh.src = na AND sh.node = nb),
pk AS (SELECT *, {_dir_sql('bearing_deg')} AS direction_bin, {_bins_sql('fin', DIST, 'm')} AS distance_bin FROM pr)"""


def _pairs(spark, d) -> DataFrame:
    places = fx.places(spark, d)
    near = sp.nearest_node(places, fx.nodes(spark)).select("poi", "node_id")
    return sp.pair_lookup(places.join(near, "poi"), fx.edges(spark), PAIRS)


@query(f"{_PL}, {_PAIR} SELECT src_POIId, dst_POIId, round(h, 4) AS haversine_distance_m, round(road, 4) AS road_distance_m, road IS NULL AS used_haversine_fallback, round(fin, 4) AS final_distance_m, round(bearing_deg, 6) AS bearing_deg, direction_bin, distance_bin FROM pk")
def pair_lookup(spark, d):
    out = _pairs(spark, d)
    return out.select("src_POIId", "dst_POIId", *[F.round(c, 4).alias(c) for c in ("haversine_distance_m", "road_distance_m")], "used_haversine_fallback", F.round("final_distance_m", 4).alias("final_distance_m"), r6("bearing_deg", "bearing_deg"), "direction_bin", "distance_bin")


_MOVE = f"""t0 AS (SELECT SessionId, PId AS dst, lag(PId) OVER w AS src, date_diff('microsecond', lag(Time) OVER w, Time) / CAST(1e6 AS DOUBLE) AS gap_s, lag(Latitude) OVER w AS a, lag(Longitude) OVER w AS b, Latitude AS c, Longitude AS d, row_number() OVER w - 2 AS transition_index FROM ss WINDOW w AS (PARTITION BY SessionId ORDER BY Time, PId, event_id)),
t1 AS (SELECT t0.*, coalesce(fin, 2 * {_m('a', 'b', 'c', 'd')}) AS final_distance_m, coalesce(pk.bearing_deg, {_bearing('a', 'b', 'c', 'd')}) AS bearing_deg, pk.distance_bin AS db, pk.direction_bin AS gb FROM t0 LEFT JOIN pk ON pk.src_POIId = src AND pk.dst_POIId = dst WHERE transition_index >= 0),
tr AS (SELECT SessionId, transition_index, src AS src_POIId, dst AS dst_POIId, gap_s, {_bins_sql('gap_s / 60.0', GAPS, 'min')} AS gap_bin, final_distance_m, coalesce(db, {_bins_sql('final_distance_m', DIST, 'm')}) AS distance_bin, bearing_deg, coalesce(gb, {_dir_sql('bearing_deg')}) AS direction_bin FROM t1)"""
_TR = f"{_PL}, {_PAIR}, {_session_sql(DAY)}, {_MOVE}"


def _moves(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = op.held(_sessions(spark, d, DAY))
    return rows, op.held(sp.transitions(rows, op._cut(_pairs(spark, d)), cfg=PAIRS))


@query(f"{_TR} SELECT SessionId, transition_index, src_POIId, dst_POIId, round(gap_s, 6) AS gap_s, gap_bin, round(final_distance_m, 4) AS final_distance_m, distance_bin, round(bearing_deg, 6) AS bearing_deg, direction_bin FROM tr")
def session_transitions(spark, d):
    _, out = _moves(spark, d)
    return out.select("SessionId", "transition_index", "src_POIId", "dst_POIId", r6("gap_s", "gap_s"), "gap_bin", F.round("final_distance_m", 4).alias("final_distance_m"), "distance_bin", r6("bearing_deg", "bearing_deg"), "direction_bin")


# ------------------------------------------------------------------ decision states and retrieval

_STATES = f"""b0 AS (SELECT *, row_number() OVER (PARTITION BY SessionId, PId ORDER BY Time, PId, event_id) = 1 AS fp, row_number() OVER (PARTITION BY SessionId, Category ORDER BY Time, PId, event_id) = 1 AS fc FROM ss),
b1 AS (SELECT SessionId, UId, PId AS current_POIId, Category AS current_category, Time, Latitude, Longitude, row_number() OVER w - 1 AS decision_index, lead(PId) OVER w AS next_POIId, lead(Time) OVER w AS next_time, lead(Category) OVER w AS next_category, {_DTB} AS current_time_bin,
date_diff('microsecond', min(Time) OVER (PARTITION BY SessionId), Time) / CAST(1e6 AS DOUBLE) / 60.0 AS elapsed, sum(CASE WHEN fp THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS up, sum(CASE WHEN fc THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS uc FROM b0 WINDOW w AS (PARTITION BY SessionId ORDER BY Time, PId, event_id)),
bs AS (SELECT b1.*, p1.gap_s AS g1, p1.gap_bin AS gb1, p1.final_distance_m AS d1, p1.distance_bin AS db1, p1.bearing_deg AS r1, p1.direction_bin AS rb1, p2.gap_s AS g2, p2.gap_bin AS gb2, p2.final_distance_m AS d2, p2.distance_bin AS db2, p2.bearing_deg AS r2, p2.direction_bin AS rb2, dx.density_count, dx.node_degree
FROM b1 LEFT JOIN tr p1 ON p1.SessionId = b1.SessionId AND p1.transition_index = decision_index - 1 LEFT JOIN tr p2 ON p2.SessionId = b1.SessionId AND p2.transition_index = decision_index - 2 JOIN dx ON dx.poi = current_POIId)"""
_DESC2 = f"{_DENS}, {_DEG}, dx AS (SELECT de.poi, density_count, nn.node_id, node_degree FROM de JOIN nn ON de.poi = nn.poi LEFT JOIN dg ON nn.node_id = dg.node_id)"
_ST = f"{_TR}, {_DESC2}, {_STATES}"
_STATE_COLS = """SessionId, decision_index, current_POIId, current_category, current_time_bin, decision_index + 1 AS prefix_len, round(elapsed * 60.0, 6) AS prefix_elapsed_s, CAST(up AS BIGINT) AS prefix_unique_poi_count, CAST(uc AS BIGINT) AS prefix_unique_category_count, round(1.0 - up / CAST(decision_index + 1 AS DOUBLE), 6) AS prefix_repeat_ratio,
coalesce(gb1, 'BOS') AS prev1_gap_bin, coalesce(db1, 'BOS') AS prev1_distance_bin, coalesce(rb1, 'BOS') AS prev1_direction_bin, round(g2, 6) AS prev2_gap_s, round(d2, 4) AS prev2_distance_m, density_count AS curr_density_count"""


def _states(spark, d, current: bool = False) -> DataFrame:
    rows, moves = _moves(spark, d)
    places = op._cut(sp.descriptors(fx.places(spark, d), fx.nodes(spark), fx.edges(spark), SPATIAL))
    return (st.current_states if current else st.decision_states)(rows, moves, places)


def _shown(df: DataFrame, *more) -> DataFrame:
    return df.select("SessionId", "decision_index", "current_POIId", "current_category", "current_time_bin", "prefix_len", F.round(F.col("prefix_elapsed_min") * 60.0, 6).alias("prefix_elapsed_s"), "prefix_unique_poi_count", "prefix_unique_category_count", r6("prefix_repeat_ratio", "prefix_repeat_ratio"), "prev1_gap_bin", "prev1_distance_bin", "prev1_direction_bin", r6("prev2_gap_s", "prev2_gap_s"), F.round("prev2_distance_m", 4).alias("prev2_distance_m"), "curr_density_count", *more)


@query(f"{_ST} SELECT {_STATE_COLS}, next_POIId, next_category FROM bs WHERE next_time IS NOT NULL")
def decision_states(spark, d):
    return _shown(_states(spark, d), "next_POIId", "next_category")


@query(f"{_ST} SELECT {_STATE_COLS} FROM bs WHERE next_time IS NULL")
def current_states(spark, d):
    return _shown(_states(spark, d, current=True))


#: Retrieval over sessions of two splits: later sessions ask, earlier ones answer.
RETRIEVAL = RetrievalConfig(top_k_cases=5, top_k_candidates=3)
_RAWV = {
    "context": ["CAST(density_count AS DOUBLE)", "CAST(coalesce(node_degree, 0) AS DOUBLE)"],
    "movement": [x for k in (1, 2) for x in (f"coalesce(ln(1 + d{k}), 0)", f"coalesce(ln(1 + g{k}), 0)", f"coalesce(sin(radians(r{k})), 0)", f"coalesce(cos(radians(r{k})), 0)")],
    "prefix": ["elapsed", "1.0 - up / CAST(decision_index + 1 AS DOUBLE)", "CAST(up AS DOUBLE)", "CAST(uc AS DOUBLE)"],
}


def _encoder_sql() -> str:
    cols = [(b, i, x) for b, xs in _RAWV.items() for i, x in enumerate(xs)]
    raw = ", ".join(f"{x} AS {b}{i}" for b, i, x in cols)
    z = ", ".join(f"({b}{i} - (SELECT avg({b}{i}) FROM e0 WHERE cs)) / coalesce(nullif((SELECT stddev_pop({b}{i}) FROM e0 WHERE cs), 0), 1) AS {b}{i}" for b, i, _ in cols)
    blocks = {b: [f"{b}{i}" for i in range(len(xs))] for b, xs in _RAWV.items()}
    norms = ", ".join(f"sqrt({' + '.join(f'{x} * {x}' for x in xs)}) AS n_{b}" for b, xs in blocks.items())
    weight = {"context": 1.0, "movement": 2.0, "prefix": 1.0}
    parts = ["[1.5 * sin(2.0 * pi() * hr / 24.0), 1.5 * cos(2.0 * pi() * hr / 24.0)]"]
    parts += [f"[{', '.join(f'{x} / (CASE WHEN n_{b} < 1e-12 THEN 1.0 ELSE n_{b} END) * {weight[b]}' for x in xs)}]" for b, xs in blocks.items()]
    parts.append("list_transform((SELECT list(c ORDER BY c) FROM (SELECT DISTINCT current_category AS c FROM e0 WHERE cs)), lambda c: CASE WHEN c = current_category THEN 1.5 ELSE 0.0 END)")
    return f"""e0 AS (SELECT bs.*, hour(Time) + minute(Time) / CAST(60.0 AS DOUBLE) AS hr, next_time IS NOT NULL AND SessionId % 3 <> 0 AS cs, {raw} FROM bs),
e1 AS (SELECT * EXCLUDE ({', '.join(f'{b}{i}' for b, i, _ in cols)}), {z} FROM e0), e2 AS (SELECT *, {norms} FROM e1),
ev AS (SELECT SessionId, decision_index, Latitude, Longitude, next_POIId, next_category, cs, next_time, {' || '.join(parts)} AS vec FROM e2)"""


def _encoded(spark, d):
    states = op.held(_states(spark, d))
    cases = states.filter("SessionId % 3 <> 0")
    encoder = rt.StateEncoder.fit(cases, RETRIEVAL)
    return states, cases, encoder


@query(f"{_ST}, {_encoder_sql()} SELECT SessionId, decision_index, array_to_string(list_transform(vec, lambda x: printf('%.4f', round(x, 4) + 0.0)), ' ') AS vector FROM ev WHERE cs")
def encoder_vectors(spark, d):
    _, cases, encoder = _encoded(spark, d)
    text = F.array_join(F.transform("vector", lambda x: F.format_string("%.4f", F.round(x, 4) + 0.0)), " ")
    return encoder.transform(cases).select("SessionId", "decision_index", text.alias("vector"))


_RETR = f"""{_encoder_sql()}, rq AS (SELECT SessionId, decision_index, Latitude, Longitude, vec, row_number() OVER (PARTITION BY SessionId ORDER BY decision_index DESC) AS r FROM ev WHERE next_time IS NOT NULL AND SessionId % 3 = 0),
r0 AS (SELECT q.SessionId AS query, c.SessionId AS case_session, c.decision_index AS case_index, c.next_POIId, c.next_category, list_dot_product(q.vec, c.vec) / sqrt(list_dot_product(q.vec, q.vec)) / sqrt(list_dot_product(c.vec, c.vec)) AS cosine_score, exp(-{_m('q.Latitude', 'q.Longitude', 'c.Latitude', 'c.Longitude')} / 500.0) AS spatial_score FROM rq q JOIN ev c ON c.cs AND c.SessionId <> q.SessionId WHERE q.r = 1),
r1 AS (SELECT *, 0.3 * spatial_score + 0.7 * cosine_score AS retrieval_score FROM r0), rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(retrieval_score, 9) DESC, case_session, case_index) AS rank FROM r1) WHERE rank <= 5)"""


def _retrieved(spark, d, asking: str = HELD_OUT, **how) -> DataFrame:
    states, cases, encoder = _encoded(spark, d)
    last = states.filter(asking)
    last = last.join(last.groupBy("SessionId").agg(F.max("decision_index").alias("decision_index")), ["SessionId", "decision_index"], "left_semi")
    from .functions.vectors import unit

    queries = encoder.transform(last, "_v").select(F.col("SessionId").alias("query"), "SessionId", unit("_v").alias("vector"), "curr_lat", "curr_lon")
    return rt.retrieve(queries, rt.index_of(cases, encoder), RETRIEVAL, **how)


@query(f"{_ST}, {_RETR} SELECT query, CAST(rank AS INT) AS rank, round(retrieval_score, 5) AS retrieval_score FROM rr")
def retrieval_top_k(spark, d):
    return _retrieved(spark, d).select("query", "rank", F.round("retrieval_score", 5).alias("retrieval_score"))


@query(f"""{_ST}, {_RETR}, p0 AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(cosine_score, 9) DESC, case_session, case_index) <= 25),
p1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(retrieval_score, 9) DESC, case_session, case_index) AS INT) AS rank FROM p0)
SELECT query, rank, case_session, case_index, round(retrieval_score, 5) AS retrieval_score FROM p1 WHERE rank <= 5""")
def retrieval_two_stages(spark, d):
    """Preselection by cosine, then the whole score."""
    return _retrieved(spark, d, preselect=True).select("query", "rank", "case_session", "case_index", F.round("retrieval_score", 5).alias("retrieval_score"))


def _cand_sql(limit: int) -> str:
    return f"""cw AS (SELECT *, exp(retrieval_score - max(retrieval_score) OVER (PARTITION BY query)) AS x FROM rr WHERE next_POIId IS NOT NULL), cx AS (SELECT *, x / sum(x) OVER (PARTITION BY query) AS w FROM cw),
cy AS (SELECT query, next_POIId, sum(w) AS w, count(*) AS n, max(retrieval_score) AS mx, avg(retrieval_score) AS mn, arg_min(next_category, rank) FILTER (next_category IS NOT NULL) AS next_category, count(DISTINCT case_session) AS sessions FROM cx GROUP BY query, next_POIId),
cz AS (SELECT *, w / sum(w) OVER (PARTITION BY query) AS prob, CAST(row_number() OVER (PARTITION BY query ORDER BY round(w, 9) DESC, n DESC, round(mx, 9) DESC, next_POIId) AS INT) AS candidate_rank FROM cy QUALIFY candidate_rank <= {limit})"""


@query(f"{_ST}, {_RETR}, {_cand_sql(3)} SELECT query, next_POIId, candidate_rank, round(w, 6) AS candidate_weight, n AS support_case_count, round(mx, 6) AS max_case_score, round(mn, 6) AS mean_case_score, round(prob, 6) AS candidate_prob, next_category, sessions AS support_session_count FROM cz")
def candidate_places(spark, d):
    out = rt.candidates(_retrieved(spark, d), 1.0, RETRIEVAL.top_k_candidates)
    return out.select("query", "next_POIId", "candidate_rank", r6("candidate_weight", "candidate_weight"), "support_case_count", r6("max_case_score", "max_case_score"), r6("mean_case_score", "mean_case_score"), r6("candidate_prob", "candidate_prob"), "next_category", "support_session_count")


@query("""WITH c AS (SELECT l_orderkey AS query, CAST(l_suppkey AS VARCHAR) AS next_POIId, l_linenumber AS rank, CAST((l_partkey % 97) AS DOUBLE) / 97 AS s, CAST(l_suppkey % 7 AS VARCHAR) AS next_category FROM lineitem),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY query)) AS x FROM c), w AS (SELECT *, x / sum(x) OVER (PARTITION BY query) AS w FROM e),
a AS (SELECT query, next_POIId, sum(w) AS cw, count(*) AS n, max(s) AS mx, avg(s) AS mn FROM w GROUP BY ALL)
SELECT query, next_POIId, CAST(row_number() OVER (PARTITION BY query ORDER BY round(cw, 9) DESC, n DESC, round(mx, 9) DESC, next_POIId) AS INT) AS candidate_rank, round(cw, 6) AS candidate_weight, n AS support_case_count, round(mx, 6) AS max_case_score, round(mn, 6) AS mean_case_score FROM a QUALIFY candidate_rank <= 10""")
def candidates_of_orders(spark, d):
    """Candidate aggregation over order lines as cases: places are suppliers, scores come from parts."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    cases = rows.select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").cast("string").alias("next_POIId"), F.col("l_linenumber").alias("rank"), ((F.col("l_partkey") % 97).cast("double") / 97).alias("retrieval_score"), (F.col("l_suppkey") % 7).cast("string").alias("next_category"), F.col("l_linenumber").alias("case_session"))
    out = rt.candidates(cases)
    return out.select("query", "next_POIId", F.col("candidate_rank").cast("int").alias("candidate_rank"), r6("candidate_weight", "candidate_weight"), "support_case_count", r6("max_case_score", "max_case_score"), r6("mean_case_score", "mean_case_score"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)
SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(c, 5) AS cosine FROM (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, b.vec_id) AS rank FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5""")
def cosine_top_k(spark, d):
    out = rt.cosine_top_k(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("id") % 20 == 0, 5)
    return out.select("query_id", "vec_id", "rank", F.round("cosine", 5).alias("cosine"))


# ------------------------------------------------------------------ prompts and evaluation

SETTINGS = Settings(spatial=PAIRS, retrieval=RetrievalConfig(top_k_cases=5, top_k_candidates=5))


def _evaluation(spark, d) -> DataFrame:
    rows = op.held(_sessions(spark, d, DAY))
    assets = next_place.build_assets(rows.filter("SessionId % 3 <> 0"), fx.places(spark, d), fx.nodes(spark), fx.edges(spark), fx.place_meta(spark), settings=SETTINGS)
    return next_place.evaluate(assets, rows.filter(HELD_OUT))


_EVAL = f"""{_ST}, {_RETR}, {_cand_sql(5)}, go AS (SELECT SessionId, count(*) AS n_checkins, arg_max(PId, {{'t': Time, 'p': PId, 'e': event_id}}) AS gold FROM ss WHERE SessionId % 3 = 0 GROUP BY SessionId),
pd AS (SELECT SessionId, n_checkins, n_checkins < 2 AS skipped, gold AS gold_next_poi_id, next_POIId AS selected_poi_id, CASE WHEN n_checkins >= 2 THEN next_POIId = gold END AS is_correct_at_1, CASE WHEN n_checkins < 2 THEN 'fewer than 2 check-ins' END AS skip_reason, CAST(NULL AS VARCHAR) AS error FROM go LEFT JOIN cz ON query = SessionId AND candidate_rank = 1)"""


@query(f"{_EVAL} SELECT SessionId, n_checkins, skipped, skip_reason, gold_next_poi_id, selected_poi_id, is_correct_at_1, error FROM pd")
def next_place_predictions(spark, d):
    """States, retrieval, candidates, prompts, stub answers and their reading, session by session."""
    return _evaluation(spark, d).select("SessionId", "n_checkins", "skipped", "skip_reason", "gold_next_poi_id", "selected_poi_id", "is_correct_at_1", "error")


@query(f"{_EVAL} SELECT count(*) AS evaluated, round(avg(CASE WHEN is_correct_at_1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1 FROM pd WHERE NOT skipped")
def hit_at_1(spark, d):
    return pr.hit_at_1(_evaluation(spark, d)).withColumn("hit_at_1", F.round("hit_at_1", 6))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value / 100.0 <= 0.10 THEN 'The observed prefix is mostly exploratory, with little repetition so far.' WHEN value / 100.0 <= 0.30 THEN 'The observed prefix is moderately exploratory, with some repetition but mostly new stops.' ELSE 'The observed prefix shows noticeable repetition, suggesting a more routine or backtracking pattern.' END AS exploration,
'The current stop is located in ' || CASE WHEN event_id % 130 >= 100 THEN 'a very dense urban zone' WHEN event_id % 130 >= 30 THEN 'a moderately dense urban zone' ELSE 'a relatively sparse local area' END || ' ' || CASE WHEN event_id % 6 >= 4 THEN 'with high local street connectivity' WHEN event_id % 6 >= 2 THEN 'with moderate local street connectivity' ELSE 'with limited local street connectivity' END || '.' AS area FROM events""")
def prompt_sentences(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    ratio = F.when(F.col("value").isNotNull(), F.col("value") / 100.0)
    return e.select("event_id", F.when(ratio.isNotNull(), pr.exploration_text(ratio)).alias("exploration"), pr.area_text(F.col("event_id") % 130, F.col("event_id") % 6).alias("area"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 3 OR event_id % 7 > 2 THEN '0' ELSE CAST(event_id % 7 AS VARCHAR) END AS selected_poi_id, CASE WHEN event_id % 5 = 3 THEN 'not a JSON object' END AS parse_error FROM events""")
def answers_read(spark, d):
    """Answers in five forms, made from the events: plain, fenced, number, broken, ranking only."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 7).cast("string").alias("k"))
    form = F.col("event_id") % 5
    text = (
        F.when(form == 0, F.concat(F.lit('{"selected_poi_id": "'), "k", F.lit('"}')))
        .when(form == 1, F.concat(F.lit('Sure:\n```json\n{"selected_poi_id": " '), "k", F.lit('"}\n```')))
        .when(form == 2, F.concat(F.lit('{"selected_poi_id": '), "k", F.lit("}")))
        .when(form == 3, F.lit("no idea"))
        .otherwise(F.concat(F.lit('{"selected_poi_id": "", "ranking": [{"rank": 1, "poi_id": "'), "k", F.lit('"}]}')))
    )
    rows = e.withColumn("llm_raw_text", text).withColumn("fallback_ids", F.array(F.lit("0"), F.lit("1"), F.lit("2")))
    return pr.read_answers(rows).select("event_id", "selected_poi_id", "parse_error")


# ------------------------------------------------------------------ session to session


def _assigned(rows: DataFrame) -> DataFrame:
    """Prototypes by arithmetic: a stand-in for a fitted mixture that SQL can repeat."""
    s = rows.select("SessionId").distinct()
    k = F.col("SessionId")
    return s.select("SessionId", (k % 7).cast("int").alias("prototype_id"), k.alias("position"), (k % 7).cast("int").alias("top1_prototype_id"), ((k + 3) % 7).cast("int").alias("top2_prototype_id"), F.when(k % 2 == 0, (k + 5) % 7).cast("int").alias("top3_prototype_id"))


_CAND = """sx AS (SELECT DISTINCT SessionId FROM ss), pool AS (SELECT SessionId, SessionId % 7 AS p, row_number() OVER (PARTITION BY SessionId % 7 ORDER BY SessionId) AS r FROM sx WHERE SessionId % 3 <> 0),
qs AS (SELECT SessionId, m, CASE m WHEN 0 THEN SessionId % 7 WHEN 1 THEN (SessionId + 3) % 7 ELSE CASE WHEN SessionId % 2 = 0 THEN (SessionId + 5) % 7 END END AS p FROM sx, range(3) t(m) WHERE SessionId % 3 = 0),
cd AS (SELECT qs.SessionId AS query_session, pool.SessionId AS candidate_session, min(m * 1000 + r) AS o FROM qs JOIN pool ON qs.p = pool.p AND pool.r <= 50 WHERE qs.SessionId <> pool.SessionId GROUP BY ALL)"""


def _candidate_pairs(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = op.held(_sessions(spark, d, DAY))
    a = _assigned(rows)
    return rows, cs.candidate_sessions(a.filter(HELD_OUT), a.filter("SessionId % 3 <> 0"))


@query(f"{_DD}, {_CAND} SELECT query_session, candidate_session, CAST(row_number() OVER (PARTITION BY query_session ORDER BY o) AS INT) AS place FROM cd")
def case_candidates(spark, d):
    return _candidate_pairs(spark, d)[1].select("query_session", "candidate_session", "place")


@query(f"""{_DD}, {_CAND}, la AS (SELECT SessionId, arg_max(Category, {{'t': Time, 'p': PId, 'e': event_id}}) AS c, arg_max(Latitude, {{'t': Time, 'p': PId, 'e': event_id}}) AS a, arg_max(Longitude, {{'t': Time, 'p': PId, 'e': event_id}}) AS o FROM ss GROUP BY SessionId)
SELECT query_session, candidate_session, CASE WHEN q.c = k.c OR {_km('q.a', 'q.o', 'k.a', 'k.o', radius='6371.0')} <= 1.0 THEN 1 ELSE 0 END AS label FROM cd JOIN la q ON q.SessionId = query_session JOIN la k ON k.SessionId = candidate_session""")
def case_labels(spark, d):
    rows, pairs = _candidate_pairs(spark, d)
    return cs.with_labels(pairs, cs.last_stops(rows)).select("query_session", "candidate_session", "label")


@query()
def cases_ranked(spark, d):
    """Pair features, a perceptron trained on them, and the best candidate sessions of each query."""
    rows, pairs = _candidate_pairs(spark, d)
    partial = op.held(op.partial_sessions(rows))
    _, scales, categories = prototypes.session_vectors(partial.filter("SessionId % 3 <> 0"))
    features, *_ = prototypes.session_vectors(partial, scales, categories=categories)
    last = op._cut(cs.last_stops(rows))
    features = op._cut(features)
    labelled = op._cut(cs.with_labels(cs.with_vectors(op._cut(pairs), features), last))
    chosen = op._cut(cs.training_pairs(labelled))
    size = features.select(F.size("features")).first()
    model = cs.train_ranker(cs.pair_features(chosen, features), 3 * size[0] + 1 if size else 1, max_iter=30)
    return cs.rank_sessions(model, cs.pair_features(labelled, features), last).withColumn("score", F.round("score", 4))


@query()
def case_retrieval(spark, d):
    """The whole session-to-session pipeline: pool of earlier sessions, later ones ask."""
    from .plans.case_retrieval import run_case_retrieval

    rows = op.held(_sessions(spark, d, DAY))
    run = run_case_retrieval(rows.filter("SessionId % 5 <> 0"), rows.filter("SessionId % 5 = 0"), _assigned(rows), max_iter=20)
    return run.predictions.withColumn("score", F.round("score", 4))


@query()
def case_dataset(spark, d):
    """Nested records of each query with its retrieved sessions, scored by position."""
    rows, pairs = _candidate_pairs(spark, d)
    last = cs.last_stops(rows)
    ranked = cs.ranked_sessions(pairs.select("query_session", "candidate_session", (1.0 / F.col("place")).alias("score")), last, 3)
    return cs.nested_dataset(ranked, op.partial_sessions(rows), rows).select("query_session_id", F.to_json(F.struct("query_partial", "ground_truth_next_poi", "retrieved_cases")).alias("record"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
