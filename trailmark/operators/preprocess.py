"""Cleaning, sessions and splits of check-ins.

Rows have no order of their own: every operator orders by (user, time, place) and, last, ``TIE`` if the table has
that column, so ties are settled alike in every run.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CanonicalConfig
from ..functions.timefn import seconds_between

TIE = "event_id"


def order_of(df: DataFrame, *keys: str) -> list[str]:
    return [*keys, *([TIE] if TIE in df.columns else [])]


def held(df: DataFrame) -> DataFrame:
    """df kept for several readers in a pass, spilling to disk; lost blocks are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


# ------------------------------------------------------------------ frequency filters


def frequency_pass(df: DataFrame, min_user_checkins: int, min_poi_unique_users: int) -> DataFrame:
    """Users with enough check-ins, then places with enough different users."""
    users = df.groupBy("UId").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_user_checkins).select("UId")
    df = df.join(users, "UId", "left_semi")
    places = df.select("UId", "PId").distinct().groupBy("PId").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_poi_unique_users).select("PId")
    return df.join(places, "PId", "left_semi")


def frequency_filter(df: DataFrame, cfg: CanonicalConfig = CanonicalConfig(), max_passes: int = 100) -> tuple[DataFrame, dict]:
    """Passes until one removes nothing; with the rows left after each.

    The loop runs over counts of (user, place) pairs, which are far fewer than check-ins, and the check-ins are
    filtered once at the end.  Lineage is cut in the shared checkpoint folder at each pass.
    """
    pairs = df.groupBy("UId", "PId").agg(F.count(F.lit(1)).alias("n"))
    pairs = _cut(pairs)
    counts = [int(pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])]
    for _ in range(max_passes):
        users = pairs.groupBy("UId").agg(F.sum("n").alias("m")).filter(F.col("m") >= cfg.min_user_checkins).select("UId")
        kept = pairs.join(users, "UId", "left_semi")
        places = kept.groupBy("PId").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= cfg.min_poi_unique_users).select("PId")
        pairs = _cut(kept.join(places, "PId", "left_semi"))
        counts.append(int(pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
        if counts[-1] == counts[-2]:
            break
    else:
        raise RuntimeError("the frequency filter did not settle")
    return df.join(pairs.select("UId", "PId"), ["UId", "PId"], "left_semi"), {"iterations": len(counts) - 1, "rows": counts}


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def frequency_filter_once(df: DataFrame, min_poi_freq: int = 10, min_user_freq: int = 10) -> DataFrame:
    """One pass with strict thresholds: places by rows first, then users by the rows left."""
    places = df.groupBy("PId").agg(F.count("UId").alias("n")).filter(F.col("n") > min_poi_freq).select("PId")
    df = df.join(places, "PId", "left_semi")
    users = df.groupBy("UId").agg(F.count("PId").alias("n")).filter(F.col("n") > min_user_freq).select("UId")
    return df.join(users, "UId", "left_semi")


def drop_isolated(df: DataFrame, seconds: int = 86_400) -> DataFrame:
    """Without check-ins further than ``seconds`` from both neighbours of their user; no neighbour is infinitely far."""
    w = Window.partitionBy("UId").orderBy(*order_of(df, "Time", "PId"))
    far = F.lit(float("inf"))
    before = F.coalesce(seconds_between(F.col("Time"), F.lag("Time").over(w)), far)
    after = F.coalesce(seconds_between(F.lead("Time").over(w), F.col("Time")), far)
    return df.withColumn("_b", before).withColumn("_a", after).filter(~((F.col("_b") > seconds) & (F.col("_a") > seconds))).drop("_b", "_a")


def drop_consecutive_repeats(df: DataFrame) -> DataFrame:
    """Without check-ins at the place of the user's previous one."""
    w = Window.partitionBy("UId").orderBy(*order_of(df, "Time", "PId"))
    return df.withColumn("_p", F.lag("PId").over(w)).filter(~F.col("PId").eqNullSafe(F.col("_p")) | F.col("_p").isNull()).drop("_p")


# ------------------------------------------------------------------ sessions


def assign_sessions(df: DataFrame, gap_seconds: float) -> DataFrame:
    """df with PrevGapHours, user_session_index and SessionId (0, 1, ... in order of user and time).

    A session begins at a user's first check-in and after a gap over ``gap_seconds``.  The global number is the
    user's index plus the sessions of all users before: a prefix sum over users, not over check-ins.
    """
    w = Window.partitionBy("UId").orderBy(*order_of(df, "Time", "PId"))
    gap = seconds_between(F.col("Time"), F.lag("Time").over(w))
    df = df.withColumn("_gap", gap)
    begins = (F.col("_gap").isNull() | (F.col("_gap") > gap_seconds)).cast("long")
    df = df.withColumn("user_session_index", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    df = df.withColumn("PrevGapHours", F.col("_gap") / 3600.0).drop("_gap")
    users = df.groupBy("UId").agg((F.max("user_session_index") + 1).alias("_n"))
    users = prefix_sums(users, "UId", "_n", "_offset")
    return df.join(users.select("UId", "_offset"), "UId").withColumn("SessionId", F.col("_offset") + F.col("user_session_index")).drop("_offset")


def prefix_sums(df: DataFrame, key: str, value: str, out: str, slices: int = 256) -> DataFrame:
    """df (one row a key) with the sum of value over all smaller keys, without sorting all keys in one task.

    Keys are cut into ranges at approximate quantiles; sums of ranges (``slices`` numbers) meet in one small window.
    """
    typed = df.schema[key].dataType.typeName() in ("long", "integer", "double")
    if not typed:
        return df.withColumn(out, F.coalesce(F.sum(value).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edges = sorted(set(df.approxQuantile(key, [i / slices for i in range(1, slices)], 1e-3)))
    at = F.lit(0) if not edges else F.expr(f"size(filter(array({', '.join(f'{e}D' for e in edges)}), e -> e < {key}))")
    df = df.withColumn("_slice", at)
    total = df.groupBy("_slice").agg(F.sum(value).alias("_t"))
    total = total.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    w = Window.partitionBy("_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inner", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return df.join(F.broadcast(total), "_slice").withColumn(out, F.col("_before") + F.col("_inner")).drop("_slice", "_before", "_inner")


def session_boundaries(df: DataFrame) -> DataFrame:
    """One row a session: user, first and last time and place, length, hours."""
    key = F.struct(*order_of(df, "Time", "PId"))
    out = df.groupBy("SessionId").agg(
        F.min("UId").alias("UId"),
        F.min("user_session_index").alias("user_session_index"),
        F.min("Time").alias("session_start_time"),
        F.max("Time").alias("session_end_time"),
        F.count(F.lit(1)).alias("session_len"),
        F.min_by("PId", key).alias("first_poi"),
        F.max_by("PId", key).alias("last_poi"),
    )
    return out.withColumn("session_duration_hours", seconds_between(F.col("session_end_time"), F.col("session_start_time")) / 3600.0)


def drop_short_sessions(checkins: DataFrame, sessions: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    sessions = sessions.filter(F.col("session_len") >= least)
    return checkins.join(sessions.select("SessionId"), "SessionId", "left_semi"), sessions


def split_edges(n: int, train_ratio: float, val_ratio: float) -> tuple[int, int]:
    """Rows up to which train and validation go: floors of products of doubles, so 10 rows at .7 and .1 give 7, 7."""
    return math.floor(n * train_ratio), math.floor(n * (train_ratio + val_ratio))


def _tag(rank: Column, edges: tuple[int, int]) -> Column:
    return F.when(rank < edges[0], "train").when(rank < edges[1], "validation").otherwise("test")


def global_rank(df: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """df with ``_rank`` (0, 1, ...) by time and keys, each hour numbered apart and then shifted by the hours before."""
    df = df.withColumn("_day", F.date_trunc("hour", time))
    days = df.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("_before", before).select("_day", "_before")  # a row an hour
    inner = F.row_number().over(Window.partitionBy("_day").orderBy(time, *keys))
    return df.withColumn("_inner", inner).join(F.broadcast(days), "_day").withColumn("_rank", F.col("_before") + F.col("_inner") - 1).drop("_day", "_before", "_inner")


def split_sessions(sessions: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.1) -> DataFrame:
    """sessions with SplitTag by start time: the first to train, the next to validation, the rest to test."""
    edges = split_edges(sessions.count(), train_ratio, val_ratio)
    return global_rank(sessions, "session_start_time", ["SessionId"]).withColumn("SplitTag", _tag(F.col("_rank"), edges)).drop("_rank")


def split_checkins(df: DataFrame, train_ratio: float = 0.8, val_ratio: float = 0.1) -> DataFrame:
    """Check-ins by global time, before sessions are made; a session may so carry several tags."""
    edges = split_edges(df.count(), train_ratio, val_ratio)
    return global_rank(df, "Time", order_of(df, "UId", "PId")).withColumn("SplitTag", _tag(F.col("_rank"), edges)).drop("_rank")


def attach_split(checkins: DataFrame, sessions: DataFrame) -> DataFrame:
    """checkins with their session's SplitTag (a session without one, or with two rows, is an error) and ordinals within
    session and user."""
    tags = sessions.groupBy("SessionId").agg(F.min("SplitTag").alias("SplitTag"), F.count(F.lit(1)).alias("_rows"))
    tags = tags.select("SessionId", F.when(F.col("_rows") == 1, F.col("SplitTag")).otherwise(F.raise_error(F.lit("a session occurs twice"))).alias("SplitTag"))
    out = checkins.join(tags, "SessionId", "left")
    out = out.withColumn("SplitTag", F.coalesce("SplitTag", F.raise_error(F.lit("a session has no split tag"))))
    keys = order_of(checkins, "Time", "PId")
    ordinal = lambda key: (F.row_number().over(Window.partitionBy(key).orderBy(*keys)) - 1).cast("long")
    return out.withColumn("session_checkin_index", ordinal("SessionId")).withColumn("user_checkin_index", ordinal("UId"))


# ------------------------------------------------------------------ the second pipeline's own steps


def flag_singletons(df: DataFrame, session: str = "SessionId") -> DataFrame:
    """SplitTag becomes ignore in sessions of one check-in."""
    n = F.count(F.lit(1)).over(Window.partitionBy(session))
    return df.withColumn("SplitTag", F.when(n == 1, "ignore").otherwise(F.col("SplitTag")))


def drop_unseen(df: DataFrame) -> DataFrame:
    """Train rows, and validation and test rows whose user and place occur in train; ignored rows go."""
    train = df.filter("SplitTag = 'train'")
    rest = df.filter("SplitTag in ('validation', 'test')")
    rest = rest.join(train.select("UId").distinct(), "UId", "left_semi").join(train.select("PId").distinct(), "PId", "left_semi")
    return train.unionByName(rest)


def sequence_ids(df: DataFrame, out: str = "sequence_id") -> DataFrame:
    """1, 2, ... within each user by time."""
    w = Window.partitionBy("UId").orderBy(*order_of(df, "Time", "PId"))
    return df.withColumn(out, F.row_number().over(w).cast("long"))


def id_map(train: DataFrame, column: str) -> DataFrame:
    """(value, id): values of train numbered from 1 in order of first appearance by time."""
    first = train.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order_of(train, "Time", "UId", "PId"))).alias("_first"))
    first = first.withColumn("_t", F.col("_first.Time"))
    ranked = global_rank(first, "_t", ["_first", column])
    return ranked.select(F.col(column).alias("value"), (F.col("_rank") + 1).alias("id"))


def encode_ids(df: DataFrame, column: str, mapping: DataFrame, out: str) -> DataFrame:
    """df with the id of column, 0 where the map has none."""
    found = df.join(mapping.withColumnRenamed("value", column).withColumnRenamed("id", out), column, "left")
    return found.withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def user_sequences(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a user with an array of each column, all in order of time."""
    keys = order_of(df, "Time", "PId")
    packed = F.array_sort(F.collect_list(F.struct(*keys, *[F.col(c).alias(f"_{c}") for c in columns])))
    out = df.groupBy("UId").agg(packed.alias("_rows"))
    field = lambda c: F.transform("_rows", lambda r: r[f"_{c}"]).alias(c)
    return out.select("UId", *[field(c) for c in columns])


def session_index(df: DataFrame, min_start_seq: int = 10, sequence_length: int = 50, session: str = "SessionId", sequence: str = "sequence_id") -> DataFrame:
    """Windows of sequence numbers for each session that begins late enough; a session of two users is an error."""
    out = df.groupBy(session).agg(F.min("UId").alias("UId"), F.max("UId").alias("_u"), F.min(sequence).alias("start_seq"), F.max(sequence).alias("end_seq"))
    out = out.withColumn("UId", F.when(F.col("UId") == F.col("_u"), F.col("UId")).otherwise(F.raise_error(F.lit("a session has several users"))))
    out = out.filter(F.col("start_seq") >= min_start_seq)
    return out.select("UId", F.col(session).alias("session_id"), F.greatest(F.lit(0), F.col("end_seq") - sequence_length + 1).cast("long").alias("start_seq"), "end_seq")


def poi_hours(df: DataFrame) -> DataFrame:
    """One row a place: category and coordinates of its first check-in, and visits by hour, most first."""
    hours = df.groupBy("PId", F.hour("Time").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = hours.groupBy("PId").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_n"), "hour", "n"))).alias("_h"))
    first = F.min_by(F.struct("Category", "Latitude", "Longitude"), F.struct(*order_of(df, "Time", "UId")))
    places = df.groupBy("PId").agg(first.alias("_f"))
    out = places.join(hours, "PId")
    visits = F.transform("_h", lambda h: F.struct(h["hour"].alias("hour"), h["n"].alias("count")))
    return out.select("PId", "_f.Category", "_f.Latitude", "_f.Longitude", visits.alias("visit_time_and_count"))


def partial_sessions(df: DataFrame) -> DataFrame:
    """Sessions of two check-ins and more without their last one."""
    keys = order_of(df, "Time", "PId")
    n = F.count(F.lit(1)).over(Window.partitionBy("SessionId"))
    at = F.row_number().over(Window.partitionBy("SessionId").orderBy(*keys))
    return df.withColumn("_n", n).withColumn("_at", at).filter("_n >= 2 and _at < _n").drop("_n", "_at")


def counters(raw: DataFrame, clean: DataFrame, sessions: DataFrame, final: DataFrame) -> DataFrame:
    """One row of sizes for the metadata document."""
    def of(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(f"{name}_checkins"), F.count_distinct("UId").alias(f"{name}_users"), F.count_distinct("PId").alias(f"{name}_pois")).withColumn("_k", F.lit(0))

    tags = sessions.agg(F.count(F.lit(1)).alias("sessions"), *[F.count_if(F.col("SplitTag") == t).alias(f"{t}_sessions") for t in ("train", "validation", "test")]).withColumn("_k", F.lit(0))
    return of(raw, "raw").join(of(clean, "clean"), "_k").join(of(final, "final"), "_k").join(tags, "_k").drop("_k")
