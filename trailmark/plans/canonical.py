"""The two preprocessing pipelines: check-ins in, sessions, splits and encoded tables out."""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import CanonicalConfig, LbsnConfig
from ..operators import preprocess as op
from ..sources import files


@dataclass
class Canonical:
    clean: DataFrame
    sessions: DataFrame
    checkins: DataFrame
    statistics: dict


def run_canonical(raw: DataFrame, cfg: CanonicalConfig = CanonicalConfig()) -> Canonical:
    """Frequency filter to its fixpoint, sessions, short ones dropped, split by start, ordinals."""
    cfg.validate()
    clean, statistics = op.frequency_filter(raw, cfg)
    rows = op.held(op.assign_sessions(clean, cfg.session_gap_hours * 3600))
    rows_kept, sessions = op.drop_short_sessions(rows, op.session_boundaries(rows), cfg.min_session_len)
    sessions = op.held(op.split_sessions(sessions, cfg.train_ratio, cfg.val_ratio))
    return Canonical(clean, sessions, op.attach_split(rows_kept, sessions), statistics)


def save(run: Canonical, raw: DataFrame, folder: str, cfg: CanonicalConfig) -> None:
    folder = f"{folder}/{cfg.output_name()}"
    files.write_by_split(run.checkins, run.sessions, folder)
    sizes = op.counters(raw, run.clean, run.sessions, run.checkins).first().asDict()
    files.write_metadata(raw.sparkSession, {"config": asdict(cfg), "counters": sizes, "filter": run.statistics}, f"{folder}/metadata")


@dataclass
class Lbsn:
    sample: DataFrame
    sequences: DataFrame
    index: DataFrame
    places: DataFrame


def run_lbsn(raw: DataFrame, cfg: LbsnConfig = LbsnConfig()) -> Lbsn:
    """One filter pass, split of check-ins, isolated ones dropped, sessions, singletons, unseen, encoding."""
    from pyspark.sql import functions as F

    rows = op.frequency_filter_once(raw, cfg.min_poi_freq, cfg.min_user_freq)
    rows = op.split_checkins(rows, cfg.train_ratio, cfg.val_ratio)
    rows = op.assign_sessions(op.drop_isolated(rows, cfg.isolated_seconds), cfg.session_gap_minutes * 60)
    rows = op.held(op.sequence_ids(op.drop_unseen(op.flag_singletons(rows))))
    train = rows.filter("SplitTag = 'train'")
    out = rows.withColumn("WeekdayId", F.weekday("Time").cast("long")).withColumn("Hour", F.hour("Time").cast("long")).withColumn("Weekday", F.date_format("Time", "EEEE"))
    for column, name in (("UId", "UserCode"), ("PId", "PoiCode"), ("Category", "CategoryId")):
        out = op.encode_ids(out, column, op.id_map(train, column), name)
    columns = ["PId", "Category", "Latitude", "Longitude", "Weekday", "Time", "Hour", "SplitTag", "SessionId"]
    return Lbsn(out, op.user_sequences(out, columns), op.session_index(out, cfg.min_start_seq, cfg.sequence_length), op.poi_hours(rows))


def save_lbsn(run: Lbsn, folder: str) -> None:
    """The four tables as Parquet: the encoded check-ins by split, sequences, windows of sessions, places."""
    run.sample.write.mode("overwrite").partitionBy("SplitTag").parquet(f"{folder}/sample")
    for name in ("sequences", "index", "places"):
        getattr(run, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Clean check-ins, split them into sessions, and write train, validation and test tables.")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--pipeline", choices=("canonical", "lbsn"), default="canonical", help="lbsn takes its own defaults but for the format of times and the ratios")
    d = CanonicalConfig()
    for name, kind in (("min_user_checkins", int), ("min_poi_unique_users", int), ("session_gap_hours", float), ("min_session_len", int), ("train_ratio", float), ("val_ratio", float), ("timestamp_format", str)):
        p.add_argument("--" + name.replace("_", "-"), type=kind, default=getattr(d, name))
    a = vars(p.parse_args(argv))
    source, target, which = a.pop("input"), a.pop("output"), a.pop("pipeline")
    cfg = CanonicalConfig(**a).validate()
    spark = SparkSession.builder.appName("trailmark canonical").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    raw = files.read_raw_checkins(spark, source, cfg.timestamp_format)
    if which == "lbsn":
        save_lbsn(run_lbsn(raw, LbsnConfig(train_ratio=cfg.train_ratio, val_ratio=cfg.val_ratio)), target)
    else:
        save(run_canonical(raw, cfg), raw, target, cfg)


if __name__ == "__main__":
    main()
