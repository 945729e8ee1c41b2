"""Fitted parts and tables that outlive a session: JSON for what is small, Parquet for what grows, Spark's own form for
the trained ranker.  Nothing is pickled, so a folder from elsewhere can be read without running its code."""

from __future__ import annotations

from dataclasses import asdict, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RetrievalConfig, Settings
from ..operators.features import Categories
from ..operators.prototypes import Mixture
from ..operators.retrieval import StateEncoder
from ..sources import files
from .next_place import Assets
from .prototypes import Frozen, Scales


def _of(kind, values: dict):
    """A settings object from its JSON, in which tuples are lists."""
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def _settings(values: dict) -> Settings:
    return Settings(**{f.name: _of(f.default_factory, values[f.name]) for f in fields(Settings)})


def mixture_values(m: Mixture) -> dict:
    return asdict(m) | {"weights": m.weights.tolist(), "means": m.means.tolist(), "covariances": m.covariances.tolist()}


def mixture_of(values: dict) -> Mixture:
    arrays = {k: np.asarray(values[k], np.float64) for k in ("weights", "means", "covariances")}
    return Mixture(**values | arrays | {"log_likelihoods": tuple(values["log_likelihoods"])})


def encoder_values(e: StateEncoder) -> dict:
    return {"scales": e.scales, "categories": e.categories, "cfg": asdict(e.cfg)}


def encoder_of(values: dict) -> StateEncoder:
    scales = {name: [tuple(s) for s in rows] for name, rows in values["scales"].items()}
    return StateEncoder(scales, tuple(values["categories"]), _of(RetrievalConfig, values["cfg"]))


def save_frozen(spark: SparkSession, frozen: Frozen, folder: str) -> None:
    """The frozen parts of prototypes; terms and their axes are tables, all else is one document."""
    if frozen.categories is not None:
        spark.createDataFrame(frozen.categories.idf, "term string, idf double").write.mode("overwrite").parquet(f"{folder}/idf")
        spark.createDataFrame(frozen.categories.axes, "term string, axis array<double>").write.mode("overwrite").parquet(f"{folder}/axes")
    small = {"scales": asdict(frozen.scales), "has_categories": frozen.categories is not None, "mixture": mixture_values(frozen.mixture), "selection": frozen.selection, "resolution": frozen.resolution}
    files.write_metadata(spark, small, f"{folder}/frozen")


def load_frozen(spark: SparkSession, folder: str) -> Frozen:
    small = files.read_metadata(spark, f"{folder}/frozen")
    scales = Scales(tuple(small["scales"]["duration"]), [tuple(s) for s in small["scales"]["spatial"]])
    categories = None
    if small["has_categories"]:
        rows = lambda name: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}").orderBy("term").collect()]  # noqa: E731  (bounded by right_vectors)
        categories = Categories(rows("idf"), rows("axes"))
    return Frozen(scales, categories, mixture_of(small["mixture"]), small["selection"], small["resolution"])


def save_assets(assets: Assets, folder: str) -> None:
    """Tables of next-place prediction.  Cases lie by prototype where they have one, so that routing reads only those."""
    for name in ("places", "pairs", "meta"):
        getattr(assets, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    routed = ["proto_prototype_id"] if "proto_prototype_id" in assets.cases.columns else []
    assets.cases.repartition(*[F.col(c) for c in routed], F.pmod(F.xxhash64("SessionId"), F.lit(16))).write.mode("overwrite").partitionBy(*routed).parquet(f"{folder}/cases")
    spark = assets.cases.sparkSession
    files.write_metadata(spark, {"encoder": encoder_values(assets.encoder), "settings": asdict(assets.settings), "cases": assets.cases.schema.jsonValue()}, f"{folder}/assets")


def load_assets(spark: SparkSession, folder: str) -> Assets:
    """The saved tables; nothing is computed again, and retrieval with them gives what it gave before."""
    from pyspark.sql.types import StructType

    small = files.read_metadata(spark, f"{folder}/assets")
    kinds = StructType.fromJson(small["cases"])
    cases: DataFrame = spark.read.schema(kinds).parquet(f"{folder}/cases").select(*kinds.names)
    table = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Assets(table("places"), table("pairs"), encoder_of(small["encoder"]), cases, table("meta"), _settings(small["settings"]))


def save_ranker(model, folder: str) -> None:
    model.write().overwrite().save(folder)


def load_ranker(folder: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(folder)
