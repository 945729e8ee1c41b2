"""From sessions to prototypes: features, mixture, assignments; and routing of prefixes with the frozen parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PrototypeConfig, SpatialConfig
from ..functions import text as tx
from ..functions.geo import cell_id
from ..operators import features as ft
from ..operators import preprocess as op
from ..operators import prototypes as pt


@dataclass
class Scales:
    """Means and deviations of the log duration and of the spatial numbers of the training sessions."""

    duration: tuple[float, float]
    spatial: list[tuple[float, float]]


@dataclass
class Frozen:
    """All that prefixes are transformed with: fitted on training sessions once."""

    scales: Scales
    categories: ft.Categories | None
    mixture: pt.Mixture
    selection: list[dict]
    resolution: int


def category_documents(checkins: DataFrame) -> DataFrame:
    """Documents of raw categories without absorption, which need no taxonomy."""
    return ft.category_documents(checkins, tx.taxonomy(checkins.sparkSession, []))


def session_vectors(checkins: DataFrame, scales: Scales | None = None, resolution: int = SpatialConfig.coarse_resolution, categories: ft.Categories | None = None, dense: bool = True) -> tuple[DataFrame, Scales, ft.Categories | None]:
    """Vectors of time, categories and space; what isn't given is fitted on checkins, and returned.  Without ``dense``
    there is no category block."""
    temporal = ft.temporal_features(checkins)
    spatial = op.held(ft.spatial_features(checkins, cell_id("Latitude", "Longitude", resolution)))
    scales = scales or Scales(ft.duration_scale(temporal), ft.spatial_scale(spatial))
    block = None
    if dense:
        documents = op.held(category_documents(checkins))
        categories = categories or ft.Categories.fit(documents)
        block = categories.transform(documents)
    return ft.assemble(ft.scaled_duration(temporal, scales.duration), spatial, scales.spatial, block), scales, categories


def fit(train: DataFrame, cfg: PrototypeConfig = PrototypeConfig(), validation: DataFrame | None = None) -> tuple[Frozen, DataFrame]:
    """(frozen parts, assignments of the training sessions)."""
    vectors, scales, categories = session_vectors(train)
    vectors = op.held(vectors)
    held_out = session_vectors(validation, scales, categories=categories)[0] if validation is not None else None
    mixture, table = pt.select_mixture(vectors, held_out, cfg)
    return Frozen(scales, categories, mixture, table, SpatialConfig.coarse_resolution), pt.top_prototypes(pt.posteriors(vectors, mixture), cfg.top_m)


def route(frozen: Frozen, prefixes: DataFrame, cfg: PrototypeConfig = PrototypeConfig()) -> DataFrame:
    """Prototypes of prefixes, whose vectors are made with nothing but what was fitted on the training sessions."""
    vectors, *_ = session_vectors(prefixes, frozen.scales, frozen.resolution, frozen.categories, frozen.categories is not None)
    sizes = prefixes.groupBy("SessionId").agg(F.count(F.lit(1)).alias("_size"))
    return pt.route(vectors.join(sizes, "SessionId"), frozen.mixture, F.col("_size"), cfg)
