"""Session features: time, movement in space, category documents, term weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..functions.geo import haversine_km
from ..functions.timefn import is_weekend, part_of_day, seconds_between
from .preprocess import held, order_of

PARTS = ("morning", "afternoon", "evening", "late_night")


def temporal_features(df: DataFrame, time: str = "Time") -> DataFrame:
    """SessionId, shares of the four parts of the day, weekend flag of the start, log of 1 + minutes."""
    shares = [F.avg((F.col("_part") == p).cast("double")).alias(f"tod_{p}") for p in PARTS]
    minutes = F.greatest(F.lit(0.0), seconds_between(F.max(time), F.min(time)) / 60.0)
    out = df.withColumn("_part", part_of_day(time)).groupBy("SessionId").agg(*shares, F.min(time).alias("_start"), F.log1p(minutes).alias("log_minutes"))
    return out.withColumn("weekend", is_weekend("_start")).drop("_start")


def duration_scale(features: DataFrame) -> tuple[float, float]:
    """Mean and population deviation of the log minutes of the training sessions; a deviation near 0 counts as 1."""
    mean, std = features.agg(F.avg("log_minutes"), F.stddev_pop("log_minutes")).first()
    return float(mean or 0.0), float(std) if std is not None and std > 1e-8 else 1.0


def scaled_duration(features: DataFrame, scale: tuple[float, float]) -> DataFrame:
    return features.withColumn("duration_z", (F.col("log_minutes") - scale[0]) / scale[1])


def radius_of_gyration(df: DataFrame) -> DataFrame:
    """Root mean square distance (km) of a session's stops to their mean position."""
    w = Window.partitionBy("SessionId")
    near = haversine_km("Latitude", "Longitude", F.avg("Latitude").over(w), F.avg("Longitude").over(w))
    return df.withColumn("_d", near).groupBy("SessionId").agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("radius_km"))


def token_entropy(df: DataFrame, token: str) -> DataFrame:
    """Entropy of a session's tokens over the largest possible one (1e-12 inside the logarithm)."""
    n = df.groupBy("SessionId", token).agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("SessionId")))
    h = p.groupBy("SessionId").agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))).alias("h"), F.count(F.lit(1)).alias("k"))
    return h.select("SessionId", F.when(F.col("k") > 1, F.col("h") / F.log("k")).otherwise(F.col("h")).alias("token_entropy"))


def centroid_displacement(df: DataFrame) -> DataFrame:
    """Distance (km) of the mean positions of a session's first and second half; the first has n // 2 stops, 1 at
    least, and a session of one stop moves 0."""
    w = Window.partitionBy("SessionId")
    at = F.row_number().over(w.orderBy(*order_of(df, "Time", "PId")))
    df = df.withColumn("_at", at).withColumn("_n", F.count(F.lit(1)).over(w))
    early = F.col("_at") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
    mean = lambda c, on, name: F.avg(F.when(on, F.col(c))).alias(name)
    out = df.groupBy("SessionId").agg(mean("Latitude", early, "a"), mean("Longitude", early, "b"), mean("Latitude", ~early, "c"), mean("Longitude", ~early, "d"))
    return out.select("SessionId", F.coalesce(haversine_km("a", "b", "c", "d"), F.lit(0.0)).alias("displacement_km"))


def spatial_features(df: DataFrame, token: Column) -> DataFrame:
    """Radius, entropy of region tokens and displacement; token may be a cell or a precomputed region."""
    df = df.withColumn("_token", token)
    return radius_of_gyration(df).join(token_entropy(df, "_token"), "SessionId").join(centroid_displacement(df), "SessionId")


def category_documents(df: DataFrame, table: DataFrame, level: str = "raw", transit: bool = False, neutral: bool = False, online: bool = False) -> DataFrame:
    """SessionId, tokens (in order) and document (joined by spaces) at a level of the taxonomy: raw, mid or activity.

    Tokens of level raw are normalised with runs of spaces as one underscore; absorption works on them before."""
    rows = tx.with_taxonomy(df, table)
    value = {"raw": "Category", "mid": "mid", "activity": "activity"}[level]
    rows = rows.withColumn("_value", tx.token_a(F.coalesce(F.col(value), F.lit(tx.UNKNOWN))))
    keys = order_of(df, "Time", "PId")
    rows = tx.absorb(rows, "_value", "SessionId", keys, transit, neutral, online)
    out = rows.groupBy("SessionId").agg(tx.ordered_list("token", keys).alias("tokens"))
    return out.withColumn("document", F.array_join("tokens", " "))


def absorption_report(df: DataFrame, table: DataFrame, online: bool = False) -> DataFrame:
    """Sessions whose document absorption changes, with both documents."""
    before = category_documents(df, table).select("SessionId", F.col("document").alias("before"))
    after = category_documents(df, table, transit=True, neutral=True, online=online).select("SessionId", F.col("document").alias("after"))
    return before.join(after, "SessionId").filter("before <> after")


def terms(documents: DataFrame) -> DataFrame:
    """(SessionId, term, n): words and pairs of neighbouring words, edge marks stripped."""
    words = F.filter(F.transform(F.split(F.lower("document"), r"\s+"), lambda t: tx.strip_edge_marks(t)), lambda t: t != "")
    rows = documents.select("SessionId", words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return rows.select("SessionId", F.explode(F.concat("w", pairs)).alias("term")).groupBy("SessionId", "term").agg(F.count(F.lit(1)).alias("n"))


def inverse_frequencies(train_terms: DataFrame, documents: int) -> DataFrame:
    """(term, idf): ln((1 + n) / (1 + df)) + 1."""
    df = train_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", (F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """(SessionId, term, weight), each session of length 1; terms outside the vocabulary go."""
    w = rows.join(idf, "term").withColumn("_w", F.col("n") * F.col("idf"))
    size = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("SessionId")))
    return w.select("SessionId", "term", (F.col("_w") / size).alias("weight"))


#: Vocabularies up to this size are decomposed by the sums of products of their terms, in one pass.
GRAM = 2048


def _sparse(weights: DataFrame, terms: list[str]) -> DataFrame:
    """(SessionId, i, w): numbers and weights of a session's terms, by number; ``terms`` is the vocabulary."""
    table = weights.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string")
    rows = weights.join(F.broadcast(table), "term").groupBy("SessionId").agg(F.sort_array(F.collect_list(F.struct("i", F.col("weight").alias("w")))).alias("_x"))
    return rows.select("SessionId", F.col("_x.i").alias("i"), F.col("_x.w").alias("w"))


def _flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, weight) of the terms of a batch of _sparse."""
    n = np.diff(batch.column("i").offsets.to_numpy())
    return np.repeat(np.arange(len(n)), n), batch.column("i").flatten().to_numpy(), batch.column("w").flatten().to_numpy()


def _products(rows: DataFrame, size: int) -> np.ndarray:
    """Sums over all sessions of the products of two terms' weights.  Tasks hand on bands of 64 terms, which meet before
    the driver, so it gets one table of the vocabulary's square."""
    step = max(1, (1 << 21) // size)

    def added(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                row, i, w = _flat(part)
                x = np.zeros((part.num_rows, size))
                x[row, i] = w
                total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_pydict({"band": list(range(0, size, 64)), "x": [total[k : k + 64].tobytes() for k in range(0, size, 64)]})

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"band": table["band"][:1], "x": [sum(np.frombuffer(x.as_py()) for x in table["x"]).tobytes()]})

    found = rows.mapInArrow(added, "band long, x binary").groupBy("band").applyInArrow(merged, "band long, x binary").collect()
    out = np.zeros((size, size))
    for band, x in found:
        out[band : band + 64] = np.frombuffer(bytes(x)).reshape(-1, size)
    return out


def right_vectors(weights: DataFrame, components: int = 64) -> tuple[list[tuple[str, list[float]]], list[float]]:
    """The part of each term in the leading right singular vectors of the term matrix, and the singular values.  The
    right vectors (terms times components) are the broadcast model; it needs a vocabulary of category terms, whose
    size does not grow with the sessions.

    Up to GRAM terms the products of the terms are summed in one pass and decomposed on the driver, each vector with
    its largest part positive; singular values that rounding can't tell from 0 go.  Larger vocabularies are
    decomposed by iterations over the sessions."""
    vocabulary = [r[0] for r in weights.select("term").distinct().orderBy("term").limit(20_001).collect()]
    if len(vocabulary) > 20_000:
        raise ValueError("more than 20,000 terms: keep the sparse weights")
    if not vocabulary:
        return [], []
    rows = held(_sparse(weights, vocabulary))
    n = rows.count()
    k = max(1, min(components, n - 1, len(vocabulary) - 1))
    if len(vocabulary) <= GRAM:
        square, v = np.linalg.eigh(_products(rows, len(vocabulary)))
        values = np.sqrt(np.maximum(square[::-1][:k], 0.0))
        known = max(1, int((values > values[0] * np.sqrt(len(vocabulary) * np.finfo(float).eps)).sum()))
        values, v = values[:known], v[:, ::-1][:, :known]
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(known)] < 0, -1.0, 1.0)
    else:
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import RowMatrix

        sparse = rows.select("i", "w").rdd.map(lambda r: Vectors.sparse(len(vocabulary), r[0], r[1])).persist(StorageLevel.MEMORY_AND_DISK)
        found = RowMatrix(sparse).computeSVD(k)
        values, v = found.s.toArray(), found.V.toArray()
        sparse.unpersist()
    rows.unpersist()
    return [(t, v[i].tolist()) for i, t in enumerate(vocabulary)], [float(x) for x in values]


def project(weights: DataFrame, axes: list[tuple[str, list[float]]]) -> DataFrame:
    """(SessionId, category_dense): the weights along the axes, of length 1."""
    matrix = weights.sparkSession.sparkContext.broadcast(np.array([a for _, a in axes]) if axes else np.zeros((0, 0)))

    def along(batches):
        for batch in batches:
            row, i, w = _flat(batch)
            x = np.add.reduceat(matrix.value[i] * w[:, None], np.flatnonzero(np.r_[True, np.diff(row) > 0])) if len(row) else np.zeros((0, 0))
            size = np.sqrt((x**2).sum(axis=1))
            x = x / np.where(size < 1e-12, 1.0, size)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column("SessionId"), pa.array(list(x), pa.list_(pa.float64()))], ["SessionId", "category_dense"])

    kind = weights.schema["SessionId"].dataType.simpleString()
    return _sparse(weights, [t for t, _ in axes]).mapInArrow(along, f"SessionId {kind}, category_dense array<double>")


def truncated_svd(weights: DataFrame, components: int = 64) -> tuple[DataFrame, list[float]]:
    """(SessionId, dense vector of length 1) and the singular values."""
    axes, values = right_vectors(weights, components)
    return project(weights, axes), values


@dataclass
class Categories:
    """Inverse frequencies and axes of the terms of the training sessions."""

    idf: list[tuple[str, float]]
    axes: list[tuple[str, list[float]]]

    @staticmethod
    def fit(documents: DataFrame, components: int = 64) -> Categories:
        found = held(terms(documents))
        idf = held(inverse_frequencies(found, documents.count()))
        axes, _ = right_vectors(held(tfidf(found, idf)), components)
        return Categories([tuple(r) for r in idf.collect()], axes)  # a row a term, as many as right_vectors allows

    def transform(self, documents: DataFrame) -> DataFrame:
        """(SessionId, category_dense) of every document; zeros where no term is known."""
        idf = documents.sparkSession.createDataFrame(self.idf, "term string, idf double")
        dense = project(tfidf(terms(documents), F.broadcast(idf)), self.axes)
        zeros = F.array(*[F.lit(0.0)] * (len(self.axes[0][1]) if self.axes else 0)).cast("array<double>")
        return documents.select("SessionId").join(dense, "SessionId", "left").withColumn("category_dense", F.coalesce("category_dense", zeros))


SPATIAL = ("radius_km", "token_entropy", "displacement_km")


def spatial_scale(spatial: DataFrame) -> list[tuple[float, float]]:
    """Mean and population deviation of each spatial number of the training sessions; a deviation of 0 counts as 1."""
    row = spatial.agg(*[f(c) for c in SPATIAL for f in (F.avg, F.stddev_pop)]).first()
    return [(float(row[2 * i] or 0.0), float(row[2 * i + 1] or 1.0)) for i in range(len(SPATIAL))]


def assemble(temporal: DataFrame, spatial: DataFrame, scale: list[tuple[float, float]], dense: DataFrame | None = None) -> DataFrame:
    """SessionId and one vector: six temporal numbers, the category vector, three spatial numbers (by ``scale``).

    Every session needs a row in each table; one that lacks it is an error, not a session less."""
    scaled = [(F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in zip(SPATIAL, scale, strict=True)]
    out = temporal.join(spatial.withColumn("_spatial", F.lit(True)), "SessionId", "left")
    whole = F.col("_spatial").isNotNull()
    parts = [F.array(*[F.col(f"tod_{p}") for p in PARTS], F.col("weekend").cast("double"), F.col("duration_z"))]
    if dense is not None:
        out = out.join(dense.withColumn("_dense", F.lit(True)), "SessionId", "left")
        whole &= F.col("_dense").isNotNull()
        parts.append(F.col("category_dense"))
    return out.select("SessionId", F.when(whole, F.concat(*parts, F.array(*scaled))).otherwise(F.raise_error(F.lit("a session lacks a block of features"))).alias("features"))
