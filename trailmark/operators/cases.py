"""Session-to-session retrieval: candidate sessions by prototype, pair features, a trained ranker, nested output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..functions.geo import EARTH_KM_ROUND, haversine_km
from .preprocess import order_of


def candidate_sessions(queries: DataFrame, pool: DataFrame, per_prototype: int = 50, top_m: int = 3) -> DataFrame:
    """(query_session, candidate_session, place): the first sessions of each of the query's prototypes.

    queries has SessionId and top1_prototype_id...; pool SessionId, prototype_id, position (its order).  The limit
    holds before repeats and the query itself go; place keeps the order of prototype and position."""
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy("prototype_id").orderBy("position", "SessionId"))).filter(F.col("_r") <= per_prototype)
    wanted = queries.select(F.col("SessionId").alias("query_session"), F.posexplode(F.array(*[F.col(f"top{m}_prototype_id") for m in range(1, top_m + 1)])).alias("_m", "prototype_id")).filter("prototype_id is not null")
    rows = wanted.join(ranked.select("prototype_id", F.col("SessionId").alias("candidate_session"), "_r"), "prototype_id").filter("candidate_session <> query_session")
    first = rows.groupBy("query_session", "candidate_session").agg(F.min(F.struct("_m", "_r")).alias("_o"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_session").orderBy("_o"))).drop("_o")


def last_stops(checkins: DataFrame) -> DataFrame:
    """(SessionId, PId, Category, Latitude, Longitude) of the last check-in of each session."""
    last = F.max_by(F.struct("PId", "Category", "Latitude", "Longitude"), F.struct(*order_of(checkins, "Time", "PId")))
    return checkins.groupBy("SessionId").agg(last.alias("_l")).select("SessionId", "_l.*")


def with_labels(pairs: DataFrame, last: DataFrame, km: float = 1.0) -> DataFrame:
    """pairs with label: both sessions end in one category, or within km of each other."""
    side = lambda s: last.select(F.col("SessionId").alias(f"{s}_session"), *[F.col(c).alias(f"_{s}_{c}") for c in ("Category", "Latitude", "Longitude")])
    rows = pairs.join(side("query"), "query_session").join(_few(side("candidate"), pairs), "candidate_session")
    near = haversine_km("_query_Latitude", "_query_Longitude", "_candidate_Latitude", "_candidate_Longitude", EARTH_KM_ROUND) <= km
    label = F.col("_query_Category").eqNullSafe(F.col("_candidate_Category")) | F.coalesce(near, F.lit(False))
    return rows.withColumn("label", label.cast("int")).select(*pairs.columns, "label")


#: Candidate sessions whose rows are broadcast; more are shuffled.
_BROADCAST = 20_000


def _few(side: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``side`` (one a candidate_session) that pairs ask for, broadcast where they are few: prototypes bound
    the candidates, whatever the number of queries."""
    ids = pairs.select("candidate_session").distinct()
    own = side.join(ids, "candidate_session", "left_semi")
    return F.broadcast(own) if ids.limit(_BROADCAST + 1).count() <= _BROADCAST else own


def with_vectors(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """pairs whose sessions both have a vector."""
    side = lambda s: features.select(F.col("SessionId").alias(f"{s}_session"))
    return pairs.join(side("query"), "query_session", "left_semi").join(side("candidate"), "candidate_session", "left_semi")


def pair_features(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """pairs with pair_features [query, candidate, |query - candidate|, cosine]; sessions without a vector go."""
    side = lambda s: features.select(F.col("SessionId").alias(f"{s}_session"), F.col("features").alias(f"_{s}"))
    rows = pairs.join(side("query"), "query_session").join(_few(side("candidate"), pairs), "candidate_session")
    both = F.concat("_query", "_candidate", F.zip_with("_query", "_candidate", lambda a, b: F.abs(a - b)), F.array(vec.cosine_padded("_query", "_candidate")))
    return rows.withColumn("pair_features", both).drop("_query", "_candidate")


def training_pairs(labelled: DataFrame, negatives: int = 5, seed: int = 42) -> DataFrame:
    """All positive pairs and, for each query, negatives picked by a hash; queries without a positive go."""
    has = labelled.filter("label = 1").select("query_session").distinct()
    order = Window.partitionBy("query_session").orderBy(F.xxhash64("query_session", "candidate_session", F.lit(seed)))
    wrong = labelled.filter("label = 0").join(has, "query_session", "left_semi").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= negatives).drop("_r")
    return labelled.filter("label = 1").unionByName(wrong)


def train_ranker(rows: DataFrame, dimension: int, hidden: tuple[int, ...] = (32, 16), max_iter: int = 300, seed: int = 42):
    """A scaled multilayer perceptron over pair_features (population deviations are close enough to the sample ones)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler

    scaler = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True)
    network = MultilayerPerceptronClassifier(layers=[dimension, *hidden, 2], featuresCol="scaled", labelCol="label", maxIter=max_iter, seed=seed)
    return Pipeline(stages=[scaler, network]).fit(as_vectors(rows))


def as_vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("vector", array_to_vector("pair_features"))


def rank_sessions(model, rows: DataFrame, last: DataFrame, top_k: int = 10) -> DataFrame:
    """(query_session, true_next_poi, rank, candidate_session, candidate_next_poi, score) of the best candidates."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(as_vectors(rows)).withColumn("score", vector_to_array("probability")[1])
    return ranked_sessions(scored.select("query_session", "candidate_session", "score"), last, top_k)


def ranked_sessions(scored: DataFrame, last: DataFrame, top_k: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_session").orderBy(F.desc("score"), "candidate_session"))
    out = scored.withColumn("rank", rank).filter(F.col("rank") <= top_k)
    side = lambda s, name: last.select(F.col("SessionId").alias(f"{s}_session"), F.col("PId").alias(name))
    return out.join(side("query", "true_next_poi"), "query_session", "left").join(side("candidate", "candidate_next_poi"), "candidate_session", "left").select("query_session", "true_next_poi", "rank", "candidate_session", "candidate_next_poi", "score")


def trajectory(checkins: DataFrame, out: str) -> DataFrame:
    """(SessionId, out): a session's check-ins in order as an array of structs."""
    keys = order_of(checkins, "Time", "PId")
    return checkins.groupBy("SessionId").agg(F.transform(F.sort_array(F.collect_list(F.struct(*keys, "Category", "Latitude", "Longitude"))), lambda r: F.struct(r["PId"].alias("PId"), r["Category"].alias("Category"), r["Latitude"].alias("Latitude"), r["Longitude"].alias("Longitude"), F.date_format(r["Time"], "yyyy-MM-dd'T'HH:mm:ss").alias("Time"))).alias(out))


def nested_dataset(predictions: DataFrame, partial: DataFrame, full: DataFrame) -> DataFrame:
    """One nested row a query: its partial session, the true next place, and the retrieved sessions in rank order."""
    retrieved = predictions.join(trajectory(full, "trajectory").withColumnRenamed("SessionId", "candidate_session"), "candidate_session", "left")
    retrieved = retrieved.groupBy("query_session").agg(F.first("true_next_poi").alias("ground_truth_next_poi"), F.sort_array(F.collect_list(F.struct("rank", "candidate_session", "candidate_next_poi", "score", "trajectory"))).alias("retrieved_cases"))
    mine = trajectory(partial, "query_partial").withColumnRenamed("SessionId", "query_session")
    return retrieved.join(mine, "query_session", "left").select(F.col("query_session").alias("query_session_id"), "query_partial", "ground_truth_next_poi", "retrieved_cases")


