"""Session-to-session retrieval: candidates by prototype, a trained ranker, nested output for each split."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PrototypeConfig
from ..operators import cases as cs
from ..operators import preprocess as op
from ..operators.features import Categories
from ..sources import files
from .prototypes import Frozen, Scales, fit, route, session_vectors


@dataclass
class CaseModel:
    """What is learned from the history: the pool with its vectors and last stops, their scales, and the ranker."""

    history: DataFrame
    pool: DataFrame
    features: DataFrame
    last: DataFrame
    scales: Scales
    categories: Categories | None
    ranker: object


@dataclass
class CaseRetrieval:
    predictions: DataFrame
    dataset: DataFrame


def learn(history: DataFrame, pool: DataFrame, per_prototype: int = 50, negatives: int = 5, km: float = 1.0, max_iter: int = 300) -> CaseModel:
    """The ranker learns from the history's own sessions, so a query's last stop is never seen."""
    features, scales, categories = session_vectors(op.held(op.partial_sessions(history)))
    # lineage is cut, or the text of the plans outgrows the driver; pairs stay narrow, and vectors join those that are
    # trained with
    features, last = op._cut(features), op._cut(cs.last_stops(history))
    pairs = op._cut(cs.with_vectors(op._cut(cs.candidate_sessions(pool, pool, per_prototype)), features))
    chosen = op._cut(cs.training_pairs(op._cut(cs.with_labels(pairs, last, km)), negatives))
    size = features.select(F.size("features")).first()
    ranker = cs.train_ranker(cs.pair_features(chosen, features), 3 * (size[0] if size else 0) + 1, max_iter=max_iter)
    return CaseModel(history, pool, features, last, scales, categories, ranker)


def answer(model: CaseModel, queries: DataFrame, asked: DataFrame, per_prototype: int = 50, top_k: int = 10) -> CaseRetrieval:
    """The best sessions of the pool for each query session, and the nested rows; asked has the queries' prototypes."""
    partial = op.partial_sessions(queries)
    features = op._cut(model.features.unionByName(session_vectors(partial, model.scales, categories=model.categories)[0]))
    last = op._cut(model.last.unionByName(cs.last_stops(queries)))
    scored = cs.pair_features(op._cut(cs.candidate_sessions(asked, model.pool, per_prototype)), features)
    predictions = op._cut(cs.rank_sessions(model.ranker, scored, last, top_k))
    return CaseRetrieval(predictions, cs.nested_dataset(predictions, partial, model.history))


def run_case_retrieval(history: DataFrame, queries: DataFrame, assignments: DataFrame, per_prototype: int = 50, top_k: int = 10, negatives: int = 5, km: float = 1.0, max_iter: int = 300) -> CaseRetrieval:
    """history and queries are check-ins with SessionId (pool and asking sessions); assignments the prototypes of both,
    with position (the order within a prototype).  The pool holds history only."""
    of = lambda rows: assignments.join(rows.select("SessionId").distinct(), "SessionId", "left_semi")
    return answer(learn(history, of(history), per_prototype, negatives, km, max_iter), queries, of(queries), per_prototype, top_k)


def run_splits(checkins: DataFrame, cfg: PrototypeConfig = PrototypeConfig(), per_prototype: int = 50, top_k: int = 10, negatives: int = 5, km: float = 1.0, max_iter: int = 300, splits: tuple[str, ...] = ("validation", "test")) -> tuple[Frozen, CaseModel, dict[str, CaseRetrieval]]:
    """Prototypes and ranker of the training sessions, and the answers for each other split.

    All sessions are seen without their last stop.  Within a prototype the pool lies by session id, and a query of any
    length is routed."""
    train = op.held(checkins.filter("SplitTag = 'train'"))
    frozen, assigned = fit(op.held(op.partial_sessions(train)), cfg)
    model = learn(train, op.held(assigned.withColumn("position", F.col("SessionId"))), per_prototype, negatives, km, max_iter)
    answers = {}
    for split in splits:
        queries = op.held(checkins.filter(F.col("SplitTag") == split))
        asked = route(frozen, op.held(op.partial_sessions(queries)), replace(cfg, min_prefix_len=1))
        answers[split] = answer(model, queries, op.held(asked), per_prototype, top_k)
    return frozen, model, answers


def save(run: CaseRetrieval, folder: str, split: str) -> None:
    """One set of JSON lines for each split."""
    files.write_json_lines(run.dataset, f"{folder}/cases_{split}")


def main(argv: list[str] | None = None) -> None:
    from .artifacts import save_frozen, save_ranker

    p = argparse.ArgumentParser(description="Retrieve similar training sessions for each validation and test session.")
    p.add_argument("--input", required=True, help="a folder that the canonical pipeline wrote")
    p.add_argument("--output", required=True)
    for name, kind, value in (("per_prototype", int, 50), ("top_k", int, 10), ("negatives", int, 5), ("km", float, 1.0), ("max_iter", int, 300)):
        p.add_argument("--" + name.replace("_", "-"), type=kind, default=value)
    p.add_argument("--components", type=int, nargs="+", default=list(PrototypeConfig.components))
    a = vars(p.parse_args(argv))
    source, target, components = a.pop("input"), a.pop("output"), tuple(a.pop("components"))
    spark = SparkSession.builder.appName("trailmark case retrieval").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    frozen, model, answers = run_splits(spark.read.parquet(f"{source}/checkins"), PrototypeConfig(components=components), **a)
    save_frozen(spark, frozen, f"{target}/prototypes")
    save_ranker(model.ranker, f"{target}/ranker")
    for split, run in answers.items():
        save(run, target, split)


if __name__ == "__main__":
    main()
