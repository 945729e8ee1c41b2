"""What is saved comes back as it was; the drivers of whole pipelines; guards of joins."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trailmark.config import LbsnConfig, PrototypeConfig, RetrievalConfig, Settings, SpatialConfig
from trailmark.operators import features as ft
from trailmark.operators import preprocess as op
from trailmark.operators import prototypes as pt
from trailmark.operators import retrieval as rt
from trailmark.operators import spatial as sp
from trailmark.plans import artifacts, canonical, case_retrieval, prototypes
from trailmark.plans.next_place import Assets
from trailmark.sources import files

T0 = dt.datetime(2024, 3, 4, 8)
SCHEMA = "SessionId long, event_id long, UId long, PId string, Category string, Latitude double, Longitude double, Time timestamp, SplitTag string"


def visits(spark, sessions=30):
    """Two habits: cafe, park, gym in the north by day, and bar, club, home in the south by night."""
    rows = []
    for s in range(sessions):
        north, tag = s % 2 == 0, "train" if s < 0.7 * sessions else "validation" if s < 0.8 * sessions else "test"
        for i, c in enumerate(("Cafe", "Park", "Gym") if north else ("Bar", "Club", "Home")):
            at = T0 + dt.timedelta(days=s, hours=i if north else 10 + i, minutes=s)
            rows.append((s, s * 10 + i, s % 5, f"{c}{s % 3}", c, (40.9 if north else 40.6) + 0.003 * i + 0.0001 * s, -74.0, at, tag))
    return spark.createDataFrame(rows, SCHEMA)


SMALL = PrototypeConfig(components=(2,), covariances=("diag",), n_init=1, max_iter=5, reg_covar=1e-2)


def test_frozen_parts_route_alike_after_loading(spark, tmp_path):
    rows = visits(spark)
    frozen, _ = prototypes.fit(rows.filter("SplitTag = 'train'"), SMALL, rows.filter("SplitTag = 'validation'"))
    artifacts.save_frozen(spark, frozen, str(tmp_path / "f"))
    again = artifacts.load_frozen(spark, str(tmp_path / "f"))
    assert again.scales == frozen.scales and again.selection == frozen.selection and again.resolution == frozen.resolution
    assert sorted(again.categories.idf) == sorted(frozen.categories.idf) and sorted(map(str, again.categories.axes)) == sorted(map(str, frozen.categories.axes))
    for part in ("weights", "means", "covariances"):
        assert np.array_equal(getattr(again.mixture, part), getattr(frozen.mixture, part))
    assert again.mixture.log_likelihoods == frozen.mixture.log_likelihoods
    asked = rows.filter("SplitTag = 'test'")
    routed = lambda f: {r.SessionId: (r.prototype_id, pytest.approx(r.prototype_confidence)) for r in prototypes.route(f, asked, SMALL).collect()}
    assert len(routed(frozen)) == 6 and routed(again) == routed(frozen)


@pytest.mark.parametrize("covariance", ["diag", "full"])
def test_mixtures_survive_json(covariance):
    rng = np.random.default_rng(1)
    m = pt.Mixture(np.array([0.3, 0.7]), rng.normal(size=(2, 3)), np.ones((2, 3)) if covariance == "diag" else np.tile(np.eye(3), (2, 1, 1)), covariance, True, 4, (0.1, 0.2))
    back = artifacts.mixture_of(json.loads(json.dumps(artifacts.mixture_values(m))))
    x = rng.normal(size=(5, 3))
    assert np.array_equal(back.posterior(x)[0], m.posterior(x)[0]) and back.converged and back.n_iter == 4


def test_assets_come_back_and_retrieve_alike(spark, tmp_path):
    cfg = RetrievalConfig(top_k_cases=3)
    encoder = rt.StateEncoder({"context": [(0.1, 2.0)], "movement": [], "prefix": [(1 / 3, 1.0)]}, ("Bar", "Café"), cfg)
    schema = "SessionId long, decision_index int, vector array<double>, curr_lat double, curr_lon double, next_POIId string, next_category string, proto_prototype_id int"
    at = lambda i: [float(np.cos(i)), float(np.sin(i))]
    cases = spark.createDataFrame([(i, 0, at(i), 40.0 + i / 1000, -74.0, str(i), "c", i % 3 if i % 4 else None) for i in range(12)], schema)
    table = spark.createDataFrame([("a", 1.5)], "poi string, x double")
    saved = Assets(table, table, encoder, cases, table, Settings(spatial=SpatialConfig(gap_edges_min=(1, 2)), retrieval=cfg))
    artifacts.save_assets(saved, str(tmp_path / "a"))
    back = artifacts.load_assets(spark, str(tmp_path / "a"))
    assert back.encoder == encoder and back.settings == saved.settings and back.cases.schema == cases.schema
    assert sorted(back.cases.collect(), key=str) == sorted(cases.collect(), key=str) and back.meta.collect() == table.collect()
    asked = cases.select(F.col("SessionId").alias("query"), "SessionId", "vector", "curr_lat", "curr_lon", F.array_compact(F.array("proto_prototype_id")).alias("prototypes"))
    for routing in ("none", "top1"):
        found = lambda c: sorted(rt.retrieve(asked, c, cfg, routing).collect())
        assert found(back.cases) == found(cases)


def test_case_retrieval_of_all_splits(spark, tmp_path):
    rows = visits(spark)
    rows.write.partitionBy("SplitTag").parquet(str(tmp_path / "in" / "checkins"))
    frozen, model, answers = case_retrieval.run_splits(rows, SMALL, per_prototype=8, top_k=4, max_iter=5)
    train = {r.SessionId for r in rows.filter("SplitTag = 'train'").collect()}
    for split, run in answers.items():
        asked = {r.SessionId for r in rows.filter(F.col("SplitTag") == split).collect()}
        found = run.predictions.collect()
        assert {r.query_session for r in found} == asked and {r.candidate_session for r in found} <= train and max(r["rank"] for r in found) <= 4
        case_retrieval.save(run, str(tmp_path / "out"), split)
        lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out" / f"cases_{split}")).collect()]
        assert {r["query_session_id"] for r in lines} == asked and all(len(r["query_partial"]) == 2 for r in lines)
    artifacts.save_ranker(model.ranker, str(tmp_path / "ranker"))
    again = case_retrieval.answer(model.__class__(**vars(model) | {"ranker": artifacts.load_ranker(str(tmp_path / "ranker"))}), rows.filter("SplitTag = 'test'"), prototypes.route(frozen, op.partial_sessions(rows.filter("SplitTag = 'test'")), PrototypeConfig(min_prefix_len=1)), 8, 4)
    key = lambda r: (r.query_session, r["rank"], r.candidate_session, r.score)
    assert sorted(map(key, again.predictions.collect())) == sorted(map(key, answers["test"].predictions.collect()))


def test_lbsn_tables_are_written(spark, tmp_path):
    rows = visits(spark, 40).drop("SessionId", "SplitTag")
    run = canonical.run_lbsn(rows, LbsnConfig(min_poi_freq=1, min_user_freq=1, min_start_seq=1, session_gap_minutes=300))
    canonical.save_lbsn(run, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "sample")).count() == run.sample.count() > 60
    sequences = spark.read.parquet(str(tmp_path / "sequences")).collect()
    assert len(sequences) == 5 and sum(len(r.PId) for r in sequences) == run.sample.count() and all(r.Time == sorted(r.Time) for r in sequences)
    assert spark.read.parquet(str(tmp_path / "index")).count() == run.index.count() > 0
    assert spark.read.parquet(str(tmp_path / "places")).count() == rows.join(run.sample.select("PId").distinct(), "PId", "left_semi").select("PId").distinct().count()


def test_a_session_with_two_tags_is_an_error(spark):
    rows = visits(spark, 4).drop("SplitTag")
    sessions = spark.createDataFrame([(s, "train") for s in range(4)], "SessionId long, SplitTag string")
    assert op.attach_split(rows, sessions).count() == 12
    for wrong in (sessions.unionByName(sessions.limit(1)), sessions.filter("SessionId > 0")):
        with pytest.raises(PySparkException, match="a session"):
            op.attach_split(rows, wrong).collect()


def test_a_session_without_a_block_is_an_error(spark):
    rows = visits(spark, 4)
    temporal = ft.scaled_duration(ft.temporal_features(rows), (0.0, 1.0))
    spatial = ft.spatial_features(rows, F.col("Category"))
    scale = [(0.0, 1.0)] * 3
    assert ft.assemble(temporal, spatial, scale).count() == 4
    with pytest.raises(PySparkException, match="lacks a block"):
        ft.assemble(temporal, spatial.filter("SessionId <> 2"), scale).collect()


def test_taxonomy_of_a_file_and_cells_of_a_function(spark, tmp_path):
    path = tmp_path / "taxonomy.csv"
    path.write_text("raw,mid\nDiner,Food & Dining\nDiner,Shopping & Retail\nOrb,Nowhere\n")
    assert sorted(map(tuple, files.read_taxonomy(spark, str(path)).collect())) == [("Diner", "Food & Dining", "FoodDrink"), ("Orb", "Nowhere", "unknown")]
    places = spark.createDataFrame([("p", 40.0, -74.0), ("q", 40.1, -74.0)], "poi string, lat double, lon double")
    nodes = spark.createDataFrame([(1, 40.0, -74.0)], "node_id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 1, 5.0)], "u long, v long, length double")
    out = sp.descriptors(places, nodes, edges, cell=lambda lat, lon, level: F.concat_ws("/", F.lit(str(level)), F.floor(lat)))
    assert {r.region_coarse_token for r in out.collect()} == {"8/40"}
