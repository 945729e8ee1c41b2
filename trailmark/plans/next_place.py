"""Offline artifacts and next-place prediction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import preprocess as op
from ..operators import prompts as pr
from ..operators import retrieval as rt
from ..operators import spatial as sp
from ..operators import states as st


@dataclass
class Assets:
    """Tables that predictions read: descriptors, pair table, encoder, cases, place metadata."""

    places: DataFrame
    pairs: DataFrame
    encoder: rt.StateEncoder
    cases: DataFrame
    meta: DataFrame
    settings: Settings


def build_assets(history: DataFrame, places: DataFrame, nodes: DataFrame, edges: DataFrame, meta: DataFrame, prototypes: DataFrame | None = None, settings: Settings = Settings()) -> Assets:
    # tables of places and results have their lineage cut, or the text of the plans outgrows the driver
    described = op._cut(sp.descriptors(places, nodes, edges, settings.spatial))
    located = described.select("poi", "lat", "lon", F.col("nearest_graph_node_id").alias("node_id"))
    pairs = op._cut(sp.pair_lookup(located, edges, settings.spatial))
    moves = sp.transitions(history, pairs, cfg=settings.spatial)
    states = op.held(st.decision_states(history, moves, described, prototypes, settings.retrieval.recent_k))
    encoder = rt.StateEncoder.fit(states, settings.retrieval)
    return Assets(described, pairs, encoder, op.held(rt.index_of(states, encoder)), meta, settings)


def queries_of(assets: Assets, prefixes: DataFrame, routed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(states, encoded queries) of the last stop of each session prefix."""
    moves = sp.transitions(prefixes, assets.pairs, cfg=assets.settings.spatial)
    states = st.current_states(prefixes, moves, assets.places, None, assets.settings.retrieval.recent_k).withColumn("query", F.col("SessionId"))
    from ..functions.vectors import unit

    encoded = assets.encoder.transform(states, "_v").select("query", "SessionId", unit("_v").alias("vector"), "curr_lat", "curr_lon")
    if routed is not None:
        encoded = encoded.join(routed.select("SessionId", F.array_compact(F.array("top1_prototype_id", "top2_prototype_id", "top3_prototype_id")).alias("prototypes")), "SessionId", "left")
    return states, encoded


def predict(assets: Assets, prefixes: DataFrame, generator: pr.Generator = pr.stub_generator, routed: DataFrame | None = None, routing: str = "none", preselect: bool = False) -> DataFrame:
    """Per session prefix: retrieved evidence, prompt, answer and the selected place; failures are rows with error."""
    s = assets.settings
    states, encoded = queries_of(assets, prefixes, routed)
    found = op._cut(rt.retrieve(encoded, assets.cases, s.retrieval, routing, preselect))
    chosen = op._cut(rt.candidates(found, s.retrieval.temperature, s.retrieval.top_k_candidates))
    stops = prefixes.withColumn("query", F.col("SessionId"))
    blocks = pr.evidence(states, stops, found, chosen, assets.meta, s.prompts)
    asked = pr.prompts(blocks, chosen, assets.meta, s.prompts)
    return pr.read_answers(pr.generate(asked, generator))


def evaluate(assets: Assets, sessions: DataFrame, generator: pr.Generator = pr.stub_generator, min_checkins: int = 2, **how) -> DataFrame:
    """One row a session: its last stop is held out and predicted from the rest; too short ones are skipped, with the reason."""
    gold = sessions.groupBy("SessionId").agg(F.count(F.lit(1)).alias("n_checkins"), F.max_by("PId", F.struct(*op.order_of(sessions, "Time", "PId"))).alias("gold_next_poi_id"))
    out = predict(assets, op.partial_sessions(sessions), generator, **how)
    rows = gold.join(out.select(F.col("query").alias("SessionId"), "selected_poi_id", "llm_raw_text", F.coalesce("error", F.when(F.size("fallback_ids") == 0, "no candidates")).alias("error")), "SessionId", "left")
    rows = rows.withColumn("skipped", F.col("n_checkins") < min_checkins)
    rows = rows.withColumn("skip_reason", F.when(F.col("skipped"), F.lit(f"fewer than {min_checkins} check-ins")))
    return rows.withColumn("is_correct_at_1", F.when(~F.col("skipped"), F.coalesce(F.col("selected_poi_id") == F.col("gold_next_poi_id"), F.lit(False))))
