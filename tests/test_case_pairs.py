"""Pairs of sessions travel without their vectors."""

import pytest

from trailmark.operators import cases as cs


def test_pairs_meet_few_candidates_by_broadcast(spark):
    features = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "SessionId long, features array<double>")
    pairs = spark.createDataFrame([(q, c) for q in range(22) for c in (1, 2, 30)], "query_session long, candidate_session long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cs.pair_features(pairs, features)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()
        assert out.count() == 40 == cs.with_vectors(pairs, features).count()
        row = out.filter("query_session = 4 and candidate_session = 2").first()
        assert row.pair_features == pytest.approx([4, 1, 2, 1, 2, 0, 9 / (17 * 5) ** 0.5])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
