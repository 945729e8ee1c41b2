"""Every query with an oracle against DuckDB over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from trailmark import catalog
from trailmark.config import PrototypeConfig

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind == "f":
            df[c] = df[c].map(lambda v: "None" if pd.isna(v) else repr(round(float(v), 6) + 0.0))
        else:
            df[c] = df[c].map(lambda v: "None" if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)) else str(v))
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    got, want = comparable(catalog.queries()[name](spark, FOLDER).toPandas()), comparable(duck.execute(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", ["retrieval_two_stages", "candidate_places", "hit_at_1", "case_dataset"])
def test_runs_without_oracle(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_all_held_out_sessions_ask(spark):
    held_out = {r.SessionId for r in catalog._sessions(spark, FOLDER, catalog.DAY).filter("SessionId % 3 = 0").select("SessionId").distinct().collect()}
    asked = lambda name, key: {r[0] for r in catalog.queries()[name](spark, FOLDER).select(key).distinct().collect()}
    assert asked("next_place_predictions", "SessionId") == held_out
    assert asked("case_dataset", "query_session_id") <= held_out and any(s % 10 for s in asked("case_dataset", "query_session_id"))
    assert any(s % 5 for s in asked("retrieval_two_stages", "query"))


@pytest.mark.parametrize("name", ["prototypes_assigned", "prefixes_routed"])
def test_prototypes_are_searched_by_default_settings(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def fit(train, cfg=PrototypeConfig(), validation=None):
        assert cfg == PrototypeConfig()
        raise Seen

    monkeypatch.setattr(catalog.prototypes, "fit", fit)
    with pytest.raises(Seen):
        catalog.queries()[name](spark, FOLDER)
