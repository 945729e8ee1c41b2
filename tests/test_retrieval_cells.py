"""Retrieval by cells: the same results as a comparison of every query with every case, over fewer pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.config import RetrievalConfig
from trailmark.operators import retrieval as rt

CFG = RetrievalConfig(top_k_cases=4, preselect_factor=3)
CASE = "SessionId long, decision_index long, vector array<double>, curr_lat double, curr_lon double, next_POIId string, next_category string, proto_prototype_id int"
QUERY = "query long, SessionId long, vector array<double>, curr_lat double, curr_lon double, prototypes array<int>"


def made(n: int, asked: int):
    rng = np.random.default_rng(5)
    kinds = np.eye(6)[rng.integers(0, 6, n + asked)] * 2
    v = kinds + rng.normal(size=(n + asked, 6)) * 0.15
    v /= np.sqrt((v**2).sum(axis=1))[:, None]
    v[n // 2 : n // 2 + 40] = v[0]  # ties
    place = rng.integers(0, 20, n + asked)
    place[n // 2 : n // 2 + 40] = place[0]
    lat, lon = 40 + place * 0.05, np.where(place % 2, 179.99, -179.99) + place * 1e-4
    lat, lon = ([None if i % 97 == 0 else float(x) for i, x in enumerate(c)] for c in (lat, lon))
    cases = [(i % 150, i // 150, v[i].tolist(), lat[i], lon[i], f"p{i}", None, int(i % 3) if i % 11 else None) for i in range(n)]
    queries = [(k, k % 150, v[n + k].tolist(), lat[n + k], lon[n + k], [[0, 2], [1], [9], None][k % 4]) for k in range(asked)]
    return cases, queries


def plain(cases, queries, routing: str, preselect: bool):
    """All pairs, without blocks."""
    for query, session, v, lat, lon, prototypes in queries:
        some = [c for c in cases if c[0] != session]
        if routing != "none":
            wanted = set((prototypes or [])[: 1 if routing == "top1" else None])
            some = [c for c in some if c[7] in wanted] or some
        cosine = np.array([c[2] for c in some]) @ np.array(v)
        to = np.array([[np.nan if x is None else x for x in c[3:5]] for c in some])
        score = CFG.alpha * rt._near(np.array([[np.nan if x is None else x for x in (lat, lon)]]), to, CFG.tau_m)[0] + (1 - CFG.alpha) * cosine
        order = list(range(len(some)))
        if preselect:
            order = sorted(order, key=lambda i: (-round(cosine[i], 9), some[i][:2]))[:12]
        for rank, i in enumerate(sorted(order, key=lambda i: (-round(score[i], 9), some[i][:2]))[:4], 1):
            yield query, rank, some[i][0], some[i][1], some[i][5], round(float(score[i]), 9)


@pytest.mark.parametrize("routing, preselect", [("none", False), ("none", True), ("top1", False), ("union", True)])
def test_cells_lose_none_of_the_best(spark, monkeypatch, routing, preselect):
    for name, value in (("BLOCK", 1), ("_COLUMNS", 60), ("BAND", 15), ("SAMPLE", 500)):
        monkeypatch.setattr(rt, name, value)
    cases, queries = made(1500, 80)
    found = rt.retrieve(spark.createDataFrame(queries, QUERY), spark.createDataFrame(cases, CASE), CFG, routing, preselect).collect()
    got = sorted((r["query"], r["rank"], r.case_session, r.case_index, r.next_POIId, round(r.retrieval_score, 9)) for r in found)
    assert got == sorted(plain(cases, queries, routing, preselect))


def test_queries_visit_few_cells(spark, monkeypatch):
    """Every query used to be sent to every block, and every case to every band of queries."""
    for name, value in (("BLOCK", 1), ("_COLUMNS", 60), ("SAMPLE", 500)):
        monkeypatch.setattr(rt, name, value)
    cases, queries = made(1500, 80)
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(cases, CASE).select("SessionId", "decision_index", "vector", F.col("curr_lat").alias("lat"), F.col("curr_lon").alias("lon"), F.lit(0).cast("long").alias("group"))
    cells = rt._drawn(rows, 1500, CFG, CFG.top_k_cases, False)
    assert cells.figures[:, 1].sum() == 1500 and len(cells.figures) >= 20
    located = [q for q in queries if q[3] is not None]
    _, visited = cells.wanted(np.array([q[2] for q in located]), np.array([q[3:5] for q in located]), np.array([q[1] for q in located]), None)
    assert visited.any(axis=1).all() and visited.mean() < 0.25


def test_no_cases_no_queries(spark):
    cases, queries = made(30, 3)
    for c, q in (([], queries), (cases, []), ([], [])):
        assert rt.retrieve(spark.createDataFrame(q, QUERY), spark.createDataFrame(c, CASE), CFG).count() == 0


@pytest.mark.parametrize("routing", ["none", "union"])
@pytest.mark.parametrize("preselect", [False, True])
def test_bars_raised_by_a_part_lose_nothing(spark, monkeypatch, routing, preselect):
    """Many small cells and a first visit for every query: the results of all pairs, and fewer rows handed on."""
    monkeypatch.setattr(rt, "_COLUMNS", 16)
    monkeypatch.setattr(rt, "BLOCK", 16)
    monkeypatch.setattr(rt, "SAMPLE", 64)
    cases, queries = made(1500, 80)
    frames = spark.createDataFrame(queries, QUERY), spark.createDataFrame(cases, CASE)
    handed = {}
    for few in (0, 10**9):
        monkeypatch.setattr(rt, "FEW", few)
        found = rt._search(frames[0].withColumn("_groups", F.col("prototypes").cast("array<bigint>")), frames[1], 1500, CFG, CFG.top_k_cases * (3 if preselect else 1), preselect, routed=routing != "none")
        handed[few] = found.count()
        rows = rt.retrieve(*frames, CFG, routing, preselect).orderBy("query", "rank").collect()
        assert [tuple(r)[:4] for r in rows] == [r[:4] for r in plain(cases, queries, routing, preselect)]
    assert handed[0] < handed[10**9]
