"""Small frames for the places where results are easy to get wrong."""

import datetime as dt
import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.config import CanonicalConfig, PrototypeConfig, RetrievalConfig
from trailmark.functions import geo, timefn, vectors
from trailmark.functions import text as tx
from trailmark.operators import features as ft
from trailmark.operators import preprocess as op
from trailmark.operators import prompts as pr
from trailmark.operators import prototypes as pt
from trailmark.operators import retrieval as rt
from trailmark.operators import spatial as sp
from trailmark.operators import states as st
from trailmark.plans import prototypes
from trailmark.schema import require_columns, require_unique, resolve_column
from trailmark.sources import files
from trailmark.streaming.sessions import live_sessions

T0 = dt.datetime(2024, 1, 1)
CK = "event_id long, UId long, PId string, Category string, Latitude double, Longitude double, Time timestamp"


def checkins(spark, rows):
    """rows: (user, place, seconds[, category])."""
    return spark.createDataFrame([(i, r[0], r[1], r[3] if len(r) > 3 else "Bar", 40.0 + 0.001 * (i % 5), -74.0, T0 + dt.timedelta(seconds=r[2])) for i, r in enumerate(rows)], CK)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_a_gap_must_be_exceeded(spark):
    rows = op.assign_sessions(checkins(spark, [(1, "a", 0), (1, "b", 21600), (1, "c", 43200.000001), (2, "a", 5), (2, "b", 5)]), 21600)
    got = {(r.UId, r.PId): (r.SessionId, r.user_session_index) for r in rows.collect()}
    assert got == {(1, "a"): (0, 0), (1, "b"): (0, 0), (1, "c"): (1, 1), (2, "a"): (2, 0), (2, "b"): (2, 0)}
    b = {r.SessionId: r for r in op.session_boundaries(rows).collect()}
    assert (b[2].first_poi, b[2].last_poi) == ("a", "b") and b[0].session_duration_hours == 6.0


def test_live_sessions_keep_the_same_boundary(spark):
    rows = checkins(spark, [(1, "a", 0), (1, "b", 21600), (1, "c", 43200.000001)])
    assert sorted(r.stops for r in live_sessions(rows).collect()) == [1, 2]


def test_live_sessions_on_a_stream(spark, tmp_path):
    rows = checkins(spark, [(1, "a", 0), (1, "b", 3600), (1, "c", 90000), (2, "d", 400000)])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CK).parquet(str(tmp_path / "in"))
    q = live_sessions(stream, lateness="1 hour").writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.stops for r in spark.sql("select * from live").collect()) == [1, 2]


def test_filter_cascades_to_a_fixpoint(spark):
    rows = [(1, "p", i) for i in range(2)] + [(1, "q", 9)] + [(2, "p", i) for i in range(3)] + [(3, "q", 1), (3, "r", 2), (3, "r", 3), (4, "r", 1)]
    cfg = CanonicalConfig(min_user_checkins=3, min_poi_unique_users=2)
    kept, info = op.frequency_filter(checkins(spark, rows), cfg)
    left = list(rows)
    passes = 0
    while True:
        passes += 1
        before = len(left)
        left = [r for r in left if sum(x[0] == r[0] for x in left) >= 3]
        left = [r for r in left if len({x[0] for x in left if x[1] == r[1]}) >= 2]
        if len(left) == before:
            break
    assert kept.count() == len(left) and info["iterations"] == passes
    assert op.frequency_filter(checkins(spark, []), cfg)[0].count() == 0


@pytest.mark.parametrize("n,edges", [(0, (0, 0)), (1, (0, 0)), (10, (7, 7)), (20, (14, 15)), (1000, (700, 799))])
def test_split_edges(n, edges):
    assert op.split_edges(n, 0.7, 0.1) == edges
    assert op.split_edges(n, 0.8, 0.1)[1] == int(n * 0.9)


def test_isolated_needs_both_neighbours_far(spark):
    day = 86_400
    rows = [(1, "a", 0), (2, "a", 0), (2, "b", day), (2, "c", 3 * day + 1), (2, "d", 5 * day + 2)]
    assert sorted((r.UId, r.PId) for r in op.drop_isolated(checkins(spark, rows)).collect()) == [(2, "a"), (2, "b")]


def test_time_bins(spark):
    hours = [0, 4, 5, 11, 12, 15, 17, 19, 22, 23]
    d = spark.createDataFrame([(T0 + dt.timedelta(hours=h),) for h in hours], "t timestamp")
    got = [(r.a, r.b) for r in d.select("t", timefn.part_of_day("t").alias("a"), timefn.decision_time_bin("t").alias("b")).orderBy("t").collect()]
    assert [a for a, _ in got] == ["late_night", "late_night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "late_night", "late_night"]
    assert [b for _, b in got] == ["night", "night", "morning", "midday", "midday", "afternoon", "afternoon", "evening", "evening", "evening"]


def test_bin_edges(spark):
    d = [geo.distance_bin(F.lit(float(x))) for x in (0, 250, 250.0001, 5000, 5000.1)]
    g = [timefn.gap_bin(F.lit(x).cast("double")) for x in (None, 240 * 60, 241 * 60)]
    b = [geo.direction_bin(F.lit(float(x))) for x in (0, 22.4, 22.5, 337.5, 359.9)]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(d + g + b)]).first()
    assert list(row) == ["0-250m", "0-250m", "250-500m", "2000-5000m", "5000+m", "BOS", "120-240min", "240+min", "N", "N", "NE", "N", "N"]


def test_kernel_values(spark):
    row = spark.range(1).select(*[geo.spatial_kernel(F.lit(x).cast("double")).alias(f"k{i}") for i, x in enumerate((100, 500, 1000, 2000, None))]).first()
    assert [round(x, 2) for x in row] == [0.82, 0.37, 0.14, 0.02, 0.0]


def test_distances_agree_and_mercator_is_close(spark):
    at = [F.lit(x) for x in (40.70, -74.02, 40.71, -74.0)]
    east1, north1 = geo.transverse_mercator(at[0], at[1], -75.0)
    east2, north2 = geo.transverse_mercator(at[2], at[3], -75.0)
    row = one(spark, km=geo.haversine_km(*at), m=geo.haversine_m(*at), plane=F.sqrt((east1 - east2) ** 2 + (north1 - north2) ** 2))
    assert row.km * 1000 == pytest.approx(row.m, rel=1e-9) and row.plane == pytest.approx(row.m, rel=5e-3)


def test_rank_bins_use_mean_ranks(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 1, 2, 5, None])], "i int, v int")
    got = [r.b for r in sp.rank_bins(d, "v", 5, "D", "b").orderBy("i").collect()]
    assert got == ["D2", "D2", "D2", "D4", "D5", "D_UNK"]


@pytest.mark.parametrize(
    "online,names,want",
    [
        (False, ["Subway", "Building", "Diner"], ["building", "building", "diner"]),
        (True, ["Subway", "Building", "Diner"], ["building", "building", "diner"]),
        (False, ["Diner", "Subway"], ["diner", "diner"]),
        (True, ["Diner", "Subway"], ["diner", "transit_unresolved"]),
        (False, ["Subway", "Subway"], ["subway", "subway"]),
        (False, ["Building", "Road"], ["building", "road"]),
        (False, ["Road", "Bar", "Road"], ["bar", "bar", "bar"]),
    ],
)
def test_absorption(spark, online, names, want):
    from trailmark.sources.fixtures import taxonomy_table

    rows = checkins(spark, [(1, "p", i, c) for i, c in enumerate(names)]).withColumn("SessionId", F.lit(1))
    got = ft.category_documents(rows, taxonomy_table(spark), transit=True, neutral=True, online=online).first()
    assert got.tokens == want


def test_tokens(spark):
    names = ["home_(private)", "ramen_/_noodle_house", "fish_&_chips_shop"]
    row = spark.range(1).select(*[tx.strip_edge_marks(F.lit(n)).alias(f"c{i}") for i, n in enumerate(names)]).first()
    assert list(row) == ["home_(private", *names[1:]]
    row = one(spark, a=tx.token_a(F.lit("  Fish  & Chips ")), b=tx.token_b(F.lit(" Fish  & Chips ")), m=tx.mid_by_rule(F.lit("Thai Restaurant")))
    assert tuple(row) == ("fish_&_chips", "fish__and_chips", "Food & Dining")


def test_entropy_of_one_token_is_a_hair_below_zero(spark):
    rows = checkins(spark, [(1, "a", 0), (1, "b", 1)]).withColumn("SessionId", F.lit(1))
    h = ft.token_entropy(rows, "Category").first().token_entropy
    assert h <= 0 and round(h, 6) == 0


def test_states_of_a_short_session(spark):
    rows = op.assign_sessions(checkins(spark, [(1, "a", 0), (1, "b", 60), (1, "a", 120), (2, "z", 0)]), 3600)
    empty = spark.createDataFrame([], "src_POIId string, dst_POIId string, final_distance_m double, bearing_deg double, distance_bin string, direction_bin string")
    moves = sp.transitions(rows, empty)
    assert [r.final_distance_m for r in moves.orderBy("transition_index").collect()] == pytest.approx([2 * 111.195, 2 * 111.195], rel=1e-3)
    s = st.decision_states(rows, moves).orderBy("decision_index").collect()
    assert [(r.current_POIId, r.next_POIId, r.prev1_gap_bin, r.prefix_unique_poi_count) for r in s] == [("a", "b", "BOS", 1), ("b", "a", "0-15min", 2)]
    assert s[0].prev1_gap_s is None and s[1].prev2_gap_bin == "BOS"
    now = {r.SessionId: r for r in st.current_states(rows, moves).collect()}
    assert now[0].prefix_unique_poi_count == 2 and now[0].prefix_repeat_ratio == pytest.approx(1 / 3) and now[1].prev1_distance_bin == "BOS"
    assert "next_POIId" not in now[0].asDict()
    with pytest.raises(Exception, match="no descriptors"):
        st.decision_states(rows, moves, spark.createDataFrame([("a", 1.0, 1.0, 5)], "poi string, lat double, lon double, density_count int")).collect()


def test_retrieval_routing_and_ties(spark):
    cases = spark.createDataFrame([(10, 0, [1.0, 0.0], 40.0, -74.0, "x", "c", 1), (11, 0, [1.0, 0.0], None, None, "y", "c", 2), (12, 0, [0.0, 1.0], 40.0, -74.0, None, None, 2), (1, 0, [1.0, 0.0], 40.0, -74.0, "own", "c", 1)], "SessionId long, decision_index long, vector array<double>, curr_lat double, curr_lon double, next_POIId string, next_category string, proto_prototype_id int")
    q = spark.createDataFrame([(1, 1, [1.0, 0.0], 40.0, -74.0, [2, 9]), (2, 2, [1.0, 0.0], 40.0, -74.0, [7])], "query long, SessionId long, vector array<double>, curr_lat double, curr_lon double, prototypes array<int>")
    cfg = RetrievalConfig(top_k_cases=3)
    full = {(r["query"], r["rank"]): r for r in rt.retrieve(q, cases, cfg).collect()}
    assert full[1, 1].case_session == 10 and full[1, 1].retrieval_score == pytest.approx(1.0)
    assert full[1, 2].spatial_score == 0 and full[1, 2].retrieval_score == pytest.approx(0.7)
    assert [full[2, r].case_session for r in (1, 2, 3)] == [1, 10, 11]
    routed = rt.retrieve(q, cases, cfg, routing="union").collect()
    assert {r.case_session for r in routed if r["query"] == 1} == {11, 12}
    assert {r.case_session for r in routed if r["query"] == 2} == {1, 10, 11}  # nothing routed: all cases
    found = rt.candidates(rt.retrieve(q, cases, cfg)).collect()
    for i in (1, 2):
        assert sum(r.candidate_weight for r in found if r["query"] == i) == pytest.approx(1)
    assert None not in {r.next_POIId for r in found}
    with pytest.raises(ValueError):
        rt.candidates(q, temperature=0)


def test_encoder_treats_cases_and_queries_alike(spark):
    rows = op.assign_sessions(checkins(spark, [(u, p, 600 * i + u, "Bar" if i % 2 else "Park") for u in range(3) for i, p in enumerate("abcab")]), 36000)
    empty = spark.createDataFrame([], "src_POIId string, dst_POIId string, final_distance_m double, bearing_deg double, distance_bin string, direction_bin string")
    moves = sp.transitions(rows, empty)
    states = st.decision_states(rows, moves)
    encoder = rt.StateEncoder.fit(states)
    offline = {(r.SessionId, r.decision_index): r.vector for r in encoder.transform(states).collect()}
    part = op.partial_sessions(rows)
    online = encoder.transform(st.current_states(part, sp.transitions(part, empty))).collect()
    assert len(online) == 3
    for r in online:
        assert r.vector == pytest.approx(offline[r.SessionId, r.decision_index])
    assert len(encoder.categories) == 2 and len(online[0].vector) == 16 + 2


def test_shortest_paths_by_heap(spark):
    import heapq

    rng = np.random.default_rng(2)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 80), rng.integers(0, 30, 80), rng.integers(1, 50, 80), strict=True)]
    got = {(r.src, r.node): r.distance for r in sp.shortest_paths(spark.createDataFrame([(i,) for i in (0, 5, 7)], "node_id long"), spark.createDataFrame(edges, "u long, v long, length double"), 60.0).collect()}
    want = {}
    for s in (0, 5, 7):
        dist, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            for a, b, w in edges:
                for i, j in ((a, b), (b, a)):
                    if i == x and d + w <= 60 and d + w < dist.get(j, math.inf):
                        dist[j] = d + w
                        heapq.heappush(heap, (d + w, j))
        want |= {(s, k): v for k, v in dist.items()}
    assert got == want


def test_range_join_reaches_over_longitude_180(spark):
    rng = np.random.default_rng(5)
    lon = np.concatenate([[180.0, -180.0, 179.9999, -179.9999], 180 - rng.uniform(0, 3, 20), -180 + rng.uniform(0, 3, 20), rng.uniform(-180, 180, 20)])
    lat = np.concatenate([[0.0, 0.0, 0.0, 0.0], rng.uniform(-60, 60, 60)])
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "poi long, lat double, lon double")
    p, q = np.radians(lat), np.radians(lon)
    square = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p)[:, None] * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    for radius in (100.0, 200_000.0, 3_000_000.0, 9_000_000.0):
        pairs = sorted((r.l_poi, r.r_poi) for r in sp.range_join(places, places, radius).collect())
        near = 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.minimum(1, square)))
        sure = sorted((int(i), int(j)) for i, j in zip(*np.where(near <= radius * 0.999), strict=True))
        assert len(pairs) == len(set(pairs)) and set(sure) <= set(pairs)
        assert set(pairs) <= {(int(i), int(j)) for i, j in zip(*np.where(near <= radius * 1.001), strict=True)}


def test_nearest_node_grows_its_range(spark):
    places = spark.createDataFrame([("a", 10.0, 10.0), ("b", 50.0, 50.0)], "poi string, lat double, lon double")
    nodes = spark.createDataFrame([(1, 10.0, 10.001), (2, 49.0, 50.0)], "node_id long, lat double, lon double")
    assert {r.poi: r.node_id for r in sp.nearest_node(places, nodes).collect()} == {"a": 1, "b": 2}


def test_mixture_learns_and_scores(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in (-3, 0, 4)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "SessionId long, features array<double>")
    cfg = PrototypeConfig(components=(2, 3), covariances=("diag", "full"), n_init=2, max_iter=40, tol=1e-4)
    best, table = pt.select_mixture(rows, rows, cfg)
    assert len(best.weights) == 3 and [r["bic"] for r in table] == sorted(r["bic"] for r in table)
    assert all(b >= a - 1e-9 for a, b in zip(best.log_likelihoods, best.log_likelihoods[1:], strict=False))
    post = pt.top_prototypes(pt.posteriors(rows, best)).collect()
    assert all(sum(r.probability) == pytest.approx(1) and r.prototype_id == int(np.argmax(r.probability)) for r in post)
    assert len({r.prototype_id for r in post[:60]}) == 1
    top = table[0]
    m = best
    assert top["bic"] == pytest.approx(m.bic(top["train_avg_loglik"] * 180, 180))
    summary = pt.prototype_summary(pt.top_prototypes(pt.posteriors(rows, best)), best).collect()
    assert sum(r.train_hard_count for r in summary) == 180 and sum(r.mixture_weight for r in summary) == pytest.approx(1)
    routed = {r.SessionId: r for r in pt.route(rows, best, F.col("SessionId")).collect()}
    assert routed[1].prototype_id is None and not routed[1].routing_applied and routed[5].prototype_id is not None


def test_session_vectors_tell_categories_apart(spark):
    """Sessions alike in time and space differ by what they visited; unseen categories give zeros, and none is lost."""
    visits = [["Cafe", "Park", "Gym"], ["Bar", "Club", "Bar"], ["Cafe", "Gym", "Park"], ["Cafe", "Park", "Gym"]]
    row = lambda s, i, c: (s, s * 10 + i, str(i), c, 40.7 + 0.01 * i, -74.0, T0 + dt.timedelta(hours=9 + i))
    schema = "SessionId long, event_id long, PId string, Category string, Latitude double, Longitude double, Time timestamp"
    train = spark.createDataFrame([row(s, i, c) for s, v in enumerate(visits) for i, c in enumerate(v)], schema)
    vectors, duration, categories = prototypes.session_vectors(train)
    got = {r.SessionId: np.array(r.features) for r in vectors.collect()}
    k = len(categories.axes[0][1])
    assert all(len(v) == 9 + k for v in got.values())
    assert got[0] == pytest.approx(got[3]) and np.linalg.norm(got[0] - got[1]) > 1
    assert all(np.linalg.norm(v[6 : 6 + k]) == pytest.approx(1) for v in got.values())
    asked = spark.createDataFrame([row(7, i, "Zoo") for i in range(3)] + [row(8, i, c) for i, c in enumerate(visits[1])], schema)
    new = {r.SessionId: np.array(r.features) for r in prototypes.session_vectors(asked, duration, categories=categories)[0].collect()}
    assert not new[7][6 : 6 + k].any() and new[8][6 : 6 + k] == pytest.approx(got[1][6 : 6 + k])


def test_a_session_alone_has_the_vector_it_has_in_its_table(spark):
    stop = lambda s, i: (s, s * 10 + i, str(i), "c", 40.7 + 0.01 * i * s, -74.0, T0 + dt.timedelta(hours=(s + 1) * i))
    schema = "SessionId long, event_id long, PId string, Category string, Latitude double, Longitude double, Time timestamp"
    rows = spark.createDataFrame([stop(s, i) for s in range(4) for i in range(2 + s)], schema)
    vectors, scales, _ = prototypes.session_vectors(rows, dense=False)
    got = {r.SessionId: list(r.features) for r in vectors.collect()}
    alone = prototypes.session_vectors(rows.filter("SessionId = 2"), scales, dense=False)[0].collect()
    assert len(alone) == 1 and list(alone[0].features) == pytest.approx(got[2]) and any(alone[0].features[-3:])


def test_entry_works_where_a_library_is_missing():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and len(e.oracle_sql()) > 40 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_answers(spark):
    texts = ['{"selected_poi_id": "7"}', '```json\n{"selected_poi_id": 7}\n```', '{"selected_poi_id": " 07 "}', '{"selected_poi_id": "", "ranking": [{"poi_id": "b"}]}', '{"selected_poi_id": "zz"}', "not json", "[1]", None]
    rows = spark.createDataFrame([(i, t, ["a", "b", "7"]) for i, t in enumerate(texts)] + [(99, '{"selected_poi_id": "a"}', [])], "i int, llm_raw_text string, fallback_ids array<string>")
    got = {r.i: (r.selected_poi_id, r.parse_error) for r in pr.read_answers(rows).collect()}
    assert [got[i][0] for i in range(8)] == ["7", "7", "7", "b", "a", "a", "a", "a"]
    assert [got[i][1] for i in (0, 4, 5, 6, 7)] == [None, None, "not a JSON object", "not a JSON object", "not a JSON object"]
    assert got[99] == (None, "no candidates")


def test_generator_failures_are_rows(spark):
    rows = spark.createDataFrame([(1, "s", "u")], "query long, system_prompt string, user_prompt string")

    def broken(prompts):
        raise OSError("down")

    assert pr.generate(rows, broken).first().error == "OSError: down"
    assert '"selected_poi_id": ""' in pr.generate(rows, pr.stub_generator).first().llm_raw_text


def test_numbers_in_text_round_half_to_even(spark):
    assert one(spark, x=pr.fixed(F.lit(0.25), 1)).x == "0.2"


def test_movement_sentences(spark):
    f = lambda d, g, b: pr.movement_text(F.lit(d).cast("double"), F.lit(g).cast("double"), F.lit(b), F.lit("g"), F.lit("NE"))
    row = one(spark, a=f(None, None, "BOS"), b=f(None, 3.0, "0-250m"), c=f(100.0, 600.0, "x"), d=f(2000.0, 100000.0, "x"))
    assert row.a == pr.NO_MOVEMENT and "distance bin 0-250m" in row.b
    assert row.c == pr.MOVEMENT[0] + " Its dominant direction bin was NE. Approximate recent movement pace was 10.0 meters per minute."
    assert row.d.startswith(pr.MOVEMENT[3])


def test_files(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text("userId,venueId,venueCategory,latitude,longitude,timezoneOffset,utcTimestamp\n1,v,Bar,40.5,-74.0,-240,2024-01-06 02:00:00\n")
    row = files.read_raw_checkins(spark, str(raw)).first()
    assert row.Time == dt.datetime(2024, 1, 5, 22) and row.Weekday == "Friday"
    with pytest.raises(ValueError, match="1 values of t"):
        files.with_times(spark.createDataFrame([("2024-01-01 00:00:00",), ("x",), (None,)], "t string"), "t")
    d = spark.createDataFrame([(1, "é", None), (2, None, 3.0)], "i int, s string, x double")
    files.write_json_lines(d.coalesce(1), str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    assert '{"i":1,"s":"é","x":null}' in text
    files.write_metadata(spark, {"when": T0}, str(tmp_path / "m"))
    assert "2024-01-01" in "".join(p.read_text() for p in (tmp_path / "m").glob("part*"))


def test_guards(spark):
    d = spark.createDataFrame([(1, 2), (1, 3)], "a int, PId int")
    with pytest.raises(ValueError, match="missing columns: b"):
        require_columns(d, ["a", "b"])
    with pytest.raises(ValueError, match="duplicate"):
        require_unique(d, "a")
    assert resolve_column(d, "poi_id") == "PId" and resolve_column(d, "name", required=False) is None
    with pytest.raises(ValueError):
        CanonicalConfig(train_ratio=0.9, val_ratio=0.2).validate()
    assert CanonicalConfig(session_gap_hours=1.5).output_name() == "canonical_gap1p5h_minlen3_split701020"


def test_vectors(spark):
    row = one(spark, d=vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), z=vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), u=vectors.unit(F.array(F.lit(3.0), F.lit(4.0))))
    assert row.d == 11 and row.z == 0 and row.u == [0.6, 0.8]


def test_prefix_sums_over_slices(spark):
    d = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k long, v long")
    got = {r.k: r.s for r in op.prefix_sums(d, "k", "v", "s", slices=8).collect()}
    total = 0
    for k, v in sorted((i * 7 % 101, i) for i in range(101)):
        assert got[k] == total
        total += v


def test_entry_works_without_the_optional_parts(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for p in root.iterdir():
        if p.name not in ("corpus_pipeline.py", "trailmark", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "trailmark").mkdir()
    for p in (root / "trailmark").iterdir():
        if p.name != "llm":
            (tmp_path / "trailmark" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql() and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
