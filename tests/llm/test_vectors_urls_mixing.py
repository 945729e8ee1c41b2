import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trailmark.llm import components, vector_search
from trailmark.llm.source_mixing import exponent, mix
from trailmark.llm.url_filter import spread, url_filter
from trailmark.llm.vector_search import exact_top_k, permutation_search

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
VEC = "vec_id long, embedding array<float>, label int, id string, score double, block int"


def table(spark, x, ids):
    return spark.createDataFrame([(int(i), None if v is None else [None if y is None else float(y) for y in v], 0, "z", 1.0, 2) for i, v in zip(ids, x, strict=True)], VEC)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12)).astype(np.float32) * rng.lognormal(size=(600, 1)).astype(np.float32)
    x[200:260] = x[200]  # many copies of one vector
    odd = [None, [1.0] * 11 + [None], [math.nan] * 12, [math.inf] + [0.0] * 11, [0.0] * 12, [1.0, 2.0], []]
    return [*x.tolist(), *odd], [*range(600), *range(1000, 1000 + len(odd))]


def plain(x, ids, every, k, score):
    ok = [(i, v) for i, v in zip(ids, x, strict=True) if v is not None and len(v) == 12 and all(y is not None and math.isfinite(y) for y in v)]
    for q, v in ok:
        if q % every == 0:
            best = sorted(((-score(v, w), i) for i, w in ok if i != q))[:k]
            for r, (s, i) in enumerate(best, 1):
                yield (q, r, i, -s)


@pytest.mark.parametrize("block", [8192, 64])
def test_exact_top_k(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", block)
    monkeypatch.setattr(vector_search, "BAND", 3)
    x, ids = vectors
    ints = lambda v: [math.floor(1024 * float(np.float32(y))) for y in v]
    want = set(plain(x, ids, 100, 10, lambda a, b: sum(p * q for p, q in zip(ints(a), ints(b), strict=True))))
    got = {tuple(r) for r in exact_top_k(table(spark, x, ids), F.col("id") % 100 == 0).collect()}
    assert got == want


def test_exact_top_k_of_large_numbers(spark):
    """Components of any size: products past 2^53 and past a long, and vectors whose squares overflow."""
    rng = np.random.default_rng(6)
    x = rng.integers(-9, 9, (60, 4)) * 10.0 ** rng.choice([0, 4, 6, 8, 160, 300], (60, 1))
    x[0], x[1] = [65536.0, 1.0, 3.0, 0.5], [131072.0 + 1 / 1024, 0, 7, 2]
    rows = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ints = lambda v: [math.floor(min(max(1024 * float(y), -1.7976931348623157e308), 1.7976931348623157e308)) for y in v]
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(ints(a), ints(b), strict=True))))
    want = {(q, r, i, s) for q in range(60) for r, (s, i) in enumerate(sorted((-score(x[q], x[i]), i) for i in range(60) if i != q)[:10], 1)}
    got = {(r.query_id, r.rank, r.vec_id, -r.score) for r in exact_top_k(rows, F.lit(True)).collect()}
    assert got == want


def test_queries_that_repeat_an_id(spark):
    t = table(spark, [[1.0, 0.0], [0.0, 1.0], [3.0, 1.0], [0.0, 2.0]], [0, 0, 5, 6])
    assert [tuple(r) for r in exact_top_k(t, F.col("id") == 0).collect()] == [(0, 1, 6, 2 << 20), (0, 2, 5, 1 << 20)]
    assert [tuple(r) for r in permutation_search(t, F.col("id") == 0).collect()] == [(0, 1, 6, 2.0), (0, 2, 5, 1.0)]


def test_pivots_that_tie(spark):
    x = [[1.0, 0.0]] * 40 + [[0.0, 1.0]] * 40 + [[1.0, 1.0]] * 3
    got = permutation_search(table(spark, x, range(83)), F.col("id") == 80, k=5).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(81, 2.0), (82, 2.0), (0, 1.0), (1, 1.0), (2, 1.0)]


def test_exact_top_k_small_tables(spark):
    assert exact_top_k(table(spark, [], []), F.lit(True)).count() == 0
    got = exact_top_k(table(spark, [[1.0, 0.0], [0.5, 0.0], [0.5, 0.0], [0.5, 0.0]], [0, 1, 2, 2]), F.col("id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got)] == [(1, 1, 524288), (2, 2, 524288), (3, 2, 524288)]
    assert exact_top_k(table(spark, [[1.0]], [1]), F.col("id") == 7).count() == 0


def test_permutation_search(spark, vectors):
    x, ids = vectors
    dot = lambda a, b: float((np.float64(np.float32(a)) * np.float64(np.float32(b))).sum())
    zero = [i for i, v in zip(ids, x, strict=True) if v is not None and not any(v)]
    keep = [(i, v) for i, v in zip(ids, x, strict=True) if i not in zero]
    want = list(plain([v for _, v in keep], [i for i, _ in keep], 20, 20, dot))
    got = permutation_search(table(spark, x, ids), F.col("id") % 20 == 0).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == len(want) and len(found & {(w[0], w[2]) for w in want}) / len(want) >= 0.9
    by = {i: v for i, v in zip(ids, x, strict=True)}
    assert all(r.score == pytest.approx(dot(by[r.query_id], by[r.vec_id]), abs=1e-12) for r in got)
    # where every row is reranked, the answer is exact, ties included
    exact = permutation_search(table(spark, x, ids), F.col("id") % 20 == 0, share=1.0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(exact)] == [w[:3] for w in sorted(want)]
    assert permutation_search(table(spark, [], []), F.lit(True)).count() == 0


def test_permutation_search_recall_on_tables(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.toPandas()
    x, ids = np.array(rows.embedding.tolist(), np.float64), rows.vec_id.to_numpy()
    got = permutation_search(e, F.col("id") % 20 == 0).toPandas()
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(got.vec_id[got.query_id == q]))
    assert hits / len(got) >= 0.9


def test_url_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "http://foo.net": ("foo.net", "", None, "allow"),
        "http://x.org/fr/1": ("x.org", "/fr/1", "org/fr/", "allow"),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "http://b.example.com/de/1": ("b.example.com", "/de/1", "example.com/de/", "block"),
        "no scheme": ("", "", None, "allow"),
        "http://q.io?a=/b": ("q.io", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://ÄB.com/\nx": ("Äb.com", "/\nx", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = [(i, u, None, "h", "r") for i, u in enumerate([*cases, None])]
    out = {r.page_id: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string"), RULES).collect()}
    for i, want in enumerate([*cases.values(), ("", "", None, "allow")]):
        r = out[i]
        assert (r.host, r.path, r.rule, r.verdict) == want
    assert url_filter(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def links(*hosts):
    return "".join(f'<a href="http://{x}/1">l</a> <a HREF=\'//{x}/2\'>m</a>' for x in hosts)


def test_distrust_flows_back_along_links(spark):
    pages = [(1, "http://bad.net/1", links("bad.net")), (2, "http://feeder.io/1", links("bad.net")), (3, "http://good.org/fr/1", links("friend.io")), (4, "http://friend.io/1", None), (5, "http://lone.io/", "<p>")]
    out = {r.page_id: r for r in url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert [out[i].verdict for i in (1, 2, 3, 4, 5)] == ["block", "block", "allow", "allow", "allow"]
    assert out[4].trust > out[4].distrust and out[2].distrust > 0.8


def plain_rank(edges, seeds, damping=0.85):
    """Personalised PageRank to convergence, in units of a seed, from {(src, dst): n}."""
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    moving, score = dict(seeds), dict(seeds)
    for _ in range(400):
        step = {}
        for (a, b), n in edges.items():
            if moving.get(a):
                step[b] = step.get(b, 0) + damping * moving[a] * n / out[a]
        moving = step
        for h, x in step.items():
            score[h] = score.get(h, 0) + x
    return score


def test_url_filter_on_a_link_graph(spark):
    """200 hosts with cross links, dangling hosts, a hub that a third of all links lead to, a blocked host with many
    linkers, and pages that repeat, against a plain run to convergence."""
    damping = 0.6
    rng = np.random.default_rng(11)
    hosts = [f"h{i}.io" for i in range(150)] + [f"g{i}.org" for i in range(25)] + [f"b{i}.net" for i in range(25)]
    pages, edges = [], {}
    for i in range(500):
        h = hosts[i % 200]
        to = [] if h in hosts[100:130] else [hosts[k] for k in rng.integers(0, 200, 2)] + ["hub.io"]
        if h in hosts[:60]:
            to.append("b0.net")
        path = "/fr/" if h.endswith("org") and rng.random() < 0.8 else "/x"
        pages.append((i, f"http://{h}{path}", links(*to)))
        if i % 50 == 0:
            pages.append(pages[-1])
    pages.append((900, "http://hub.io/", links(*hosts[::7])))
    for _, url, html in pages:
        h = url[7:].split("/")[0]
        for x in re.findall(r"http://([^/]+)/1", html):
            if x != h:
                edges[h, x] = edges.get((h, x), 0) + 2
    mine, good, bad = {}, {}, {}
    for _, url, _ in pages:
        h = url[7:].split("/")[0]
        mine[h] = mine.get(h, 0) + 1
        good[h] = good.get(h, 0) + (h.endswith("org") and "/fr/" in url)
        bad[h] = bad.get(h, 0) + h.endswith("net")
    seed = lambda x: {h: n / mine[h] for h, n in x.items() if n}
    trust = plain_rank(edges, seed(good), damping)
    distrust = plain_rank({(b, a): n for (a, b), n in edges.items()}, seed(bad), damping)
    got = url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES, damping=damping).collect()
    assert len(got) == len(pages)
    for r in got:
        t, d = trust.get(r.host, 0), distrust.get(r.host, 0)
        assert r.trust == pytest.approx(t, abs=1e-4) and r.distrust == pytest.approx(d, abs=1e-4)
        if r.rule:
            assert r.verdict == dict((b, a) for a, b in RULES)[r.rule]
        else:
            judged = good.get(r.host) or bad.get(r.host)
            assert r.verdict == ("block" if d - t > (0.5 if judged else 1e-3) else "allow")
    verdicts = {r.host: r.verdict for r in got if r.rule is None}
    assert {"allow", "block"} == set(verdicts.values())
    # a blocked host with 60 linkers gives each little, but more than the trust of those nobody trusts
    assert sum(v == "block" for h, v in verdicts.items() if h in hosts[:60]) > 20


def test_rules_as_a_table(spark):
    urls = ["http://a.b.Example.com/de/x", "http://example.com/en", "http://x.org/fr/1", "http://a.b.c.d/q/r", "http://net/", "http://i.net/a", None, "http://.net./"]
    many = [("block", f"host{i}.test/p/") for i in range(1200)] + [("allow", "b.c.d/"), ("block", "c.d/q/r"), ("block", "c.d/q/")]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate([*urls, "http://www.host7.test/p/1", "http://host7.test/q"])], "page_id long, url string, html string")
    few = {r.page_id: (r.rule, r.verdict) for r in url_filter(pages, RULES).collect()}
    table = spark.createDataFrame([*RULES, *RULES[:1]], "verdict string, rule string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter(pages, table).collect()} == few
    assert few[0] == ("example.com/de/", "block") and few[5] == ("net/", "block") and few[7] == (None, "allow")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter(pages, many).collect()}
    assert out[8] == ("host7.test/p/", "block") and out[9][0] is None and out[3] == ("c.d/q/r", "block")


@pytest.mark.parametrize("hot", [False, True])
def test_spread_is_personalised_pagerank(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(components, "FEW_ROWS", 1)
        monkeypatch.setattr(components, "HOT_KEYS", 2)
    e = {("a", "b"): 1, ("a", "c"): 3, ("b", "a"): 1, ("c", "a"): 1}
    rows = [(a, b, n) for (a, b), n in e.items()]
    got = {r.host: r.score for r in spread(spark.createDataFrame(rows, "src string, dst string, n long"), spark.createDataFrame([("a", 1.0), ("z", 0.5)], "host string, seed double"), 0.2, 1e-2).collect()}
    want = plain_rank(e, {"a": 1.0, "z": 0.5}, 0.2)
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h], abs=1e-2) for h in want)


MIX = "doc_id long, text string, source string, epoch int, weight double, block int"


def mixture(spark, sizes, **how):
    rows = [(i * 1000 + j, "w " * n, s, 1, 1.0, 2) for i, (s, texts) in enumerate(sizes.items()) for j, n in enumerate(texts)]
    d = spark.createDataFrame(rows, MIX)
    return {r[0]: len(r[1].split()) for r in rows}, mix(d, **how).collect()


def test_mix_meets_the_repeat_limit_and_loses_nothing(spark):
    tokens, out = mixture(spark, {"a": [50] * 400, "b": [50] * 40, None: [50] * 4}, repeat_limit=3.0)
    assert {r.doc_id for r in out} == set(tokens)
    drawn, size = {}, {}
    for i, n in tokens.items():
        size[i // 1000] = size.get(i // 1000, 0) + n
    for r in out:
        drawn[r.doc_id // 1000] = drawn.get(r.doc_id // 1000, 0) + tokens[r.doc_id]
    assert drawn[0] == size[0]
    assert drawn[2] / size[2] == pytest.approx(3.0, abs=0.26) and 1 < drawn[1] / size[1] < 3
    weights = {r.source: r.weight for r in out}
    assert sum(weights.values()) == pytest.approx(1)
    assert all(0 <= r.position <= 1 for r in out)
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out)


def xx(*parts, seed=42):
    """The hash of a row of numbers, whose width in bytes is given; nulls leave it as it was."""
    for value, width in parts:
        if value is not None:
            seed = xxhash.xxh64(value.to_bytes(width, "little", signed=True), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def plainly_mixed(rows, repeat_limit, budget, block_tokens, seed=17):
    """{(row, epoch)} that are drawn, and the weight and passes of each source, from (id, words, source, row)."""
    tokens = {}
    for _, n, s, _ in rows:
        tokens[s] = tokens.get(s, 0) + max(1, n)

    def weigh(t):
        z = sum(x**t for x in tokens.values())
        return {s: x**t / z for s, x in tokens.items()}

    def passes(t):
        w = weigh(t)
        total = budget or max(tokens[s] / w[s] for s in w)
        return {s: w[s] * total / tokens[s] for s in w}

    lo, hi = 0.0, 1.0
    if max(passes(0.0).values()) > repeat_limit * (1 + 1e-9):
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if max(passes(mid).values()) <= repeat_limit * (1 + 1e-9) else (mid, hi)
        t = hi
    else:
        t = 0.0
    drawn, found = set(), passes(t)
    for s, own in found.items():
        own = round(own) if abs(own - round(own)) < 1e-6 else own
        blocks = {}
        count = math.ceil(tokens[s] / block_tokens)
        for i, n, source, row in rows:
            if source == s:
                blocks.setdefault(xx((i, 8), (row, 8), (seed, 4)) % count, []).append((i, max(1, n), row))
        for epoch in range(max(1, math.ceil(own))):
            room = (own - epoch) * tokens[s]
            for b in sorted(blocks, key=lambda b: (xx((b, 4), (epoch, 4), (seed, 4)), b)):
                texts = sorted((xx((i, 8), (row, 8), (epoch, 4), (seed + 1, 4)), row, n) for i, n, row in blocks[b])
                if room < sum(n for *_, n in texts):
                    texts = [x for k, x in enumerate(texts) if sum(n for *_, n in texts[:k]) < room]
                drawn |= {(row, epoch) for _, row, _ in texts}
                room -= sum(n for _, n, _ in blocks[b])
                if room <= 0:
                    break
    return drawn, weigh(t), found


@pytest.mark.parametrize("limit, budget", [(2.0, None), (9.0, 150.0), (9.0, 3000.0)])
def test_mix_agrees_with_a_plain_version(spark, limit, budget):
    """Many blocks, partial passes, null and repeated ids, null sources, and a source that holds most rows."""
    rng = np.random.default_rng(8)
    rows = [(int(i) if i % 7 else None, "w " * int(rng.integers(0, 30)), ["a", "a", "a", "b", None][i % 5], 0, 0.0, 0) for i in range(300)]
    rows += [(5, "w w w", "b", 0, 0.0, 0)] * 40 + [(None, None, "c", 0, 0.0, 0)] * 30
    d = spark.createDataFrame(rows, MIX)
    known = [(r[0], len((r[1] or "").split()), r[2], r[3]) for r in d.select("doc_id", "text", "source", F.monotonically_increasing_id()).collect()]
    want, weights, passes = plainly_mixed(known, limit, budget, 40)
    d = d.withColumn("row", F.monotonically_increasing_id())
    out = mix(d, repeat_limit=limit, budget=budget, block_tokens=40, keep=("row",)).collect()
    assert {(r.row, r.epoch) for r in out} == want and len(out) == len(want)
    assert all(r.weight == pytest.approx(weights[r.source], rel=1e-6) and 0 <= r.position <= 1 for r in out)
    assert len({r.block for r in out}) > (3 if budget == 150.0 else 20)
    size = {r[3]: max(1, r[1]) for r in known}
    for s in weights:
        drawn = sum(size[r.row] for r in out if r.source == s)
        total = sum(max(1, r[1]) for r in known if r[2] == s)
        assert passes[s] * total - 1e-3 <= drawn < passes[s] * total + 30


def test_mix_to_entropy_and_budget(spark):
    _, out = mixture(spark, {"a": [10] * 300, "b": [10] * 30}, repeat_limit=None, target_entropy=0.9)
    w = {r.source: r.weight for r in out}
    h = -sum(x * math.log(x) for x in w.values())
    assert h == pytest.approx(0.9 * math.log(2), abs=1e-3)
    tokens, out = mixture(spark, {"a": [10] * 300, "b": [10] * 30}, repeat_limit=None, target_entropy=1.0, budget=1000.0)
    assert sum(tokens[r.doc_id] for r in out) == pytest.approx(1000, abs=21)


def test_mix_edge_cases(spark):
    assert mix(spark.createDataFrame([], MIX)).count() == 0
    d = spark.createDataFrame([(1, None, "a", 0, 0.0, 0), (1, None, "a", 0, 0.0, 0), (2, "", None, 0, 0.0, 0), (3, "x " * 20000, "b", 0, 0.0, 0)], MIX)
    out = mix(d, keep=("text",)).collect()
    assert {r.doc_id for r in out} == {1, 2, 3} and 2 <= sum(r.doc_id == 1 for r in out) <= 4
    with pytest.raises(ValueError):
        mix(d, repeat_limit=0.5)


def test_exponent_bounds(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 10)], "_source string, tokens long")
    t, total = exponent(s, repeat_limit=1.0)
    assert t == pytest.approx(1.0) and total == pytest.approx(1010)
    t, _ = exponent(s, repeat_limit=10.0)
    assert (1000 / 10) ** (1 - t) == pytest.approx(10, rel=1e-3)


def test_no_python_in_mixing(spark):
    d = spark.createDataFrame([(1, "a b", "s", 0, 0.0, 0)], MIX)
    plan = mix(d)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
