import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import _chunks, components, jaccard_join
from trailmark.llm.components import connected_components
from trailmark.llm.jaccard_join import jaccard_components, jaccard_links
from trailmark.llm.language_id import language_id
from trailmark.llm.lm_scoring import ESTIMATE, level, lm_score
from trailmark.llm.quality_classifier import quality_score
from trailmark.llm.substring_dedup import substring_dedup

from . import cases


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(params=[1 << 22, 2000], ids=["one part", "many parts"])
def parts(request, monkeypatch):
    monkeypatch.setattr(_chunks, "PART_BYTES", request.param)


def key(row):
    return tuple((x is None, x) for x in row)


def test_substring_dedup(docs, rows, parts):
    out = substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, out), key=key) == sorted(cases.trimmed(rows), key=key)


def test_substring_dedup_spans_and_keep(spark):
    long = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, long, "a"), (2, f"x {long} y", "b")], "doc_id long, text string, removed string")
    out = {r.doc_id: r for r in substring_dedup(d.withColumnRenamed("removed", "extra"), keep=("extra",)).collect()}
    assert out[1].n_removed == 0 and out[1].extra == "a" and out[2].kept_text == "x y"
    assert [tuple(s) for s in out[2].removed] == [(1, 21)]


def test_substring_dedup_empty(empty):
    assert substring_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(empty, window=1)


@pytest.mark.parametrize("salted, id_bits", [(False, 64), (True, 64), (False, 8)])
def test_jaccard_components(docs, rows, salted, id_bits, monkeypatch):
    """With ids of 8 bits many sets share an id first."""
    if salted:
        monkeypatch.setattr(components, "FEW_ROWS", 1)
        monkeypatch.setattr(jaccard_join, "HOT_LIST", 3)
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    least = cases.components(rows)
    want = [(r[0], len(cases.shingles(r[1])), least.get(cases.shingles(r[1]), r[0])) for r in rows]
    got = [tuple(r) for r in jaccard_components(docs, id_bits=id_bits).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_jaccard_links_are_all_links(docs, rows):
    own, links = jaccard_links(docs)
    sets = {r.set_id: cases.shingles(t) for r, t in ((r, dict((x[0], x[1]) for x in rows)[r.doc_id]) for r in own.collect() if r.doc_id is not None) if r.set_id is not None}
    got = {tuple(sorted((r.a, r.b))) for r in links.collect()}
    ids = list(sets)
    want = set()
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                want.add(tuple(sorted((a, b))))
    assert got == want and want


def test_jaccard_long_lists_of_two_are_compared(spark):
    """Two sets of a dealt list may have been in different buckets, so nobody has paired them."""
    s = np.arange(1, 21, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lists = spark.createDataFrame([(7, 1), (7, 2)], "x long, y long")
    classes = spark.createDataFrame([(i, 20, bytes(jaccard_join.signature(s))) for i in (1, 2)], "set_id long, n int, sig binary")
    alone = spark.createDataFrame([], "node long, component long")
    assert [tuple(sorted(r[:2])) for r in jaccard_join._across(lists, classes, alone, 80, True).collect()] == [(1, 2)]


def test_jaccard_empty(empty):
    assert jaccard_components(empty).count() == 0


def test_light_boundary_weighs_costs():
    assert jaccard_join.light_boundary({5: 100}, 80, 50.0) >= 5
    assert jaccard_join.light_boundary({60: 100}, 80, 1.0) < 60


def test_bitmaps_never_drop_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        base = rng.integers(0, 1 << 63, rng.integers(4, 120), dtype=np.uint64)
        other = base.copy()
        other[: rng.integers(0, max(1, len(base) // 8))] = rng.integers(0, 1 << 63)
        a, b = np.unique(base), np.unique(other)
        n = len(np.intersect1d(a, b))
        if 100 * n >= 80 * (len(a) + len(b) - n):
            sa, sb = jaccard_join.signature(a), jaccard_join.signature(b)
            assert jaccard_join._close(len(a), len(b), int.from_bytes(sa, "little"), len(sa) * 8, int.from_bytes(sb, "little"), len(sb) * 8, 80)


def test_rounds_of_components_have_short_plans(spark, monkeypatch):
    cut, joins = components.cut, []

    def seen(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return cut(df)

    monkeypatch.setattr(components, "cut", seen)
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r.component for r in connected_components(links).collect()} == {0}
    assert 0 < max(joins) <= 3  # those of one join with hot keys


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (100, 102), (7, 7), (None, 3), (100, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in (100, 101, 102)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def held(doc_id, modulus, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == rest


def bucket(modulus):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def test_lm_base_scores(docs, rows, parts):
    got = lm_score(docs, bucket(7) != 2).collect()
    c = cases.unigram_counts(rows, lambda i: not held(i, 7, 2))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    text = {}
    for r in rows:
        text.setdefault(r[0], []).append([*cases.words_of(r[1], True), b"\0end"])
    for r in got:
        options = [w for w in text[r.doc_id] if len(w) == r.n_tokens]
        base = [sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) for w in options]
        assert any(abs(b - r.base_score) < 1e-6 for b in base)
        assert r.train_tokens == n and r.held_out == held(r.doc_id, 7, 2)
        assert any(sum(x in c for x in w) == r.n_known for w in options)
        assert r.score < 0


def test_lm_knows_what_it_saw(spark):
    seen = "the cat sat on the mat and the dog sat on the rug"
    d = spark.createDataFrame([(i, seen, True) for i in range(20)] + [(50, seen, False), (51, "mat the on sat cat the rug dog and the sat on the", False)], "doc_id long, text string, t boolean")
    out = {r.doc_id: r.score for r in lm_score(d, F.col("t")).collect()}
    assert out[50] > out[51] + 1 and out[50] == pytest.approx(out[0])


def test_lm_learns_from_what_it_saw_once(spark):
    words = [f"w{i}" for i in range(400)]
    d = spark.createDataFrame([(0, " ".join(words), True), (1, " ".join(words), False), (2, " ".join(words[::-1]), False)], "doc_id long, text string, t boolean")
    out = {r.doc_id: r.score for r in lm_score(d, F.col("t")).collect()}
    assert out[1] == pytest.approx(out[0]) and out[1] > out[2] + 100


def test_lm_without_training(docs, empty, rows):
    assert {r.train_tokens for r in lm_score(docs, F.lit(False)).collect()} == {0}
    assert lm_score(empty, F.lit(True)).count() == 0


def test_lm_filter_grows_with_the_corpus(spark):
    """9,000,000 words seen once: 8 bits each are more than 2^26."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(8999)), lambda i: F.concat(F.lit("w"), (F.col("id") * 9000 + i).cast("string"))))
    d = spark.range(0, 1000, 1, 8).select(F.col("id").alias("doc_id"), words.alias("text"))
    d = d.withColumn("text", F.concat_ws(" ", "text", F.lit("end")))
    got = lm_score(d, F.lit(True), order=1).agg(F.min(F.col("score") - F.col("base_score")), F.max("n_tokens")).first()
    assert got[1] == 9002 and got[0] > -1  # without level 1 every word would lose log10(2)


def test_levels_grow_and_estimate():
    c = np.arange(1, 5000)
    q = level(c)
    assert (np.diff(q) >= 0).all() and q[0] == 1
    assert (np.abs(np.log2(ESTIMATE[q] / c)) <= 0.51).all()


def test_quality(spark, docs, empty):
    good = [(i, "a calm and plain sentence number %d about nothing much." % i) for i in range(40)]
    bad = [(i, "BUY!!! $$$ NOW%d !!! FREE*** $$$" % i) for i in range(40, 80)]
    d = spark.createDataFrame(good + bad + [(90, None), (91, ""), (92, "a quiet sentence about plain things."), (93, "$$$ BUY!!! $$$"), (93, "$$$ BUY!!! $$$")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(i, 0) for i in range(40, 80)] + [(1, None), (2, 5), (999, 1), (None, 1)], "doc_id long, quality int")
    out = quality_score(d, labels, F.col("doc_id") < 85).collect()
    assert len(out) == 85 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert {r.predicted for r in out if r.doc_id == 92} == {1} and {r.predicted for r in out if r.doc_id == 93} == {0}
    again = {r.doc_id: r.score for r in quality_score(d, labels, F.col("doc_id") < 85).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in out)
    none = quality_score(docs, labels, F.lit(False)).collect()
    assert {r.score for r in none} == {0.5} and len(none) == docs.count()
    assert quality_score(empty, labels, F.lit(True)).count() == 0


def test_quality_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_score(d, labels, bucket(3) != 1).filter("held_out").join(labels, "doc_id")
    n, right = out.agg(F.count(F.lit(1)), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n > 100 and right / n > 0.97


def test_language(spark, docs, empty):
    fr, de = "le chat est sur la table avec une pomme", "der hund ist in dem garten und schläft"
    d = spark.createDataFrame([(i, f"{fr} {i}", "fr") for i in range(10)] + [(i, f"{de} {i}", "de") for i in range(10, 20)] + [(30, "la pomme est une table", None), (31, "und der garten", "xx"), (32, None, "fr"), (33, "123 !!", "fr"), (34, "", None), (31, "und der garten", "xx")], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id(d, F.col("doc_id") < 25).collect()}
    assert [out[i].lang_pred for i in (0, 15, 30, 31, 32, 33, 34)] == ["fr", "de", "fr", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in language_id(docs, F.lit(False)).collect()} == {"und"}
    assert language_id(docs, F.lit(True)).count() == docs.count() and language_id(empty, F.lit(True)).count() == 0


def test_language_ranks_by_plain_version(spark):
    from collections import Counter

    from trailmark.llm.language_id import Detector, Grams, profiles

    texts = ["Abba ab, baab! Éa", "ça va bien", "aaa"]

    def plain(t):
        c = Counter()
        s = [x if x.isalpha() else "\x01" for x in f" {t.lower()} "]
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                if (n == 1 and g[0] != "\x01") or (n == 2 and g != ["\x01"] * 2) or (n == 3 and g[1] != "\x01"):
                    c[tuple(map(ord, g))] += 1
        return c

    import pyarrow as pa

    g = Grams(pa.array(texts))
    for d, t in enumerate(texts):
        at = g.group == d
        names = g.names(g.code[at])
        got = {}
        for name, n in zip(names.tolist(), g.count[at].tolist(), strict=True):
            cps = tuple(x for x in ((name >> 42) & (1 << 21) - 1, (name >> 21) & (1 << 21) - 1, name & (1 << 21) - 1) if x)
            got[cps] = n
        assert got == dict(plain(t))
    p = profiles(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"), "text", "lang", 5)
    total = sum((plain(t) for t in texts), Counter())
    pack = lambda k: sum(c << s for c, s in zip(k, (42, 21, 0)[3 - len(k) :], strict=True))
    want = [pack(k) for k, _ in sorted(total.items(), key=lambda kv: (-kv[1], pack(kv[0])))[:5]]
    assert p["x"].tolist() == want
    langs, score = Detector(p, 5).predict(pa.array(texts))
    assert langs == ["x"] * 3 and (score > 0).all()


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id(d, bucket(4) != 2).filter("held_out").join(d.select("doc_id", "lang"), "doc_id")
    n, right = out.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n > 0.97


def twins(n: int) -> tuple[str, str]:
    """Two words of n letters that a polynomial hash modulo a power of two takes for one."""
    return tuple("".join("ab"[(i.bit_count() + x) & 1] for i in range(n)) for x in (0, 1))


@pytest.mark.parametrize("n", [1024, 8192])
def test_words_that_weak_hashes_confuse(spark, n):
    a, b = twins(n)
    rest = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([*rest[:6], w, *rest[6:]]), None, None, None) for i, w in ((1, a), (2, b))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.doc_id, r.n_removed) for r in substring_dedup(d).collect()} == {(1, 0), (2, 0)}
    assert {(r.doc_id, r.component_id) for r in jaccard_components(d).collect()} == {(1, 1), (2, 2)}
    out = {r.doc_id: r for r in lm_score(d, F.col("doc_id") == 1).collect()}
    assert out[1].n_known == 14 and out[2].n_known == 13


def test_hashes_tell_ranges_apart():
    """Words that differ in one byte, in length, in order or by zero bytes, and the copies of each."""
    rng = np.random.default_rng(2)
    base = [bytes(rng.integers(33, 127, n, dtype=np.uint8)) for n in (1, 7, 8, 9, 16, 17, 255, 256, 257, 300) for _ in range(3)]
    words = set(base)
    for w in base:
        words |= {w[:k] + bytes([w[k] ^ 1]) + w[k + 1 :] for k in range(len(w))} | {w + b"x", w[::-1], w + b"\0", b"\0" + w}
    words = list(words) * 2
    ends = np.cumsum([len(w) for w in words])
    for h in _chunks.range_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, 2):
        assert len(np.unique(h)) == len(words) // 2 and (h[: len(words) // 2] == h[len(words) // 2 :]).all()


def test_hashes_of_runs_of_words():
    h = np.random.default_rng(3).integers(0, 1 << 63, 40, dtype=np.uint64)
    h = np.concatenate((h, h, h[::-1]))
    for n in (1, 2, 3, 5, 7, 13):
        at, got = _chunks.word_ngrams(h, np.repeat([0, 1], 60), n)
        assert at.tolist() == [*range(61 - n), *range(60, 121 - n)]
        seen = {}
        for i, x in zip(at.tolist(), got.tolist(), strict=True):
            assert seen.setdefault(tuple(h[i : i + n].tolist()), x) == x
        assert len(set(seen.values())) == len(seen)


def test_components_need_enough_rounds(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="settle"):
        connected_components(links, max_rounds=1)


def test_one_row_repeated_very_often(spark):
    """100,000 equal rows are dealt over the parts of all input partitions."""
    n = 100_000
    d = spark.range(0, n, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three four five six seven").alias("text"))
    parts = d.select(_chunks.part_of(50, F.col("doc_id"), F.col("text")).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert parts <= n / 2
    out = lm_score(d, F.lit(True)).agg(F.count(F.lit(1)), F.min("train_tokens"), F.min("n_known")).first()
    assert tuple(out) == (n, 8 * n, 8)
    assert substring_dedup(d, window=3).agg(F.sum("n_removed")).first()[0] == 0
    assert jaccard_components(d).agg(F.count(F.lit(1)), F.min("component_id"), F.max("component_id")).first() == (n, 7, 7)
