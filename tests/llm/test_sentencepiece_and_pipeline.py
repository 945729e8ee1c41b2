import math

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

import corpus_pipeline
from trailmark.llm import sentencepiece as sp
from trailmark.llm.queries import MODEL_FILE, oracle_sql, queries

from . import cases


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)


EXTRA = [(900, "  a  b\n\tc   "), (901, "x" * 300 + " " * 90 + "y日本語\U0001f600é▁q"), (902, " "), (903, "Hello world, hello internationalization!"), (904, "a" * 62 + " " + "b" * 63), (905, "\x00\r\n")]
EXTRA += [(906 + x, "".join("ab"[(i.bit_count() + x) & 1] for i in range(1024))) for x in (0, 1)]  # one hash, if weak


def test_bpe_ids_are_the_librarys(spark, library):
    rows = [(r[0], r[1]) for r in cases.documents()] + EXTRA
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, ids int, round_trip int").repartition(2)
    out = sp.encode(d, MODEL_FILE, keep=("text",), check=True).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r.ids) == library.encode(r.text or "")
        assert r.round_trip == ("▁" not in (r.text or ""))


def test_decode(spark, library):
    rows = [(1, library.encode("  two  spaces ")), (2, []), (3, None), (4, library.encode("naïve 日本\n")), (5, [3 + 0xC3])]
    out = {r.i: r.text for r in sp.decode(spark.createDataFrame(rows, "i int, ids array<int>"), MODEL_FILE).collect()}
    assert [out[i] for i in (1, 2, 3, 4, 5)] == ["  two  spaces ", "", "", "naïve 日本\n", "�"]
    with pytest.raises(Exception, match="outside the model"):
        sp.decode(spark.createDataFrame([(1, [99999])], "i int, ids array<int>"), MODEL_FILE).collect()


def small_model(kind: int, pieces: dict[str, float]):
    m = proto.ModelProto()
    m.trainer_spec.model_type = kind
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = True, False
    for p, s, t in [("<unk>", 0.0, 2), *((p, s, 1) for p, s in pieces.items())]:
        m.pieces.add(piece=p, score=s, type=t)
    return sp.Pieces.of(m)


def best_path(unit: str, pieces: dict[str, float]) -> list[str]:
    best: list = [(0.0, [])] + [(-math.inf, [])] * len(unit)
    for j in range(1, len(unit) + 1):
        for i in range(j):
            s = best[i][0] + pieces.get(unit[i:j], -math.inf)
            if s > best[j][0]:
                best[j] = (s, [*best[i][1], unit[i:j]])
    return best[-1][1]


def test_viterbi_finds_the_best_path(spark):
    rng = np.random.default_rng(4)
    chars = "▁abcd"
    pieces = {c: -9.0 for c in chars}
    while len(pieces) < 60:
        pieces["".join(rng.choice(list("abcd"), rng.integers(2, 6)))] = float(-rng.integers(2, 12))
    pieces |= {"▁a": -3.0, "▁ab": -5.0}
    m = small_model(1, pieces)
    texts = ["".join(rng.choice(list("abcd"), rng.integers(1, 20))) for _ in range(60)] + ["a" * 100, "aXb", ""]
    out = {r.text: [m.text[i] for i in r.ids] for r in sp.encode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), m, keep=("text",)).collect()}
    for t in texts[:-2]:
        assert sum(pieces[p] for p in out[t]) == pytest.approx(sum(pieces[p] for p in best_path("▁" + t, pieces)))
        assert "".join(out[t]) == "▁" + t
    assert out["aXb"] == ["▁a", "<unk>", "b"] and out[""] == []


def test_merges_of_long_units_agree_with_the_fold(spark, library):
    m = sp.Pieces(MODEL_FILE)
    for t in ("international", "thonnterreationly", "aaaaaaa", "queeuxoiement"):
        assert sp._long_unit("▁" + t, m).tolist() == library.encode(t)
    assert sp._long_unit("▁" + "ab" * 500, m).tolist() == library.encode("ab" * 500)


@pytest.mark.parametrize("late", [False, True])
def test_one_pass_unless_a_merge_makes_a_better_edge_fit(spark, late):
    ranked = ["abc", "ab", "cab", "de"] if late else ["ab", "abc", "cab", "de"]
    pieces = {p: -float(r) for r, p in enumerate([*ranked, *"▁abcde"])}
    m = small_model(2, pieces)
    assert m.late() == ({"abc"} if late else set())
    texts = ["abcab", "cabab", "abcabcab", "cabc", "dede", "abdeabc", "de", "d"]
    units = spark.createDataFrame([(k, "▁" + t) for k, t in enumerate(texts)], "u long, w string")
    out = sp._merged(sp._edges(units, m))
    rank = {p: r for r, (p, _, _) in enumerate(m.ranked)}
    for u, found in out.collect():
        assert [m.ranked[r][0] for r in found] == plain_merges("▁" + texts[u], rank)
    assert ("slice(" in out._jdf.queryExecution().optimizedPlan().toString()) == late


def plain_merges(text: str, rank: dict[str, int]) -> list[str]:
    parts = list(text)
    while fits := [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]:
        i = min(fits)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert sp.encode(d, MODEL_FILE).count() == 0


def test_unsupported_models_are_refused():
    m = proto.ModelProto()
    m.trainer_spec.model_type = 3
    with pytest.raises(ValueError):
        sp.Pieces.of(m)


def test_every_operator_is_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{i}" for i in range(1, 11)]
    assert set(oracle_sql()) <= set(names)


COLUMNS = {
    "op1_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op4_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op8_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_permutation_search": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = {r[0]: (*r[:5], *r[5:]) for r in cases.documents() if r[0] is not None and "\0" not in (r[1] or "")}
    spark.createDataFrame(list(rows.values()), cases.SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rng = np.random.default_rng(3)
    spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    hosts = ["a.net", "Example.NET", "b.com", "www.example.com", "x.org", "c.io"]
    pages = [(i, f"http://{hosts[i % 6]}/{['de', 'fr', 'en'][i % 3]}/{i}?q", "".join(f'<a href="https://{hosts[(i * k) % 6]}/">' for k in (1, 5))) for i in range(40)] + [(50, None, None), (51, "x", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", list(queries()))
def test_registered_queries(spark, tables, name):
    """Columns and rows of each registered query, and its rows where SQL can tell them."""
    out = queries()[name](spark, tables)
    if name in COLUMNS:
        assert out.schema.simpleString() == "struct<" + COLUMNS[name].replace(", ", ",").replace(" ", ":") + ">"
    got = sorted(map(tuple, out.collect()), key=repr)
    n = spark.read.parquet(f"{tables}/documents.parquet").count()
    if "doc_id" in out.columns and not name.startswith("op2"):
        assert len(got) == len({r[0] for r in got}) == n
    if name in oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "labels", "embeddings", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
        want = con.execute(oracle_sql()[name])
        at = [[c[0] for c in want.description].index(c) for c in out.columns]
        assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of what it decides, on its own input."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words, n))
    passage = text(60)
    good = [text(80) for _ in range(60)]
    good += [f"{text(30)} {passage} {text(30)}" for _ in range(5)]
    good += [good[0], good[1] + " tail", text(40).upper().lower()]
    bad = ["$$$ BUY!!! %s" % text(10).upper() for _ in range(20)]
    rows = [(i, t, "en", "s0" if i % 3 else "s1", len(t)) for i, t in enumerate(good + bad)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    docs, inputs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append([tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()])
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    quality, near, trim, mixed = inputs[1:]
    assert {r[0] for r in quality} == set(range(len(good)))
    least = cases.components(quality)
    assert {r[0] for r in near} == {least[cases.shingles(r[1])] for r in quality}
    plain = {i: (n, gone) for i, n, gone, _ in cases.trimmed(near)}
    assert {r[0] for r in trim} == {i for i, (n, gone) in plain.items() if gone < n}
    before = {r[0]: r[1] for r in near}
    for r in trim:
        assert len(r[1].split()) == plain[r[0]][0] - plain[r[0]][1]
        assert r[1] == before[r[0]] or plain[r[0]][1]
        assert r[4] == len(r[1])
    assert {r[0] for r in mixed} == {r[0] for r in trim} and len(mixed) <= 2 * len(trim) + 2
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    last = {r[0]: r[1] for r in mixed}
    out = docs.collect()
    assert len(out) == len(mixed) and all(list(r.ids) == library.encode(last[r.doc_id]) for r in out)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, out))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline_keeps_nulls_and_repeats(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(1, None, None, None, None), (None, "only a null id here", "en", "a", 19), (2, "same text of two rows", "en", "a", 21), (2, "same text of two rows", "en", "a", 21), (3, "", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == {None, 1, 2, 3}
    assert out.filter(F.col("doc_id") == 2).select("ids").distinct().count() == 1
