"""The persisted index, exact neighbours, shown hits and guards on small hand-made input."""

import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from fernweave.functions import text as T
from fernweave.jobs import queries, store
from fernweave.operators import fusion, index, lexical, maintenance, scope, vectors


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    docs = [(1, "red fox red"), (2, "red dog"), (3, "blue dog fox"), (4, None), (5, ""), (6, "fox red fox red fox"), (7, "GREEN, green!")]
    target = str(tmp_path_factory.mktemp("index"))
    index.build(spark.createDataFrame(docs, "doc_id long, text string").withColumn("path", F.concat(F.lit("/p/"), "doc_id")), target)
    return index.load(spark, target)


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_index(spark, held, tmp_path):
    assert held.n == 7 and held.average == pytest.approx(15 / 7)
    rows = {(r.term, r.doc_id): (r.tf, r.positions, r.dl) for r in held.postings.collect()}
    assert rows["fox", 6] == (3, [0, 2, 4], 5) and rows["green", 7] == (2, [0, 1], 2) and len(rows) == 10
    assert index.load(spark, f"{tmp_path}/none") is None


def test_blank_and_unknown_queries(held):
    assert ids(lexical.search(held, [])) == [] and ids(lexical.search(held, ["zzz"])) == []
    assert ids(lexical.search(held, ["zzz", "dog"], "auto")) == [2, 3]
    assert ids(lexical.search(held, ["zzz", "dog"], "and")) == []
    with pytest.raises(ValueError):
        lexical.search(held, ["dog"], "not")


def test_modes_and_filters(held):
    assert set(ids(lexical.search(held, ["red", "fox"], "and"))) == {1, 6}
    assert set(ids(lexical.search(held, ["red", "fox"]))) == {1, 2, 3, 6}
    assert ids(lexical.search(held, ["red"], where=F.col("path") == "/p/2")) == [2]


def test_phrases(held):
    assert set(ids(lexical.phrases(held, [["red", "fox"]]))) == {1, 6}
    assert ids(lexical.phrases(held, [["fox", "red", "fox", "red", "fox"]])) == [6]
    assert ids(lexical.phrases(held, [["green", "green"], ["blue"]])) == [7, 3] or set(ids(lexical.phrases(held, [["green", "green"], ["blue"]]))) == {3, 7}
    assert ids(lexical.phrases(held, [["dog", "red"]])) == []


@pytest.mark.parametrize("n", [19_999, 20_001])
def test_the_same_rules_at_every_size(spark, tmp_path, n):
    """A common term is left out when it is asked for, and never by itself."""
    target = f"{tmp_path}/index"
    index.build(spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "common rare").when(F.col("id") < 2000, "common").otherwise("other").alias("text")), target)
    held = index.load(spark, target)
    assert lexical.search(held, ["common", "rare"], k=n).count() == -(-n // 10) + 1800
    assert lexical.without_common({"a": 700, "b": 5, "c": 0}, n, ["a", "b", "c"]) == ["b"]
    assert lexical.without_common({"a": 7000, "b": 900, "c": 800, "d": 0}, n, ["a", "b", "c", "d"]) == ["c", "b"]
    assert lexical.without_common({"d": 0}, n, ["d"]) == ["d"]


def test_index_follows_its_files(spark, tmp_path):
    folder = f"{tmp_path}/tables"
    for n in (2, 3):
        docs = [(k, f"word{k} text", "en", "s", 5) for k in range(n)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        assert store.document_index(spark, folder).n == n
    assert store.document_index(spark, folder).postings.inputFiles() == store.document_index(spark, folder).postings.inputFiles()


def test_known_items(spark, tmp_path):
    """Items of one and two words, parts of words, and words that stand but not together."""
    folder = f"{tmp_path}/tables"
    docs = [(1, "alpha beta gamma delta"), (2, "beta alpha gamma delta"), (3, "xalpha beta gammax"), (4, None), (5, "Alpha beta gamma")]
    items = [(1, "alpha beta gamma"), (2, "beta"), (3, "a gamma"), (4, "lpha beta gam"), (5, ""), (6, "no such words here"), (7, ", ")]
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = {tuple(r) for r in queries.known_items(spark, folder).select("item_id", "doc_id").collect()}
    assert found == {(i, d) for i, x in items for d, t in docs if x and t and x in t}
    found = {tuple(r) for r in queries.known_items(spark, folder, any_case=True).select("item_id", "doc_id").collect()}
    assert found == {(i, d) for i, x in items for d, t in docs if x and t and x.lower() in t.lower()}


def test_nearest(spark):
    rng = np.random.default_rng(3)
    table = np.round(rng.integers(-2, 3, (300, 4)) / 2, 1)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(table)] + [(1000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    asked = df.filter("vec_id in (3, 7, 1000)")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.similarity) for r in vectors.nearest(df, asked, 12).collect()}
    for q in (3, 7):
        best = sorted(((-round(float(table[q] @ v), 6), k) for k, v in enumerate(table)))[:12]
        assert [found[q, n] for n in range(1, 13)] == [(k, pytest.approx(-s)) for s, k in best]
    assert len(found) == 24
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="one length"):
        vectors.nearest(ragged, ragged)
    with pytest.raises(PythonException, match="2 numbers"):
        vectors.nearest(ragged, ragged.filter("vec_id = 1")).collect()


def test_rolling_rate(spark):
    rng = random.Random(4)
    times = [rng.choice([rng.randrange(10**6), 500_000 + rng.randrange(50)]) / 100 for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(times)), "event_id long, s double").select("event_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    found = {r.event_id: (r.n_events, r.per_second) for r in scope.rolling_rate(rows, 60).collect()}
    for k, t in enumerate(times):
        window = [x for x in times if round((t - 60) * 1e6) <= round(x * 1e6) <= round(t * 1e6)]
        assert found[k][0] == len(window) and found[k][1] == pytest.approx(len(window) / max(t - min(window), 1.0), abs=1e-5)


def test_shown_and_collapsed(spark):
    best = spark.createDataFrame([(1, 4, 2.0), (2, 5, 1.0)], "doc_id long, ordinal int, score double")
    near = spark.createDataFrame([(1, 0, 0.3), (1, 1, 0.4), (2, 7, 0.9), (3, 2, 0.5), (9, 1, 0.8)], "doc_id long, ordinal int, score double")
    units = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c")], "doc_id long, path string")
    texts = spark.createDataFrame([(1, 4, "four"), (2, 7, "seven!")], "doc_id long, ordinal int, text string")
    rows = {r.doc_id: (r.path, r.ordinal, r.shown) for r in fusion.shown(fusion.over_chunks(best, near), units, texts, 5, 5).collect()}
    assert rows == {1: ("/a", 4, "four"), 2: ("/b", 7, "seven"), 3: ("/c", 2, None)}
    hits = spark.createDataFrame([(1, 0.5, "h"), (2, 0.9, "h"), (3, 0.5, "h"), (4, 0.1, None), (5, 0.1, "")], "doc_id long, score double, key string")
    assert {r.doc_id: (r.duplicates, r.n_duplicates) for r in fusion.collapse(hits, "key").collect()} == {2: ([1, 3], 2), 4: ([], 0), 5: ([], 0)}


def test_guards(spark):
    one = spark.createDataFrame([("ok", "/a/x.md", "x.md", ".md")], "status string, path string, filename string, extension string")
    may = lambda **k: not one.filter(scope.allowed(*(F.col(c) for c in one.columns), **({"roots": ["/a"], "globs": []} | k))).isEmpty()
    assert may() and not may(roots=[]) and not may(globs=["*.MD"]) and not may(within=["/b"]) and may(extensions=["md"]) and not may(extensions=["txt"])
    old = spark.range(200).select(F.concat(F.lit("/"), F.col("id").cast("string")).alias("path"))
    assert maintenance.vanished(old, old.limit(150)).count() == 50 and maintenance.vanished(old, old.limit(99)).count() == 0
    assert maintenance.vanished(old.limit(100), old.limit(0)).count() == 100


def test_bound_vectors(spark):
    vecs = spark.createDataFrame([(1, "m", [1.0, 2.0]), (2, "m", [1.0, 2.0])], "vec_id long, model string, embedding array<float>")
    state = lambda *a: (lambda s, v: (s, v.count()))(*maintenance.bound(*a))
    assert state(vecs, "m", 2, False) == ("ok", 2) and state(vecs, "m", 3, True) == ("reset", 0) and state(vecs.limit(0), "n", 2, False) == ("created", 0)
    with pytest.raises(ValueError):
        maintenance.bound(vecs, "n", 2, False)


def test_signed_tokens(spark):
    part = "A" * 20
    cases = {f"x eyJ{part}.eyJ{part}.{part} y": True, f"zzeyJ{part}.eyJ{part}.{part}": True, f"eyJ{part}.eyJ{part}": False, f"{part}.eyJ{part}.eyJ{part}.{part}": True, f"eyJ{part[1:]}.eyJ{part}.{part}": False, f"eyJ{part}.{part}.{part}": False, "": False, "eyJ" * 100_000: False}
    df = spark.createDataFrame(list(cases), "string").select(T.has_signed_token(F.col("value")).alias("found"), "value")
    assert {r.value: r.found for r in df.collect()} == cases


def test_names_and_times(spark):
    df = spark.createDataFrame([("a%b_c*\\?", "it's", "a\x07b\tc\x9f\n", 1.7e9 + 0.9)], "g string, q string, v string, s double")
    row = df.select(T.like_pattern(F.col("g")), T.quoted(F.col("q")), T.visible(F.col("v")), T.iso_time(F.col("s")), T.epoch_seconds(T.iso_time(F.col("s")))).first()
    assert tuple(row) == ("a\\%b\\_c%\\\\_", "'it''s'", "a\\u0007b\tc\\u009f\n", "2023-11-14T22:13:20Z", 1_700_000_000)
