"""An index that changes in place, bounded search, substrings, globs and evaluation by mode, on small hand-made input."""

import fnmatch
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.functions import text as T
from fernweave.operators import batch_search, filters, globs, index, lexical, maintenance, pivots, substring
from fernweave.operators import vectors as plain_vectors

SHAPE = "doc_id long, text string, path string"
WORDS = ["red", "fox", "dog", "blue", "green", "the", "a", "sea"]


def rows(rng, ids):
    return [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 12))), f"/p/{k % 3}/{k}") for k in ids]


def ranked(held, terms):
    return [tuple(r) for r in lexical.search(held, terms, k=50).collect()]


def vectors(docs):
    return docs.select("doc_id", (F.col("doc_id") * 2).alias("vec"))


@pytest.fixture
def target(tmp_path):
    return f"{tmp_path}/index"


def test_updates_equal_new_indexes(spark, target, tmp_path):
    """After each update everything is as if the index had been built anew, and only what changed was read."""
    rng = random.Random(2)
    now = dict((r[0], r) for r in rows(rng, range(190)))
    held = index.sync(spark.createDataFrame(list(now.values()), SHAPE), target, "v0", sides={"vectors": vectors})
    assert held.n_read == 190 and held.generation == 1
    for step in range(1, 4):
        for k in rng.sample(sorted(now), 5):
            del now[k]
        changed = {r[0]: r for r in rows(rng, rng.sample(sorted(now), 4))}
        changed = {k: (k, r[1] + " sea", r[2]) for k, r in changed.items()}
        added = {r[0]: r for r in rows(rng, range(1000 * step, 1000 * step + 3))}
        now |= changed | added
        docs = spark.createDataFrame(list(now.values()), SHAPE)
        held = index.sync(docs, target, f"v{step}", sides={"vectors": vectors})
        new = index.build(docs, f"{tmp_path}/new{step}")
        assert held.n_read == 7 and held.version == f"v{step}" and (held.n, held.words) == (new.n, new.words)
        for terms in (["red"], ["fox", "the", "sea"], ["none"]):
            assert ranked(held, terms) == ranked(new, terms)
            assert lexical.frequencies(held, terms) == lexical.frequencies(new, terms)
        key = lambda i: {(r.term, r.doc_id, r.tf, r.dl, tuple(r.positions)) for r in i.postings.collect()}
        assert key(held) == key(new)
        assert {r.vec for r in held.tables("vectors").collect()} == {2 * k for k in now}
    assert len(held.segments) == 4
    same = index.sync(docs, target, "v9", sides={"vectors": vectors})
    assert same.n_read == 0 and same.segments == held.segments
    merged = index.merge(same)
    assert len(merged.segments) == 1 and not merged.gone and key(merged) == key(new) and ranked(merged, ["fox", "sea"]) == ranked(new, ["fox", "sea"])
    assert {r.vec for r in merged.tables("vectors").collect()} == {2 * k for k in now}
    gone = index.vacuum(spark, target, 1)
    assert gone and ranked(index.load(spark, target), ["fox", "sea"]) == ranked(new, ["fox", "sea"])


def test_a_merge_is_due(spark, target):
    rng = random.Random(3)
    docs = rows(rng, range(40))
    held = index.sync(spark.createDataFrame(docs, SHAPE), target)
    for step in range(index.MOST_SEGMENTS + 1):
        docs = [*docs, *rows(rng, [1000 + step])]
        held = index.sync(spark.createDataFrame(docs, SHAPE), target)
    assert len(held.segments) <= index.MOST_SEGMENTS and held.n == len(docs)
    held = index.delete(held, spark.createDataFrame([(k,) for k in range(30)], "doc_id long"))
    assert held.n == len(docs) - 30 and held.n_gone == 0 and len(held.segments) == 1


def test_delete_upsert_and_fork(spark, target, tmp_path):
    docs = [(1, "red fox", "/p/a"), (2, "red dog", "/p/b"), (3, None, "/q/c"), (None, "red sea", "/q/d"), (4, "red", "/p/a/x"), (4, "red red", "/p/a/y")]
    held = index.build(spark.createDataFrame(docs, SHAPE), target)
    branch = index.fork(held, f"{tmp_path}/fork")
    branch = index.delete_where(branch, F.col("path").startswith("/p/a/"))
    assert branch.n == 4 and held.n == 6 and index.load(spark, target).n == 6
    branch = index.upsert(branch, spark.createDataFrame([(2, "blue dog", "/p/b"), (None, "blue", "/q/d"), (9, "blue blue", "/r")], SHAPE))
    assert branch.n == 5 and branch.n_read == 3
    assert {r.doc_id for r in lexical.search(branch, ["red"]).collect()} == {1}
    assert {r.doc_id for r in lexical.search(branch, ["blue"]).collect()} == {2, None, 9}
    empty = index.delete(branch, spark.createDataFrame([(1,), (2,), (3,), (9,), (None,)], "doc_id long"))
    assert empty.n == 0 and ranked(empty, ["red"]) == []
    assert [tuple(r) for r in lexical.search(index.upsert(empty, spark.createDataFrame([(5, "red", "/z")], SHAPE)), ["red"]).collect()] != []


def test_generations(spark, target):
    """A generation that was not finished is passed over, one of another format not read."""
    held = index.build(spark.createDataFrame([(1, "red", "/a")], SHAPE), target)
    spark.createDataFrame([(99, "x", [], [], 7, 7, 0, 0)], index.MANIFEST).write.parquet(f"{target}/generations/gen=2")
    assert index.load(spark, target).generation == 1
    later = index.upsert(held, spark.createDataFrame([(2, "red", "/b")], SHAPE))
    assert later.generation == 3 and index.load(spark, target).n == 2


@pytest.mark.parametrize("rounds", [(16, 128), (1, 1), (6, 2)])
def test_bounded_search(spark, target, rounds, monkeypatch):
    """The rows of a full search, from fewer blocks where a rare term decides."""
    monkeypatch.setattr(lexical, "ROUNDS", rounds)
    rng = random.Random(4)
    docs = [(k, " ".join(["the"] * rng.randint(1, 4) + rng.choices(WORDS, k=rng.randint(0, 9)) + ["rare"] * (k % 997 == 5)), f"/p/{k % 2}") for k in range(3000)]
    held = index.build(spark.createDataFrame(docs, SHAPE), target)
    for terms, k in ((["the", "rare"], 4), (["the"], 10), (["red", "fox", "fox"], 7), (["none"], 5), (["the", "sea"], 5000)):
        search = lexical.BoundedSearch(held, terms, k)
        assert [tuple(r) for r in search.result().collect()] == [tuple(r) for r in lexical.search(held, terms, k=k).collect()], terms
        if terms == ["the", "rare"] and rounds[0] == 6:
            # four blocks have the rare term, whose score no other reaches
            assert search.n_blocks == 47 and search.n_read <= 8
    where = F.col("path") == "/p/1"
    assert [tuple(r) for r in lexical.BoundedSearch(held, ["the", "fox"], 5, where).result().collect()] == [tuple(r) for r in lexical.search(held, ["the", "fox"], k=5, where=where).collect()]
    less = index.delete(held, spark.createDataFrame([(5,), (1002,)], "doc_id long"))
    assert [tuple(r) for r in lexical.BoundedSearch(less, ["the", "rare"], 4).result().collect()] == [tuple(r) for r in lexical.search(less, ["the", "rare"], k=4).collect()]


def test_substrings(spark):
    rng = random.Random(6)
    values = [(k, "".join(rng.choices("aAbB/é.", k=rng.randint(0, 9)))) for k in range(150)] + [(200, None), (201, ""), (7, "aab"), (None, "AbA")]
    needles = [(k, "".join(rng.choices("abAB/É.", k=rng.randint(1, 5)))) for k in range(60)] + [(60, ""), (61, None), (62, "aba"), (62, "zz"), (63, "b")]
    df = spark.createDataFrame(values, "doc_id long, value string")
    found = {tuple(r) for r in substring.containing(substring.pieces(df), df, spark.createDataFrame(needles, "needle_id long, needle string")).collect()}
    expected = {(n, d) for n, x in needles if x for d, v in values if v and x.lower() in v.lower()}
    assert {x for x in found if x[1] is not None} == {x for x in expected if x[1] is not None}


def test_globs_as_fnmatch_has_them():
    rng = random.Random(0)
    for _ in range(3000):
        rules = ["".join(rng.choice(["a", "b", "/", "*", "?", "[ab]", "[!a]", "[a-c]", "[", "]", "x", "[+-9]"]) for _ in range(rng.randint(0, 6))) for _ in range(3)]
        text = "".join(rng.choice("abcx/[]") for _ in range(rng.randint(0, 6)))
        expected = tuple(k for k, g in enumerate(rules) if fnmatch.fnmatchcase(text, g))
        assert globs.Automaton([globs.steps(g) for g in rules]).matches(text) == expected
        assert tuple(k for k, g in enumerate(rules) if re.match(filters.glob_pattern(g), text)) == expected
        name = text.rsplit("/", 1)[-1]
        out = any((fnmatch.fnmatchcase(text, g) or g.endswith("/**") and fnmatch.fnmatchcase(text, g[:-3])) if "/" in g else fnmatch.fnmatchcase(name, g) for g in rules)
        assert bool(globs.exclusions(tuple(rules)).matches(text)) == out


def test_many_globs_cost_no_more(spark):
    """Once its states are made, the automaton looks as often at a path for 5,000 globs as for ten."""
    class Counting(globs.Automaton):
        looked = 0

        def _arc(self, state, c):
            Counting.looked += 1
            return super()._arc(state, c)

    machine = Counting([globs.steps(f"*doc_{k}[0-4]?.*") for k in range(5000)])
    paths = [f"/corpus/en/doc_{k}.md" for k in range(0, 9000, 7)]
    first = [machine.matches(p) for p in paths]
    made = Counting.looked
    assert [machine.matches(p) for p in paths] == first and Counting.looked == made
    assert first[paths.index("/corpus/en/doc_700.md")] == (7,)


def test_exclusions_in_spark(spark):
    df = spark.createDataFrame([("/a/B.md",), ("/a/c.txt",), (None,), ("/skip",), ("/skip/x/y",), ("/skipped",)], "path string")
    keep = lambda rules: [r.path for r in df.filter(~filters.excluded(F.col("path"), rules)).collect()]
    assert keep(["[b-c].MD", "/skip/**"]) == ["/a/c.txt", None, "/skipped"]
    assert len(keep([])) == 6


def test_evaluation_by_mode(spark):
    lexical_pool = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0), (2, 20, 1.0)], "query_id long, doc_id long, score double")
    near = spark.createDataFrame([(1, 11, 0.9), (1, 12, 0.5), (3, 30, 0.7)], "query_id long, doc_id long, score double")
    from fernweave.operators import fusion

    fused = fusion.fuse(batch_search.candidates(lexical_pool, near), ("query_id",))
    best = batch_search.by_mode(fused)
    got = {(r.mode, r.query_id, r["rank"]): (r.doc_id, r.score) for r in best.collect()}
    assert got["literal", 1, 1] == (10, 3.0) and got["semantic", 1, 1] == (11, 0.9) and got["hybrid", 1, 1] == (11, 0.6)
    assert got["hybrid", 2, 1] == (20, 0.4) and got["hybrid", 3, 1] == (30, 0.6) and ("literal", 3, 1) not in got
    labels = spark.createDataFrame([(1, 10), (3, 30), (3, 31), (4, 1)], "query_id long, doc_id long")
    kinds = spark.createDataFrame([(1, "a"), (3, "b"), (4, "b")], "query_id long, kind string")
    found = {(r["mode"], r.kind): (r.n_queries, r.top1, r.recall, r.mrr) for r in batch_search.evaluate_modes(best, labels, kinds).collect()}
    assert found["literal", "a"] == (1, 1.0, 1.0, 1.0) and found["literal", "b"] == (2, 0.0, 0.0, 0.0)
    assert found["semantic", "b"] == (2, 0.5, 0.25, 0.5) and found["hybrid", "all"][0] == 3 and len(found) == 9


def test_marks_of_direction(spark):
    row = spark.createDataFrame([("a‮b⁦‏\x07\t\nc",)], "t string").select(T.visible(F.col("t"))).first()[0]
    assert row == "a\\u202eb\\u2066\\u200f\\u0007\t\nc"


def test_newest_of_all(spark):
    df = spark.createDataFrame([(k, k % 3, k % 5) for k in range(20)], "event_id long, kind long, ts long")
    assert [r.event_id for r in maintenance.newest(df, None, "ts", 5).collect()] == [4, 9, 14, 19, 3]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_pivots(spark, tmp_path, spread):
    """The rows of a full scan, for vectors of any length; clustered ones are mostly left out."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    data = [(k, (centres[k % 12] + spread * rng.normal(size=8)).tolist()) for k in range(600)] + [(600, None)] + [(601 + k, centres[0].tolist()) for k in range(15)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    pivots.build(df, f"{tmp_path}/pivots")
    held = pivots.load(spark, f"{tmp_path}/pivots")
    asked = df.filter("vec_id % 25 = 0")
    best, seen = pivots.nearest(held, asked, 7)
    assert {tuple(r) for r in best.collect()} == {tuple(r) for r in plain_vectors.nearest(df, asked, 7).collect()}
    share = sum(r.n_seen for r in seen.collect()) / (615 * 24)
    assert share <= 1 and (spread > 0.5 or share < 0.4)
    allowed = df.filter("vec_id % 7 = 3").select("vec_id")
    masked, _ = pivots.nearest(held, asked, 7, allowed)
    assert {tuple(r) for r in masked.collect()} == {tuple(r) for r in plain_vectors.nearest(df.join(allowed, "vec_id", "left_semi"), asked, 7).collect()}


def test_pivots_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pivots.build(none, f"{tmp_path}/pivots")
    held = pivots.load(spark, f"{tmp_path}/pivots")
    assert pivots.nearest(held, none)[0].isEmpty() and pivots.load(spark, f"{tmp_path}/none") is None


def test_no_moves_of_files_that_are_still_there(spark):
    """A hard link is a new file, not a move: its first name is there; a copy that changed isn't a move either."""
    shape = "path string, size long, mtime double, content_hash string, file_id string"
    old = spark.createDataFrame([("/a", 1, 1.0, "h1", "1"), ("/b", 1, 1.0, "h2", "2"), ("/c", 1, 1.0, "h3", "3")], shape)
    new = spark.createDataFrame([("/a", 1, 1.0, "h1", "1"), ("/a_link", 1, 1.0, "h1", "1"), ("/b2", 1, 1.0, "h2", "2"), ("/c2", 2, 2.0, "h9", "3")], shape)
    assert [tuple(r) for r in maintenance.moves(old, new).select("new_path", "old_path").collect()] == [("/b2", "/b")]
    assert {r.path for r in maintenance.vanished(old, new).collect()} == {"/b", "/c"}
