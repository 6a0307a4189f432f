"""What keeps disk and memory of large tables down: the same results from slices, without an index, with bounded batches."""

import random
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fernweave.functions import stem
from fernweave.jobs import queries, store, updating
from fernweave.jobs.queries import QUERIES
from fernweave.operators import index, lexical
from fernweave.streaming import pairing

FOLDER = "/root/testdata/sf0.001"


def test_stems_of_many_texts_take_little_memory(monkeypatch):
    """The words of all texts of a batch are never Python's at once, whatever the batch's size."""
    monkeypatch.setattr(stem, "AT_ONCE", 100_000)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(2000)]
    texts = pa.array([" ".join(rng.choices(words, k=300)) for _ in range(1500)] + [None, ""])
    stem.stemmed_lists(texts)
    tracemalloc.start()
    found = stem.stemmed_lists(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1502 and found[-2].as_py() == found[-1].as_py() == []
    assert found[7].as_py() == stem.words_of(texts[7].as_py())
    assert peak < 8e6  # all words at once are over 25 MB


def test_stemmed_search_splits_texts_in_slices(spark, tmp_path, monkeypatch):
    """An index of stems from slices and small batches is that of one batch."""
    docs = spark.createDataFrame([(k, f"Running dogs {'jumped ' * (k % 5)}naïve {k}") for k in range(60)], "doc_id long, text string")
    whole = index.build(docs, f"{tmp_path}/whole", stem.index_words)
    monkeypatch.setattr(index, "SLICE_WORDS", 50)
    monkeypatch.setattr(index, "AT_ONCE", 20)
    cut = index.build(docs, f"{tmp_path}/cut", stem.index_words)
    key = lambda i: sorted((r.term, r.doc_id, r.tf, r.dl, *r.positions) for r in i.postings.collect())
    assert key(whole) == key(cut) and (whole.n, whole.words) == (cut.n, cut.words)
    assert [tuple(r) for r in lexical.search(whole, ["run", "naiv"]).collect()] == [tuple(r) for r in lexical.search(cut, ["run", "naiv"]).collect()]


def test_chunk_table_builds_no_index(spark, monkeypatch):
    def none(*_):
        raise AssertionError("the table of chunks needs no index")

    monkeypatch.setattr(store, "chunk_index", none)
    assert QUERIES["chunk_table"](spark, FOLDER).count() > 0


@pytest.mark.parametrize("slices", [1, 3])
def test_slices_of_a_segment(spark, tmp_path, monkeypatch, slices):
    """Postings, blocks and frequencies are those of a plain count; units of one doc_id and length are one, null ids too."""
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choices(["red", "fox", "Sea", "x1"], k=rng.randint(0, 30)))) for k in range(-3, 200)]
    docs += [(7, "red fox"), (7, "fox fox"), (8, None), (None, "red a"), (None, "sea red"), (None, "sea")]
    for name, value in (("SLICE_WORDS", 4000 // slices), ("MOST_SLICES", slices), ("FILE_WORDS", 300), ("AT_ONCE", 64)):
        monkeypatch.setattr(index, name, value)
    held = index.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), f"{tmp_path}/i")
    places = defaultdict(list)
    for k, text in docs:
        words = (text or "").lower().split()
        for at, w in enumerate(words):
            places[w, k, len(words)].append(at)
    expected = {(*key, len(at), tuple(sorted(at))) for key, at in places.items()}
    assert Counter((r.term, r.doc_id, r.dl, r.tf, tuple(r.positions)) for r in held.postings.collect()) == Counter(expected)
    assert lexical.frequencies(held, ["red", "sea", "a"]) == {t: sum(e[0] == t for e in expected) for t in ("red", "sea", "a")}
    bounds = held.blocks.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.sum("n").alias("n")).collect()
    block = lambda k: (-1 if k is None else k) // index.BLOCK
    for r in bounds:
        mine = [e for e in expected if e[0] == r.term and block(e[1]) == r.block]
        assert (r.tf, r.dl, r.n) == (max(e[3] for e in mine), min(e[2] for e in mine), len(mine))
    assert len(bounds) == len({(e[0], block(e[1])) for e in expected})


def test_only_renames_go_through_the_state_by_root(spark, tmp_path):
    pairing.coalesced_stream(spark, f"{FOLDER}/events.parquet", f"{tmp_path}/s")
    reports = pairing.reported(spark.read.parquet(f"{FOLDER}/events.parquet"))
    renames = reports.filter("action like 'renamed%'").count()
    assert spark.read.parquet(f"{tmp_path}/s/others/rows").count() == reports.count() - renames
    paired = pairing.paired(reports).filter("action = 'renamed'").select("event_id", "path", "old_path")
    kept = spark.read.parquet(f"{tmp_path}/s/changes/rows").select("event_id", "path", "old_path")
    assert kept.count() and {tuple(r) for r in kept.collect()} == {tuple(r) for r in paired.collect()}


def test_rankings_are_made_once(spark, monkeypatch):
    """What a query reads twice is a written table by then, with the rows that it had."""
    seen = []

    def written(rows):
        seen.append((sorted(rows.collect()), store.kept(rows)))
        return seen[-1][1]

    monkeypatch.setattr(updating, "kept", written)
    assert QUERIES["evaluation_by_mode"](spark, FOLDER).count() and QUERIES["hybrid_batch"](spark, FOLDER).count()
    assert len(seen) == 2 and all(rows and rows == sorted(table.collect()) for rows, table in seen)


@pytest.mark.parametrize("most", [0, 10**6])
def test_labels_by_sent_or_shuffled_ids(spark, monkeypatch, most):
    monkeypatch.setattr(queries, "MOST_IDS", most)
    found = {tuple(r) for r in queries.known_items(spark, FOLDER).collect()}
    texts, items = (spark.read.parquet(f"{FOLDER}/{name}.parquet").collect() for name in ("documents", "benchmark"))
    assert found == {(b.item_id, d.doc_id) for b in items for d in texts if d.text and b.text and b.text in d.text}


def test_a_merge_shuffles_no_postings(spark, tmp_path):
    """Segments are put together without their dead rows, in the order of their files; null ids may be dead too."""
    docs = [(k, f"red fox {k}", f"/p/{k}") for k in range(40)] + [(None, "red sea", "/n")]
    held = index.build(spark.createDataFrame(docs, "doc_id long, text string, path string"), f"{tmp_path}/i")
    held = index.delete(held, spark.createDataFrame([(3,), (None,)], "doc_id long"))
    held = index.upsert(held, spark.createDataFrame([(5, "blue", "/p/5")], "doc_id long, text string, path string"))
    (old, *_) = held.segments
    rows = held.alive(old, "postings")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan.replace("Exchange hashpartitioning(doc_id", "", 1)
    assert {r.doc_id for r in rows.collect()} == {*range(40)} - {3, 5}
    merged = index.merge(held)
    assert len(merged.segments) == 1 and {r.doc_id for r in merged.postings.collect()} == {*range(40)} - {3}
