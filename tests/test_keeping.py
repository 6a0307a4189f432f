"""Stemming, settled changes, exact ranks and scopes against plain ways to the same results."""

import random
import sqlite3
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from fernweave.functions import stem
from fernweave.functions import text as T
from fernweave.jobs.keeping import ASKED
from fernweave.jobs.queries import QUERIES
from fernweave.operators import maintenance, scope
from fernweave.sources import files
from fernweave.streaming import changes, live, pairing

FOLDER = "/root/testdata/sf0.001"
ENGLISH = """relational conditional valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism
decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance
inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective
bowdlerize probate rate cease controll roll caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling
hissing fizzed failing filing happy sky generalizations oscillators licensing licensed analogy geology café naïve yes syzygy by a it""".split()


def full_text(rows):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, x) values (?, ?)", rows)
    con.execute("create virtual table v using fts5vocab(t, 'row')")
    return con


def documents():
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{FOLDER}/documents.parquet'").fetchall()


def test_stems_are_those_of_a_full_text_index():
    for word in ENGLISH:
        con = full_text([(1, word)])
        assert [r[0] for r in con.execute("select term from v")] == [stem.stem(w) for w in stem.WORD.findall(stem.folded(word))], word
    assert stem.words_of(None) == [] and stem.words_of("") == []


def test_stemmed_terms(spark):
    expected = dict(full_text(documents()).execute("select term, doc from v").fetchall())
    assert {r.term: r.df for r in QUERIES["stemmed_terms"](spark, FOLDER).collect()} == expected


def test_bm25_stemmed(spark):
    con = full_text(documents())
    expected = con.execute("select rowid, -bm25(t) from t where t match ? order by bm25(t) limit 300", (" OR ".join(ASKED),)).fetchall()
    expected = sorted(((round(s, 6), i) for i, s in expected), key=lambda x: (-x[0], x[1]))[:10]
    found = [(r.score, r.doc_id) for r in QUERIES["bm25_stemmed"](spark, FOLDER).collect()]
    assert [i for _, i in found] == [i for _, i in expected]
    assert all(abs(a - b) < 1e-5 for (a, _), (b, _) in zip(found, expected, strict=True))


def plain_bursts(reports, quiet):
    """Pairing and coalescing by plain loops; reports are (event_id, ts, root, path, action)."""
    old, changes = {}, []
    for i, ts, root, path, action in sorted(reports, key=lambda r: (r[1], r[0])):
        if action == "renamed_old":
            old[root] = path
        elif action == "renamed_new":
            changes.append((ts, i, path, "renamed", old.pop(root, None)))
        else:
            changes.append((ts, i, path, action, None))
    held, done = {}, []
    for ts, _, path, action, was in changes:
        burst = held.get(path)
        if burst and ts - burst[3] > quiet:
            done.append((path, *burst[:3], burst[4]))
            burst = None
        if burst and burst[0] == "removed" and action in ("modified", "added"):
            action = "added"
        held[path] = (action, was or (burst[1] if burst else None), burst[2] if burst else ts, ts, burst[4] + 1 if burst else 1)
    return Counter(done + [(p, *b[:3], b[4]) for p, b in held.items()])


def test_pairs_and_bursts(spark):
    random.seed(5)
    began = datetime(2024, 1, 1)
    actions = ["added", "removed", "removed", "modified", "renamed_old", "renamed_new"]
    reports = [(i, began + timedelta(minutes=random.randrange(3000)), f"/r{i % 3}", f"/r{i % 3}/{random.randrange(9)}", random.choice(actions)) for i in range(1500)]
    df = spark.createDataFrame(reports, "event_id long, ts timestamp, root string, path string, action string")
    found = pairing.coalesced(pairing.paired(df), "20 minutes").select("path", "action", "old_path", "started", "n_events")
    assert Counter(tuple(r) for r in found.collect()) == plain_bursts(reports, timedelta(minutes=20))


def test_stream_goes_on(spark, tmp_path):
    """A second run in the same folder takes up what the first left open, and reads no sibling of the events."""
    began = datetime(2024, 1, 1)
    rows = [(i, began + timedelta(minutes=40 * i + (400 if i > 30 else 0)), i % 2, ["signup", "error", "click", "purchase"][i % 4], 0.0) for i in range(60)]
    shape = "event_id long, ts timestamp, user_id long, event_type string, value double"
    place, state = f"{tmp_path}/events", f"{tmp_path}/state"
    spark.createDataFrame(rows[:25], shape).coalesce(1).write.parquet(place)
    spark.createDataFrame([(999, began, 7, "click", 0.0)], shape).write.parquet(place + ".bak")
    for more in (None, rows[25:45], rows[45:]):
        if more:
            spark.createDataFrame(more, shape).coalesce(1).write.mode("append").parquet(place)
        found = {(r.path, r.started): r.n_events for r in live.settled_stream(spark, place, state).collect()}
        merged = pairing.coalesced_stream(spark, place, state + "2").collect()
    whole = spark.createDataFrame(rows, shape)
    closed = max(r[1] for r in rows) - timedelta(hours=1)
    ended = {(r.path, r.started): r.n_events for r in changes.settled(changes.watch_events(whole)).collect()}
    assert found and found == {k: n for k, n in ended.items() if k in found} and len(ended) - len(found) <= 2
    bursts = plain_bursts([(r.event_id, r.ts, r.root, r.path, r.action) for r in pairing.reported(whole).collect()], timedelta(hours=1))
    assert merged and not Counter(tuple(r) for r in merged) - bursts
    assert sum(bursts.values()) - len(merged) <= 2 and all(r.started <= closed for r in merged)


def test_ranked_values(spark):
    random.seed(6)
    rows = [(k, random.choice([1.0, 2.0, random.random() * 9])) for k in "abc" for _ in range({"a": 1, "b": 20, "c": 30_001}[k])] + [("d", None), ("a", None)]
    found = {(r.key, r.share): r.v for r in scope.ranked_values(spark.createDataFrame(rows, "k string, v double"), "k", "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    assert found == {(k, s): sorted(g)[min(int(len(g) * s), len(g) - 1)] for k, g in groups.items() for s in (0.0, 0.5, 0.95, 1.0)}


def test_scopes(spark):
    docs = spark.createDataFrame([("/a/x.md", "x.md"), ("/ab/y.md", "y.md")], "path string, filename string")
    assert scope.out_of_scope(docs, [], []).count() == 0
    assert [r.path for r in scope.out_of_scope(docs, ["/a"], []).collect()] == ["/ab/y.md"]
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/a",), ("/ab/c/d",)], "root string")
    assert sorted(r.root for r in scope.outermost(roots).collect()) == ["/a", "/ab"]
    changes = spark.createDataFrame([("/r", "removed", None), ("/r/z.md", "removed", None), ("/n.md", "renamed", "/r/x.md"), ("/q", "removed", None)], "path string, action string, old_path string")
    known = spark.createDataFrame([("/r/x.md",), ("/r/s/y.md",), ("/rr/y.md",)], "path string")
    jobs = Counter(tuple(r) for r in scope.jobs_of_changes(changes, known, F.lit(True)).collect())
    assert jobs == Counter([("/r/x.md", "vanish", 2, 2), ("/r/s/y.md", "vanish", 2, 1), ("/n.md", "index", 2, 1)])


def test_words_and_notes(spark):
    df = spark.createDataFrame([("C:\\A\\B.txt\\", 'say "x" it\'s'), ("file:///a//", ""), ("/", None)], "p string, q string")
    rows = df.select(T.normalized_path(F.col("p")).alias("p"), T.match_expression(F.split("q", " "), "AND").alias("m"), F.array_join(T.freetext_words(F.col("q")), "|").alias("f")).collect()
    assert [tuple(r) for r in rows] == [("c:/a/b.txt", '"say" AND """x""" AND "it\'s"', "say|it's"), ("/a", '""', ""), ("/", None, None)]
    notes = spark.createDataFrame([(5, 5, False, 10), (1200, 3, True, 1500)], "n int, e int, t boolean, c int").select(T.coverage_note(F.col("n"), F.col("e"), F.col("t"), F.col("c")).alias("note")).collect()
    assert notes[0].note is None and notes[1].note == "vectors for 3 of 1,200 chunks, words for all; indexed up to character 1,500"


def test_inventory(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, size in (("a/x.MD", 3), ("a/b/y.txt", 1), ("a/b/z.json", 7), ("a/empty.txt", 0), ("a/_hidden.txt", 2)):
        (tmp_path / name).write_bytes(b"q" * size)
    found = files.inventory(spark, f"file://{tmp_path}", ["*.JSON"])
    assert sorted((r.path.removeprefix(str(tmp_path)), r.filename, r.extension, r.size) for r in found.collect()) == [("/a/b/y.txt", "y.txt", ".txt", 1), ("/a/x.MD", "x.MD", ".md", 3)]
    assert files.covers(found, f"{tmp_path}/a") and not files.covers(found, f"{tmp_path}/c")
    assert [bytes(r.content) for r in files.inventory(spark, f"file://{tmp_path}", ["y.txt", "z*"], content=True).collect()] == [b"qqq"]
    assert files.inventory(spark, f"file://{tmp_path}", since="2100-01-01T00:00:00").count() == 0


def test_stale_and_quarantined(spark):
    made = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (3, 1, None)], "doc_id long, ordinal int, text_hash string")
    now = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (2, 0, "c"), (2, 1, "e")], "doc_id long, ordinal int, text_hash string")
    assert [r.doc_id for r in maintenance.fresh_vectors(made, now).collect()] == [2]
    docs = spark.createDataFrame([(1, "s", "h", "ok"), (2, None, "h", "ok"), (3, "t", None, "missing")], "doc_id long, text string, content_hash string, status string")
    rows = maintenance.quarantined(docs, F.col("text") == "s").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, None, None, "secret_suspected"), (2, None, "h", "ok"), (3, "t", None, "missing")]
