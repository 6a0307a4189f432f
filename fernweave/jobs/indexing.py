"""Registered queries: building an index, searching it for many queries, keeping it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import decode
from ..functions import text as T
from ..operators import batch_search, chunking, filters, fusion, lexical, maintenance, vectors
from ..sources.corpus import corpus, shared_dir, table
from ..streaming import live
from .store import chunk_index, document_index
from .queries import _CORPUS, _POOLS, _SNAPSHOTS, _WATCH, TERMS, _snapshots, known_items, query

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
NAMES = ["42", "99"]
MOST_SIZE = 20_000


@query()
def chunk_table(spark, sf_dir):
    """All chunks of the corpus; tested against the rules' properties, which SQL can't fold. No words are asked for, so no index is built."""
    return chunking.chunked(corpus(spark, sf_dir).select("doc_id", "text", "extension")).withColumn("text", F.md5(F.col("text").cast("binary"))).withColumnRenamed("text", "text_md5")


@query()
def bm25_best_chunk(spark, sf_dir):
    """The ten documents with the best chunk: BM25 over chunks, statistics of all chunks, the earliest of equal chunks."""
    return lexical.top(lexical.best_units(chunk_index(spark, sf_dir), TERMS), 10)


_ASKED = f"""w AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark),
k AS (SELECT query_id, t, list_filter(t, lambda x: length(x) > 1 AND x NOT IN ({_STOP})) AS kept FROM w),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_slice(CASE WHEN len(kept) > 0 THEN kept ELSE t END, 1, 32)) AS term FROM k) GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY term), stats),
s AS (SELECT query_id, doc_id, round(sum(qtf * CASE WHEN idf > 0 THEN idf ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), stats GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10)"""


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_ASKED} SELECT * FROM ranked")
def bm25_batch(spark, sf_dir):
    """The ten best documents of every benchmark text as a query."""
    return batch_search.search_all(document_index(spark, sf_dir), _items(spark, sf_dir))


@query(f"""WITH {_ASKED}, label AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
kind AS (SELECT query_id, CASE WHEN len(t) < 20 THEN 'short' ELSE 'long' END AS kind FROM w),
g AS (SELECT query_id, min(rank) AS first, count_if(rank <= 5) / least(count(*), 5) AS recall FROM label LEFT JOIN ranked USING (query_id, doc_id) GROUP BY query_id)
SELECT coalesce(kind, 'all') AS kind, count(*) AS n_queries, round(avg(coalesce((first = 1)::INT, 0)), 6) AS top1, round(avg(recall), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM g JOIN kind USING (query_id) GROUP BY GROUPING SETS ((kind), ())""")
def retrieval_evaluation(spark, sf_dir):
    items = _items(spark, sf_dir)
    labels = known_items(spark, sf_dir).withColumnRenamed("item_id", "query_id")
    kinds = items.select("query_id", F.when(F.size(T.tokens(F.col("text"))) < 20, "short").otherwise("long").alias("kind"))
    return batch_search.evaluate(batch_search.search_all(document_index(spark, sf_dir), items), labels, kinds)


@query("SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+(?:[-''][\\p{L}\\p{N}_]+)*'), ' ') AS words FROM benchmark")
def query_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_words(F.col("text")), " ").alias("words"))


@query(f"""WITH {_CORPUS}, h AS (SELECT doc_id, 'doc ' || doc_id AS human, trim(regexp_replace(regexp_extract(substr('## ' || text, 1, 1500), '(?m)^\\s{{0,3}}#{{1,3}}\\s+(.+?)\\s*#*\\s*$', 1), '[*_`]+', '', 'g')) AS heading FROM corpus)
SELECT doc_id, substr(CASE WHEN heading <> '' AND lower(heading) <> human THEN heading || ' (' || human || ')' ELSE human END, 1, 200) AS title FROM h""")
def heading_titles(spark, sf_dir):
    """Titles where each document's first line is taken for a heading."""
    return corpus(spark, sf_dir).select("doc_id", T.title(F.concat(F.lit("## "), "text"), F.col("filename"), F.col("source")).alias("title"))


@query(_POOLS + f"""
nm AS (SELECT doc_id, fraction FROM (SELECT doc_id, (contains(filename, '{NAMES[0]}')::INT + contains(filename, '{NAMES[1]}')::INT) / 2.0 AS fraction FROM corpus) WHERE fraction >= 0.5 ORDER BY fraction DESC, doc_id LIMIT 500),
u AS (SELECT doc_id, lexical / max(lexical) OVER () AS lexical, NULL::DOUBLE AS filename, NULL::DOUBLE AS semantic, true AS scored FROM lex
 UNION ALL SELECT doc_id, fraction * 0.5, fraction, NULL, false FROM nm UNION ALL SELECT doc_id, NULL, NULL, semantic, false FROM sem),
c AS (SELECT doc_id, max(lexical) AS lexical, max(filename) AS filename, max(semantic) AS semantic, bool_or(scored) AS scored FROM u GROUP BY doc_id),
r AS (SELECT *, row_number() OVER (ORDER BY lexical DESC NULLS LAST, doc_id) AS lr, row_number() OVER (ORDER BY semantic DESC NULLS LAST, doc_id) AS sr, coalesce(filename, 0) AS fn,
 coalesce((lexical - min(lexical) OVER ()) / (max(lexical) OVER () - min(lexical) OVER ()), 0) AS l, coalesce((semantic - min(semantic) OVER ()) / (max(semantic) OVER () - min(semantic) OVER ()), 0) AS s FROM c)
SELECT doc_id, round(least(1.0, CASE WHEN fn >= 1 THEN greatest(0.6 * s + 0.4 * l, 0.9 + 0.1 * l) WHEN fn > 0 THEN 0.6 * s + 0.4 * l + 0.25 * 0.4 * fn ELSE 0.6 * s + 0.4 * l END), 6) AS convex,
 round((coalesce(0.6 / (60 + CASE WHEN semantic IS NOT NULL THEN sr END), 0) + coalesce(0.4 / (60 + CASE WHEN lexical IS NOT NULL THEN lr END), 0) + fn * 0.2 / 61) / (1.2 / 61), 6) AS rrf,
 CASE WHEN lexical IS NOT NULL AND semantic IS NOT NULL THEN 'both' WHEN semantic IS NOT NULL THEN 'semantic' WHEN scored THEN 'lexical' WHEN fn > 0 THEN 'filename' ELSE 'lexical' END AS match_type FROM r""")
def hybrid_with_names(spark, sf_dir):
    """Hybrid ranking of text, vector and the 500 best file-name matches."""
    docs, vecs = corpus(spark, sf_dir), table(spark, sf_dir, "embeddings")
    share = sum((filters.name_contains(F.col("filename"), t).cast("double") for t in NAMES), F.lit(0.0)) / len(NAMES)
    names = docs.select("doc_id", share.alias("fraction")).filter("fraction >= 0.5").orderBy(F.desc("fraction"), "doc_id").limit(500)
    near = vectors.nearest(vecs, vecs.filter("vec_id = 0"), 300).select(F.col("vec_id").alias("doc_id"), fusion.clamped(F.col("similarity")).alias("score"))
    return fusion.fuse(fusion.with_names(lexical.search(document_index(spark, sf_dir), TERMS, k=300), names, near)).select("doc_id", "convex", "rrf", "match_type")


@query(_SNAPSHOTS + f""", o AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'missing' ELSE 'ok' END AS status FROM old),
m AS (SELECT DISTINCT new.path FROM new JOIN old USING (doc_id, content_hash) WHERE new.path NOT IN (SELECT path FROM old) AND old.path NOT IN (SELECT path FROM new)),
x AS (SELECT CASE WHEN new.path LIKE '/corpus/src3/%' THEN 'rejected' WHEN new.size > {MOST_SIZE} THEN 'too_large' WHEN o.size = new.size AND abs(o.mtime - new.mtime) < 1e-6 THEN CASE WHEN status = 'missing' THEN 'restored' ELSE 'unchanged' END
 WHEN o.content_hash = new.content_hash THEN 'touched' WHEN m.path IS NOT NULL THEN 'moved' WHEN regexp_matches(d.text, 'token = "[0-9a-f]{{40}}"') THEN 'secret_suspected' WHEN NOT regexp_matches(d.text, '\\S') THEN 'empty' ELSE 'indexed' END AS result
 FROM new LEFT JOIN o USING (path) LEFT JOIN m USING (path) JOIN documents d ON d.doc_id = new.doc_id
 UNION ALL SELECT 'missing' FROM o WHERE path NOT IN (SELECT path FROM new))
SELECT result, count(*) AS n FROM x GROUP BY result""")
def index_outcomes(spark, sf_dir):
    """How many files of the new inventory end in which way, and how many of the index are gone."""
    old, new = _snapshots(spark, sf_dir)
    old = old.withColumn("status", F.when(F.col("doc_id") % 17 == 0, "missing").otherwise("ok"))
    new = new.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = maintenance.outcomes(old, new, filters.under(F.col("path"), "/corpus/src3"), T.suspected_secret(F.col("text")).isNotNull(), ~F.col("text").rlike("\\S"), MOST_SIZE)
    return found.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5(text) AS text_md5, CASE WHEN regexp_matches(text, '\\S') THEN 'ok' ELSE 'empty' END AS status FROM documents")
def decode_files(spark, sf_dir):
    """Every document's bytes, in UTF-8, UTF-16 or UTF-32 with its mark by its id, read back as text."""
    marked = F.concat(F.unhex(F.lit("0000FEFF")), F.encode("text", "UTF-32"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16")).otherwise(marked)
    files = table(spark, sf_dir, "documents").select("doc_id", decode.decode_text(raw).alias("f"))
    return files.select("doc_id", F.md5(F.col("f.text").cast("binary")).alias("text_md5"), "f.status")


@query(f"""WITH {_WATCH}, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS k FROM f)
SELECT path, min(ts) AS started, count(*) AS n_events, last(action ORDER BY ts, event_id) AS last_action FROM g GROUP BY path, k HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e)""")
def events_settled_stream(spark, sf_dir):
    """``events_settled`` as a stream: bursts whose end the watermark has passed."""
    return live.settled_stream(spark, f"{sf_dir}/events.parquet", f"{shared_dir(spark)}/{uuid.uuid4().hex}")
