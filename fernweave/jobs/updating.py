"""Registered queries: an index that changes in place, bounded search, substrings, many globs, many hybrid queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batch_search, filters, fusion, globs, index, lexical, maintenance, pivots, scope, substring, vectors
from ..sources.corpus import as_files, corpus, table
from .indexing import _ASKED, _items
from .queries import _CORPUS, _HYBRID, _SIMS, EXCLUDES, EXTENSIONS, TERMS, _candidates, _any, _bm25_sql, known_items, query
from .store import document_index, document_sides, hashed, kept, scratch_fork, vector_index

COMMON_AND_RARE = ["the", "ering", "thnt", "of"]
GLOBS = [f"*_{k}[0-4]?.[!cp]*" for k in range(1000)]

#: The documents after an update: every 11th is gone, every 13th has more words, of every 50th there is a copy with a new id.
_AFTER = "(SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN text || ' ering thnt ndat' ELSE text END AS text, lang, source, n_chars FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id + 1000000000, 'ering ' || text, lang, source, n_chars FROM documents WHERE doc_id % 50 = 1) documents"
_CHANGED = "(doc_id % 13 = 0 AND doc_id % 11 <> 0)"


def _updated(spark, sf_dir) -> index.Index:
    """A fork of the documents' index after the update: what is gone is deleted, what changed or came is put in."""
    docs = table(spark, sf_dir, "documents")
    changed = docs.filter("doc_id % 13 = 0 and doc_id % 11 <> 0").withColumn("text", F.concat("text", F.lit(" ering thnt ndat")))
    copies = docs.filter("doc_id % 50 = 1").withColumns({"text": F.concat(F.lit("ering "), "text"), "doc_id": F.col("doc_id") + 1_000_000_000})
    base = document_index(spark, sf_dir)
    held = index.delete_where(scratch_fork(spark, base), F.col("doc_id") % 11 == 0)
    return index.upsert(held, hashed(as_files(changed.unionByName(copies))), sides=document_sides(spark, sf_dir))


@query(_bm25_sql(TERMS, _any(TERMS)).replace("FROM documents", f"FROM {_AFTER}"))
def bm25_after_update(spark, sf_dir):
    """The ten best documents after documents were changed, deleted and added; only what changed or came was split into words."""
    return lexical.search(_updated(spark, sf_dir), TERMS)


_COUNTS = f"WITH d AS (SELECT *, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS nt FROM {_AFTER})"


@query(f"""{_COUNTS}, s AS (SELECT count(*) AS n_units, sum(dl)::BIGINT AS n_words, sum(nt)::BIGINT AS n_postings FROM d), r AS (SELECT count_if({_CHANGED}) + count_if(doc_id % 50 = 1) AS n_read FROM documents), v AS (SELECT count(*) AS n_vectors FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0))
SELECT 'updated' AS state, n_units, n_words, n_postings, n_vectors, n_read FROM s, r, v UNION ALL SELECT 'merged', n_units, n_words, n_postings, n_vectors, 0 FROM s, v""")
def index_generations(spark, sf_dir):
    """What an index holds after the update and after its segments were merged, and how many units were read for it."""
    updated = _updated(spark, sf_dir)
    rows = []
    for state, held in (("updated", updated), ("merged", index.merge(updated))):
        postings = held.postings.agg(F.count(F.lit(1)).alias("n_postings"))
        live = held.tables("vectors").agg(F.count(F.lit(1)).alias("n_vectors"))
        rows.append(postings.join(live).select(F.lit(state).alias("state"), F.lit(held.n).alias("n_units"), F.lit(held.words).alias("n_words"), "n_postings", "n_vectors", F.lit(held.n_read).alias("n_read")))
    return rows[0].unionByName(rows[1])


@query(f"""WITH {_CORPUS}, k AS (SELECT doc_id, text, starts_with(path, '/corpus/src3/') AS gone FROM corpus), t AS (SELECT doc_id, gone, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM k)
SELECT (SELECT count(*) FROM k WHERE NOT gone) AS n_units, (SELECT count(*) FROM t WHERE NOT gone) AS n_postings, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM k WHERE NOT gone)) AS n_vectors,
 (SELECT coalesce(sum(length(path)), 0)::BIGINT FROM corpus WHERE NOT starts_with(path, '/corpus/src3/')) AS path_chars""")
def subtree_cascade(spark, sf_dir):
    """What is left of units, postings, vectors and paths when a folder is taken out of the index in one generation."""
    held = index.delete_where(scratch_fork(spark, document_index(spark, sf_dir)), F.col("path").startswith("/corpus/src3/"))
    units = held.units.agg(F.count(F.lit(1)).alias("n_units"), F.coalesce(F.sum(F.length("path")), F.lit(0)).alias("path_chars"))
    postings = held.postings.agg(F.count(F.lit(1)).alias("n_postings"))
    return units.join(postings).join(held.tables("vectors").agg(F.count(F.lit(1)).alias("n_vectors"))).select("n_units", "n_postings", "n_vectors", "path_chars")


@query(_bm25_sql(COMMON_AND_RARE, _any(COMMON_AND_RARE)))
def bm25_topk_bounded(spark, sf_dir):
    """The ten best documents of a query with very common words, without scoring all that have one."""
    return lexical.BoundedSearch(document_index(spark, sf_dir), COMMON_AND_RARE).result()


_NEEDLES = "(SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'DOC_' || item_id WHEN 1 THEN '/EN/doc_' || item_id % 10 WHEN 2 THEN 'Src' || item_id % 20 || '/d' WHEN 3 THEN chr((97 + item_id % 26)::INT) ELSE item_id % 10 || '.' END AS needle FROM benchmark)"


@query(f"WITH {_CORPUS}, n AS {_NEEDLES} SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM n JOIN corpus ON contains(lower(path), lower(needle)) GROUP BY item_id")
def paths_containing(spark, sf_dir):
    """How many paths hold each of many strings, of one character and more, in any case."""
    i = F.col("item_id")
    needle = F.when(i % 5 == 0, F.concat(F.lit("DOC_"), i)).when(i % 5 == 1, F.concat(F.lit("/EN/doc_"), i % 10)).when(i % 5 == 2, F.concat(F.lit("Src"), i % 20, F.lit("/d"))).when(i % 5 == 3, F.char(97 + i % 26)).otherwise(F.concat(i % 10, F.lit(".")))
    needles = table(spark, sf_dir, "benchmark").select(i.alias("needle_id"), needle.alias("needle"))
    held = document_index(spark, sf_dir)
    found = substring.containing(held.tables("path_pieces").drop("segment"), held.units.select("doc_id", F.col("path").alias("value")), needles)
    return found.groupBy(F.col("needle_id").alias("item_id")).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {_CORPUS} SELECT doc_id, count(*) AS n_globs, min(k)::INT AS first_glob FROM corpus JOIN range(1000) r(k) ON filename GLOB ('*_' || k || '[0-4]?.[!cp]*') GROUP BY doc_id")
def many_globs(spark, sf_dir):
    """Which file names match any of a thousand globs with classes, in one walk over each name."""
    found = corpus(spark, sf_dir).select("doc_id", globs.which(F.col("filename"), GLOBS).alias("k")).filter(F.size("k") > 0)
    return found.select("doc_id", F.size("k").cast("long").alias("n_globs"), F.array_min("k").alias("first_glob"))


@query(f"WITH {_CORPUS} SELECT doc_id, filename FROM corpus WHERE filename GLOB 'doc_[1-3][!0-4]*.[mt]?*'")
def glob_classes(spark, sf_dir):
    return filters.glob_names(corpus(spark, sf_dir), "doc_[1-3][!0-4]*.[mt]?*").select("doc_id", "filename")


def _near(spark, sf_dir) -> DataFrame:
    """The 300 nearest vectors of every benchmark item that has one, as scores of documents."""
    vecs = table(spark, sf_dir, "embeddings")
    asked = vecs.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return vectors.nearest(vecs, asked, 300).select("query_id", F.col("vec_id").alias("doc_id"), fusion.clamped(F.col("similarity")).alias("score"))


_FUSED = f"""WITH {_ASKED.replace("rank <= 10", "rank <= 300")}, lex AS (SELECT query_id, doc_id, score AS lexical FROM ranked),
sem AS (SELECT query_id, doc_id, least(greatest(raw, 0.0), 1.0) AS semantic FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS raw FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark))
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) <= 300),
c AS (SELECT query_id, doc_id, lexical, semantic FROM lex FULL JOIN sem USING (query_id, doc_id)),
s2 AS (SELECT *, min(lexical) OVER p AS l0, max(lexical) OVER p AS l1, min(semantic) OVER p AS s0, max(semantic) OVER p AS s1 FROM c WINDOW p AS (PARTITION BY query_id)),
h AS (SELECT query_id, doc_id, lexical, semantic, round(0.6 * coalesce(CASE WHEN s1 = s0 THEN CASE WHEN semantic IS NOT NULL THEN 1.0 END ELSE (semantic - s0) / (s1 - s0) END, 0) + 0.4 * coalesce(CASE WHEN l1 = l0 THEN CASE WHEN lexical IS NOT NULL THEN 1.0 END ELSE (lexical - l0) / (l1 - l0) END, 0), 6) AS convex,
 CASE WHEN lexical IS NOT NULL AND semantic IS NOT NULL THEN 'both' WHEN semantic IS NOT NULL THEN 'semantic' ELSE 'lexical' END AS match_type FROM s2),
m AS (SELECT 'literal' AS mode, query_id, doc_id, lexical AS score FROM h UNION ALL SELECT 'semantic', query_id, doc_id, semantic FROM h UNION ALL SELECT 'hybrid', query_id, doc_id, convex FROM h),
byrank AS (SELECT mode, query_id, doc_id, score, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, doc_id)::INT AS rank FROM m WHERE score IS NOT NULL QUALIFY rank <= 10)"""


@query(f"{_FUSED} SELECT b.query_id, b.doc_id, b.score, b.rank, h.match_type FROM byrank b JOIN h USING (query_id, doc_id) WHERE mode = 'hybrid'")
def hybrid_batch(spark, sf_dir):
    """The ten best documents of every benchmark item by words and vectors together."""
    fused = kept(batch_search.hybrid_all(document_index(spark, sf_dir), _items(spark, sf_dir), _near(spark, sf_dir)))
    best = batch_search.by_mode(fused).filter("mode = 'hybrid'").drop("mode")
    return best.join(fused.select("query_id", "doc_id", "match_type"), ["query_id", "doc_id"])


@query(f"""{_FUSED}, label AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))),
kind AS (SELECT query_id, CASE WHEN len(t) < 20 THEN 'short' ELSE 'long' END AS kind FROM w),
g AS (SELECT mode, query_id, min(rank) AS first, count_if(coalesce(rank <= 5, false)) / least(count(*), 5) AS recall FROM label CROSS JOIN (SELECT DISTINCT mode FROM byrank) LEFT JOIN byrank USING (mode, query_id, doc_id) GROUP BY mode, query_id)
SELECT mode, coalesce(kind, 'all') AS kind, count(*) AS n_queries, round(avg(coalesce((first = 1)::INT, 0)), 6) AS top1, round(avg(recall), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM g JOIN kind USING (query_id) GROUP BY GROUPING SETS ((mode, kind), (mode))""")
def evaluation_by_mode(spark, sf_dir):
    """Known-item evaluation of literal, semantic and hybrid search, by kind of query and over all."""
    items = _items(spark, sf_dir)
    ranked = kept(batch_search.by_mode(batch_search.hybrid_all(document_index(spark, sf_dir), items, _near(spark, sf_dir))))
    kinds = items.select("query_id", F.when(F.size(T.tokens(F.col("text"))) < 20, "short").otherwise("long").alias("kind"))
    return batch_search.evaluate_modes(ranked, known_items(spark, sf_dir, any_case=True).withColumnRenamed("item_id", "query_id"), kinds)


_MARKS = "‮⁦\x07"


@query("SELECT doc_id, md5(" + "replace(" * 3 + "chr(8238) || text || chr(8294) || chr(7)" + "".join(f", chr({n}), '\\u{n:04x}')" for n in (8238, 8294, 7)) + ") AS shown_md5 FROM documents")
def terminal_text(spark, sf_dir):
    """Texts as a terminal may show them: controls and marks of direction written out."""
    marked = F.concat(F.lit(_MARKS[0]), "text", F.lit(_MARKS[1:]))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.visible(marked).cast("binary")).alias("shown_md5"))


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 500")
def error_log(spark, sf_dir):
    """The newest 500 errors of all."""
    return maintenance.newest(table(spark, sf_dir, "events").filter("event_type = 'error'"), None, "ts", 500).select("event_id", "ts")


@query(f"SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM ({_SIMS}) QUALIFY rank <= 10")
def knn_pivots(spark, sf_dir):
    """The ten nearest vectors of each query, by the bounds of clusters."""
    return pivots.nearest(vector_index(spark, sf_dir), table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0"))[0]


@query(f"SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM ({_SIMS}) WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'fr') QUALIFY rank <= 10")
def knn_masked_pivots(spark, sf_dir):
    """The same among the vectors of French documents alone."""
    allowed = table(spark, sf_dir, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("vec_id"))
    return pivots.nearest(vector_index(spark, sf_dir), table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0"), allowed=allowed)[0]


@query(f"WITH {_CORPUS} SELECT doc_id, CASE WHEN filename GLOB '*.json' OR path GLOB '/corpus/src3/*' OR filename GLOB 'doc_1?.md' THEN 'excluded' WHEN extension NOT IN ('.md', '.txt') THEN 'extension ' || extension || ' isn''t listed' END AS reason FROM corpus")
def policy_reasons(spark, sf_dir):
    """Why the policy refuses each file."""
    return corpus(spark, sf_dir).select("doc_id", scope.policy_reason(F.col("path"), F.col("extension"), EXTENSIONS, EXCLUDES).alias("reason"))


@query("""SELECT 'ok' AS state, (SELECT count(*) FROM embeddings) AS n_vectors UNION ALL SELECT 'reset', 0 UNION ALL SELECT 'created', (SELECT count(*) FROM embeddings WHERE vec_id < 0)""")
def model_binding(spark, sf_dir):
    """A store's vectors as they may be used: with their own model, with another one, and where there are none."""
    vecs = table(spark, sf_dir, "embeddings").withColumn("model", F.lit("given:64"))
    mixed = vecs.withColumn("model", F.when(F.col("vec_id") % 2 == 0, "older:64").otherwise(F.col("model")))
    found = [maintenance.bound(v, "given:64", 64, True) for v in (vecs, mixed, vecs.filter("vec_id < 0"))]
    rows = [held.agg(F.count(F.lit(1)).alias("n_vectors")).select(F.lit(state).alias("state"), "n_vectors") for state, held in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(_HYBRID + """ SELECT h.doc_id, '{"path":"' || path || '","score":' || printf('%.6f', convex) || ',"match_type":"' || match_type || '","file_type":"' || ltrim(extension, '.') || '","size":' || size || ',"scores":{"semantic":' || coalesce(printf('%.6f', semantic), 'null')
 || ',"lexical":' || coalesce(printf('%.6f', lexical), 'null') || ',"semantic_rank":' || coalesce(semantic_rank::VARCHAR, 'null') || ',"lexical_rank":' || coalesce(lexical_rank::VARCHAR, 'null') || '}}' AS hit FROM h JOIN corpus USING (doc_id)""")
def hit_reports(spark, sf_dir):
    """Hybrid hits as JSON, with the components of their scores inside; what a hit doesn't have is null."""
    hits = fusion.fuse(_candidates(spark, sf_dir)).join(document_index(spark, sf_dir).units.select("doc_id", "path", "extension", "size"), "doc_id")
    places = lambda c: F.round(c, 6).cast("decimal(12,6)")  # noqa: E731 (never as an exponent)
    scores = F.struct(*(places(c).alias(c) for c in ("semantic", "lexical")), "semantic_rank", "lexical_rank")
    whole = F.struct("path", places("convex").alias("score"), "match_type", F.ltrim("extension", F.lit(".")).alias("file_type"), "size", scores.alias("scores"))
    return hits.select("doc_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("hit"))


@query("""WITH m AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)))
SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM m GROUP BY item_id""")
def labels_in_any_case(spark, sf_dir):
    """Which documents hold a query's text, whatever the case of letters."""
    return known_items(spark, sf_dir, any_case=True).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
