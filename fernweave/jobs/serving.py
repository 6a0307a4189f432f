"""Registered queries: hits put together from chunks, guards, samples, pages of chunks, names and times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions import text as T
from ..operators import fusion, lexical, maintenance, scope, vectors
from ..sources.corpus import corpus, table
from .queries import _CORPUS, _FILTER_SQL, _HYBRID, _SNAPSHOTS, EXCLUDES, EXTENSIONS, ROOTS, TERMS, _candidates, _score_sql, _snapshots, query
from .store import document_index, line_index

ALL_ROOTS = [f"/corpus/src{k}" for k in range(12)]
_IN_ROOTS = "(" + " OR ".join(f"path LIKE '{r}/%'" for r in ALL_ROOTS) + ")"
_SHOWN = f"status <> 'missing' AND {_IN_ROOTS} AND NOT (filename GLOB '*.json' OR path GLOB '/corpus/src3/*' OR filename GLOB 'doc_1?.md') AND (path LIKE '/corpus/src0/%' OR path LIKE '/corpus/src7/%') AND extension IN ('.md', '.txt')"
_WORDS = list(dict.fromkeys(TERMS))


def _chunk_hits(spark, sf_dir) -> DataFrame:
    """The 300 nearest chunk vectors of the first one; the vectors are two a document, in order."""
    vecs = table(spark, sf_dir, "embeddings")
    near = vectors.nearest(vecs, vecs.filter("vec_id = 0"), 300)
    return near.select(F.expr("vec_id div 2").alias("doc_id"), (F.col("vec_id") % 2).cast("int").alias("ordinal"), fusion.clamped(F.col("similarity")).alias("score"))


_SEM = """near AS (SELECT v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS raw FROM embeddings q, embeddings v WHERE q.vec_id = 0 ORDER BY raw DESC, v.vec_id LIMIT 300),
sem AS (SELECT doc_id, score AS semantic, ordinal AS semantic_ordinal FROM (SELECT vec_id // 2 AS doc_id, (vec_id % 2)::INT AS ordinal, least(greatest(raw, 0.0), 1.0) AS score FROM near) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) = 1)"""


@query(f"WITH {_CORPUS}, {_SEM} SELECT doc_id, path, semantic AS score, semantic_ordinal AS ordinal FROM sem JOIN corpus USING (doc_id)")
def semantic_chunks(spark, sf_dir):
    """Documents of the nearest chunks, each with its best one; chunks of no document are dropped."""
    best = _chunk_hits(spark, sf_dir).groupBy("doc_id").agg(F.max_by(F.struct("score", "ordinal"), F.struct("score", -F.col("ordinal"))).alias("b"))
    return best.join(document_index(spark, sf_dir).units.select("doc_id", "path"), "doc_id").select("doc_id", "path", "b.score", "b.ordinal")


_LINES = f"""{_CORPUS}, l AS (SELECT doc_id, (i - 1)::INT AS ordinal, lines[i] AS line, regexp_extract_all(lower(lines[i]), '[a-z0-9]+') AS t FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS lines FROM documents)),
rows_ AS (SELECT doc_id, ordinal, len(t) AS dl, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf_{w}" for w in _WORDS)} FROM l),
stats AS (SELECT count(*) AS n, avg(dl) AS a, {", ".join(f"count_if(tf_{w} > 0) AS df_{w}" for w in _WORDS)} FROM rows_),
s AS (SELECT doc_id, ordinal, {_score_sql(TERMS)} AS score FROM rows_, stats WHERE {" OR ".join(f"tf_{w} > 0" for w in _WORDS)}),
lex AS (SELECT doc_id, score AS lexical, ordinal AS lexical_ordinal FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) = 1 ORDER BY 2 DESC, 1 LIMIT 300)"""


@query(f"WITH {_LINES} SELECT doc_id, lexical AS score, lexical_ordinal AS ordinal FROM lex ORDER BY score DESC, doc_id LIMIT 10")
def bm25_best_line(spark, sf_dir):
    """The ten documents with the best line, over an index of lines."""
    return lexical.top(lexical.best_units(line_index(spark, sf_dir), TERMS), 10)


@query(f"""WITH {_LINES}, {_SEM},
c AS (SELECT doc_id, lexical / max(lexical) OVER () AS lexical, lexical_ordinal, semantic, semantic_ordinal FROM lex FULL JOIN sem USING (doc_id)),
r AS (SELECT *, coalesce((lexical - min(lexical) OVER ()) / (max(lexical) OVER () - min(lexical) OVER ()), 0) AS l, coalesce((semantic - min(semantic) OVER ()) / (max(semantic) OVER () - min(semantic) OVER ()), 0) AS s FROM c),
h AS (SELECT doc_id, round(0.6 * s + 0.4 * l, 6) AS score, CASE WHEN semantic IS NOT NULL AND semantic >= coalesce(lexical, 0) THEN semantic_ordinal ELSE coalesce(lexical_ordinal, semantic_ordinal) END AS ordinal FROM r)
SELECT doc_id, path, score, ordinal, substr(line, 1, 120) AS shown FROM h JOIN corpus USING (doc_id) LEFT JOIN (SELECT doc_id, ordinal, line FROM l) USING (doc_id, ordinal) ORDER BY score DESC, doc_id LIMIT 20""")
def hybrid_chunks(spark, sf_dir):
    """The 20 best documents by their best line and best chunk vector, with the path and the piece of text to show."""
    best = lexical.top(lexical.best_units(line_index(spark, sf_dir), TERMS), 300)
    return fusion.shown(fusion.over_chunks(best, _chunk_hits(spark, sf_dir)), document_index(spark, sf_dir).units, lambda ids: _lines_of(table(spark, sf_dir, "documents").join(F.broadcast(ids), "doc_id", "left_semi")), 20, 120)


def _line_texts(spark, sf_dir) -> DataFrame:
    return _lines_of(table(spark, sf_dir, "documents"))


def _lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "text"))


@query(_HYBRID.split("h AS (")[0].rstrip().rstrip(",") + f""", st AS (SELECT *, CASE doc_id % 9 WHEN 0 THEN 'missing' ELSE 'ok' END AS status FROM corpus),
g AS (SELECT r.* EXCLUDE (l, s) FROM r JOIN st USING (doc_id) WHERE {_SHOWN}),
m AS (SELECT *, coalesce((lexical - min(lexical) OVER ()) / nullif(max(lexical) OVER () - min(lexical) OVER (), 0), CASE WHEN lexical IS NOT NULL THEN 1 ELSE 0 END) AS l, coalesce((semantic - min(semantic) OVER ()) / nullif(max(semantic) OVER () - min(semantic) OVER (), 0), CASE WHEN semantic IS NOT NULL THEN 1 ELSE 0 END) AS s FROM g)
SELECT doc_id, lexical_rank::INT AS lexical_rank, semantic_rank::INT AS semantic_rank, round(0.6 * s + 0.4 * l, 6) AS convex FROM m""")
def guarded_hits(spark, sf_dir):
    """Hybrid hits that may be shown: ranked among all candidates, scaled among those that are left."""
    units = document_index(spark, sf_dir).units.withColumn("status", F.when(F.col("doc_id") % 9 == 0, "missing").otherwise("ok"))
    may = scope.allowed(F.col("status"), F.col("path"), F.col("filename"), F.col("extension"), ALL_ROOTS, EXCLUDES, ["/corpus/src0", "/corpus/src7"], EXTENSIONS)
    ranked = fusion.fuse(_candidates(spark, sf_dir)).select("doc_id", "lexical", "semantic", "lexical_rank", "semantic_rank")
    kept = ranked.join(units.filter(may).select("doc_id"), "doc_id", "left_semi")
    return fusion.fuse(kept).select("doc_id", "lexical_rank", "semantic_rank", "convex")


@query(_HYBRID + """, k AS (SELECT h.doc_id, convex AS score, md5(d.text) AS content_hash FROM h LEFT JOIN documents d USING (doc_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY coalesce(content_hash, doc_id::VARCHAR) ORDER BY score DESC, doc_id) AS n, coalesce(content_hash, doc_id::VARCHAR) AS same FROM k),
o AS (SELECT same, string_agg(doc_id::VARCHAR, ',' ORDER BY n) AS duplicates FROM g WHERE n > 1 GROUP BY same)
SELECT doc_id, score, coalesce(duplicates, '') AS duplicates FROM g LEFT JOIN o USING (same) WHERE n = 1""")
def duplicates_listed(spark, sf_dir):
    """Every hit of the hybrid ranking after equal contents are collapsed, with the others' ids."""
    hits = fusion.fuse(_candidates(spark, sf_dir)).select("doc_id", F.col("convex").alias("score"))
    best = fusion.collapse(hits.join(document_index(spark, sf_dir).units.select("doc_id", "content_hash"), "doc_id", "left"), "content_hash")
    return best.select("doc_id", "score", F.array_join(F.transform("duplicates", lambda x: x.cast("string")), ",").alias("duplicates"))


@query(f"""WITH {_CORPUS} SELECT doc_id, CASE WHEN NOT {_FILTER_SQL.split(" AND ")[0]} THEN 'outside roots' WHEN doc_id % 31 = 0 AND lang NOT IN ('en', 'fr') THEN 'link leads outside' WHEN n_chars = 0 THEN 'folder' WHEN doc_id % 37 = 0 THEN 'offline' END AS reason FROM corpus""")
def reject_reasons(spark, sf_dir):
    """Why files aren't indexed; every 31st is a followed link, to a root if the text is English or French."""
    target = F.when(F.col("lang").isin("en", "fr"), F.lit("/corpus/src7/x")).otherwise(F.lit("/elsewhere/x"))
    reason = scope.reject_reason(F.col("path"), ROOTS, F.col("doc_id") % 31 == 0, True, target, F.col("size") == 0, F.col("doc_id") % 37 == 0)
    return corpus(spark, sf_dir).select("doc_id", reason.alias("reason"))


_SAMPLED = {"prose": "*.md", "text": "*.txt", "ones": "doc_1*"}


@query(f"""WITH {_CORPUS}, m AS (SELECT 'prose' AS pattern, * FROM corpus WHERE filename GLOB '*.md' UNION ALL SELECT 'text', * FROM corpus WHERE filename GLOB '*.txt' UNION ALL SELECT 'ones', * FROM corpus WHERE filename GLOB 'doc_1*')
SELECT pattern, path FROM m WHERE size <= 5000 AND NOT regexp_matches(filename, '77') QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY path) <= 15""")
def corpus_sample(spark, sf_dir):
    """Fifteen files of each name pattern for an evaluation corpus."""
    return scope.sampled(corpus(spark, sf_dir), _SAMPLED, 15, 5000, "77")


@query("SELECT doc_id, (i - 1)::INT AS ordinal, length(lines[i])::INT AS size FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS lines FROM documents) WHERE i - 1 BETWEEN 2 AND 4")
def chunk_page(spark, sf_dir):
    """Lines 2 to 4 of every document: a page of three after an offset of two."""
    return _line_texts(spark, sf_dir).filter("ordinal >= 2 and ordinal < 2 + 3").select("doc_id", "ordinal", F.length("text").alias("size"))


@query(f"WITH {_CORPUS} SELECT doc_id, strftime(make_timestamp((mtime * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS modified, floor(mtime)::BIGINT AS seconds FROM corpus")
def modified_times(spark, sf_dir):
    """Times of files as ISO text, and read back."""
    return corpus(spark, sf_dir).select("doc_id", T.iso_time(F.col("mtime")).alias("modified")).withColumn("seconds", T.epoch_seconds(F.col("modified")))


@query(f"WITH {_CORPUS} SELECT doc_id, filename FROM corpus WHERE filename LIKE 'doc\\__2%.md' ESCAPE '\\'")
def filename_pattern(spark, sf_dir):
    """Names by a pattern with * and ?, as LIKE has it."""
    return corpus(spark, sf_dir).filter(F.like(F.col("filename"), T.like_pattern(F.lit("doc_?2*.md")))).select("doc_id", "filename")


@query("SELECT page_id, '''' || replace(url, '''', '''''') || '''' AS quoted FROM pages")
def quoted_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.quoted(F.col("url")).alias("quoted"))


@query(_SNAPSHOTS + " SELECT path FROM old WHERE path NOT IN (SELECT path FROM new) AND NOT ((SELECT count(*) FROM old) > 100 AND (SELECT count(*) FROM old WHERE path IN (SELECT path FROM new)) < 0.5 * (SELECT count(*) FROM old))")
def guarded_deletions(spark, sf_dir):
    """Paths to delete from the index, behind the guard against mass deletion."""
    return maintenance.vanished(*_snapshots(spark, sf_dir))


@query(f"WITH {_CORPUS} SELECT doc_id, size % 3 <> 0 AND CASE WHEN doc_id % 4 = 0 THEN false WHEN doc_id % 4 = 1 THEN mtime > 1.7e9 + 500 ELSE true END AS settled FROM corpus")
def unchanged_files(spark, sf_dir):
    """Files that need not be read again: every third one grew, a fourth is missing, a fourth failed when it was last changed."""
    docs = corpus(spark, sf_dir)
    status = F.when(F.col("doc_id") % 4 == 0, "missing").when(F.col("doc_id") % 4 == 1, "error").otherwise("ok")
    was = F.when(F.col("size") % 3 == 0, F.col("size") - 1).otherwise(F.col("size"))
    return docs.select("doc_id", maintenance.unchanged(F.col("size"), F.col("mtime"), was, F.col("mtime"), status, F.col("mtime"), 1.7e9 + 500 + 86_400).alias("settled"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS lines FROM documents),
b AS (SELECT doc_id, i, lines[i] AS part, coalesce(sum(length(lines[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT doc_id, md5(substr(string_agg(substr(part, 1, (500 - before)::BIGINT), chr(10) || chr(10) ORDER BY i) FILTER (before < 500), 1, 500)) AS text_md5, bool_or(before >= 500 OR before + length(part) > 500) AS truncated FROM b GROUP BY doc_id""")
def budgeted_text(spark, sf_dir):
    """The first 500 characters of every document's lines, and whether there was more."""
    found = extract.collected(_line_texts(spark, sf_dir), 500)
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "truncated")


_VISIBLE = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(html, 'article', 'section') WHEN page_id % 9 = 1 THEN '<article> <b></b></article>' ELSE html END AS html FROM pages),
t AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<article') THEN {_VISIBLE.format("regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)")} END AS a, {_VISIBLE.format("html")} AS v FROM p)
SELECT page_id, CASE WHEN page_id % 50 = 7 THEN 'denied' WHEN a <> '' OR v <> '' THEN 'ok' ELSE 'empty' END AS status, CASE WHEN page_id % 50 = 7 THEN 'none' WHEN a <> '' THEN 'article' ELSE 'page' END AS extractor,
 CASE WHEN page_id % 50 = 7 THEN '' WHEN a IS NULL THEN 'article error,' WHEN a = '' THEN 'article empty,' ELSE 'article ok' END || CASE WHEN page_id % 50 = 7 OR a <> '' THEN '' WHEN v <> '' THEN 'page ok' ELSE 'page empty' END AS attempts,
 md5(CASE WHEN page_id % 50 = 7 THEN '' ELSE coalesce(nullif(a, ''), v) END) AS text_md5 FROM t""")
def page_extraction(spark, sf_dir):
    """Pages' text by their article or else whole; every fourth has none, some are blank, every fiftieth may not be read."""
    html = F.when(F.col("page_id") % 4 == 0, F.replace("html", F.lit("article"), F.lit("section"))).when(F.col("page_id") % 9 == 1, "<article> <b></b></article>").otherwise(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    found = extract.chain([("article", extract.article(F.col("html"))), ("page", T.html_text(F.col("html")))], F.when(F.col("page_id") % 50 == 7, "denied"))
    rows = pages.select("page_id", found.alias("f"))
    tried = F.array_join(F.transform("f.attempts", lambda a: F.concat_ws(" ", a["extractor"], a["status"])), ",")
    return rows.select("page_id", "f.status", "f.extractor", tried.alias("attempts"), F.md5(F.col("f.text").cast("binary")).alias("text_md5"))
