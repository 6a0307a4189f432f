"""Registered queries over the given tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, fusion, lexical, maintenance, vectors
from ..sources.corpus import corpus, table
from ..streaming import changes
from .store import document_index, kept

TERMS = ["ering", "thnt", "ndat", "thnt"]
PAIR = ["ering", "thnt"]
NOWHERE = ["ering", "zzzzzz"]
ROOTS = ["/corpus/src1", "/corpus/src7"]
EXTENSIONS = ["md", ".TXT"]
EXCLUDES = ["*.json", "/corpus/src3/**", "DOC_1?.md"]
NOW = 1.7e9 + 10_000
#: Candidates whose ids are sent to every executor at most, about 16 bytes each.
MOST_IDS = 500_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CORPUS = """corpus AS (SELECT *, '/corpus/' || source AS root, '/corpus/' || source || '/' || lang || '/' || filename AS path, n_chars AS size, 1.7e9 + doc_id AS mtime
  FROM (SELECT *, 'doc_' || doc_id || extension AS filename FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' WHEN 3 THEN '.json' ELSE '.csv' END AS extension FROM documents)))"""


def _tf_sql(terms: list[str]) -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS tf_{t}" for t in dict.fromkeys(terms))
    has = ", ".join(f"count_if(tf_{t} > 0) AS df_{t}" for t in dict.fromkeys(terms))
    return f"""tok AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM corpus),
rows_ AS (SELECT doc_id, path, extension, content, len(t) AS dl, {counts} FROM (SELECT *, md5(text) AS content FROM tok)),
stats AS (SELECT count(*) AS n, avg(dl) AS a, {has} FROM rows_)"""


def _score_sql(terms: list[str]) -> str:
    idf = lambda t: f"CASE WHEN ln((n - df_{t} + 0.5) / (df_{t} + 0.5)) > 0 THEN ln((n - df_{t} + 0.5) / (df_{t} + 0.5)) ELSE 1e-6 END"
    return "round(" + " + ".join(f"({idf(t)}) * tf_{t} * 2.2 / (tf_{t} + 1.2 * (0.25 + 0.75 * dl / a))" for t in terms) + ", 6)"


def _bm25_sql(terms: list[str], where: str, k: int = 10) -> str:
    return f"WITH {_CORPUS}, {_tf_sql(terms)} SELECT doc_id, {_score_sql(terms)} AS score FROM rows_, stats WHERE {where} ORDER BY score DESC, doc_id LIMIT {k}"


def _any(terms: list[str], word: str = "OR") -> str:
    return "(" + f" {word} ".join(f"tf_{t} > 0" for t in dict.fromkeys(terms)) + ")"


_FILTER_SQL = "((path = '/corpus/src1' OR path LIKE '/corpus/src1/%') OR (path = '/corpus/src7' OR path LIKE '/corpus/src7/%')) AND extension IN ('.md', '.txt')"


@query(_bm25_sql(TERMS, _any(TERMS)))
def bm25_or_topk(spark, sf_dir):
    return lexical.search(document_index(spark, sf_dir), TERMS)


@query(_bm25_sql(PAIR, _any(PAIR, "AND")))
def bm25_and_topk(spark, sf_dir):
    return lexical.search(document_index(spark, sf_dir), PAIR, "and")


@query(_bm25_sql(NOWHERE, f"CASE WHEN (SELECT count(*) FROM rows_ WHERE {_any(NOWHERE, 'AND')}) > 0 THEN {_any(NOWHERE, 'AND')} ELSE {_any(NOWHERE)} END"))
def bm25_and_or_fallback(spark, sf_dir):
    return lexical.search(document_index(spark, sf_dir), NOWHERE, "auto")


@query(_bm25_sql(TERMS, _any(TERMS) + " AND " + _FILTER_SQL))
def filtered_bm25(spark, sf_dir):
    return lexical.search(document_index(spark, sf_dir), TERMS, where=filters.under_any(F.col("path"), ROOTS) & filters.has_extension(F.col("extension"), EXTENSIONS))


@query(f"""WITH {_CORPUS}, tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM corpus),
rows_ AS (SELECT doc_id, len(t) AS dl, (SELECT count(*) FROM range(1, greatest(len(t), 1)) r(i) WHERE t[i] = 'of' AND t[i + 1] = 'the') AS tf_p FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS a, count_if(tf_p > 0) AS df_p FROM rows_)
SELECT doc_id, {_score_sql(["p"])} AS score FROM rows_, stats WHERE tf_p > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_phrase(spark, sf_dir):
    return lexical.phrases(document_index(spark, sf_dir), [["of", "the"]])


_ASKED_WITH_COMMON = ["the", "onerer", "ering", "thnt"]


@query(f"""WITH {_CORPUS}, {_tf_sql(_ASKED_WITH_COMMON)}, dfs AS (SELECT unnest([{", ".join(f"{{'t': '{t}', 'df': df_{t}}}" for t in _ASKED_WITH_COMMON)}], recursive := true), n FROM stats),
kept AS (SELECT t FROM dfs WHERE df > 0 AND df <= 0.03 * n UNION SELECT t FROM (SELECT t FROM dfs WHERE df > 0 AND NOT EXISTS (SELECT 1 FROM dfs WHERE df > 0 AND df <= 0.03 * n) ORDER BY df, t LIMIT 2)),
parts AS (SELECT doc_id, t, tf * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS s
 FROM (SELECT doc_id, dl, unnest([{", ".join(f"{{'t': '{t}', 'tf': tf_{t}}}" for t in _ASKED_WITH_COMMON)}], recursive := true) FROM rows_) JOIN kept USING (t) JOIN dfs USING (t), (SELECT a FROM stats) WHERE tf > 0)
SELECT doc_id, round(sum(s), 6) AS score FROM parts GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_common_term_prune(spark, sf_dir):
    """Terms in over 3 % of the documents are left out, whatever the corpus's size; if all are, the two rarest stay."""
    return lexical.search(document_index(spark, sf_dir), _ASKED_WITH_COMMON, prune=True)


@query("SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term")
def df_table(spark, sf_dir):
    return lexical.document_frequencies(document_index(spark, sf_dir))


@query("SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, round(avg(n), 6) AS avgdl FROM (SELECT len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents)")
def corpus_stats(spark, sf_dir):
    return document_index(spark, sf_dir).units.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("n_tokens"), F.round(F.avg("dl"), 6).alias("avgdl"))


@query("WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL) SELECT (SELECT count(*) FROM documents) AS n_units, count(*) AS n_postings, count(DISTINCT term) AS n_terms, sum(tf)::BIGINT AS n_words FROM p")
def index_sizes(spark, sf_dir):
    """What the persisted index holds; the first query of a session builds it."""
    held = document_index(spark, sf_dir)
    terms = held.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))
    return terms.agg(F.lit(held.n).alias("n_units"), F.sum("df").alias("n_postings"), F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_words"))


@query(f"WITH {_CORPUS} SELECT doc_id, path FROM corpus WHERE {_FILTER_SQL}")
def root_and_extension_filter(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return docs.filter(filters.under_any(F.col("path"), ROOTS) & filters.has_extension(F.col("extension"), EXTENSIONS)).select("doc_id", "path")


@query(f"WITH {_CORPUS} SELECT doc_id, filename FROM corpus WHERE filename GLOB 'doc_1*.md'")
def glob_filter(spark, sf_dir):
    return filters.glob_names(corpus(spark, sf_dir), "doc_1*.md").select("doc_id", "filename")


@query(f"WITH {_CORPUS} SELECT doc_id, filename FROM corpus WHERE filename GLOB 'doc_2?.txt'")
def glob_case_retry(spark, sf_dir):
    return filters.glob_names(corpus(spark, sf_dir), "DOC_2?.txt").select("doc_id", "filename")


@query(f"WITH {_CORPUS} SELECT doc_id, filename FROM corpus WHERE contains(lower(filename), 'c_42')")
def filename_like(spark, sf_dir):
    return corpus(spark, sf_dir).filter(filters.name_contains(F.col("filename"), "C_42")).select("doc_id", "filename")


@query(f"WITH {_CORPUS} SELECT doc_id, filename GLOB '*.json' OR path GLOB '/corpus/src3/*' OR filename GLOB 'doc_1?.md' AS excluded FROM corpus")
def exclude_globs(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", filters.excluded(F.col("path"), EXCLUDES).alias("excluded"))


@query(f"WITH {_CORPUS} SELECT doc_id, CASE WHEN path LIKE '/corpus/src1/en/%' THEN '/corpus/src1/en' WHEN path LIKE '/corpus/src1/%' THEN '/corpus/src1' WHEN path LIKE '/corpus/src7/%' THEN '/corpus/src7' END AS root FROM corpus")
def root_attribution(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", filters.longest_root(F.col("path"), [*ROOTS, "/corpus/src1/en"]).alias("root"))


_NAMES = ["doc", "42", "md"]


@query(f"WITH {_CORPUS}, f AS (SELECT doc_id, round((" + " + ".join(f"contains(filename, '{t}')::INT" for t in _NAMES) + f") / {len(_NAMES)}.0, 3) AS fraction FROM corpus) SELECT doc_id, fraction FROM f WHERE fraction >= 0.5")
def filename_fraction(spark, sf_dir):
    share = sum((filters.name_contains(F.col("filename"), t).cast("int") for t in _NAMES), F.lit(0)) / len(_NAMES)
    return corpus(spark, sf_dir).select("doc_id", F.round(share, 3).alias("fraction")).filter("fraction >= 0.5")


_SIMS = "SELECT q.vec_id AS query_id, v.vec_id, q.label AS query_label, v.label, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"


def _neighbours(spark, sf_dir, k: int = 10) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    return vectors.nearest(vecs, vecs.filter("vec_id % 50 = 0"), k)


@query(f"SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM ({_SIMS}) QUALIFY rank <= 10")
def knn_batch(spark, sf_dir):
    return _neighbours(spark, sf_dir)


@query(f"SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM ({_SIMS}) WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'fr') QUALIFY rank <= 10")
def knn_masked(spark, sf_dir):
    """Only vectors of French documents are ranked: the filter comes before the cut."""
    vecs = table(spark, sf_dir, "embeddings")
    allowed = table(spark, sf_dir, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("vec_id"))
    return vectors.nearest(vecs.join(allowed, "vec_id", "left_semi"), vecs.filter("vec_id % 50 = 0"))


@query(f"SELECT query_label AS label, count(*) AS n, round(avg((query_label = label)::INT), 6) AS hit_rate FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM ({_SIMS}) QUALIFY rank <= 10) GROUP BY query_label")
def knn_label_precision(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = _neighbours(spark, sf_dir).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    return near.groupBy(F.col("query_label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("query_label") == F.col("label")).cast("int")), 6).alias("hit_rate"))


@query("""WITH w AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) GROUP BY ALL),
b AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS bucket, sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::BIGINT < 8 THEN n ELSE -n END) AS w FROM w GROUP BY ALL)
SELECT doc_id, bucket, round(CASE WHEN sum(w * w) OVER (PARTITION BY doc_id) > 0 THEN w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) ELSE 0 END, 6) AS weight FROM b""")
def hashing_embed(spark, sf_dir):
    return vectors.hashed_embedding(table(spark, sf_dir, "documents"))


def _candidates(spark, sf_dir) -> DataFrame:
    best = lexical.search(document_index(spark, sf_dir), TERMS, k=300)
    vecs = table(spark, sf_dir, "embeddings")
    near = vectors.nearest(vecs, vecs.filter("vec_id = 0"), 300).select(F.col("vec_id").alias("doc_id"), fusion.clamped(F.col("similarity")).alias("score"))
    return fusion.assemble(best, near)


_POOLS = f"""WITH {_CORPUS}, {_tf_sql(TERMS)}, lex AS (SELECT doc_id, {_score_sql(TERMS)} AS lexical FROM rows_, stats WHERE {_any(TERMS)} ORDER BY 2 DESC, 1 LIMIT 300),
sem AS (SELECT v.vec_id AS doc_id, least(greatest(round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6), 0.0), 1.0) AS semantic, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS raw FROM embeddings q, embeddings v WHERE q.vec_id = 0 ORDER BY raw DESC, 1 LIMIT 300),"""
_HYBRID = _POOLS + """
c AS (SELECT doc_id, lexical, semantic FROM lex FULL JOIN sem USING (doc_id)),
r AS (SELECT *, CASE WHEN lexical IS NOT NULL THEN row_number() OVER (ORDER BY lexical DESC NULLS LAST, doc_id) END AS lexical_rank, CASE WHEN semantic IS NOT NULL THEN row_number() OVER (ORDER BY semantic DESC NULLS LAST, doc_id) END AS semantic_rank,
 coalesce(CASE WHEN max(lexical) OVER () = min(lexical) OVER () THEN CASE WHEN lexical IS NOT NULL THEN 1.0 END ELSE (lexical - min(lexical) OVER ()) / (max(lexical) OVER () - min(lexical) OVER ()) END, 0) AS l,
 coalesce((semantic - min(semantic) OVER ()) / (max(semantic) OVER () - min(semantic) OVER ()), 0) AS s FROM c),
h AS (SELECT doc_id, lexical, semantic, lexical_rank::INT AS lexical_rank, semantic_rank::INT AS semantic_rank, round(0.6 * s + 0.4 * l, 6) AS convex,
 round((coalesce(0.6 / (60 + semantic_rank), 0) + coalesce(0.4 / (60 + lexical_rank), 0)) / (1.2 / 61), 6) AS rrf,
 CASE WHEN lexical IS NOT NULL AND semantic IS NOT NULL THEN 'both' WHEN semantic IS NOT NULL THEN 'semantic' ELSE 'lexical' END AS match_type FROM r)"""


@query(_HYBRID + " SELECT * FROM h")
def hybrid_fusion(spark, sf_dir):
    """Lexical and semantic candidates with ranks, min-max convex and reciprocal-rank scores."""
    return fusion.fuse(_candidates(spark, sf_dir))


@query(_HYBRID + """, k AS (SELECT h.doc_id, convex AS score, md5(d.text) AS content_hash FROM h LEFT JOIN documents d USING (doc_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY coalesce(content_hash, doc_id::VARCHAR) ORDER BY score DESC, doc_id) AS n, count(*) OVER (PARTITION BY coalesce(content_hash, doc_id::VARCHAR)) - 1 AS n_duplicates FROM k)
SELECT doc_id, score, n_duplicates FROM g WHERE n = 1 ORDER BY score DESC, doc_id LIMIT 20""")
def duplicate_collapse(spark, sf_dir):
    """The 20 best hits of the hybrid ranking after equal contents are collapsed."""
    hits = fusion.fuse(_candidates(spark, sf_dir)).select("doc_id", F.col("convex").alias("score"))
    hashes = document_index(spark, sf_dir).units.select("doc_id", "content_hash")
    best = fusion.collapse(hits.join(hashes, "doc_id", "left"), "content_hash")
    return best.select("doc_id", "score", "n_duplicates").orderBy(F.desc("score"), "doc_id").limit(20)


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(0), ''), '(?m)^[ \\t\\f\\v]+$', '', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '[\\x01-\\x08\\x0B\\x0E-\\x1F\\x7F]', '', 'g')) AS clean_md5 FROM documents""")
def normalize_and_clean(spark, sf_dir):
    clean = T.strip_controls(T.normalize_newlines(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean.cast("binary")).alias("clean_md5"))


@query(f"WITH {_CORPUS} SELECT doc_id, lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) AS ext, trim(regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '[_.-]+', ' ', 'g')) AS title FROM corpus")
def document_titles(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", T.file_extension(F.col("filename")).alias("ext"), T.human_stem(F.col("filename")).alias("title"))


_RE2 = {"jwt": "eyJ[A-Za-z0-9_-]{20,}\\.eyJ[A-Za-z0-9_-]{20,}\\.[A-Za-z0-9_-]{20,}"}


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{_RE2.get(n, p).replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in T.SECRET_RULES) + " END AS rule FROM documents")
def secret_screen(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.suspected_secret(F.col("text")).alias("rule"))


_FLAT = "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents"


@query(f"""WITH p AS (SELECT doc_id, f, list_min(list_filter([strpos(lower(f), 'ering'), strpos(lower(f), 'thnt')], lambda x: x > 0)) AS pos FROM ({_FLAT})),
s AS (SELECT doc_id, f, greatest(coalesce(pos, 1) - 1 - 40, 0) AS b FROM p)
SELECT doc_id, CASE WHEN length(f) <= 120 THEN f ELSE (CASE WHEN b > 0 THEN '...' ELSE '' END) || substr(f, b + 1, 120) || (CASE WHEN b + 120 < length(f) THEN '...' ELSE '' END) END AS excerpt FROM s""")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), PAIR, 120).alias("excerpt"))


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two inventories of the corpus: some files are gone, some new, some changed, some moved between them."""
    docs = corpus(spark, sf_dir).select("doc_id", "path", "size", "mtime", F.md5(F.col("text").cast("binary")).alias("content_hash"), F.col("doc_id").cast("string").alias("file_id"))
    old = docs.filter("doc_id % 11 <> 0")
    moved = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("/moved"), "path")).otherwise(F.col("path"))
    new = docs.filter("doc_id % 7 <> 0").withColumns({"path": moved, "mtime": F.when(F.col("doc_id") % 5 == 0, F.col("mtime") + 60).otherwise(F.col("mtime"))})
    return old, new


_SNAPSHOTS = f"""WITH {_CORPUS}, d AS (SELECT doc_id, path, size, mtime, md5(text) AS content_hash FROM corpus), old AS (SELECT * FROM d WHERE doc_id % 11 <> 0),
new AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '/moved' || path ELSE path END AS path, size, CASE WHEN doc_id % 5 = 0 THEN mtime + 60 ELSE mtime END AS mtime, content_hash FROM d WHERE doc_id % 7 <> 0)"""


@query(_SNAPSHOTS + " SELECT path, CASE WHEN old.mtime IS NULL THEN 'added' WHEN new.mtime IS NULL THEN 'vanished' WHEN old.size = new.size AND abs(old.mtime - new.mtime) < 1e-6 THEN 'unchanged' ELSE 'changed' END AS change FROM old FULL JOIN new USING (path)")
def snapshot_diff(spark, sf_dir):
    return maintenance.difference(*_snapshots(spark, sf_dir))


@query(_SNAPSHOTS + " SELECT new.path AS new_path, min(old.path) AS old_path FROM new JOIN old USING (doc_id, content_hash) WHERE new.path NOT IN (SELECT path FROM old) AND old.path NOT IN (SELECT path FROM new) GROUP BY new.path")
def snapshot_moves(spark, sf_dir):
    return maintenance.moves(*_snapshots(spark, sf_dir))


@query(_SNAPSHOTS + " SELECT (SELECT count(*) FROM old) AS known, (SELECT count(*) FROM old WHERE path IN (SELECT path FROM new)) AS seen")
def mass_deletion_counts(spark, sf_dir):
    """What the guard compares before anything is deleted."""
    old, new = _snapshots(spark, sf_dir)
    return old.join(new.select("path", F.lit(1).alias("there")), "path", "left").agg(F.count(F.lit(1)).alias("known"), F.count("there").alias("seen"))


@query(f"WITH {_CORPUS} SELECT doc_id FROM corpus WHERE doc_id % 3 = 0 AND mtime <= {NOW} - 600")
def tombstone_purge(spark, sf_dir):
    status = F.when(F.col("doc_id") % 3 == 0, "missing").otherwise("ok")
    return maintenance.purgeable(corpus(spark, sf_dir).withColumns({"status": status, "missing_since": F.col("mtime")}), NOW).select("doc_id")


@query("WITH c AS (SELECT doc_id, md5(text) AS h FROM documents), v AS (SELECT vec_id, h FROM embeddings JOIN c ON vec_id = doc_id) SELECT doc_id, m AS vec_id FROM c LEFT JOIN (SELECT h, min(vec_id) AS m FROM v GROUP BY h) USING (h)")
def vector_reuse(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_hash"))
    vecs = table(spark, sf_dir, "embeddings").join(chunks.select(F.col("doc_id").alias("vec_id"), "text_hash"), "vec_id").select("vec_id", "text_hash")
    return maintenance.reuse_vectors(chunks, vecs).select("doc_id", "vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')")
def orphan_vectors(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").filter("lang <> 'de'").select(F.col("doc_id").alias("text_hash"))
    return maintenance.orphans(table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").alias("text_hash")), chunks).select("vec_id")


@query(f"WITH {_CORPUS} SELECT extension, count(*) AS n, sum(size)::BIGINT AS chars, count_if(size = 0) AS n_empty, max(size) AS longest FROM corpus GROUP BY extension")
def stats_by_extension(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("extension").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"), F.count_if(F.col("size") == 0).alias("n_empty"), F.max("size").alias("longest"))


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(quality::VARCHAR, 'all') AS quality, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (lang), ())")
def labels_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.rollup("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce(F.col("quality").cast("string"), F.lit("all")).alias("quality"), "n", "mean_chars")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 50")
def error_retention(spark, sf_dir):
    """The newest 50 events of each type."""
    return maintenance.newest(table(spark, sf_dir, "events"), "event_type", "ts", 50).select("event_id", "event_type")


_WATCH = "e AS (SELECT event_id, ts, '/watched/' || user_id AS path, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' WHEN 'purchase' THEN 'renamed' ELSE 'modified' END AS action FROM events)"


@query(f"""WITH {_WATCH}, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS k FROM f)
SELECT path, min(ts) AS started, count(*) AS n_events, last(action ORDER BY ts, event_id) AS last_action FROM g GROUP BY path, k""")
def events_settled(spark, sf_dir):
    return changes.settled(changes.watch_events(table(spark, sf_dir, "events")))


@query(f"WITH {_WATCH} SELECT date_trunc('day', ts)::TIMESTAMP AS started, action, count(*) AS n_events FROM e GROUP BY ALL")
def events_throughput(spark, sf_dir):
    return changes.throughput(changes.watch_events(table(spark, sf_dir, "events")))


@query(f"""WITH {_WATCH}, i AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) - row_number() OVER (PARTITION BY path, action ORDER BY ts, event_id) AS k FROM e)
SELECT path, min(ts) AS started, count(*) AS n_events FROM i WHERE action = 'modified' GROUP BY path, k HAVING count(*) >= 3""")
def pause_streaks(spark, sf_dir):
    return changes.streaks(changes.watch_events(table(spark, sf_dir, "events")), "modified", 3)


@query("SELECT conv_id, count(*) AS n_turns, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def reassemble_text(spark, sf_dir):
    """A conversation's turns in order, as one text; a conversation's turns are bounded by its length."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", "n_turns", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n").cast("binary")).alias("text_md5"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, md5(trim(regexp_replace(replace(replace(replace(replace(replace(
 regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), F.md5(T.html_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("""WITH l AS (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)
SELECT doc_id, line_no::INT AS line_no, start, length(line)::INT AS size FROM o""")
def line_offsets(spark, sf_dir):
    """Each line's number, start and size in its document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", "line_no", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("start"), F.length("line").alias("size"))


def known_items(spark, sf_dir, any_case: bool = False) -> DataFrame:
    """(item_id, doc_id) where a document holds an item's text word for word, or in any case of letters; an empty text is held by none.

    An item's words but the first and last stand in such a document as whole
    words, so the postings of the rarest of them name the candidates. The few
    items with no such word are held against all documents, in blocks of a
    checked size.
    """
    docs, items = table(spark, sf_dir, "documents").select("doc_id", F.col("text")), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle")).filter("needle <> ''")
    if any_case:
        docs, items = docs.withColumn("text", F.lower("text")), items.withColumn("needle", F.lower("needle"))
    words = T.tokens(F.col("needle"))
    items = items.select("item_id", "needle", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))).alias("inner"))
    postings = document_index(spark, sf_dir).postings.select("term", "doc_id")
    asked = items.select("item_id", F.explode(F.array_distinct("inner")).alias("term"))
    df = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # a word of no document rules its item out
    rarest = asked.join(df, "term", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).filter("r.df > 0").select("item_id", F.col("r.term").alias("term"))
    pairs = kept(postings.join(rarest, "term").select("item_id", "doc_id"))
    candidates = pairs.join(items.select("item_id", "needle"), "item_id")
    ids = pairs.select("doc_id").filter("doc_id is not null").distinct()
    # texts of candidates alone are shuffled, where their ids aren't too many for every executor
    met = docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= MOST_IDS else docs
    found = candidates.join(met, "doc_id").filter(F.contains("text", "needle")).select("item_id", "doc_id")
    short = items.filter(F.size("inner") == 0)
    n = max(1, -(-(short.agg(F.sum(F.octet_length("needle"))).first()[0] or 0) // (4 << 20)))
    parts = [docs.join(F.broadcast(short.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)), F.contains("text", "needle")).select("item_id", "doc_id") for k in range(n)]
    return reduce(DataFrame.unionByName, parts, found)


@query("""WITH m AS (SELECT item_id, doc_id, length(b.text) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM m GROUP BY item_id""")
def labels_by_containment(spark, sf_dir):
    """Which documents hold a query's text word for word: the labels of a known-item evaluation."""
    return known_items(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
