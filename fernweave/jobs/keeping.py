"""Registered queries: scope, coverage, changes and jobs of an index; words, paths and notes of its hits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as T
from ..operators import batch_search, filters, fusion, lexical, maintenance, scope
from ..sources.corpus import corpus, shared_dir, table
from ..streaming import changes, pairing
from .indexing import _ASKED, MOST_SIZE, NAMES, _items
from .store import document_index, stemmed_index
from .queries import _CORPUS, _HYBRID, _POOLS, _SNAPSHOTS, _WATCH, EXTENSIONS, PAIR, ROOTS, TERMS, _candidates, _score_sql, _snapshots, known_items, query

ASKED = ["licensing", "generations", "related"]
OLD_LIMITS, NEW_LIMITS = (8000, 8, 3, [".json"]), (2, [".json", ".csv"])
_OUT = "NOT ((path = '/corpus/src1' OR path LIKE '/corpus/src1/%') OR (path = '/corpus/src7' OR path LIKE '/corpus/src7/%')) OR filename GLOB 'doc_*9.json'"
_SECRET = "regexp_matches(text, 'token = \"[0-9a-f]{40}\"')"


@query(f"WITH {_CORPUS} SELECT doc_id, extension IN ('.md', '.txt') AND NOT filename GLOB 'doc_1*' AND size <= {MOST_SIZE} AS wanted FROM corpus")
def wanted_files(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", scope.wanted(F.col("path"), F.col("extension"), F.col("size"), EXTENSIONS, ["DOC_1*"], MOST_SIZE).alias("wanted"))


@query(f"WITH {_CORPUS} SELECT doc_id FROM corpus WHERE {_OUT}")
def scope_sweep(spark, sf_dir):
    return scope.out_of_scope(corpus(spark, sf_dir), ROOTS, ["doc_*9.json"]).select("doc_id")


@query(f"WITH {_CORPUS} SELECT path, CASE WHEN path LIKE '/corpus/src3/%' THEN 'requeue' ELSE 'quarantine' END AS action FROM corpus WHERE CASE WHEN path LIKE '/corpus/src3/%' THEN doc_id % 3 = 0 ELSE doc_id % 3 <> 0 AND {_SECRET} END")
def policy_rescan(spark, sf_dir):
    docs = corpus(spark, sf_dir).withColumn("status", F.when(F.col("doc_id") % 3 == 0, "secret_suspected").otherwise("ok"))
    return scope.rescan(docs, T.suspected_secret(F.col("text")).isNotNull(), filters.under(F.col("path"), "/corpus/src3"))


@query(f"WITH {_CORPUS} SELECT doc_id FROM (SELECT *, ceil(size / 1000) AS n_chunks FROM corpus) WHERE doc_id % 50 = 0 OR size >= 8000 OR n_chunks >= 8 OR (extension = '.csv' AND n_chunks > 2) OR (extension IN ('.csv', '.json') AND n_chunks > 2)")
def coverage_affected(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    affected = scope.coverage_affected(F.col("doc_id") % 50 == 0, F.col("size"), F.ceil(F.col("size") / 1000), F.col("extension"), OLD_LIMITS, NEW_LIMITS)
    return docs.filter(affected).select("doc_id")


@query(f"WITH {_CORPUS} SELECT doc_id FROM corpus WHERE size > 0 AND doc_id % 6 <> 0 AND (doc_id % 3 = 0 OR doc_id % 4 = 0)")
def needs_embedding(spark, sf_dir):
    """Documents with chunks whose vectors are missing or of another model."""
    model = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 0, "hash:1:32").otherwise("hash:1:64")
    status = F.when(F.col("doc_id") % 6 == 0, "missing").otherwise("ok")
    docs = corpus(spark, sf_dir).withColumns({"model": model, "status": status})
    return docs.filter((F.col("size") > 0) & (F.col("status") == "ok") & ~F.col("model").eqNullSafe("hash:1:64")).select("doc_id")


@query(f"WITH {_CORPUS} SELECT count(*) AS documents, count_if(doc_id % 9 = 0) AS missing, count_if(size > 8000) AS truncated, sum(ceil(size / 1000))::BIGINT AS chunks, sum(least(ceil(size / 1000), 3))::BIGINT AS embedded, count_if(ceil(size / 1000) > 3) AS partial FROM corpus")
def index_totals(spark, sf_dir):
    chunks = F.ceil(F.col("size") / 1000)
    return corpus(spark, sf_dir).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("doc_id") % 9 == 0).alias("missing"), F.count_if(F.col("size") > 8000).alias("truncated"), F.sum(chunks).alias("chunks"), F.sum(F.least(chunks, F.lit(3))).alias("embedded"), F.count_if(chunks > 3).alias("partial"))


@query("SELECT coalesce(quality::VARCHAR, 'none') AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def stats_by_status(spark, sf_dir):
    """Documents by status; those without one are counted as none."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(_SNAPSHOTS + " SELECT path, size, mtime, 'new' AS source FROM new UNION ALL SELECT path, size, mtime, 'old' FROM old WHERE path NOT IN (SELECT path FROM new)")
def merged_inventories(spark, sf_dir):
    old, new = (d.select("path", "size", "mtime", F.lit(n).alias("source")) for d, n in zip(_snapshots(spark, sf_dir), ("old", "new"), strict=True))
    return scope.merged(new, old)


@query(_SNAPSHOTS + " SELECT path, coalesce(CASE WHEN new.size % 2 = 0 THEN new.size END, old.size) AS size, coalesce(new.mtime, old.mtime) AS mtime FROM old FULL JOIN new USING (path)")
def upserted_rows(spark, sf_dir):
    """The index after an update by path in which odd sizes are unknown."""
    old, new = _snapshots(spark, sf_dir)
    return scope.upserted(old, new.withColumn("size", F.when(F.col("size") % 2 == 0, F.col("size"))), ["size", "mtime"])


@query(f"WITH {_CORPUS}, r AS (SELECT DISTINCT root FROM corpus WHERE doc_id % 2 = 0 AND lang = 'fr' UNION SELECT DISTINCT root || '/' || lang FROM corpus) SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE starts_with(r.root, o.root || '/'))")
def outermost_roots(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    roots = docs.filter("doc_id % 2 = 0 and lang = 'fr'").select("root").unionByName(docs.select(F.concat_ws("/", "root", "lang").alias("root")))
    return scope.outermost(roots)


@query(f"WITH {_CORPUS}, c AS (SELECT root, max(mtime) AS checkpoint FROM corpus WHERE doc_id % 8 <> 0 AND source <> 'src2' GROUP BY root) SELECT doc_id FROM corpus LEFT JOIN c USING (root) WHERE checkpoint IS NULL OR mtime >= checkpoint - 5")
def changed_since_checkpoint(spark, sf_dir):
    """What a pass reads that follows one which saw most files and never came to one root."""
    docs = corpus(spark, sf_dir)
    seen = docs.filter("doc_id % 8 <> 0 and source <> 'src2'").groupBy("root").agg(F.max("mtime").alias("checkpoint"))
    return scope.changed_since(docs, seen).select("doc_id")


@query(f"""WITH {_CORPUS}, {_WATCH}, known AS (SELECT path FROM corpus WHERE doc_id % 4 <> 0),
c AS (SELECT CASE WHEN action = 'renamed' THEN '/moved' || d.path WHEN action = 'removed' AND event_id % 10 = 0 THEN root || '/' || lang ELSE d.path END AS path, action, CASE WHEN action = 'renamed' THEN d.path END AS old_path, extension FROM e JOIN corpus d ON e.path = '/watched/' || d.doc_id),
t AS (SELECT coalesce(old_path, CASE WHEN action = 'removed' THEN path END) AS target, CASE WHEN old_path IS NULL THEN 2 ELSE 3 END AS priority FROM c),
j AS (SELECT k.path, 'vanish' AS op, priority FROM t JOIN known k ON k.path = target OR (target NOT IN (SELECT path FROM known) AND starts_with(k.path, target || '/'))
 UNION ALL SELECT path, 'index', 2 FROM c WHERE action <> 'removed' AND extension IN ('.md', '.txt'))
SELECT path, op, min(priority)::INT AS priority, count(*) AS n_requests FROM j GROUP BY path, op""")
def jobs_of_changes(spark, sf_dir):
    """Jobs of the watched events, each taken for a change of the document whose number its user has."""
    docs = corpus(spark, sf_dir)
    events = changes.watch_events(table(spark, sf_dir, "events"))
    met = events.withColumnRenamed("path", "watched").join(docs.select(F.concat(F.lit("/watched/"), F.col("doc_id").cast("string")).alias("watched"), "path", "root", "lang", "extension"), "watched")
    renamed = F.col("action") == "renamed"
    place = F.when(renamed, F.concat(F.lit("/moved"), "path")).when((F.col("action") == "removed") & (F.col("event_id") % 10 == 0), F.concat_ws("/", "root", "lang")).otherwise(F.col("path"))
    moved = met.select(place.alias("path"), "action", F.when(renamed, F.col("path")).alias("old_path"), "extension")
    return scope.jobs_of_changes(moved, docs.filter("doc_id % 4 <> 0"), filters.has_extension(F.col("extension"), EXTENSIONS))


_REPORTS = """r AS (SELECT event_id, ts, '/watched/r' || (user_id % 7) AS root, '/watched/r' || (user_id % 7) || '/' || user_id AS path,
 CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'renamed_old' ELSE 'renamed_new' END ELSE 'modified' END AS action FROM events),
n AS (SELECT *, lag(action) OVER w AS last_action, lag(path) OVER w AS last_path FROM r WHERE action LIKE 'renamed%' WINDOW w AS (PARTITION BY root ORDER BY ts, event_id)),
p AS (SELECT event_id, ts, path, 'renamed' AS action, CASE WHEN last_action = 'renamed_old' THEN last_path END AS old_path FROM n WHERE action = 'renamed_new'
 UNION ALL SELECT event_id, ts, path, action, NULL FROM r WHERE action NOT LIKE 'renamed%')"""
_COALESCED = _REPORTS + """, f AS (SELECT *, lag(ts) OVER w AS last_ts, lag(action) OVER w AS before FROM p WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN ts - last_ts <= INTERVAL 1 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY ts, event_id) AS k FROM f),
b AS (SELECT path, CASE WHEN last(action ORDER BY ts, event_id) IN ('modified', 'added') AND last(before ORDER BY ts, event_id) = 'removed' AND last(ts - last_ts <= INTERVAL 1 HOUR ORDER BY ts, event_id) THEN 'added' ELSE last(action ORDER BY ts, event_id) END AS action,
 last(old_path ORDER BY ts, event_id) FILTER (old_path IS NOT NULL) AS old_path, epoch_us(min(ts)) AS started, count(*) AS n_events, max(ts) AS ended FROM g GROUP BY path, k)"""


@query(f"WITH {_REPORTS} SELECT event_id, path, action, old_path FROM p")
def rename_pairs(spark, sf_dir):
    """Reported changes with the two halves of each rename as one."""
    return pairing.paired(pairing.reported(table(spark, sf_dir, "events"))).drop("ts")


@query(f"WITH {_COALESCED} SELECT path, action, old_path, started, n_events FROM b")
def changes_coalesced(spark, sf_dir):
    """Each path's bursts of changes as one change."""
    found = pairing.coalesced(pairing.paired(pairing.reported(table(spark, sf_dir, "events"))))
    return found.withColumn("started", F.unix_micros("started"))


@query(f"WITH {_COALESCED} SELECT path, action, old_path, started, n_events FROM b WHERE ended + INTERVAL 1 HOUR <= (SELECT max(ts) FROM p)")
def changes_coalesced_stream(spark, sf_dir):
    """``changes_coalesced`` as a stream with state: bursts whose end the watermark has passed."""
    found = pairing.coalesced_stream(spark, f"{sf_dir}/events.parquet", f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    return found.withColumn("started", F.unix_micros("started"))


@query("""WITH t AS (SELECT event_id, epoch_us(ts) AS us FROM events), r AS (SELECT event_id, us, count(*) OVER w AS n_events, min(us) OVER w AS oldest FROM t WINDOW w AS (ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
SELECT event_id, n_events, round(n_events / greatest((us - oldest) / 1e6, 1.0), 6) AS per_second FROM r""")
def rolling_throughput(spark, sf_dir):
    return scope.rolling_rate(table(spark, sf_dir, "events"), 3600)


@query("WITH v AS (SELECT event_type AS key, list(value ORDER BY value) AS l FROM events GROUP BY event_type) SELECT key, s AS share, l[least(floor(len(l) * s)::BIGINT, len(l) - 1) + 1] AS value FROM v, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) p(s)")
def nearest_rank(spark, sf_dir):
    """Median and 95th percentile by place, exact."""
    return scope.ranked_values(table(spark, sf_dir, "events"), "event_type", "value", [0.5, 0.95])


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20")
def recent_errors(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), "event_id").limit(20)


@query(f"WITH {_CORPUS} SELECT doc_id, 'file://' || path || '/' AS url, lower(path) AS path FROM corpus")
def normalized_paths(spark, sf_dir):
    """Paths as URLs with a slash too many, and read back."""
    url = F.concat(T.path_to_url(F.col("path")), F.lit("/"))
    return corpus(spark, sf_dir).select("doc_id", url.alias("url")).withColumn("path", T.normalized_path(F.col("url")))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+(?:[-''][\\p{L}\\p{N}_]+)*') AS q, regexp_extract_all(text, '[\\p{L}\\p{N}_''-]+') AS f FROM benchmark)
SELECT item_id, array_to_string(list_transform(q, lambda x: '"' || x || '"'), ' OR ') AS expression, array_to_string(list_slice(list_filter(f, lambda x: length(x) > 1), 1, 20), ' ') AS freetext FROM w""")
def match_expressions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.match_expression(T.query_words(F.col("text")), "OR").alias("expression"), F.array_join(T.freetext_words(F.col("text")), " ").alias("freetext"))


@query("SELECT doc_id, CASE WHEN regexp_matches(f, '(?i)\\bering') THEN 'ering' ELSE '' END || CASE WHEN regexp_matches(f, '(?i)\\bthnt') THEN ' thnt' ELSE '' END AS found FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS f FROM documents)")
def excerpt_terms(spark, sf_dir):
    """Which terms begin a word of the text."""
    found = T.terms_in(F.regexp_replace("text", "\\s+", " "), PAIR)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(found == F.array(F.lit(PAIR[1])), F.lit(" " + PAIR[1])).otherwise(F.array_join(found, " ")).alias("found"))


@query(f"""WITH {_CORPUS}, n AS (SELECT doc_id, ceil(size / 1000)::BIGINT AS chunks, size, doc_id % 50 = 0 AS truncated FROM corpus)
SELECT doc_id, nullif(concat_ws('; ', CASE WHEN chunks > 3 THEN 'vectors for 3 of ' || format('{{:,}}', chunks) || ' chunks, words for all' END, CASE WHEN truncated THEN 'indexed up to character ' || format('{{:,}}', size) END), '') AS note FROM n""")
def coverage_notes(spark, sf_dir):
    chunks = F.ceil(F.col("size") / 1000)
    return corpus(spark, sf_dir).select("doc_id", T.coverage_note(chunks, F.least(chunks, F.lit(3)), F.col("doc_id") % 50 == 0, F.col("size")).alias("note"))


@query(f"""WITH {_CORPUS}, l AS (SELECT doc_id, 'doc ' || doc_id AS title, unnest(range(1, least(len(string_split(text, chr(10))), CASE WHEN extension IN ('.json', '.csv') THEN 2 ELSE 1000000 END) + 1)) AS i, string_split(text, chr(10)) AS lines FROM corpus)
SELECT doc_id, (i - 1)::INT AS ordinal, md5(title || chr(10) || chr(10) || lines[i]) AS input_md5 FROM l""")
def embedding_inputs(spark, sf_dir):
    """Title and line of what is embedded: all lines, or the first two of a data file."""
    lines = corpus(spark, sf_dir).select("doc_id", "extension", T.human_stem(F.col("filename")).alias("title"), F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))
    kept = lines.filter(~F.col("extension").isin(".json", ".csv") | (F.col("ordinal") < 2))
    return kept.select("doc_id", "ordinal", F.md5(F.concat_ws("\n\n", "title", "line").cast("binary")).alias("input_md5"))


@query(f"""WITH {_CORPUS}, tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM corpus),
rows_ AS (SELECT doc_id, len(t) AS dl, (SELECT count(*) FROM range(1, greatest(len(t), 1)) r(i) WHERE t[i] = 'of' AND t[i + 1] = 'the') AS tf_a, len(list_filter(t, lambda x: x = 'ering')) AS tf_b FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS a, count_if(tf_a > 0) AS df_a, count_if(tf_b > 0) AS df_b FROM rows_)
SELECT doc_id, {_score_sql(["a", "b"])} AS score FROM rows_, stats WHERE tf_a > 0 OR tf_b > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_with_phrase(spark, sf_dir):
    """A hyphenated word is a phrase inside a longer query."""
    return lexical.phrases(document_index(spark, sf_dir), [w.split("-") for w in ("of-the", "ering")])


@query(_POOLS + f"""
nm AS (SELECT doc_id, (contains(filename, '{NAMES[0]}')::INT + contains(filename, '{NAMES[1]}')::INT) / 2.0::DOUBLE AS fraction FROM corpus),
u AS (SELECT doc_id, lexical / max(lexical) OVER () AS s FROM lex UNION ALL SELECT doc_id, greatest(fraction * 0.5, 0.6 + 0.4 * fraction) FROM nm WHERE fraction >= 0.5
 UNION ALL SELECT doc_id, 0.8::DOUBLE * (doc_id % 1001) / 1000 FROM labels WHERE quality = 1)
SELECT doc_id, round(least(max(s), 1.0), 4) AS score FROM u GROUP BY doc_id""")
def literal_ranking(spark, sf_dir):
    """Text, file names and an outside ranking without vectors."""
    docs = corpus(spark, sf_dir)
    share = sum((filters.name_contains(F.col("filename"), t).cast("double") for t in NAMES), F.lit(0.0)) / len(NAMES)
    outside = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", (F.col("doc_id") % 1001).alias("rank"))
    return fusion.literal(lexical.search(document_index(spark, sf_dir), TERMS, k=300), docs.select("doc_id", share.alias("fraction")).filter("fraction >= 0.5"), outside)


@query()
def stemmed_terms(spark, sf_dir):
    """Document frequencies of folded and stemmed words; tested against a full-text index."""
    return lexical.document_frequencies(stemmed_index(spark, sf_dir))


@query()
def bm25_stemmed(spark, sf_dir):
    """The ten best documents by stemmed words; tested against a full-text index."""
    return lexical.search(stemmed_index(spark, sf_dir), [stem.stem(w) for w in ASKED])


@query(_HYBRID + """, p AS (SELECT *, floor(semantic * 1000 + 0.5)::BIGINT AS s, floor(lexical * 1000 + 0.5)::BIGINT AS x FROM h)
SELECT doc_id, concat_ws('; ', 'meaning ' || (s // 1000) || '.' || lpad((s % 1000)::VARCHAR, 3, '0') || ', place ' || semantic_rank, 'words ' || (x // 1000) || '.' || lpad((x % 1000)::VARCHAR, 3, '0') || ', place ' || lexical_rank, CASE WHEN doc_id % 4 = 0 THEN 'name 50 %' END, CASE WHEN doc_id % 10 = 1 THEN 'outside rank 0.' || lpad((doc_id % 1000)::VARCHAR, 3, '0') END) AS why FROM p""")
def hit_reasons(spark, sf_dir):
    hits = fusion.fuse(_candidates(spark, sf_dir))
    name = F.when(F.col("doc_id") % 4 == 0, F.lit(0.5))
    outside = F.when(F.col("doc_id") % 10 == 1, (F.col("doc_id") % 1000) / 1000)
    why = fusion.reasons(F.col("semantic"), F.col("semantic_rank"), F.col("lexical"), F.col("lexical_rank"), name, outside)
    return hits.select("doc_id", F.array_join(why, "; ").alias("why"))


@query(f"""WITH {_ASKED}, label AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT query_id, count(DISTINCT doc_id) AS n_relevant FROM ranked JOIN label USING (query_id, doc_id) WHERE rank <= 5 GROUP BY query_id""")
def relevant_in_first_five(spark, sf_dir):
    first = batch_search.search_all(document_index(spark, sf_dir), _items(spark, sf_dir), 5)
    return first.join(known_items(spark, sf_dir).withColumnRenamed("item_id", "query_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_relevant"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, i, lines[i] AS line, CASE WHEN doc_id % 3 = 0 AND i = 2 THEN lines[i] || '!' ELSE lines[i] END AS now FROM l WHERE true)
SELECT doc_id, count(*) AS n_vectors FROM c GROUP BY doc_id HAVING bool_and(line = now)""")
def fresh_vectors(spark, sf_dir):
    """Vectors that may be stored when the second line of every third document changed while they were computed."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))
    now = F.when((F.col("doc_id") % 3 == 0) & (F.col("ordinal") == 1), F.concat("line", F.lit("!"))).otherwise(F.col("line"))
    hashed = lambda c: lines.select("doc_id", "ordinal", F.md5(c.cast("binary")).alias("text_hash"))
    return maintenance.fresh_vectors(hashed(F.col("line")), hashed(now)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_vectors"))


@query(f"WITH {_CORPUS} SELECT doc_id, CASE WHEN {_SECRET} THEN NULL ELSE length(text) END AS n_kept, CASE WHEN {_SECRET} THEN 'secret_suspected' ELSE 'ok' END AS status FROM corpus")
def quarantine(spark, sf_dir):
    docs = corpus(spark, sf_dir).withColumns({"status": F.lit("ok"), "content_hash": F.md5(F.col("text").cast("binary"))})
    return maintenance.quarantined(docs, T.suspected_secret(F.col("text")).isNotNull()).select("doc_id", F.length("text").cast("long").alias("n_kept"), "status")


@query(f"WITH {_CORPUS} SELECT doc_id FROM corpus WHERE NOT starts_with(path, '/corpus/src1/')")
def subtree_removed(spark, sf_dir):
    return corpus(spark, sf_dir).filter(~filters.under(F.col("path"), "/corpus/src1")).select("doc_id")


@query(f"WITH {_CORPUS} SELECT doc_id, to_json({{'path': path, 'file_type': ltrim(extension, '.'), 'size': size}})::VARCHAR AS hit FROM corpus")
def hits_as_json(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.to_json(F.struct("path", F.ltrim("extension", F.lit(".")).alias("file_type"), "size")).alias("hit"))


@query(f"WITH {_CORPUS} SELECT source, string_agg(DISTINCT extension, ',' ORDER BY extension) AS extensions, md5(string_agg(DISTINCT extension, ',' ORDER BY extension)) AS policy_id FROM corpus GROUP BY source")
def policy_ids(spark, sf_dir):
    """What identifies each source's list of extensions, in any order it is given."""
    listed = F.array_join(F.array_sort(F.collect_set("extension")), ",")
    return corpus(spark, sf_dir).groupBy("source").agg(listed.alias("extensions")).withColumn("policy_id", F.md5(F.col("extensions").cast("binary")))
