"""Operator 8: secret scan with multipart credential linking, DataFrame functions only.

Strong findings stand alone: assignments to secret names, access identifiers
and runs of hex digits. Weak ones (account names, opaque keys, endpoints) are
reported only where the parts of a credential come together within SCOPE
characters of a document: a name or key needs its other half nearby, an
endpoint needs both. The interval join is a sweep: each row's parts are sorted
by start, and running ends before and starts after a part give the nearest
part of each class, so work is linear in the parts.

Places come from the text between matches: ``split`` and ``regexp_extract_all``
see the same matches, so running lengths are starts in code points.

Results for odd input: null is the empty text and has no spans; each row is
scanned by itself, even if doc_ids repeat or are null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters within which parts belong together.
SCOPE = 200

#: Kind, pattern, group whose length counts, least length, class (identifier, secret, endpoint), strong. In reporting order.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, "secret", True),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, "identifier", True),
    ("hex", r"[0-9a-f]{16,}", 0, 16, "secret", True),
    ("account", r"""(?i:\b(?:user_?name|user|login|client_?id|account_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}+""", 0, 0, "identifier", False),
    ("key", r"(?<![A-Za-z0-9/+])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[0-9])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", 0, 0, "secret", False),
    ("endpoint", r"""https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:/[^\s"'<>]*+)?""", 0, 0, "endpoint", False),
]


def _parts(text: Column) -> Column:
    """All matches of all kinds: kind's number, place in order, characters before it since the last match, its length, whether it is long enough."""
    def found(number: int, pattern: str, group: int, least: int) -> Column:
        p = F.lit(pattern)
        whole = F.regexp_extract_all(text, p, F.lit(0))
        counted = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        each = F.arrays_zip(whole.alias("m"), gaps.alias("gap"), counted.alias("c"))
        return F.transform(each, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("nth"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["m"]).alias("size"), (F.char_length(x["c"]) >= least).alias("good")))

    arrays = [F.when(text.rlike(pattern), found(n, pattern, group, least)) for n, (_, pattern, group, least, _, _) in enumerate(KINDS)]
    empty = F.expr("cast(array() as array<struct<kind:int,nth:int,gap:int,size:int,good:boolean>>)")
    return F.concat(*(F.coalesce(a, empty) for a in arrays))


def _is(what: str) -> Column:
    return F.col("kind").isin([n for n, k in enumerate(KINDS) if k[4] == what])


def find_spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and spans, an array of (start, number, kind, end, strong) by start and then kind."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = rows.select("row", "doc_id", _parts(F.col("text")).alias("parts")).select("row", "doc_id", F.explode_outer("parts").alias("p")).select("row", "doc_id", "p.*").repartition("row")
    by_kind = Window.partitionBy("row", "kind").orderBy("nth")
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(by_kind)).withColumn("start", F.col("end") - F.col("size")).withColumn("kind", F.when(F.col("good"), F.col("kind")))
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)

    def near(what: str) -> Column:
        last = F.max(F.when(_is(what), F.col("end"))).over(before)
        following = F.min(F.when(_is(what), F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= SCOPE, F.lit(False)) | F.coalesce(following - F.col("end") <= SCOPE, F.lit(False))

    linked = parts.withColumns({"identifier": near("identifier"), "secret": near("secret")})
    strong = F.col("kind").isin([n for n, k in enumerate(KINDS) if k[5]])
    stays = F.col("kind").isNotNull() & (strong | F.when(_is("identifier"), F.col("secret")).when(_is("secret"), F.col("identifier")).otherwise(F.col("identifier") & F.col("secret")))
    name = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("kind") + 1)
    span = F.when(stays, F.struct("start", F.col("kind").alias("number"), name.alias("kind"), "end", strong.alias("strong")))
    # the parts of one row
    return linked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
