"""Chunks, screening, titles, decoding and evaluation on small hand-made input."""

import codecs

import pytest
from pyspark.sql import functions as F

from fernweave.functions import decode
from fernweave.functions import text as T
from fernweave.operators import batch_search, chunking

SMALL = chunking.Limits(200, 300, 40, 10)


def bodies(text, is_code=False, limits=SMALL):
    return chunking.chunk(text, is_code, limits)


def test_no_chunks_of_blank_text(spark):
    docs = spark.createDataFrame([(1, None, ".md"), (2, " \n\t\r\n", None), (3, "some words", None)], "doc_id long, text string, extension string")
    assert [tuple(r) for r in chunking.chunked(docs).collect()] == [(3, 0, 0, 10, "some words", False)]


def test_chunks_cover_the_text():
    text = "\n\n".join(f"Paragraph {i} says a thing or two. It goes on a little." for i in range(40))
    found = bodies(text)
    assert [c[0] for c in found] == list(range(len(found)))
    assert found[0][1] == 0 and found[-1][2] == len(text)
    for (_, _, end, before), (_, start, stop, body) in zip(found, found[1:]):
        assert text[end:start].strip() == ""
        assert body.endswith(text[start:stop])
        lead = body[: len(body) - (stop - start) - 1]
        assert lead and before.endswith(lead) and len(lead) <= SMALL.overlap


def test_long_blocks_are_cut():
    one = "word " * 500
    assert max(b - a for _, a, b, _ in bodies(one)) <= SMALL.longest
    solid = bodies("x" * 1000)
    assert [(a, b) for _, a, b, _ in solid] == [(0, 300), (300, 600), (600, 900), (900, 1000)]
    sentences = "This is one sentence of the text. " * 60
    cut = bodies(sentences)
    assert all(sentences[a:b].startswith("This") and sentences[a:b].rstrip().endswith(".") for _, a, b, _ in cut)


def test_blocks_begin_at_headings_and_definitions():
    prose, code = "intro\n# One\na\n# Two\nb", "import x\ndef f():\n    pass\ndef g():\n    pass"
    import re

    assert [prose[a:b] for a, b in chunking.blocks(prose, re.compile(chunking.HEADING))] == ["intro", "# One\na", "# Two\nb"]
    assert [code[a:b] for a, b in chunking.blocks(code, re.compile(chunking.DEFINITION))] == ["import x", "def f():\n    pass", "def g():\n    pass"]


def test_small_rest_joins_the_chunk_before():
    text = "a" * 195 + "\n\nshort"
    assert bodies(text) == [(0, 0, 202, "a" * 195 + "\nshort")]


def test_most_chunks(spark):
    text = "\n\n".join("y" * 150 for _ in range(500))
    assert len(bodies(text)) == 500
    assert len(bodies(text, limits=chunking.Limits(200, 300, 40, 10, 7))) == 7
    docs = spark.createDataFrame([(1, text, ".md"), (2, "short text  \n ", ".md")], "doc_id long, text string, extension string")
    cut = chunking.chunked(docs, chunking.Limits(200, 300, 40, 10, 7)).groupBy("doc_id", "truncated").count().collect()
    assert sorted(map(tuple, cut)) == [(1, True, 7), (2, False, 1)]


SIGNED = "eyJ" + "a" * 20 + "." + "eyJ" + "b" * 20 + "." + "c" * 20
CASES = [
    ("-----BEGIN RSA PRIVATE " + "KEY-----", "private_key_block"),
    ("AKIA" + "A1B2" * 4, "aws_access_key"),
    ("sk-ant-" + "a1" * 16, "anthropic_key"),
    ("sk-proj-" + "a1" * 16, "openai_key"),
    ("ghp_" + "a1" * 18, "github_token"),
    ("xoxb-" + "12345-abcde", "slack_token"),
    ("sk_live_" + "a1" * 10, "stripe_key"),
    ("AIza" + "b" * 35, "google_api_key"),
    ('"client_secret": "' + "a" * 20 + '"', "google_oauth_client_secret"),
    ("api_key = " + "Z" * 24, "generic_assignment"),
    (SIGNED, "jwt"),
    ("password: " + SIGNED, "jwt"),
    ("x" * 20 + "." + SIGNED, "jwt"),
    (SIGNED.rsplit(".", 1)[0] + ".short", None),
    ("eyJ-" * 50_000, None),
    ("api_key = changeme", None),
    ("AKIA" + "a1b2" * 4, None),
    ("", None),
    (None, None),
]


def test_secret_rules(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    found = dict(docs.select("i", T.suspected_secret(F.col("text"))).collect())
    assert [found[i] for i in range(len(CASES))] == [rule for _, rule in CASES]


@pytest.mark.parametrize(
    "text, name, parent, title",
    [
        ("# Big *Plan* ##\nrest", "some_file.md", "x", "Big Plan (some file)"),
        ("no heading", "README.md", "tools", "tools README"),
        ("# Some File", "some-file.md", "x", "some file"),
        (None, "a.b.txt", None, "a b"),
        ("#hashtag", ".profile", "home", "profile"),
    ],
)
def test_titles(spark, text, name, parent, title):
    row = spark.createDataFrame([(text, name, parent)], "text string, name string, parent string")
    assert row.select(T.title(F.col("text"), F.col("name"), F.col("parent"))).first()[0] == title


@pytest.mark.parametrize(
    "data, expected",
    [
        (b"", ("", "empty", "utf-8")),
        (None, ("", "empty", "utf-8")),
        ("é".encode(), ("é", "ok", "utf-8")),
        (codecs.BOM_UTF8 + b"a", ("a", "ok", "utf-8-sig")),
        (codecs.BOM_UTF16_LE + "hi".encode("utf-16-le"), ("hi", "ok", "utf-16")),
        (codecs.BOM_UTF32_LE + "hé😀".encode("utf-32-le"), ("hé😀", "ok", "utf-32")),
        (codecs.BOM_UTF32_BE + " ".encode("utf-32-be"), (" ", "empty", "utf-32")),
        ("plain".encode("utf-16-le"), ("plain", "ok", "utf-16-le")),
        ("plain".encode("utf-16-be"), ("plain", "ok", "utf-16-be")),
        (b"caf\xe9", ("café", "ok", "cp1252")),
        (b"\x00\x01\x02\x00\x00\x07\x08\x00\x00", ("", "binary", "")),
    ],
)
def test_decoding(data, expected):
    assert decode.decoded(data) == expected


def test_query_words(spark):
    row = spark.createDataFrame([("The rent-buy snake_case d'Été, 42!",)], "q string")
    assert row.select(T.query_words(F.col("q"))).first()[0] == ["the", "rent-buy", "snake_case", "d'été", "42"]
    one = spark.createDataFrame([(1, "the of a"), (2, "the big idea x"), (3, None)], "query_id int, text string")
    assert sorted(map(tuple, batch_search.query_terms(one).collect())) == [(1, "a", 1), (1, "of", 1), (1, "the", 1), (2, "big", 1), (2, "idea", 1)]


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 7), (2, 20, 4)], "query_id int, doc_id int, rank int")
    labels = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "query_id int, doc_id int")
    kinds = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "query_id int, kind string")
    got = {r["kind"]: (r["n_queries"], r["top1"], r["recall"], r["mrr"]) for r in batch_search.evaluate(ranked, labels, kinds).collect()}
    assert got == {"a": (1, 1.0, 0.5, 1.0), "b": (2, 0.0, 0.5, 0.125), "all": (3, 0.333333, 0.5, 0.416667)}
