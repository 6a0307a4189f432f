"""Scrubbing by blocks gives what it gives at once, in all columns."""

from collections import Counter

import pytest

from fernweave.llm import decontaminate

SHAPE = "row int, doc_id long, text string, spans string, n_chars int"
DOCS = [(1, 1, "Before. One TWO three; after", "s", 99), (2, 2, "one two three", "s", 13), (3, 3, "clean é text", None, 77), (4, 4, None, "s", 5), (5, 5, "é one two three é", "s", None), (6, None, "four five one two three", "s", 0), (7, 5, "", "s", 3)]
EXPECTED = [(1, 1, "Before. ; after", "s", 15), (3, 3, "clean é text", None, 77), (4, 4, None, "s", 5), (5, 5, "é  é", "s", None), (6, None, "four five ", "s", 10), (7, 5, "", "s", 3)]


@pytest.mark.parametrize("block", [1 << 20, 10])
def test_all_columns(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(DOCS, SHAPE)
    bench = spark.createDataFrame([(1, "one two three"), (2, "nothing like this"), (3, "two three")], "item_id long, text string")
    assert len(decontaminate._blocks(bench)) == (1 if block > 10 else 4)
    found = decontaminate.scrub(docs, bench)
    assert found.dtypes == docs.dtypes
    assert Counter(tuple(r) for r in found.collect()) == Counter(EXPECTED)


def test_long_items_and_repeated_items(spark, monkeypatch):
    """A long item is searched in pieces with the same windows, equal rows of one item count once."""
    from tests.llm import brute

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 100)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    words = [f"w{k}" for k in range(101)]
    items = [(1, " ".join(words)), (2, "a b c"), (2, "a b c")] + [(3, " ".join(words[50:61]))] * 200
    docs = [(k, " ".join(words[k : k + 10])) for k in range(95)] + [(100, "x a b c y " + " ".join(words[3:30])), (101, None), (102, " ".join(words) + " a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sum(r.n for r in (b.selectExpr("max(length(text)) as n").first() for b in decontaminate._blocks(bench)) if r.n) < 300 * 40
    found = {r.doc_id: (r.n_words, sum(s.end_word - s.start_word for s in r.spans), r.items) for r in decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    for d, n_words, n_hit, n_items, _, _ in brute.op3(docs, items):
        assert (found[d][0], found[d][1], len(found[d][2])) == (n_words, n_hit, n_items), d
