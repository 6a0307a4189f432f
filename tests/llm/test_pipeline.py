"""The pipeline's stages and their chain against a pipeline of plain loops."""

from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from fernweave.llm import langid
from fernweave.llm.common import cut
from tests.llm import brute
from tests.llm.test_near_sets import heads

SMALL = "/root/testdata/sf0.001"


def plain_scrub(text, windows):
    """The text without the benchmark's passages; None if no word is left of one that had hits."""
    found = list(brute.WORD.finditer(brute.low(text)))
    words, hit = [m[0] for m in found], [False] * len(found)
    for n in {len(w) for w in windows}:
        for a in range(len(words) - n + 1):
            if tuple(words[a : a + n]) in windows:
                hit[a : a + n] = [True] * n
    out, at = [], 0
    for k, m in enumerate(found):
        if hit[k]:
            if not k or not hit[k - 1]:
                out.append(text[at : m.start()])
            at = m.end()
    return None if hit and all(hit) else "".join([*out, (text or "")[at:]]) if any(hit) else text


@pytest.mark.parametrize("which", ["small", "odd"])
def test_run(spark, odd, which):
    folder = SMALL if which == "small" else odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    expected = rows(docs)
    refused = langid.predict(pa.array([t for _, t in expected], pa.string()), langid.train(docs))[2]
    expected = [r for r, x in zip(expected, refused) if not x]
    stages, read = dict(corpus_pipeline.STAGES), docs
    read = cut(stages["language_id"](spark, read, folder))
    assert expected and Counter(rows(read)) == Counter(expected) and read.columns == docs.columns

    judged = [(d, n, sha) for d, _, n, sha in brute.op6(expected)]
    before = expected
    read = cut(stages["line_dedup"](spark, read, folder))
    texts = Counter((d, brute.sha(t or "")) for d, t in rows(read))
    blank = {brute.sha(" " * a + "\n" * b) for a in range(4) for b in range(60)}
    assert texts == Counter((d, sha) for d, n, sha in judged if not n or sha not in blank) and read.columns == docs.columns
    expected = rows(read)
    assert len(expected) <= len(before)

    groups = heads([(d, t, "") for d, t in expected])
    read = cut(stages["simhash_near_dedup"](spark, read, folder))
    expected = [min(g, key=lambda r: (r[0] is None, r[0] or 0))[:2] for g in groups]
    assert Counter(rows(read)) == Counter(expected) and read.columns == docs.columns

    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = brute.WORD.findall(brute.low(r.text))
        windows |= {tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9) if w else 0)}
    read = cut(stages["decontamination"](spark, read, folder))
    expected = [(d, x) for d, t in expected if (x := plain_scrub(t, windows)) is not None or t is None]
    assert Counter(rows(read)) == Counter(expected) and read.columns == docs.columns

    tokens = Counter((r.doc_id, r.n_tokens, brute.sha(",".join(map(str, r.token_ids)))) for r in corpus_pipeline.run(spark, folder).collect())
    assert tokens == Counter(r[:3] for r in brute.op1(expected))


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
