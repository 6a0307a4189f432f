"""Operator 4's encoder: pieces of a batch given to the library once, and counts that come with the ids."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fernweave.llm import token_store

TEXTS = ["Word word, WORD!! word's 'word' don't!'s a1b22 x_y", "Éte été, ŉ İstanbul ǅ J̌ ß ªº éÉ. 日本語 😀!", "<|endoftext|> a<|ENDOFTEXT|>b <|x|> </w> w</w>w", "", None, "tab\tand\nline \x01\x02 \x85 end  ", "naïve café ­soft (word) [word] word... word"]


@pytest.mark.parametrize("memo", [3, 450_000])
def test_as_the_library(memo):
    code, asked = token_store.WordEncoder(token_store.default_path(), memo), Counter()
    given = code._pieces
    code._pieces = lambda pieces: asked.update(pieces) or given(pieces)
    for texts in (TEXTS, TEXTS[::-1], TEXTS[:2]):
        ids, sizes = code.encode(pa.array(texts, pa.string()))
        expected = [code.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == list(map(len, expected)) and ids.tolist() == [i for x in expected for i in x]
    assert asked["word"] and (memo == 3 or set(asked.values()) == {1})


def test_tally(spark):
    rows = token_store.encode(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2), token_store.default_path(), 1)
    found = {r["id"]: r["n"] for r in token_store._counts(rows).collect()}
    assert found == Counter(i for r in rows.collect() for i in np.frombuffer(r["ids"], "<u2").tolist())
    assert rows.selectExpr("bool_and(sum = crc32(ids))").first()[0]


def test_batches_are_let_go():
    code, held = token_store.WordEncoder(token_store.default_path()), []
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["word " * 2_000] * 50)], ["doc_id", "text"])
    tracemalloc.start()
    for _ in range(12):
        size = token_store.coded_batch(code, batch, 1).column("ids").nbytes
        held.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert size > 200_000 and held[-1] - held[1] < size


def test_long_parts_are_not_kept():
    code = token_store.WordEncoder(token_store.default_path())
    for text in ("x" * 5_000, "日本語" * 5_000, "a-b" * 5_000 + " word"):
        ids, _ = code.encode(pa.array([text]))
        assert ids.tolist() == code.whole.encode(text, add_special_tokens=False).ids
    assert "word" in code.by_part and max(map(len, code.by_part)) <= token_store.KEPT_CHARS


def test_full_memo_takes_what_comes_again():
    code = token_store.WordEncoder(token_store.default_path(), 4)
    for text, held in (("one two three", True), ("four five six", True), ("seven", False), ("seven", True), ("eight", False)):
        ids, _ = code.encode(pa.array([text]))
        assert ids.tolist() == code.whole.encode(text, add_special_tokens=False).ids
        assert (text.split()[-1] in code.by_part) == held
