"""The near-duplicate stage against exact Jaccard similarities."""

import random

import pytest

import corpus_pipeline
from fernweave.llm import near_sets
from tests.llm import brute

SHAPE = "doc_id long, text string, row string"


def shingles(text, words=5):
    w = brute.low(text).split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def heads(rows, percent=80):
    """The row kept of each group of linked rows, by plain loops."""
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(sets):
        for j, y in enumerate(sets[:k]):
            if x == y or 100 * len(x & y) >= percent * len(x | y):
                root[find(k)] = find(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    return [[rows[k] for k in g] for g in groups.values()]


def near_copies(rng, n_bases, n_copies, most):
    words = [f"w{k}" for k in range(3000)]
    out = []
    for _ in range(n_bases):
        base = rng.choices(words, k=rng.randint(60, 150))
        for _ in range(n_copies):
            copy = list(base)
            for _ in range(rng.randint(0, most)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((len(out), " ".join(copy), f"r{len(out)}"))
    return out


def kept(spark, rows):
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    found = corpus_pipeline.near_dedup(spark, docs, "")
    assert found.columns == docs.columns
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_reaches_similarity(spark):
    rows = near_copies(random.Random(6), 25, 4, 4)
    expected = sorted((min(g) for g in heads(rows)), key=str)
    assert 25 <= len(expected) < 90
    assert kept(spark, rows) == expected


@pytest.mark.parametrize("edits", [1, 2])
def test_hot_keys(spark, edits, monkeypatch):
    monkeypatch.setattr(near_sets, "HOT", 4)
    rows = near_copies(random.Random(edits), 3, 40, edits)
    assert kept(spark, rows) == sorted((min(g) for g in heads(rows)), key=str)


def test_odd_rows(spark):
    """One row of each group stays, by row and not by doc_id."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(None, a, "1"), (None, b, "2"), (None, a, "3"), (7, c, "4"), (7, b.upper(), "5"), (9, c + " end", "6"), (3, None, "7"), (4, "", "8"), (5, " \n", "9"), (6, "x", "10"), (6, "x", "11"), (8, "x y", "12")]
    found = kept(spark, rows)
    assert len(found) == len(heads(rows))
    names = {r[2] for r in found}
    assert {"4", "5", "7", "12"} <= names and not {"2", "6", "8", "9"} & names
    assert len({"1", "3"} & names) == len({"10", "11"} & names) == 1
    assert kept(spark, []) == []
