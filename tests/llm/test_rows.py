"""Line dedup of rows whose ids are null or repeated."""

import random
from collections import Counter

import pytest

from fernweave.llm import line_dedup
from tests.llm import brute

SHAPE = "doc_id long, text string, source string"
SHARED = "one two three four five six seven eight nine ten"


def found(spark, rows):
    return line_dedup.dedup_lines(spark.createDataFrame(rows, SHAPE).repartition(3)).collect()


@pytest.mark.parametrize("bins", [1 << 18, 1])
def test_null_and_repeated_ids(spark, bins, monkeypatch):
    """With one bin every row counts as repeated."""
    monkeypatch.setattr(line_dedup, "AGAIN_BINS", bins)
    rows = [(1, "dup line", "a"), (None, "dup line\nstays 1", "b"), (None, "unique line\nstays 2", "c"), (5, "dup line\nstays 3", "d"), (5, "other line\nstays 4", "e"), (None, SHARED + "\ndup line", "f"), (None, None, "g"), (None, None, "h"), (6, "", "i")]
    got = {r.source: (r.text, r.n_lines, r.n_removed) for r in found(spark, rows)}
    assert got == {"a": ("dup line", 1, 0), "b": ("stays 1", 2, 1), "c": ("unique line\nstays 2", 2, 0), "d": ("stays 3", 2, 1), "e": ("other line\nstays 4", 2, 0), "f": (SHARED, 2, 1), "g": (None, 0, 0), "h": (None, 0, 0), "i": ("", 0, 0)}


def test_equal_lines_at_the_same_number(spark):
    """A line of several rows of one id stays in one of them, and so does the text of equal rows."""
    rows = [(None, "equal line\nx", "a"), (None, "equal line\ny", "b"), (3, SHARED + "\n\np", "c"), (3, SHARED + "\n\np", "d"), (3, SHARED.replace("two", "2") + "\nq", "e"), (None, " equal  LINE\nz", "f")]
    lines = Counter(tuple(brute.low(x).split()) for r in found(spark, rows) for x in r.text.split("\n"))
    assert lines["equal", "line"] == 1 and all(lines[x,] == 1 for x in "xyzpq") and lines[()] == 2
    assert lines[tuple(SHARED.split())] + lines[tuple(SHARED.replace("two", "2").split())] == 1


def test_as_distinct_ids(spark):
    """Rows without ids lose as many lines as rows with ids do, whatever their order."""
    rng = random.Random(8)
    rows = [(None, "\n".join(rng.choice(["short a", "short b", SHARED, f"own {k} {j}"]) for j in range(4)), str(k)) for k in range(40)]
    assert sum(r.n_removed for r in found(spark, rows)) == sum(n for _, _, n, _ in brute.op6([(k, t) for k, (_, t, _) in enumerate(rows)]))
