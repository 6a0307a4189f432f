"""Path predicates: roots, globs, names, exclusions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .globs import ANY, RUN, Step, any_excluded, steps


def under(path: Column, root: str) -> Column:
    """The root itself or what lies in it; a sibling with a longer name does not."""
    return (path == root) | path.startswith(root + "/")


def under_any(path: Column, roots: list[str]) -> Column:
    out = F.lit(False)
    for root in roots:
        out = out | under(path, root)
    return out


def has_extension(extension: Column, wanted: list[str]) -> Column:
    return extension.isin(sorted({("" if e.startswith(".") else ".") + e.lower() for e in wanted}))


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression, for one pattern alone; * and ? also cross slashes, [..] is a class and [!..] its opposite."""

    def one(step: Step) -> str:
        if step == RUN:
            return ".*"
        if step == ANY:
            return "."
        body = "".join(re.escape(a) if a == b else f"{re.escape(a)}-{re.escape(b)}" for a, b in step.ranges)
        return f"[^{body}]" if step.others else f"[{body}]"

    return "(?s)^" + "".join(map(one, steps(glob))) + "$"


def glob_names(docs: DataFrame, glob: str) -> DataFrame:
    """Documents whose file name matches; in lower case only if nothing matches as it is written."""
    exact = docs.filter(F.col("filename").rlike(glob_pattern(glob)))
    if glob == glob.lower() or not exact.isEmpty():
        return exact
    return docs.filter(F.col("filename").rlike(glob_pattern(glob.lower())))


def name_contains(filename: Column, needle: str) -> Column:
    return F.contains(F.lower(filename), F.lit(needle.lower()))


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a rule excludes the path (see ``globs.exclusions``); case doesn't count, nor how many rules there are."""
    return any_excluded(path, globs)


def longest_root(path: Column, roots: list[str]) -> Column:
    """The longest of the roots that holds the path, or null."""
    return F.coalesce(*(F.when(under(path, r), F.lit(r)) for r in sorted(roots, key=len, reverse=True)))
