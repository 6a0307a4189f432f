"""Bytes of text files as strings, with the encoding that was found."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: What a file with a mark begins with. Four bytes are looked at before two, since one mark begins another.
MARKS = {
    b"\x00\x00\xfe\xff": "utf-32",
    b"\xff\xfe\x00\x00": "utf-32",
    b"\xef\xbb\xbf": "utf-8-sig",
    b"\xfe\xff": "utf-16",
    b"\xff\xfe": "utf-16",
}
#: Bytes that are looked at for NULs, the fewest pairs of bytes to judge by, and the shares of NULs that make half of the bytes empty or full.
HEAD, LEAST_PAIRS, EMPTY_HALF, FULL_HALF = 8192, 4, 0.6, 0.1


def encoding_of(data: bytes) -> str | None:
    """By the mark, or by where NULs stand: none is UTF-8, NULs in every second byte UTF-16, all else is binary (None)."""
    for size in (4, 3, 2):
        if data[:size] in MARKS:
            return MARKS[data[:size]]
    nul = np.frombuffer(data[:HEAD], np.uint8) == 0
    if not nul.any():
        return "utf-8"
    first, second = nul[0::2], nul[1::2]
    if len(second) < LEAST_PAIRS:
        return None
    share = {"utf-16-le": (first.mean(), second.mean()), "utf-16-be": (second.mean(), first.mean())}
    return next((name for name, (full, empty) in share.items() if full < FULL_HALF and empty > EMPTY_HALF), None)


def decoded(data: bytes | None) -> tuple[str, str, str]:
    """(text, status, encoding); status is ok, empty (nothing but white space) or binary. What isn't UTF-8 after all is cp1252."""
    data = data or b""
    name = encoding_of(data)
    if name is None:
        return "", "binary", ""
    try:
        text = data.decode(name, "strict" if name == "utf-8" else "replace")
    except UnicodeDecodeError:
        name = "cp1252"
        text = data.decode(name, "replace")
    return text, "ok" if text.strip() else "empty", name


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("text", "status", "encoding")]))
def decode_text(content: pd.Series) -> pd.DataFrame:
    """``decoded`` of each file's bytes, as of the content column of Spark's binary file source; null is empty."""
    return pd.DataFrame([decoded(None if c is None else bytes(c)) for c in content], columns=["text", "status", "encoding"])
