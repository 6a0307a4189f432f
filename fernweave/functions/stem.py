"""Words as an index holds them: lower case, without accents, stemmed by Porter's published algorithm."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

WORD = re.compile(r"[^\W_]+")
#: Words of fewer or more bytes stay as they are.
SHORTEST, LONGEST = 3, 64
#: Bytes of texts whose words are in Python at once, and the kind of what is made of them.
AT_ONCE, LISTS = 2_000_000, pa.list_(pa.string())

#: Fixed values of the published algorithm: endings and what takes their place, by step.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")
_ENDINGS = {id(endings): tuple(endings) for endings in (STEP_2, STEP_3, STEP_4)}


_KINDS = "".join("v" if ch in "aeiou" else "y" if ch == "y" else "c" for ch in map(chr, range(256)))


def shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel behind a consonant."""
    kinds = word.translate(_KINDS)
    if "y" not in kinds:
        return kinds
    out = ""
    for kind in kinds:
        out += ("v" if out.endswith("c") else "c") if kind == "y" else kind
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def _short_end(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, endings: dict[str, str], least: int) -> str:
    """The word with its longest listed ending exchanged, if the rest has at least the measure."""
    if not word.endswith(_ENDINGS[id(endings)]):
        return word
    for size in range(min(7, len(word)), 1, -1):
        ending = word[-size:]
        if ending in endings:
            rest = word[:-size]
            fits = measure(rest) >= least and (ending != "ion" or rest.endswith(("s", "t")))
            return rest + endings[ending] if fits else word
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    for ending in ("ed", "ing"):
        rest = word.removesuffix(ending)
        if rest != word:
            if "v" not in shape(rest):
                return word
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if len(rest) > 1 and rest[-1] == rest[-2] and shape(rest)[-1] == "c" and rest[-1] not in "lsz":
                return rest[:-1]
            return rest + "e" if measure(rest) == 1 and _short_end(rest) else rest
    return word


@lru_cache(maxsize=250_000)
def stem(word: str) -> str:
    """The word's stem. Bytes count: each one of a letter outside ASCII is a consonant."""
    raw = word.encode()
    return _stem(raw.decode("latin-1")).encode("latin-1").decode(errors="ignore") if SHORTEST <= len(raw) <= LONGEST else word


def _stem(word: str) -> str:
    if word[1:].endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _past(word)
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for endings, least in ((STEP_2, 1), (STEP_3, 1), (STEP_4, 2)):
        word = _swap(word, endings, least)
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


class _Plain(dict):
    """Each character without its marks, made when first met; ``odd`` are those whose order among others matters."""

    odd: set[str] = set()

    def __missing__(self, code: int) -> str:
        kept = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if any(map(unicodedata.combining, kept)):
            self.odd.add(chr(code))
        self[code] = "".join(kept)
        return self[code]


_PLAIN = _Plain()


def folded(text: str) -> str:
    """Lower case, accents taken off their letters."""
    low = text.lower()
    if low.isascii():
        return low
    plain = low.translate(_PLAIN)
    if not _PLAIN.odd.isdisjoint(low):
        plain = "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", plain)


def words_of(text: str | None) -> list[str]:
    return stemmed_lists(pa.array([text], pa.string()))[0].as_py()


def _found(texts: pa.Array) -> pa.Array:
    """The folded words of some texts as lists; those of ASCII texts are cut by Arrow."""
    texts = texts.fill_null("")
    ascii = pc.string_is_ascii(texts)
    plain = pc.split_pattern_regex(pc.ascii_lower(texts.filter(ascii)), "[^a-z0-9]+")
    other = pa.array([WORD.findall(folded(t)) for t in texts.filter(pc.invert(ascii)).to_pylist()], LISTS)
    order = np.argsort(np.argsort(~ascii.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    return pa.concat_arrays([plain.cast(LISTS), other]).take(pa.array(order))


def _stemmed(texts: pa.Array) -> pa.Array:
    """The stemmed words of some texts as lists; each distinct word of them is stemmed once."""
    found = _found(texts)
    words = found.flatten()
    full = np.asarray(pc.not_equal(words, ""))  # there is an empty one where a text begins or ends with another character
    ends = np.append(0, np.cumsum(full))[found.offsets.to_numpy() - found.offsets[0].as_py()]
    words = words.filter(pa.array(full)).dictionary_encode()
    stems = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stems.take(words.indices))


def stemmed_lists(texts: pa.Array) -> pa.Array:
    """The stemmed words of each text, in order, as lists; none for null. Some texts at a time are cut into words."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // AT_ONCE
    begins = np.flatnonzero(np.diff(part, prepend=-1, append=part[-1] + 1 if len(part) else 0))
    parts = [_stemmed(texts.slice(a, b - a)) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    return pa.concat_arrays(parts) if parts else pa.array([], LISTS)


@F.arrow_udf(ArrayType(StringType()))
def index_words(text: pa.Array) -> pa.Array:
    """The stemmed words of each text, in order; none for null."""
    return stemmed_lists(text)


@F.arrow_udf(IntegerType())
def _n_other(text: pa.Array) -> pa.Array:
    return pa.array([len(WORD.findall(folded(x.as_py() or ""))) for x in text], pa.int32())


def n_words(text: Column) -> Column:
    """How many words a text has; none is stemmed, and only texts beyond ASCII go to Python."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.regexp_count(text, F.lit("[A-Za-z0-9]+"))).otherwise(_n_other(F.when(~plain, text)))


#: What an index may call besides: the words of an Arrow array, and their number.
index_words.of_arrow, index_words.number = stemmed_lists, n_words
