"""Porter's suffix stripping of 1980, for one word and for a vocabulary column.

A word's shape is one letter per character, ``v`` or ``c``.  The shape of a
prefix is the prefix of the shape, so it is made once per step and the measure
of any stem is the number of ``vc`` in the shape before the suffix.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import Column

#: Suffixes and what replaces them if the stem's measure is above 0.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes that go if the stem's measure is above 1; ``ion`` only after s or t.
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(word: str) -> str:
    """``v`` or ``c`` for each character; y is a vowel only after a consonant, digits are consonants."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _undoubled(word: str, of: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and of[-1] == "c"


def _short(word: str, of: str) -> bool:
    return of.endswith("cvc") and word[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if "vc" in shape(w[:-3]) else w
    for suffix in ("ed", "ing"):
        stem = w.removesuffix(suffix)
        of = shape(stem)
        if stem != w and "v" in of:
            if stem.endswith(("at", "bl", "iz")) or (of.count("vc") == 1 and _short(stem, of) and not _undoubled(stem, of)):
                return stem + "e"
            return stem[:-1] if _undoubled(stem, of) and stem[-1] not in "lsz" else stem
    return w


def _replaced(w: str, rules: dict[str, str]) -> str:
    """The rule of the longest matching suffix, if the stem before it has a measure above 0."""
    for suffix in sorted((s for s in rules if w.endswith(s)), key=len, reverse=True):
        stem = w[: -len(suffix)]
        return stem + rules[suffix] if "vc" in shape(stem) else w
    return w


def _cut(w: str) -> str:
    for suffix in sorted((s for s in STEP_4 if w.endswith(s)), key=len, reverse=True):
        stem = w[: -len(suffix)]
        if suffix == "ion" and not stem.endswith(("s", "t")):
            continue
        return stem if shape(stem).count("vc") > 1 else w
    return w


def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two characters stay."""
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = _cut(_replaced(_replaced(w, STEP_2), STEP_3))
    if w.endswith("e"):
        of = shape(w[:-1])
        if of.count("vc") > 1 or (of.count("vc") == 1 and not _short(w[:-1], of)):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and shape(w).count("vc") > 1 else w


def stem_column(words: Column | str) -> Column:
    """Stems of a column of distinct words; meant for a vocabulary, not for every occurrence."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    return F.pandas_udf(lambda w: w.map(stem, na_action="ignore"), T.StringType(), F.PandasUDFType.SCALAR)(words)
