"""Per-document text statistics and the structural profile of a text.

Besides basic counts, each text has two distributions: its words over classes
of function words, and its characters over character classes.  Both are
compared by Jensen-Shannon divergence with profiles of prose, lists, tables and
junk; the nearest profile names the structure.  Everything is built from column
expressions, so a scan of the text column is the whole plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English function words by class.
FUNCTION_WORDS = {
    "article": "the a an",
    "preposition": "of in to for on at by from into over near after before between under through without against during since about than as",
    "coordinator": "and or with",
    "conjunction": "but nor so yet if then although while because where when though however whereas unless until that which who what how",
    "auxiliary": "is are was were be been being am has have had do does did will would can could shall should may might must not no",
    "pronoun": "it its their they them he she his her we our us you your i my me this these those each some any both neither others other all most more many there one such",
}
WORD_CLASSES = [*FUNCTION_WORDS, "number", "code", "other_word"]
#: Character classes as Java patterns; what none of them holds is a symbol.
CHAR_PATTERNS = {"letter": r"\p{L}", "digit": r"\p{Nd}", "space": r"[  ]", "line_break": r"[\r\n]", "stop": r"[.,;:!?'\"()]", "rule": r"[-–—|\t=/\[\]<>•*·»\\_#]"}
CHAR_CLASSES = [*CHAR_PATTERNS, "symbol"]
COMMON = [w for c in FUNCTION_WORDS.values() for w in c.split()]


def _any_of(words: list[str]) -> str:
    """A pattern of the words that tests one letter at a time, not one word after the other."""
    ends = "" in words
    firsts = sorted({w[0] for w in words if w})
    branches = [c + _any_of([w[1:] for w in words if w[:1] == c]) for c in firsts]
    if not branches:
        return ""
    return f"(?:{'|'.join(branches)}){'?' if ends else ''}" if len(branches) > 1 or ends else branches[0]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).when(whole.isNotNull(), F.lit(0.0))


def _evaluated(df: DataFrame, *columns: Column) -> DataFrame:
    """``id`` and ``columns``, computed once per row.

    A plain select would be merged with what follows, and every later mention
    of a column would run its patterns again; a generator is not merged.
    """
    return df.select("id", F.explode(F.array(F.struct(*columns))).alias("all")).select("id", "all.*")


def text_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``df``: id, counts and shares of its text.

    ``n_chars``, ``n_words`` (runs of letters and digits), ``mean_word_length``,
    ``symbol_ratio`` (characters that are neither letter, digit nor white space),
    ``n_lines`` (lines that are not blank), ``end_punctuation_ratio`` (of those,
    lines ending in . ! or ?), ``common_word_ratio`` (function words among the
    words), and the shares ``w_*`` of word classes and ``c_*`` of character
    classes.  A null text has null statistics; an empty or blank one has zeros.
    """
    text, low, rest, known = F.col("text"), F.lower("text"), F.col("rest"), F.col("known")
    count = lambda pattern, of: F.regexp_count(of, F.lit(pattern))
    kept = lambda of, pattern: F.length(F.regexp_replace(of, f"[^{pattern}]+", ""))
    member = lambda ws: lambda w: w.isin(ws)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Whole texts are passed over once per pattern here ...
    passed = _evaluated(
        rows,
        F.length(text).alias("n_chars"),
        F.regexp_replace(text, r"\p{L}+", "").alias("rest"),
        F.regexp_extract_all(low, F.lit(rf"\b{_any_of(COMMON)}\b"), F.lit(0)).alias("known"),
        count(r"[\p{L}\p{N}]+", text).alias("n_words"),
        count(r"\p{N}[\p{L}\p{N}]*+", text).alias("with_number"),
        count(r"\p{N}(?<![\p{L}\p{N}]\p{N})\p{N}*+(?![\p{L}\p{N}])", text).alias("w_number"),
        count(r"(?m)^[^\r\n]*\S[^\r\n]*$", text).alias("n_lines"),
        count(r"(?m)[.!?][ \t]*$", text).alias("ended"),
    )
    # ... the rest works on what letters leave over, and on the function words found.
    letters = F.col("n_chars") - F.length(rest)
    counted = _evaluated(
        passed,
        *(F.col(c) for c in ("n_chars", "n_words", "n_lines", "ended", "w_number")),
        (letters + kept(rest, r"\p{N}")).alias("in_words"),
        F.length(F.regexp_replace(rest, r"[\p{N}\s]+", "")).alias("symbols"),
        letters.alias("c_letter"),
        *(kept(rest, p).alias(f"c_{c}") for c, p in CHAR_PATTERNS.items() if c != "letter"),
        *(F.size(F.filter(known, member(ws.split()))).alias(f"w_{c}") for c, ws in FUNCTION_WORDS.items()),
        (F.col("with_number") - F.col("w_number")).alias("w_code"),
    )
    words = [*FUNCTION_WORDS, "number", "code"]
    chars, total = F.col("n_chars"), F.col("n_words")
    named = sum((F.col(f"c_{c}") for c in CHAR_PATTERNS), F.lit(0))
    known = sum((F.col(f"w_{c}") for c in words), F.lit(0))
    common = sum((F.col(f"w_{c}") for c in FUNCTION_WORDS), F.lit(0))
    shares = _evaluated(
        counted,
        F.col("n_chars"),
        F.col("n_words"),
        _share(F.col("in_words"), total).alias("mean_word_length"),
        _share(F.col("symbols"), chars).alias("symbol_ratio"),
        F.col("n_lines"),
        F.when(F.col("n_lines").isNotNull(), F.least(_share(F.col("ended"), F.col("n_lines")), F.lit(1.0))).alias("end_punctuation_ratio"),
        _share(common, total).alias("common_word_ratio"),
        *(_share(F.col(f"w_{c}"), total).alias(f"w_{c}") for c in words),
        _share(F.greatest(total - known, F.lit(0)), total).alias("w_other_word"),
        *(_share(F.col(f"c_{c}"), chars).alias(f"c_{c}") for c in CHAR_PATTERNS),
        _share(F.greatest(chars - named, F.lit(0)), chars).alias("c_symbol"),
    )
    return shares.withColumnRenamed("id", id_col)


#: Shares of word and character classes of typical texts of each structure.
PROFILES = [
    ("prose", {"article": 0.12, "preposition": 0.105, "coordinator": 0.04, "conjunction": 0.045, "auxiliary": 0.09, "pronoun": 0.065, "number": 0.025, "code": 0.005, "other_word": 0.505}, {"letter": 0.80, "digit": 0.015, "space": 0.16, "line_break": 0.003, "stop": 0.02, "rule": 0.001, "symbol": 0.001}),
    ("prose", {"article": 0.10, "preposition": 0.08, "coordinator": 0.025, "conjunction": 0.025, "auxiliary": 0.06, "pronoun": 0.04, "number": 0.03, "code": 0.06, "other_word": 0.58}, {"letter": 0.79, "digit": 0.03, "space": 0.15, "line_break": 0.003, "stop": 0.02, "rule": 0.003, "symbol": 0.004}),
    ("prose", {"article": 0.06, "preposition": 0.14, "coordinator": 0.07, "conjunction": 0.01, "auxiliary": 0.02, "pronoun": 0.03, "number": 0.08, "other_word": 0.59}, {"letter": 0.80, "digit": 0.035, "space": 0.145, "stop": 0.018}),
    ("prose", {"article": 0.14, "preposition": 0.08, "coordinator": 0.02, "conjunction": 0.01, "auxiliary": 0.04, "pronoun": 0.02, "number": 0.02, "other_word": 0.67}, {"letter": 0.82, "digit": 0.01, "space": 0.15, "stop": 0.015}),
    ("list", {"article": 0.005, "preposition": 0.005, "other_word": 0.99}, {"letter": 0.85, "digit": 0.0, "space": 0.09, "line_break": 0.035, "stop": 0.01, "rule": 0.015}),
    ("list", {"article": 0.015, "preposition": 0.015, "coordinator": 0.085, "auxiliary": 0.01, "pronoun": 0.005, "number": 0.03, "other_word": 0.84}, {"letter": 0.78, "digit": 0.015, "space": 0.12, "line_break": 0.03, "stop": 0.025, "rule": 0.03}),
    ("list", {"article": 0.01, "preposition": 0.01, "coordinator": 0.02, "number": 0.33, "other_word": 0.63}, {"letter": 0.62, "digit": 0.09, "space": 0.09, "line_break": 0.03, "stop": 0.14, "rule": 0.03}),
    ("table", {"article": 0.01, "number": 0.62, "other_word": 0.37}, {"letter": 0.24, "digit": 0.12, "space": 0.60, "line_break": 0.02, "stop": 0.02}),
    ("table", {"article": 0.01, "number": 0.67, "other_word": 0.32}, {"letter": 0.40, "digit": 0.26, "space": 0.06, "line_break": 0.03, "stop": 0.18, "rule": 0.07}),
    ("junk", {"other_word": 1.0}, {"letter": 0.05, "space": 0.05, "stop": 0.08, "rule": 0.42, "symbol": 0.40}),
    ("junk", {"code": 1.0}, {"letter": 0.70, "digit": 0.26, "space": 0.04}),
    ("junk", {"number": 1.0}, {"digit": 0.58, "space": 0.23, "stop": 0.09, "rule": 0.05, "symbol": 0.05}),
    ("junk", {"article": 0.01, "preposition": 0.01, "other_word": 0.98}, {"letter": 0.70, "space": 0.10, "line_break": 0.01, "stop": 0.02, "rule": 0.16, "symbol": 0.01}),
    ("junk", {"article": 0.06, "preposition": 0.05, "coordinator": 0.02, "conjunction": 0.02, "auxiliary": 0.04, "pronoun": 0.03, "number": 0.38, "code": 0.05, "other_word": 0.35}, {"letter": 0.47, "digit": 0.13, "space": 0.04, "line_break": 0.01, "stop": 0.02, "rule": 0.19, "symbol": 0.14}),
    ("junk", {"number": 0.45, "code": 0.10, "other_word": 0.45}, {"letter": 0.50, "digit": 0.27, "space": 0.06, "line_break": 0.02, "stop": 0.07, "rule": 0.08}),
]


def _divergence(shares: Column, profile: Column) -> Column:
    """Jensen-Shannon divergence in bits between two arrays of shares of the same classes."""

    def part(p: Column, q: Column) -> Column:
        mid = (p + q) / 2
        return (F.when(p > 0, p * F.log2(p / mid)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / mid)).otherwise(0.0)) / 2

    return F.aggregate(F.zip_with(shares, profile, part), F.lit(0.0), lambda total, x: total + x)


def _literal(shares: dict[str, float], classes: list[str]) -> Column:
    total = sum(shares.values())
    return F.array(*(F.lit(shares.get(c, 0.0) / total) for c in classes))


def text_structure(df: DataFrame, id_col: str, text_col: str, profiles: list = PROFILES) -> DataFrame:
    """``text_statistics`` with ``divergence`` and ``structure``.

    ``structure`` is the kind of the nearest of ``profiles``, by the sum of the
    divergences of words and characters: prose, list, table or junk.  Null for
    null, empty and blank texts.  A text without words is compared by its
    characters alone.
    """
    stats = text_statistics(df, id_col, text_col)
    some = (F.col("n_chars") > 0) & ((F.col("n_words") > 0) | (F.col("symbol_ratio") > 0))
    known = F.array(*(F.struct(F.lit(kind).alias("kind"), _literal(words, WORD_CLASSES).alias("words"), _literal(chars, CHAR_CLASSES).alias("chars")) for kind, words, chars in profiles))
    words, chars = F.array(*(f"w_{c}" for c in WORD_CLASSES)), F.array(*(f"c_{c}" for c in CHAR_CLASSES))

    def far(p: Column) -> Column:
        by_words = F.when(F.col("n_words") > 0, _divergence(words, p["words"])).otherwise(0.0)
        return F.struct((by_words + _divergence(chars, p["chars"])).alias("divergence"), p["kind"].alias("structure"))

    named = [c for c in stats.columns if c != id_col]
    best = _evaluated(stats.withColumnRenamed(id_col, "id"), *(F.col(c) for c in named), F.when(some, F.array_min(F.transform(known, far))).alias("near"))
    return best.select(F.col("id").alias(id_col), *named, F.col("near.divergence").alias("divergence"), F.col("near.structure").alias("structure"))


def unlike_prose(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids of records whose text is in the main a list, a table or junk; each once.

    A record in several rows is one case if any of its rows is.  Null ids, and
    null, empty and blank texts, are no case.
    """
    rows = text_structure(df.where(F.col(id_col).isNotNull()), id_col, text_col)
    return rows.where(F.col("structure").isNotNull() & (F.col("structure") != "prose")).select(id_col).distinct()
