"""Text forms: cleaning, rebuilding and splitting."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def rebuild(gloss: Column, after: Column) -> Column:
    """Words and what stood after them, joined back."""
    return F.trim(F.array_join(F.zip_with(gloss, after, lambda g, a: F.concat(g, a)), ""))


# Corpus marks and what they become.
CORPUS_MARKS = [("<special7>", "<s>"), ("<special8>", "</s>"), ("<special9>", "<unk>")]


def undo_pieces(line: Column) -> Column:
    """Join sub-words (``@@ ``) and rename the corpus marks."""
    text = F.trim(F.replace(line, F.lit("@@ "), F.lit("")))
    for old, new in CORPUS_MARKS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# Spaces removed before marks and clitics, in this order.
CLEANUPS = [
    (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"),
    (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"),
]


def clean_spaces(text: Column) -> Column:
    for old, new in CLEANUPS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def fill_slots(pattern: Column, slots: Column) -> Column:
    """Replace every slot of a map in a text, longer slot names first."""
    order = F.array_sort(
        F.map_entries(slots), lambda a, b: F.when(F.length(a.key) > F.length(b.key), -1).when(F.length(a.key) < F.length(b.key), 1).otherwise(0)
    )
    return F.aggregate(order, pattern, lambda t, e: F.replace(t, e.key, e.value))


def fill_sql(pattern: Column, slots: Column) -> Column:
    """A template as SQL: FROM mark removed, column names as one word (``_=_`` for spaces)."""
    joined = F.transform_values(slots, lambda k, v: F.when(F.contains(k, F.lit("COLUMN")), F.replace(v, F.lit(" "), F.lit("_=_"))).otherwise(v))
    return fill_slots(F.replace(pattern, F.lit(" {FROM}"), F.lit("")), joined)


def keep_marks(text: Column, marks: list[str]) -> Column:
    """Split a text around special marks; the marks stay as tokens."""
    found = "(" + "|".join("\\Q" + m + "\\E" for m in marks) + ")"
    parts = F.split(F.regexp_replace(text, found, "\u0001$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFD", s))


def basic_tokens(text: Column, lower: bool = True) -> Column:
    """Cleaned words: control characters dropped, white space unified, CJK letters apart,
    accents removed in lower case, punctuation apart."""
    clean = F.regexp_replace(text, r"[\u0000�]|[\p{Cc}\p{Cf}\p{Co}\p{Cs}&&[^\t\n\r]]", "")
    clean = F.regexp_replace(clean, r"[\p{Zs}\t\n\r]", " ")
    clean = F.regexp_replace(clean, r"([一-鿿㐀-䶿豈-﫿\x{20000}-\x{2CEAF}\x{2F800}-\x{2FA1F}])", " $1 ")
    if lower:
        clean = F.regexp_replace(_decomposed(F.lower(clean)), r"\p{Mn}+", "")
    apart = F.regexp_replace(clean, r"([\p{P}$+<=>^`|~])", " $1 ")
    return F.filter(F.split(apart, r"\s+"), lambda w: w != "")
