"""Column functions on text: tokens, shingles, character grams, set similarity, edit ratio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word class is letters, numbers and underscore in any script.
WORD = r"[\p{L}\p{N}_]+"
INDEX_WORD = r"[\p{L}\p{N}_]{2,}"
# The default stop words.
STOP_WORDS = "و در به از که این را با برای آن یک تا هم می او اگر اما یا چه من تو ما".split()


def tokens(text: Column, pattern: str = WORD) -> Column:
    """Lower-case words in order; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def without_stop_words(words: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words that are not stop words, repeats and order kept."""
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def normalize_persian(text: Column) -> Column:
    """Arabic forms of ye and kaf and Arabic digits to Persian ones; runs of white space to one space."""
    return F.trim(F.regexp_replace(F.translate(text, "يك٠١٢٣٤٥٦٧٨٩", "یک۰۱۲۳۴۵۶۷۸۹"), r"[\s\p{Z}]+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")


def word_grams(words: Column, k: int, joiner: str = " ") -> Column:
    """Runs of k words in a row; empty with fewer than k words."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), joiner))).otherwise(F.array().cast("array<string>"))


def char_grams(text: Column, k: int = 3) -> Column:
    """Distinct runs of k characters; empty with fewer than k characters."""
    return F.when(F.char_length(text) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def lcs_length(text: Column, other: str) -> Column:
    """Length of the longest common subsequence with a literal, by the row recurrence on arrays."""
    m = len(other)
    if not m:
        return F.when(text.isNotNull(), F.lit(0))
    target = F.lit(list(other))

    def row(before: Column, c: Column) -> Column:
        # next[j] = before[j-1] + 1 on a match, else the greater of before[j] and next[j-1]
        step = lambda made, j: F.concat(made, F.array(F.when(F.element_at(target, j) == c, F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(before, j + 1), F.element_at(made, -1)))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(m)), F.array(F.lit(0)), step)

    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.element_at(F.aggregate(letters, F.array_repeat(F.lit(0), m + 1), row), -1)


def indel_ratio(text: Column, other: str) -> Column:
    """2 * LCS over the sum of lengths; 1 for two empty strings."""
    return F.coalesce(F.try_divide(2.0 * lcs_length(text, other), F.char_length(text) + len(other)), F.when(text.isNotNull(), 1.0))
