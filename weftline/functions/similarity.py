"""Similarity of two columns, in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phonetic
from .text import soundex_simple, tokens


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exact(a, b) -> Column:
    return F.when(_c(a) == _c(b), 1.0).otherwise(0.0)


def levenshtein(a, b, both_empty: float = 1.0) -> Column:
    """1 - distance / longer length."""
    a, b = _c(a), _c(b)
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n > 0, F.lit(1.0) - F.levenshtein(a, b) / n).otherwise(both_empty)


def _set_ratio(x: Column, y: Column, both_empty: float) -> Column:
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(both_empty)


def jaccard(a, b) -> Column:
    """Of sets of words between white space; 1 where both are empty."""
    words = lambda c: F.filter(F.array_distinct(F.split(_c(c), r"\s+")), lambda t: t != "")
    return _set_ratio(words(a), words(b), 1.0)


def _grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda i: F.substring(c, i, F.lit(n)))))


def ngram_jaccard(a, b, n: int = 3) -> Column:
    """Of character n-grams of lower-case, trimmed values; 1 where equal, 0 where one is shorter than n."""
    x, y = F.lower(F.trim(_c(a))), F.lower(F.trim(_c(b)))
    return F.when(x == y, 1.0).when((F.length(x) < n) | (F.length(y) < n), 0.0).otherwise(_set_ratio(_grams(x, n), _grams(y, n), 0.0))


def overlap(a, b) -> Column:
    """Shared tokens over the smaller set's, without stop words; 0 where one is empty."""
    x, y = tokens(a), tokens(b)
    n = F.least(F.size(x), F.size(y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


def phonetic_equal(a, b) -> Column:
    return F.when(soundex_simple(a) == soundex_simple(b), 1.0).otherwise(0.0)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """0 where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def jaro_winkler(a, b) -> Column:
    return phonetic.column_functions()["jaro_winkler"](_c(a), _c(b))


def sequence_ratio(a, b) -> Column:
    return phonetic.column_functions()["sequence_ratio"](_c(a), _c(b))


#: By the name that configurations use. A callable of two columns may stand instead of a name.
ALGORITHMS = {
    "exact": exact, "levenshtein": levenshtein, "jaccard": jaccard, "ngram": ngram_jaccard, "overlap": overlap, "phonetic": phonetic_equal, "cosine": cosine,
    "jaro_winkler": jaro_winkler, "sequence_ratio": sequence_ratio,
}


def algorithm(name):
    if callable(name):
        return name
    if name not in ALGORITHMS:
        raise ValueError(f"unknown similarity {name!r}; known: {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[name]
