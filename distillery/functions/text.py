"""Column helpers over text: normalising, counting and the words of a string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
#: A numbered or bulleted line.
LIST_ITEM = r"^(\d+\.\s|[*-]\s)"
#: A sentence ends after . ! or ? where white space and a capital follow.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def estimate_tokens(c: Column, tokenizer=None) -> Column:
    """A quarter of the characters, rounded up, or what a tokenizer counts (a function of a column, say a pandas UDF); nothing for blank text."""
    n = tokenizer(c) if tokenizer else F.greatest(F.lit(1), F.ceil(F.length(c) / 4))
    return F.when(strip(c) == "", F.lit(0)).otherwise(n).cast("int")


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)))


def word_tokens(c: Column) -> Column:
    """Words by white space, at 1.3 tokens a word."""
    return word_count(c) * F.lit(1.3)


def words(c: Column) -> Column:
    """Lower-case words in order, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def is_list_item(c: Column) -> Column:
    return c.rlike(LIST_ITEM)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(c: Column, digits: int) -> Column:
    """Rounded as SQL engines do it, on the number times a power of ten, halves away from zero; what is below zero keeps its sign as -0."""
    scaled = c.cast("double") * float(10**digits)
    return F.round(F.abs(scaled)) * F.signum(scaled) / float(10**digits)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct words; none where either is empty."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(both == 0, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def more_alike_than(a: Column, b: Column, limit: float) -> Column:
    """Whether jaccard(a, b) > limit; sizes that rule it out are looked at first."""
    fits = F.least(F.size(a), F.size(b)) > F.greatest(F.size(a), F.size(b)) * limit
    return F.when(fits, jaccard(a, b) > limit).otherwise(F.lit(False))


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of distinct words, each word a dimension; 0 where either is empty, null where either is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).when(a.isNotNull() & b.isNotNull(), both / F.sqrt(F.size(a).cast("double") * F.size(b)))


def dot(x: Column, y: Column) -> Column:
    """Of two numeric arrays, summed in double precision."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays, summed in double precision; null where either is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
