"""Column functions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(query: Column) -> Column:
    """Words of a query, split at white space of any script, without empty ones; null has none."""
    return F.filter(F.coalesce(F.split(query, r"(?U)\s+"), F.array()), lambda w: w != "")


def has_any(text: Column, words: Column) -> Column:
    """Whether the text contains one of the words, anywhere and in the same case; without words, false."""
    return F.coalesce(F.exists(words, lambda w: F.coalesce(F.contains(text, w), F.lit(False))), F.lit(False))


def fixed(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", x)


def cut(message: Column, length: int = 40) -> Column:
    return F.substring(message, 1, length)


def unit(v: Column) -> Column:
    """The vector at length one; the zero vector stays as it is. Vector and length are bound once, as a lambda works out for each element what it names."""
    length = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bound = F.transform(F.array(v), lambda w: F.struct(w.alias("v"), length(w).alias("n")))
    return F.get(F.transform(bound, lambda b: F.transform(b["v"], lambda x: F.coalesce(F.try_divide(x.cast("double"), b["n"]), F.lit(0.0)))), F.lit(0))
