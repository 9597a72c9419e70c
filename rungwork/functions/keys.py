"""Canonical spellings of keys and terms, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s ]+"


def squeeze(c: Column) -> Column:
    """White space squeezed to single blanks and trimmed; NULL stays NULL."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def canonical_key(c: Column) -> Column:
    """Lower case with white space trimmed and squeezed; blank becomes NULL."""
    return F.nullif(F.lower(squeeze(c)), F.lit(""))


def topic_path(term: Column) -> Column:
    """``a -- b`` as the array of its non-empty, squeezed parts."""
    return F.filter(F.transform(F.split(term, "--"), squeeze), lambda p: p != "")


def canonical_term(term: Column) -> Column:
    """Parts of a topic term squeezed and joined by `` -- ``; a term without parts becomes NULL."""
    return F.nullif(F.array_join(topic_path(term), " -- "), F.lit(""))


def distinct_keys(values: Column) -> Column:
    """Sorted distinct canonical keys of an array; NULL array gives an empty one."""
    keys = F.filter(F.transform(values, canonical_key), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))))
