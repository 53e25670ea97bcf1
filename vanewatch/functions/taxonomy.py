"""Keyword taxonomies over free text: ``{name: [words]}``, earlier names take precedence."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Taxonomy = dict[str, list[str]]


def mentions(text: Column, words: list[str], whole_words: bool = False) -> Column:
    """Does the text hold any of the words, ignoring case; NULL text holds none."""
    lowered = F.lower(text)
    if whole_words:
        found = lowered.rlike(rf"\b(?:{'|'.join(re.escape(w) for w in words)})\b")
    else:
        found = reduce(or_, [F.contains(lowered, F.lit(w)) for w in words])
    return F.coalesce(found, F.lit(False))


def matches(text: Column, taxonomy: Taxonomy, whole_words: bool = False) -> Column:
    """All names whose words occur in the text, in order of precedence."""
    hits = [
        F.when(mentions(text, words, whole_words), F.lit(name)) for name, words in taxonomy.items()
    ]
    return F.array_compact(F.array(*hits))


def first_match(text: Column, taxonomy: Taxonomy, other: str, whole_words: bool = False) -> Column:
    branches = [
        F.when(mentions(text, words, whole_words), F.lit(name)) for name, words in taxonomy.items()
    ]
    return F.coalesce(*branches, F.lit(other))


def bonus_score(text: Column, words: list[str]) -> Column:
    """One point for a match plus one per bonus word in the text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    score = F.lit(1)
    for word in words:
        score = score + F.contains(lowered, F.lit(word)).cast("int")
    return score
