"""Tags of texts by a table of terms: one walk over a text finds the terms of all fields."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: (field, tag, term): a tag of a field holds where one of its terms is in the text as whole words.
Rules = Sequence[tuple[str, str, str]]
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def inner(c: str) -> bool:
    """Whether a letter belongs to a word: only ASCII letters and digits do."""
    return c.isascii() and c.isalnum()


@functools.lru_cache(maxsize=8)
def automaton(rules: tuple[tuple[str, str, str], ...]):
    """An automaton of all terms, each with the places of its rules."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    for k, (_, _, term) in enumerate(rules):
        if term:
            of.setdefault(term.translate(LOWER), []).append(k)
    made = ahocorasick.Automaton()
    for term, places in of.items():
        made.add_word(term, (len(term), places))
    made.make_automaton()
    return made if of else None


def matched(text: str, rules: tuple[tuple[str, str, str], ...]) -> list[int]:
    """The places of the rules whose term is in a text, ascending."""
    walker = automaton(rules)
    if walker is None:
        return []
    low, found = text.translate(LOWER), set()
    for end, (size, places) in walker.iter(low):
        start = end - size + 1
        # A term that begins or ends within a word is not there.
        if not (start and inner(low[start - 1]) and inner(low[start])) and not (end + 1 < len(low) and inner(low[end + 1]) and inner(low[end])):
            found.update(places)
    return sorted(found)


def tagged(df: DataFrame, text: str, rules: Rules, separator: str = ";") -> DataFrame:
    """The rows with a column for each field of the rules: its different tags in order of the rules, joined; empty where none holds, as for a null text.

    The terms are as many as the table holds, and a text is walked once for all of them.
    """
    table = tuple((str(f), str(t), str(w)) for f, t, w in rules)
    fields = list(dict.fromkeys(f for f, _, _ in table))

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([matched(t or "", table) for t in texts], dtype=object)

    names = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("tag")) for f, t, _ in table])
    made = df.withColumn("__hits", F.transform(places(F.col(text)), lambda k: F.element_at(names, k + 1)))
    of: list[Column] = [F.array_join(F.array_distinct(F.transform(F.filter("__hits", _of(f)), lambda h: h["tag"])), separator).alias(f) for f in fields]
    return made.select(*[F.col(c) for c in df.columns], *of)


def _of(field: str):
    """Whether a hit is one of a field."""
    return lambda h: h["field"] == field


def first_tag(column: str, default: str, separator: str = ";") -> Column:
    """The first of joined tags, or a default."""
    return F.when(F.col(column) == "", F.lit(default)).otherwise(F.element_at(F.split(column, separator), 1))

