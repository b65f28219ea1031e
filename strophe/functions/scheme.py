"""Rhyme schemes of line windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = ("AABB", "ABAB", "ABBA", "AAAA")
# The two pattern tables, for scoring and for sampling.
SCORING = {"AABB": "AABBCCDDEEFFGGHHIIJJ", "ABAB": "ABABCDCDEFEFGHGHIJIJ", "ABBA": "ABBACDDCEFFEGHHGIJJI", "AAAA": "AAAABBBBCCCCDDDDEEEE", "free": None}
SAMPLING = {"AABB": "AABBCCDDEEFFFFGGHH", "ABAB": "ABABCDCDEFEFEFGHGH", "ABBA": "ABBACDCDEFFEGHGHIJ", "free": None}


def classify(a: Column, b: Column, c: Column, d: Column) -> Column:
    """unknown, AAAA, AABB, ABAB, ABBA or irregular."""
    unknown = a.isNull() | b.isNull() | c.isNull() | d.isNull()
    return (
        F.when(unknown, "unknown")
        .when((a == b) & (b == c) & (c == d), "AAAA")
        .when((a == b) & (c == d), "AABB")
        .when((a == c) & (b == d), "ABAB")
        .when((a == d) & (b == c), "ABBA")
        .otherwise("irregular")
    )


def window_schemes(suffixes: Column) -> Column:
    """The scheme of each run of four suffixes of an array, from four shifted slices: the array is made a few times a row, not once a line."""
    n = F.greatest(F.size(suffixes) - 3, F.lit(0))
    runs = F.arrays_zip(*[F.slice(suffixes, k + 1, n) for k in range(4)])
    return F.transform(runs, lambda x: classify(*(x.getField(str(k)) for k in range(4))))


def groups(scheme: str, lines: int, table: dict[str, str | None] = SCORING) -> list[int]:
    """The rhyme group of each line of a verse; lines beyond the pattern are groups of their own."""
    pattern = table.get(scheme, scheme)
    if pattern is None:
        return list(range(lines))
    order = {letter: i for i, letter in enumerate(dict.fromkeys(pattern))}
    given = [order[letter] for letter in pattern[:lines]]
    last = order[pattern[-1]]
    return given + list(range(last + 1, last + 1 + lines - len(given)))


def group_array(scheme: str, most: int, table: dict[str, str | None] = SCORING) -> Column:
    return F.array(*[F.lit(g) for g in groups(scheme, most, table)])
