"""Small building blocks for Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def present(*columns: Column) -> Column:
    """The first column that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def fold_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def last_wins(entries: Column, key: str = "k") -> Column:
    """Entries of an array of structs, which must be sortable and begin with (key, place), less those with a later equal key.

    Equal keys meet by sorting, so that long lists take no more than n log n.
    """
    return let(F.array_sort(entries), lambda es: F.filter(es, lambda e, j: F.coalesce(F.get(es, j + 1)[key] != e[key], F.lit(True))))


def first_wins(entries: Column, key: str = "k") -> Column:
    """As last_wins, less those with an earlier equal key."""
    return let(F.array_sort(entries), lambda es: F.filter(es, lambda e, j: F.when(j > 0, F.get(es, j - 1)[key] != e[key]).otherwise(True)))


def as_map(entries: Column, key: str = "k", value: str = "v") -> Column:
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e[key], e[value])))
