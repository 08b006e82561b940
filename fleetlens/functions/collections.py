"""Arrays used as ordered lists or sets, and keyed maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: a lambda's variable is not written out again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def listed(values: Column) -> Column:
    """An absent list is an empty list."""
    return F.coalesce(values, empty_strings())


def contains(values: Column, item: Column) -> Column:
    return F.coalesce(F.array_contains(values, item), F.lit(False))


def first_match(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


def append_absent(values: Column, item: Column) -> Column:
    return F.when(contains(values, item), values).otherwise(F.array_append(listed(values), item))


def without(values: Column, removed: Column) -> Column:
    """Drop every listed value and keep the order and repeats of the rest."""
    return F.filter(values, lambda v: ~contains(removed, v))


def map_put(entries: Column, key: Column, value: Column) -> Column:
    rest = F.map_filter(entries, lambda k, _: k != key)
    return F.map_concat(rest, F.map_from_arrays(F.array(key), F.array(value)))
