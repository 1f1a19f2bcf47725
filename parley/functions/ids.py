"""Identifiers that survive a task retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *key: Column) -> Column:
    """``prefix_`` and 20 letters and digits holding 96 bits of a hash of the key.

    A random id would change when a lost executor makes a task run again; a
    hash of the row's own key does not.
    """

    def part(k: Column) -> Column:
        # With its length in front no value runs into the next; a null is no text at all.
        text = k.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))

    joined = F.concat(*map(part, key))

    def half(start: int) -> Column:
        return F.lpad(F.conv(F.substring(F.sha2(joined, 256), start, 12), 16, 36), 10, "0")

    return F.concat(F.lit(prefix + "_"), half(1), half(13))


def random_id(prefix: str) -> Column:
    """A new id on every evaluation, for callers who want no stable key."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 20))
