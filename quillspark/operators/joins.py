"""Joins that no frequent key holds up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by_key(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` inner-joined with one row of ``facts`` a key, so that no key is one task's work.

    ``facts.n`` says how many rows have the key. Keys with more than a 50,000th
    of all ``total`` rows (at most 50,000 keys, whatever the input) are
    broadcast; rows of the others are shuffled. ``rows`` is read twice.
    """
    most = max(100, total // 50_000)
    hot = F.broadcast(facts.filter(F.col("n") > most).drop("n"))
    cold = facts.filter(F.col("n") <= most).drop("n")
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))
