"""Joins back to a table of groups, whatever share of the rows one group holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than one in HOT_SHARE of all rows is broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 512


def join_back(rows: DataFrame, groups: DataFrame, keys: list[str], n_col: str, total: int, finish=lambda g: g) -> DataFrame:
    """``rows`` with the columns of ``finish(groups)``.  ``groups`` has one row per group: its ``keys``, the
    number of its rows ``n_col``, and more; ``finish`` keeps keys and rows.  Null keys equal each other.

    A group's rows meet its one row in one task after a shuffle, so the groups with more
    than ``total / HOT_SHARE`` rows, fewer than HOT_SHARE by count, are joined by a broadcast instead
    and their rows stay where they are.  ``rows`` and ``groups`` are read twice: cut their lineage before.
    """
    def named(part):
        return part.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *[c for c in part.columns if c not in keys])

    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)])
    hot = groups.filter(F.col(n_col) * HOT_SHARE > total)
    cold = groups.filter(F.col(n_col) * HOT_SHARE <= total)
    names = [f"_g{i}" for i in range(len(keys))]
    often = rows.join(F.broadcast(named(finish(hot))), same, "inner").drop(*names)
    rest = rows.join(F.broadcast(named(hot).select(*names)), same, "left_anti")
    others = rest.join(named(finish(cold)).hint("merge"), same, "inner").drop(*names)
    return often.unionByName(others)
