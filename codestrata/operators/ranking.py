"""Ordered operations over groups of any size: ranks and running sums without one task per group.

A plain ``Window.partitionBy(group)`` sends a whole group to one task. Here rows are range-partitioned on (group, order), so that a group
holding a third of all rows is spread over a third of the partitions; each piece is summed on its own and lifted by the totals of the
pieces before it. The table of piece totals has one row per (group, partition), so its window is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cut


def _order(keys: list[str]) -> list[Column]:
    """Sort columns from names; a leading ``-`` sorts downwards (nulls last), otherwise upwards (nulls first)."""
    return [F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys]


def running_sums(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """``df`` with, for each name in ``values``, the sum of its value over the rows of the same group up to and including the current one: all sums in
    one pass over one order.

    ``order``: column names, ``-name`` for descending. It should be total within a group; rows with equal keys get their sums in any order.
    ``totals``: also give a group's whole sum of a name under another name. Null values count 0, null groups are one group; an empty input gives an
    empty output.
    """
    parts = df.withColumns({f"__rs_v_{k}": F.coalesce(v, F.lit(0)) for k, v in values.items()})
    parts = cut(parts.repartitionByRange(*_order(group + order)).withColumn("__rs_p", F.spark_partition_id()))
    w = Window.partitionBy(*group, "__rs_p").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("__rs_p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = parts.groupBy(*group, "__rs_p").agg(*[F.sum(f"__rs_v_{k}").alias(f"__rs_s_{k}") for k in values])
    pieces = pieces.withColumns({f"__rs_b_{k}": F.coalesce(F.sum(f"__rs_s_{k}").over(before), F.lit(0)) for k in values})
    for k, name in (totals or {}).items():
        pieces = pieces.withColumn(name, F.sum(f"__rs_s_{k}").over(Window.partitionBy(*group)))
    pieces = pieces.select(*[F.col(g).alias(f"__rs_g_{g}") for g in group], F.col("__rs_p").alias("__rs_r_p"), *[f"__rs_b_{k}" for k in values], *(totals or {}).values())
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__rs_g_{g}")) for g in group] + [F.col("__rs_p") == F.col("__rs_r_p")])
    res = parts.withColumns({f"__rs_c_{k}": F.sum(f"__rs_v_{k}").over(w) for k in values}).join(pieces, same, "left")
    res = res.withColumns({k: F.col(f"__rs_c_{k}") + F.col(f"__rs_b_{k}") for k in values})
    return res.drop("__rs_p", "__rs_r_p", *[f"__rs_{x}_{k}" for k in values for x in "vcb"], *[f"__rs_g_{g}" for g in group])


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, total: str | None = None) -> DataFrame:
    """``running_sums`` of a single value under the name ``out``."""
    return running_sums(df, group, order, {out: value}, {out: total} if total else None)


def value_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n_equal, n_le, n_ge, n): for each distinct non-null value its multiplicity, how many are at most / at least as large,
    and the group's size. Equal values are aggregated before the shuffle, so ties of any number cost one row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n_equal"))
    run = running_sum(counts, group, [value], F.col("n_equal"), "n_le", total="n")
    return run.withColumn("n_ge", F.col("n") - F.col("n_le") + F.col("n_equal"))


def rank_over(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """``row_number`` over groups of any size. ``order`` should be total for a repeatable result."""
    return running_sum(df, group, order, F.lit(1), out)


def percentile_high(n_le: Column, n: Column) -> Column:
    """Tie-high percentile: (values <= v, less one) over (values, less one); 0 for a single value."""
    return F.when(n > 1, (n_le - 1) / (n - 1)).otherwise(F.lit(0.0))
