"""Problem 7: one order from several scores on different scales, in which no single score decides (leximin).

Each score becomes the share of its group's records that don't lie above it (ties alike, a missing score 0), so all scores share one scale. A record's percentiles are sorted ascending and records
are compared by that vector: first by their weakest score, then by the next weakest, and so on. A high score can't make up for a weak one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.ranking import rank_over, value_ranks
from codestrata.session import cut


def latest(rows: DataFrame, key: str, at: str, keep: list[str]) -> DataFrame:
    """The row of each key with the latest ``at`` (null is earliest); equal times are decided by the kept values, so the result is repeatable.
    Combined map-side by ``max_by``, without a window."""
    kept = F.struct(*[F.col(c) for c in keep])
    top = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), kept.alias("row"))).alias("m"))
    return top.select(key, *[F.col("m.row")[c].alias(c) for c in keep if c != key])


RANK_ROWS = 500_000  # distinct values sent to every executor at most


def percentiles(rows: DataFrame, key: str, group: str, measures: list[str]) -> DataFrame:
    """(key, group, measure, value, n_gt): one row per non-null value; n_gt: values of the group that are larger. NaN counts as null."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    long = rows.select(key, group, F.explode(each).alias("m")).select(key, group, "m.measure", "m.value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    ranks = value_ranks(long, [group, "measure"], "value")
    ranks = cut(ranks.select(F.col(group).alias("g"), F.col("measure").alias("q"), F.col("value").alias("v"), (F.col("n") - F.col("n_le")).alias("n_gt")))
    # one value may be a third of all rows (zero often is): the distinct values go to the rows if they are counted few, else skew handling splits it
    ranks = F.broadcast(ranks) if ranks.limit(RANK_ROWS + 1).count() <= RANK_ROWS else ranks
    same = F.col(group).eqNullSafe(F.col("g")) & (F.col("measure") == F.col("q")) & (F.col("value") == F.col("v"))
    return long.join(ranks, same).select(key, group, "measure", "value", "n_gt")


def leximin(rows: DataFrame, key: str, group: str, measures: list[str]) -> DataFrame:
    """(key, group, percentiles, weakest, place, records), one row per record of ``rows`` (unique by key).

    ``percentiles``: the ascending vector of 1 - (values of the group that are larger) / records, a missing score counting as 0. ``place``: the order
    within the group, best first, equal vectors by key. ``records``: those of the group.
    """
    rows = cut(rows.select(key, group, *measures))
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("records")).withColumnRenamed(group, "g")
    p = percentiles(rows, key, group, measures)
    mine = [F.max(F.when(F.col("measure") == m, F.col("n_gt"))).alias(f"p_{i}") for i, m in enumerate(measures)]
    per = p.groupBy(F.col(key).alias("k_")).agg(*mine)
    all_ = rows.select(key, group).join(per, F.col(key) == F.col("k_"), "left").join(F.broadcast(size), F.col(group).eqNullSafe(F.col("g")))
    vector = F.array_sort(F.array(*[F.coalesce((F.col("records") - F.col(f"p_{i}")) / F.col("records"), F.lit(0.0)) for i in range(len(measures))]))
    all_ = all_.select(key, group, vector.alias("percentiles"), "records").withColumn("weakest", F.col("percentiles")[0])
    return rank_over(all_, [group], ["-percentiles", key], "place")


def tops(order: DataFrame, share: int = 10, but: int = 1) -> DataFrame:
    """Records of a leximin order that stand among the group's top 1/``share`` (rounded up) in all scores but their ``but`` weakest: their vector from
    there on lies above 1 - k / records."""
    n, k = F.col("records"), F.ceil(F.col("records") / share)
    return order.filter(F.round(F.col("percentiles")[but] * n) > n - k)
