"""Risk of files, maintenance score of repositories, directory roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import dirname
from codestrata.operators.ranking import percentile_high, value_ranks

RISK_WEIGHTS = {"central": 0.24, "contracts": 0.14, "size": 0.12, "churn": 0.12, "untested": 0.12, "persist": 0.12, "hidden": 0.08, "fanin": 0.06}
SCORE_WEIGHTS = {"coupling": 0.20, "duplication": 0.10, "size": 0.15, "agent_risk": 0.25, "test_protection": 0.15, "prompt_archaeology": 0.15}
TIERS = [(25, "handover"), (45, "pack"), (65, "supervised")]


def with_percentile(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Adds the tie-high percentile of ``value`` within ``group``; null values have none."""
    r = value_ranks(df, [group], value).select(F.col(group).alias("__g"), F.col(value).alias("__v"), percentile_high(F.col("n_le"), F.col("n")).alias(out))
    return df.join(r, F.col(group).eqNullSafe(F.col("__g")) & (F.col(value) == F.col("__v")), "left").drop("__g", "__v")


def risk(metrics: DataFrame, group: str = "repo", with_history: bool = True) -> DataFrame:
    """Adds signals, score and tier to file metrics (pagerank, reach, fan_in, loc, longest_func, contracts, churn_commits, tested, persists,
    uses_persist, autoload, hidden, testable, generated; missing columns count as none).

    Without history, churn and hidden partners are dropped and the other weights rescaled. Writing saved data puts a floor under the score.
    """
    have = set(metrics.columns)
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    flag = lambda c, d=False: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    m = metrics.withColumns({"__pr": num("pagerank"), "__re": num("reach"), "__ch": num("churn_commits")})
    for c, out in (("__pr", "__prp"), ("__re", "__rep"), ("__ch", "__chp")):
        m = with_percentile(m, group, c, out)
    testable = flag("testable", True)
    central = (0.5 * F.col("__prp") + 0.5 * F.col("__rep")) * F.when(testable, 1.0).otherwise(0.6)
    signals = {
        "central": central,
        "fanin": F.least(F.lit(1.0), num("fan_in") / 15),
        "size": 0.6 * F.least(F.lit(1.0), num("loc") / 700) + 0.4 * F.least(F.lit(1.0), num("longest_func") / 120),
        "contracts": F.least(F.lit(1.0), num("contracts") / 30),
        "churn": F.when(F.col("__ch") > 0, F.col("__chp")).otherwise(0.0),
        "untested": F.when(flag("tested") | ~testable, 0.0).otherwise(1.0),
        "persist": F.when(flag("persists"), 1.0).when(flag("uses_persist"), 0.6).otherwise(0.0),
        "hidden": F.least(F.lit(1.0), num("hidden") / 3),
    }
    weights = {k: v for k, v in RISK_WEIGHTS.items() if with_history or k not in ("churn", "hidden")}
    total = sum(weights.values())
    raw = reduce(lambda a, b: a + b, [F.lit(w) * signals[k] for k, w in weights.items()]) * 100 / total
    floor = F.when(flag("persists"), 72.0).when(flag("uses_persist") & (flag("autoload") | (num("fan_in") >= 8)), 62.0).otherwise(0.0)
    score = F.greatest(raw, floor)
    m = m.withColumn("score", score)
    tier = F.when(flag("generated"), "generated").when(F.col("score") >= 62, "do-not-touch").when(F.col("score") >= 45, "careful").otherwise("normal")
    reasons = F.array_compact(F.array(
        F.when(flag("persists"), "writes persistent data").when(flag("uses_persist"), "owns state that is saved"),
        F.when(flag("autoload"), "reachable from every script"),
        F.when(num("fan_in") >= 6, F.format_string("%d files depend on it", num("fan_in").cast("int"))),
        F.when(num("reach") >= 12, F.format_string("a change can reach %d files", num("reach").cast("int"))),
        F.when(num("loc") >= 500, F.format_string("%d lines", num("loc").cast("int"))),
        F.when(F.col("__ch") >= 4, F.format_string("changed in %d commits", F.col("__ch").cast("int"))),
        F.when(num("hidden") > 0, "changes with files it has no reference to"),
        F.when(~flag("tested") & testable, "no test references it"),
    ))
    m = m.withColumns({"tier": tier, "signals": F.create_map(*[x for k in signals for x in (F.lit(k), signals[k])]), "reasons": reasons})
    return m.drop("__pr", "__re", "__ch", "__prp", "__rep", "__chp")


def secret_controllers(metrics: DataFrame, group: str = "repo", least: int = 6) -> DataFrame:
    """Short files much depends on: top fifth by rank, lower half by lines, four or more dependants; groups of ``least`` files or more."""
    m = metrics.withColumns({"__p": F.coalesce("pagerank", F.lit(0.0)), "__l": F.coalesce("loc", F.lit(0))})
    m = with_percentile(with_percentile(m, group, "__p", "pagerank_pct"), group, "__l", "loc_pct")
    n = metrics.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    return m.join(n, group).filter((F.col("pagerank_pct") >= 0.8) & (F.col("loc_pct") <= 0.5) & (F.col("fan_in") >= 4)).drop("__p", "__l", "__n")


def category_scores(components: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., category, score): the mean of the components' scores that are not null, less the credit, never below 0."""
    return components.groupBy(*keys, "category").agg(F.greatest(F.lit(0.0), F.coalesce(F.avg("score"), F.lit(0.0)) - F.coalesce(F.max("credit"), F.lit(0.0))).alias("score"))


def total_score(categories: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., total, tier): the weighted sum of category scores and its tier."""
    w = F.create_map(*[F.lit(x) for kv in SCORE_WEIGHTS.items() for x in kv])
    t = categories.groupBy(*keys).agg(F.sum(F.col("score") * F.try_element_at(w, F.col("category"))).alias("total"))
    return t.withColumn("tier", tier_of(F.col("total")))


def tier_of(total: Column) -> Column:
    out = None
    for bar, name in TIERS:
        out = F.when(total < bar, name) if out is None else out.when(total < bar, name)
    return out.otherwise("stabilize")


def directories(files: DataFrame, key: str = "repo") -> DataFrame:
    """(key, dir, files, loc, role): files and lines per directory, and its commonest role (ties by name)."""
    f = files.withColumn("dir", dirname(F.col("path")))
    roles = f.groupBy(key, "dir", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("loc").alias("l"))
    return roles.groupBy(key, "dir").agg(F.sum("n").alias("files"), F.sum("l").alias("loc"), F.min(F.struct((-F.col("n")).alias("k"), "role")).getField("role").alias("role"))


def directory_edges(edges: DataFrame, key: str = "repo") -> DataFrame:
    """(key, src_dir, dst_dir, n) of file edges (key, src, dst) between different directories."""
    e = edges.select(key, dirname(F.col("src")).alias("src_dir"), dirname(F.col("dst")).alias("dst_dir"))
    return e.filter("src_dir <> dst_dir").groupBy(key, "src_dir", "dst_dir").agg(F.count(F.lit(1)).alias("n"))
