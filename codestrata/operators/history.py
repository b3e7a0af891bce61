"""What the commit log says: file churn, co-change, hidden partners, renames, replay of history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators.ranking import running_sum, running_sums
from codestrata.session import cut

MAX_FILES = 30


def commits_once(commits: DataFrame) -> DataFrame:
    """Re-loaded commits once, as first loaded; null shas are dropped."""
    cols = [c for c in commits.columns if c != "sha"]
    first = commits.filter(F.col("sha").isNotNull()).groupBy("sha").agg(F.min(F.struct("loaded_at", *[c for c in cols if c != "loaded_at"])).alias("r"))
    return first.select("sha", *[F.col("r")[c].alias(c) for c in cols])


def touched(commit_files: DataFrame, code: DataFrame) -> DataFrame:
    """(repo, sha, path, lines) of files that exist in ``code`` (repo, path), exact duplicate rows once, missing counts as 0."""
    rows = commit_files.filter(F.col("path").isNotNull()).select("repo", "sha", "path", "added", "deleted").distinct()
    lines = F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))
    kept = rows.join(code.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    return kept.groupBy("repo", "sha", "path").agg(F.sum(lines).alias("lines"))


def ai_author(body: Column) -> Column:
    """Name of the writing agent a commit body gives away, white space collapsed; null without one."""
    b = F.coalesce(body, F.lit(""))
    named = F.trim(F.regexp_replace(F.regexp_extract(b, X.AI_TRAILER, 1), r"\s+", " "))
    tool = F.regexp_extract(b, X.AI_BODY, 1)
    return F.when(named != "", named).when(tool != "", tool)


def file_history(t: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, path, changes, churn, fixes): commits touching a file, their lines, and how many read like fixes."""
    fix = commits.select("sha", F.coalesce(F.col("subject").rlike(X.FIX_SUBJECT), F.lit(False)).alias("fix"))
    j = t.join(fix, "sha", "left")
    return j.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("changes"), F.sum("lines").alias("churn"), F.count_if("fix").alias("fixes"))


def pair_stats(t: DataFrame, most: int = MAX_FILES, small: int = 8) -> DataFrame:
    """(repo, a, b, n, weight, n_small) of files changed together in commits of 2 to ``most`` files; weight adds 1 / (files - 1) per commit.

    Pairs are formed inside a commit's row (bounded by ``most``) and summed with map-side combining.
    """
    sizes = t.groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size").between(2, most))
    lists = t.join(sizes, ["repo", "sha"]).groupBy("repo", "sha", "size").agg(F.array_sort(F.collect_list("path")).alias("ps"))
    a = lists.select("repo", "size", "ps", F.explode("ps").alias("a"))
    p = a.select("repo", "size", "a", F.explode(F.filter("ps", lambda x: x > F.col("a"))).alias("b"))
    return p.groupBy("repo", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / (F.col("size") - 1)).alias("weight"), F.count_if(F.col("size") <= small).alias("n_small"))


def with_confidence(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Adds conf_ab = n / changes of a and conf_ba = n / changes of b."""
    a = history.select("repo", F.col("path").alias("a"), F.col("changes").alias("changes_a"))
    b = history.select("repo", F.col("path").alias("b"), F.col("changes").alias("changes_b"))
    j = pairs.join(a, ["repo", "a"], "left").join(b, ["repo", "b"], "left")
    return j.withColumns({"conf_ab": F.coalesce(F.try_divide("n", "changes_a"), F.lit(0.0)), "conf_ba": F.coalesce(F.try_divide("n", "changes_b"), F.lit(0.0))})


def cochange_edges(pairs: DataFrame, commits_in_repo: DataFrame) -> DataFrame:
    """(repo, src, dst, w), both directions: .8 * best confidence * min(1, weight / 1.5) for pairs seen twice or more in repositories with
    five commits or more; weaker than .08 is dropped."""
    p = pairs.filter("n >= 2").join(commits_in_repo.filter("commits >= 5").select("repo"), "repo", "left_semi")
    w = 0.8 * F.greatest("conf_ab", "conf_ba") * F.least(F.lit(1.0), F.col("weight") / 1.5)
    e = p.select("repo", "a", "b", w.alias("w")).filter("w >= 0.08")
    return e.select("repo", F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(e.select("repo", "b", "a", "w"))


def hidden_partners(pairs: DataFrame, linked: DataFrame, top: int = 6) -> DataFrame:
    """(repo, path, partner, n, confidence): files that change together (n >= 3, twice in small commits, confidence >= .5, weight >= .6) with no
    link (repo, src, dst) either way; the ``top`` partners of each file, by count, confidence and name."""
    one = pairs.filter("n >= 3 and n_small >= 2 and weight >= 0.6")
    both = one.select("repo", F.col("a").alias("path"), F.col("b").alias("partner"), "n", F.col("conf_ab").alias("confidence")).union(one.select("repo", "b", "a", "n", "conf_ba"))
    both = both.filter("confidence >= 0.5")
    links = linked.select("repo", F.col("src").alias("path"), F.col("dst").alias("partner"))
    links = links.union(links.select("repo", "partner", "path")).distinct()
    free = both.join(links, ["repo", "path", "partner"], "left_anti")
    place = F.row_number().over(Window.partitionBy("repo", "path").orderBy(F.desc("n"), F.desc("confidence"), "partner"))
    return free.withColumn("place", place).filter(F.col("place") <= top).select("repo", "path", "partner", "n", "confidence")


def upper_median(sizes: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """(group, out): element n // 2 (from 0) of the ordered values. Values are counted first, so a group of any size is a short histogram;
    ranks of the histogram come from a running sum spread over its partitions."""
    hist = sizes.groupBy(group, F.col(value).alias("__x")).agg(F.count(F.lit(1)).alias("__k"))
    run = running_sum(hist, [group], ["__x"], F.col("__k"), "__upto", total="__n")
    return run.filter(F.col("__upto") > F.floor(F.col("__n") / 2)).groupBy(group).agg(F.min("__x").alias(out))


def rename_expansion(renames: DataFrame) -> DataFrame:
    """(.., old, new) from the log's forms ``a/{x => y}/b`` and ``old => new`` in column ``spec``; double slashes collapse."""
    brace = F.col("spec").rlike(r"^.*\{.* => .*\}.*$")
    pick = lambda g: F.regexp_extract("spec", r"^(.*)\{(.*) => (.*)\}(.*)$", g)
    tidy = lambda mid: F.regexp_replace(F.concat(pick(1), pick(mid), pick(4)), "/+", "/")
    old = F.when(brace, tidy(2)).otherwise(F.substring_index("spec", " => ", 1))
    new = F.when(brace, tidy(3)).otherwise(F.regexp_replace("spec", r"^.*? => ", ""))
    return renames.withColumns({"old": old, "new": new})


def current_names(renames: DataFrame, hops: int = 50) -> DataFrame:
    """(repo, old, current): where a name (repo, ord, old, new) ends up; the last rename of a name wins whenever it happened, at most ``hops`` steps.

    Pointer doubling: each round joins the map with itself, so ``hops`` steps take log2(hops) joins.
    """
    step = renames.groupBy("repo", "old").agg(F.max_by("new", "ord").alias("current")).withColumn("hops", F.lit(1))
    reach = 1
    while reach < hops:
        step = cut(step)
        nxt = step.select("repo", F.col("old").alias("current"), F.col("current").alias("after"), F.col("hops").alias("more"))
        j = step.join(nxt, ["repo", "current"], "left")
        go = F.col("after").isNotNull() & (F.col("hops") + F.col("more") <= hops)
        step = j.select("repo", "old", F.when(go, F.col("after")).otherwise(F.col("current")).alias("current"), F.when(go, F.col("hops") + F.col("more")).otherwise(F.col("hops")).alias("hops"))
        reach *= 2
    return step.select("repo", "old", "current")


def prefix_state(commits: DataFrame, t: DataFrame) -> DataFrame:
    """(repo, ord, sha, commits, fixes, churn): the state of a repository after each of its commits."""
    lines = t.groupBy("sha").agg(F.sum("lines").alias("lines"))
    c = commits.join(lines, "sha", "left").select("repo", "ord", "sha", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce(F.col("subject").rlike(X.FIX_SUBJECT), F.lit(False)).cast("int").alias("fix"))
    return running_sums(c, ["repo"], ["ord", "sha"], {"commits": F.lit(1), "fixes": F.col("fix"), "churn": F.col("lines")}).select("repo", "ord", "sha", "commits", "fixes", "churn")


def backtest(t: DataFrame, commits: DataFrame, ks: tuple[int, ...] = (5, 10), low: int = 2, high: int = 20) -> DataFrame:
    """(repo, samples, recall_k..., hit_k..., mrr): how well earlier co-change foretells what else a commit changes.

    A sample is a commit of ``low`` to ``high`` files that isn't the first; its seed is the file with most changed lines (ties by name).
    Partners are ranked by how often they changed with the seed in strictly earlier commits (ties by name).
    """
    c = commits.select("repo", "sha", "ord")
    full = t.join(c, ["repo", "sha"])
    sizes = full.groupBy("repo", "sha", "ord").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("lines")).alias("k"), "path")).alias("m"))
    samples = sizes.filter(F.col("size").between(low, high) & (F.col("ord") > 0)).select("repo", "sha", "ord", F.col("m.path").alias("seed"), (F.col("size") - 1).alias("truth"))
    small = sizes.filter(F.col("size").between(2, MAX_FILES)).select("repo", "sha", "ord")
    occ = full.join(small, ["repo", "sha", "ord"]).select("repo", "sha", "ord", "path")
    mine = samples.select("repo", F.col("sha").alias("s"), F.col("ord").alias("at"), F.col("seed").alias("path"))
    before = mine.join(occ, ["repo", "path"]).filter(F.col("ord") < F.col("at")).select("repo", "s", "sha", F.col("path").alias("seed"))
    mates = before.join(occ.select("repo", "sha", F.col("path").alias("mate")), ["repo", "sha"]).filter(F.col("mate") != F.col("seed"))
    votes = mates.groupBy("repo", "s", "mate").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("repo", "s").orderBy(F.desc("n"), "mate"))
    ranked = votes.withColumn("place", place).filter(F.col("place") <= max(ks)).select("repo", F.col("s").alias("sha"), F.col("mate").alias("path"), "place")
    hits = ranked.join(t.select("repo", "sha", "path"), ["repo", "sha", "path"])
    per = hits.groupBy("repo", "sha").agg(*[F.count_if(F.col("place") <= k).alias(f"h{k}") for k in ks], F.min("place").alias("first"))
    j = samples.join(per, ["repo", "sha"], "left")
    got = lambda k: F.coalesce(f"h{k}", F.lit(0))
    return j.groupBy("repo").agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.avg(got(k) / F.col("truth")).alias(f"recall_{k}") for k in ks],
        *[F.avg((got(k) > 0).cast("double")).alias(f"hit_{k}") for k in ks],
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )
