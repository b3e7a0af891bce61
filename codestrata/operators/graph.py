"""Weighted graphs: merging, ranking, reachability, cycles, cheapest paths.

Edges are DataFrames (repo, src, dst, w): every repository is a graph of its own, and all of them are worked on at once. There is one form of
each operator: a round is an equi-join on (repo, node) and an aggregation with map-side combining, so a node with a third of all edges is summed
in pieces. Rounds are cut into the checkpoint folder every few steps, so that the plan stays short and a lost executor costs only those steps.
No operator lists pairs of nodes that can reach each other: reachability travels as bit sets of 1,024 targets a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import edge_cost
from codestrata.operators.ranking import rank_over, running_sum
from codestrata.session import cut

STRIDE = 4  # rounds between cuts
BROADCAST_ROWS = 500_000  # edges up to this count are sent to the executors, more are shuffled; the result is the same
WORDS = 16  # 64-bit words of a bit set


def merge_references(refs: DataFrame) -> DataFrame:
    """(repo, src, dst, kind, weight, lines, members) from single references (repo, src, dst, kind, weight, line, member): the kind of the highest
    weight stays (ties by name), lines and members are united."""
    return refs.groupBy("repo", "src", "dst").agg(
        F.min(F.struct((-F.col("weight")).alias("k"), "kind")).alias("m"), F.max("weight").alias("weight"),
        F.array_sort(F.collect_set("line")).alias("lines"), F.array_sort(F.collect_set("member")).alias("members"),
    ).select("repo", "src", "dst", F.col("m.kind").alias("kind"), "weight", "lines", "members")


def merge_kinds(edges: DataFrame, cap: float = 1.5) -> DataFrame:
    """(repo, src, dst, w, kinds) from (repo, src, dst, kind, w): the highest weight per kind, the kinds' sum capped."""
    best = edges.groupBy("repo", "src", "dst", "kind").agg(F.max("w").alias("w"))
    return best.groupBy("repo", "src", "dst").agg(F.least(F.lit(cap), F.sum("w")).alias("w"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "w")))).alias("kinds"))


def static_weights(edges: DataFrame) -> DataFrame:
    """Reference weight times 1 + min(.4, .05 per member)."""
    return edges.withColumn("w", F.col("weight") * (1 + F.least(F.lit(0.4), 0.05 * F.size("members"))))


def contract_weights(sends: DataFrame) -> DataFrame:
    """(repo, src, dst, w) from sends (repo, src, dst, table_id, key): .75 * min(1, .5 + .1 per distinct key), the best table of a pair of files."""
    per = sends.groupBy("repo", "src", "dst", "table_id").agg((0.75 * F.least(F.lit(1.0), 0.5 + 0.1 * F.count_distinct("key"))).alias("w"))
    return per.groupBy("repo", "src", "dst").agg(F.max("w").alias("w"))


def string_weights(shared: DataFrame) -> DataFrame:
    """(repo, src, dst, w), both directions, from shared strings (repo, a, b, weight): .35 * min(1, weight / 3) where the weight is .6 or more."""
    e = shared.filter("weight >= 0.6").select("repo", "a", "b", (0.35 * F.least(F.lit(1.0), F.col("weight") / 3)).alias("w"))
    return e.select("repo", F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(e.select("repo", "b", "a", "w"))


def impact_neighbours(edges: DataFrame) -> DataFrame:
    """Reverse adjacency: who is affected by a change of src."""
    return edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def _hinted(rows: DataFrame) -> DataFrame:
    """A cut table with a broadcast hint if it was counted small."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("repo", "node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), ["repo", "src"], "left_semi").join(n.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_semi")


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 60) -> DataFrame:
    """(repo, node, rank): weighted PageRank of each repository in a fixed number of rounds from 1/n; nodes without outgoing weight spread theirs
    evenly. Edges to or from other nodes than ``nodes`` (repo, node) are ignored; no nodes give no rows.

    The rounds are linear, so what has to be iterated is v_j = A^j 1 alone, A the weights shared out without damping: no global sum is needed within
    a round. From the sums of all v_j in a repository follows what its loose ends give back in each round, and with it the rank as a sum over v_j.
    Nodes without edges stay out of the rounds: only v_0 isn't 0 there.
    """
    nodes = nodes.select("repo", "node").distinct()
    inside = cut(_inside(edges, nodes).filter("w > 0").groupBy("repo", "src", "dst").agg(F.sum("w").alias("w")))
    total = inside.groupBy("repo", "src").agg(F.sum("w").alias("total"))
    linked = inside.select("repo", F.col("src").alias("node")).union(inside.select("repo", "dst")).distinct()
    arcs = inside.join(total, ["repo", "src"]).select("repo", "src", "dst", (F.col("w") / F.col("total")).alias("share"))
    arcs = _hinted(cut(arcs.union(linked.select("repo", "node", "node", F.lit(None).cast("double")))))  # a null share keeps a node's own history
    state = linked.select("repo", "node", F.array(F.lit(1.0)).alias("v"))
    for k in range(1, rounds + 1):
        j = state.withColumnRenamed("node", "src").join(arcs, ["repo", "src"])
        got = F.coalesce(F.sum(F.element_at("v", -1) * F.col("share")), F.lit(0.0))
        state = j.groupBy("repo", F.col("dst").alias("node")).agg(F.max(F.when(F.col("share").isNull(), F.col("v"))).alias("v"), got.alias("g")).select("repo", "node", F.concat("v", F.array("g")).alias("v"))
        if k % STRIDE == 0:
            state = cut(state)
    state = cut(state)
    sums = state.select("repo", F.posexplode("v").alias("j", "x")).groupBy("repo", "j").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda t: t["x"]).alias("s"))  # rounds + 1 numbers
    size = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).join(sums, "repo", "left")

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for repo, n, s in zip(b.repo, b.n, b.s):
                s = np.zeros(rounds + 1) if s is None else np.asarray(s)
                given: list[float] = []  # what every node gets from loose ends and restarts in each round
                power = damping ** np.arange(rounds + 1)
                for k in range(rounds):
                    moved = power[k] * s[k + 1] / n + sum(given[k - 1 - j] * power[j] * s[j + 1] for j in range(k))
                    given.append((1 - damping) / n + damping * (1 - moved) / n)
                weights = [given[rounds - 1 - j] * power[j] for j in range(rounds)] + [power[rounds] / n]
                out.append((repo, [float(x) for x in weights]))
            yield pd.DataFrame(out, columns=["repo", "k"])

    weights = cut(size.mapInPandas(shares, "repo string, k array<double>"))
    rank = F.aggregate(F.arrays_zip("v", "k"), F.lit(0.0), lambda acc, t: acc + F.coalesce(t["v"], F.lit(0.0)) * t["k"])
    none = F.array(F.lit(1.0))
    return nodes.join(state, ["repo", "node"], "left").join(weights, "repo").withColumn("v", F.coalesce("v", none)).select("repo", "node", rank.alias("rank"))


def personalized(edges: DataFrame, seeds: DataFrame, alpha: float = 0.55, rounds: int = 40) -> DataFrame:
    """(q, repo, node, mass) for any number of searches at once, seeds (q, repo, node): mass walks along edges from a search's seeds; a node passes
    on alpha * mass * w / max(sum of w, 1), so weak links leak; a node without outgoing weight drops its mass; each round restarts (1 - alpha)
    evenly at the seeds. Edges may carry ``q`` too: then each search walks its own graph."""
    own = ["q"] if "q" in edges.columns else []
    at = [*own, "repo", "src"]
    total = edges.groupBy(*at).agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("t"), F.sum("w").alias("raw")).filter("raw > 0")
    arcs = _hinted(cut(edges.join(total, at).select(*at, "dst", (alpha * F.col("w") / F.col("t")).alias("share"))))
    start = seeds.select("q", "repo", "node").distinct()
    start = cut(start.join(start.groupBy("q").agg(F.count(F.lit(1)).alias("k")), "q").select("q", "repo", "node", (1 / F.col("k")).alias("mass")))
    again = start.withColumn("mass", (1 - alpha) * F.col("mass"))
    state = start
    for k in range(1, rounds + 1):
        sent = state.select("q", "repo", F.col("node").alias("src"), "mass").join(arcs, at).select("q", "repo", F.col("dst").alias("node"), (F.col("mass") * F.col("share")).alias("mass"))
        state = sent.union(again).groupBy("q", "repo", "node").agg(F.sum("mass").alias("mass"))
        if k % STRIDE == 0:
            state = cut(state)
    return state


def reach_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, node, reach): how many of ``nodes`` (repo, node) can get to a node over edges between them, directly or not.

    Nodes with edges are numbered; a bit set of 1,024 numbers is one row (node, block), and only rows that gained a bit travel on. A repository of n
    linked files makes at most n * n / 1,024 rows, and only where something is reached; rounds are as many as the longest shortest path.
    """
    nodes = nodes.select("repo", "node").distinct()
    e = cut(_inside(edges, nodes).filter("src <> dst").select("repo", "src", "dst").distinct())
    linked = e.select("repo", F.col("src").alias("node")).union(e.select("repo", "dst")).distinct()
    n = rank_over(linked, ["repo"], ["node"], "no").select("repo", "node", (F.col("no") - 1).alias("no"))
    word = F.floor(F.pmod("no", F.lit(64 * WORDS)) / 64)
    one = F.expr("shiftleft(1L, CAST(pmod(no, 64) AS INT))")
    names = [f"b{i}" for i in range(WORDS)]
    state = n.select("repo", "node", F.floor(F.col("no") / (64 * WORDS)).alias("block"), *[F.when(word == i, one).otherwise(F.lit(0).cast("long")).alias(b) for i, b in enumerate(names)])
    state = front = cut(state)
    while not front.isEmpty():
        sent = front.withColumnRenamed("node", "src").join(e, ["repo", "src"]).groupBy("repo", F.col("dst").alias("node"), "block").agg(*[F.bit_or(b).alias(f"n_{b}") for b in names])
        j = state.join(sent, ["repo", "node", "block"], "full")
        zero = F.lit(0).cast("long")
        new = [F.coalesce(b, zero).bitwiseOR(F.coalesce(f"n_{b}", zero)).alias(b) for b in names]
        gained = reduce(lambda x, y: x | y, [F.coalesce(b, zero).bitwiseOR(F.coalesce(f"n_{b}", zero)) != F.coalesce(b, zero) for b in names])
        both = cut(j.select("repo", "node", "block", *new, gained.alias("gained")))
        state, front = both.drop("gained"), both.filter("gained").drop("gained")
    count = state.groupBy("repo", "node").agg((F.sum(reduce(lambda x, y: x + y, [F.bit_count(b) for b in names])) - 1).alias("reach"))
    return nodes.join(count, ["repo", "node"], "left").select("repo", "node", F.coalesce("reach", F.lit(0).cast("long")).alias("reach"))


def _spread_label(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(repo, node, label): the largest label (repo, node, label) that gets to a node along the edges, its own included."""
    state = front = labels
    while True:
        sent = front.withColumnRenamed("node", "src").join(edges, ["repo", "src"]).groupBy("repo", F.col("dst").alias("node")).agg(F.max("label").alias("more"))
        both = cut(state.join(sent, ["repo", "node"], "left").select("repo", "node", F.greatest("label", "more").alias("label"), F.coalesce(F.col("more") > F.col("label"), F.lit(False)).alias("gained")))
        state, front = both.drop("gained"), both.filter("gained").drop("gained")
        if front.isEmpty():
            return state


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, node, component, size): strongly connected components, named by their smallest node.

    Nodes without an edge in or without one out are trimmed until none is left; then the largest name that gets to a node colours it, and what gets
    back to a colour's own node within the colour is that node's component; the rest goes round again. No pairs of nodes are listed.
    """
    nodes = nodes.select("repo", "node").distinct()
    e = cut(_inside(edges, nodes).filter("src <> dst").select("repo", "src", "dst").distinct())
    found = []
    while not e.isEmpty():
        while True:  # trimming
            live = e.select("repo", F.col("src").alias("x")).intersect(e.select("repo", F.col("dst").alias("x")))
            kept = cut(e.join(live.withColumnRenamed("x", "src"), ["repo", "src"], "left_semi").join(live.withColumnRenamed("x", "dst"), ["repo", "dst"], "left_semi"))
            same = kept.count() == e.count()
            e = kept
            if same:
                break
        if e.isEmpty():
            break
        live = e.select("repo", F.col("src").alias("node")).distinct()
        colour = _spread_label(e, live.withColumn("label", F.col("node")))
        c = colour.select("repo", "node", F.col("label").alias("colour"))
        inside = e.join(c.withColumnsRenamed({"node": "src", "colour": "cs"}), ["repo", "src"]).join(c.withColumnsRenamed({"node": "dst", "colour": "cd"}), ["repo", "dst"]).filter("cs = cd")
        back = cut(inside.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")))
        mark = _spread_label(back, c.select("repo", "node", (F.col("node") == F.col("colour")).cast("int").alias("label"))).filter("label = 1").select("repo", "node")
        part = cut(mark.join(c, ["repo", "node"]))
        found.append(part)
        gone = part.select("repo", "node")
        e = cut(e.join(gone.withColumnRenamed("node", "src"), ["repo", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_anti"))
    if not found:
        return nodes.select("repo", "node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    c = reduce(DataFrame.unionByName, found)
    named = c.groupBy("repo", "colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size"))
    c = c.join(named, ["repo", "colour"]).select("repo", "node", "component", "size")
    return nodes.join(c, ["repo", "node"], "left").select("repo", "node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))


def shortest_chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(q, repo, node, hops, via): breadth first from the start nodes (q, repo, node) of any number of searches at once, as far as edges lead; ``via``
    is the node before, the smallest by name of equally near ones, null at a start."""
    e = edges.select("repo", "src", "dst").distinct()
    seen = cut(starts.select("q", "repo", "node").distinct().select("q", "repo", "node", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via")))
    front, hop = seen, 0
    while not front.isEmpty():
        hop += 1
        nxt = front.select("q", "repo", F.col("node").alias("src")).join(e, ["repo", "src"]).groupBy("q", "repo", F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        front = cut(nxt.join(seen, ["q", "repo", "node"], "left_anti").select("q", "repo", "node", F.lit(hop).alias("hops"), "via"))
        seen = seen.union(front)
        if hop % STRIDE == 0:
            seen = cut(seen)
    return seen


def cheapest_paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(q, repo, node, dist, via): cheapest way from any of a search's seeds (q, repo, node) at cost .35 - ln(min(1, max(w, .001))) per edge; ``via`` is
    the node before (of equally cheap ones the smallest by name). Only nodes whose distance fell are followed further. Edges may carry ``q``."""
    own = ["q"] if "q" in edges.columns else []
    e = cut(edges.filter("src <> dst").select(*own, "repo", "src", "dst", edge_cost(F.col("w")).alias("c")))
    best = cut(seeds.select("q", "repo", "node").distinct().select("q", "repo", "node", F.lit(0.0).alias("dist"), F.lit(None).cast("string").alias("via")))
    front = best
    while not front.isEmpty():
        step = front.select("q", "repo", F.col("node").alias("src"), "dist").join(e, [*own, "repo", "src"]).groupBy("q", "repo", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("c")).alias("d"), F.col("src").alias("v"))).alias("m"))
        j = best.join(step, ["q", "repo", "node"], "full")
        better = F.col("m").isNotNull() & (F.col("dist").isNull() | (F.col("m.d") < F.col("dist")))
        j = cut(j.select("q", "repo", "node", F.when(better, F.col("m.d")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("m.v")).otherwise(F.col("via")).alias("via"), better.alias("gained")))
        best, front = j.drop("gained"), j.filter("gained").drop("gained")
    return best


def chains(paths: DataFrame, ends: DataFrame, last: int | None = None) -> DataFrame:
    """(q, repo, node, chain): the nodes on the way to each of ``ends`` (q, repo, node), from ``via`` of paths (q, repo, node, via); the last ``last``
    hops, all without a number. One join a hop, over the ends only."""
    step = paths.select("q", "repo", F.col("node").alias("at"), "via")
    todo = ends.select("q", "repo", "node").distinct().join(paths.select("q", "repo", "node"), ["q", "repo", "node"], "left_semi")
    todo = cut(todo.select("q", "repo", "node", F.array("node").alias("chain"), F.col("node").alias("at")))
    done, hop = [], 0
    while True:
        j = cut(todo.join(step, ["q", "repo", "at"], "left"))
        done.append(j.filter("via is null").select("q", "repo", "node", "chain"))
        todo = j.filter("via is not null").select("q", "repo", "node", F.concat(F.array("via"), "chain").alias("chain"), F.col("via").alias("at"))
        hop += 1
        if last is not None and hop >= last:
            done.append(todo.select("q", "repo", "node", "chain"))
            break
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def ancestors(parents: DataFrame, most: int = 12) -> DataFrame:
    """(repo, name, ancestor, depth) up the chain of (repo, name, parent), ``most`` levels at most (part of the definition); each name has one parent
    (the smallest). Names above themselves (a cycle) are left out."""
    one = parents.filter(F.col("parent").isNotNull()).groupBy("repo", "name").agg(F.min("parent").alias("parent"))
    level = cut(one.select("repo", "name", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    out = level
    up = one.select("repo", F.col("name").alias("ancestor"), F.col("parent").alias("next"))
    for d in range(2, most + 1):
        if level.isEmpty():
            break
        level = cut(level.join(up, ["repo", "ancestor"]).select("repo", "name", F.col("next").alias("ancestor"), F.lit(d).alias("depth")).filter(F.col("ancestor") != F.col("name")))
        out = out.union(level)
    return out.groupBy("repo", "name", "ancestor").agg(F.min("depth").alias("depth"))


def concentration(edges: DataFrame, nodes: DataFrame, top: int = 3) -> DataFrame:
    """(repo, top_share, avg_fan_out, edges): the share of a repository's references that its ``top`` files take, and references per file.

    The top counts come from the histogram of incoming references: values times files, the ``top`` largest by a running sum."""
    e = edges.select("repo", "src", "dst").distinct()
    hist = e.groupBy("repo", "dst").agg(F.count(F.lit(1)).alias("n")).groupBy("repo", "n").agg(F.count(F.lit(1)).alias("k"))
    run = rank_over_counts(hist)
    best = run.filter(F.col("upto") - F.col("k") < top).groupBy("repo").agg(F.sum(F.col("n") * F.least(F.col("k"), top - (F.col("upto") - F.col("k")))).alias("best"))
    size = nodes.select("repo", "node").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    j = size.join(e.groupBy("repo").agg(F.count(F.lit(1)).alias("edges")), "repo", "left").join(best, "repo", "left")
    m = F.coalesce("edges", F.lit(0))
    return j.select("repo", (F.coalesce("best", F.lit(0)) / F.greatest(m, F.lit(1))).alias("top_share"), (m / F.greatest(F.col("n"), F.lit(1))).alias("avg_fan_out"), m.alias("edges"))


def rank_over_counts(hist: DataFrame) -> DataFrame:
    """Adds ``upto``: how many items have this value or a larger one, from (repo, n, k)."""
    return running_sum(hist, ["repo"], ["-n"], F.col("k"), "upto")
