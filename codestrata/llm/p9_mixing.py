"""Problem 9: mixing sources to target weights.

Documents are grouped by membership pattern: the set of sources in which the same text stands. A text that several sources hold may serve
any of them. The patterns (at most 2^sources) and the sources form a small flow network: a pattern gives its tokens at a cost that rises with each
repetition (convex), a source takes from it what its own documents there hold times its repetitions, up to its target, and what can't be met is shortfall. The cheapest flow says how
many tokens of each pattern go to each source; documents are then selected in a seeded order up to that many tokens.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.ranking import running_sum
from codestrata.session import cut, spread

#: The vocabulary file, a parameter of the machine; see the README.
TOKENIZER = os.environ.get("CODESTRATA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    words = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    return tiktoken.Encoding("own", pat_str=words, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str = TOKENIZER):
    """A pandas UDF: tokens of a text; null and empty have none."""

    @F.pandas_udf("long")
    def tokens(text: pd.Series) -> pd.Series:
        enc = _encoder(path)
        return text.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return tokens


def measured(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, text_key, tokens), written once: sources trimmed and lower-cased, exact duplicate rows counted once (the text is
    represented by two 64-bit hashes and its length after the count). Documents without a source keep a null source."""
    key = F.concat_ws("-", F.xxhash64("text"), F.hash("text"), F.char_length("text"))
    d = spread(docs.select("doc_id", "source", "text")).select("doc_id", F.lower(F.trim("source")).alias("source"), key.alias("text_key"), token_counter(path)("text").alias("tokens"))
    return cut(d.distinct())


def min_cost_flow(own: dict[tuple[str, str], float], quota: dict[str, float], repeats: dict[str, int]) -> dict[tuple[str, str], float]:
    """Tokens from each pattern to each source, of least cost among the flows that fill the quotas as far as they can be filled.

    ``own``: tokens of a source's own documents in a pattern. The r-th use of a pattern's texts costs r, whichever source uses them: root -> pattern in
    steps of the pattern's size at cost 1, 2, ..., pattern -> source up to the source's own tokens times its repetitions, source -> sink up to its quota.
    Patterns that several sources hold cost a little more, which keeps shared texts for sources that lack their own. Solved by potentials: each
    phase finds the next path cost for all nodes at once and sends everything that this cost allows, so phases are as few as costs.
    """
    eps = 1e-9
    size: dict[str, float] = {}
    holders: dict[str, list[str]] = {}
    for (p, s), t in sorted(own.items()):
        if s in quota and t > 0:
            size[p] = size.get(p, 0.0) + t
            holders.setdefault(p, []).append(s)
    at = {x: k for k, x in enumerate(["root", "sink", *(("p", p) for p in size), *(("s", s) for s in sorted(quota))])}
    out: list[list[int]] = [[] for _ in at]
    to: list[int] = []
    cap: list[float] = []
    cost: list[float] = []

    def edge(x: object, y: object, c: float, k: float) -> None:
        for i, j, c_, k_ in ((at[x], at[y], c, k), (at[y], at[x], 0.0, -k)):
            out[i].append(len(to))
            to.append(j)
            cap.append(c_)
            cost.append(k_)

    routes = {}
    for p, mine in holders.items():
        for r in range(1, max(repeats[s] for s in mine) + 1):
            edge("root", ("p", p), size[p], float(r))
        for s in mine:
            routes[len(to)] = (p, s)
            edge(("p", p), ("s", s), own[p, s] * repeats[s], 0.001 * (len(mine) - 1))
    for s, q in sorted(quota.items()):
        edge(("s", s), "sink", q, 0.0)
    height = [0.0] * len(at)
    while True:
        dist, done, heap = [math.inf] * len(at), [False] * len(at), [(0.0, 0)]
        dist[0] = 0.0
        while heap:
            d, x = heapq.heappop(heap)
            if done[x]:
                continue
            done[x] = True
            for k in out[x]:
                nd = d + cost[k] + height[x] - height[to[k]]
                if cap[k] > eps and nd < dist[to[k]] - 1e-12:
                    dist[to[k]] = nd
                    heapq.heappush(heap, (nd, to[k]))
        if dist[1] == math.inf:
            break
        far = max(d for d in dist if d < math.inf)
        height = [h + min(d, far) for h, d in zip(height, dist)]
        while True:  # blocking flows over the edges of no reduced cost
            level = [-1] * len(at)
            level[0], todo = 0, [0]
            for x in todo:
                for k in out[x]:
                    y = to[k]
                    if level[y] < 0 and cap[k] > eps and abs(cost[k] + height[x] - height[y]) < 1e-9:
                        level[y] = level[x] + 1
                        todo.append(y)
            if level[1] < 0:
                break
            nxt = [0] * len(at)
            path: list[int] = []
            x = 0
            while True:
                if x == 1:
                    push = min(cap[k] for k in path)
                    for k in path:
                        cap[k] -= push
                        cap[k ^ 1] += push
                    i = next(i for i, k in enumerate(path) if cap[k] <= eps)
                    x, path = to[path[i] ^ 1], path[:i]
                    continue
                while nxt[x] < len(out[x]):
                    k = out[x][nxt[x]]
                    y = to[k]
                    if cap[k] > eps and level[y] == level[x] + 1 and abs(cost[k] + height[x] - height[y]) < 1e-9:
                        break
                    nxt[x] += 1
                else:
                    if x == 0:
                        break
                    level[x] = -1
                    x = to[path.pop() ^ 1]
                    nxt[x] += 1
                    continue
                path.append(k)
                x = y
    return {route: cap[k ^ 1] for k, route in routes.items() if cap[k ^ 1] > eps}


def documents(m: DataFrame, sources: list[str]) -> DataFrame:
    """(doc_id, text_key, source, tokens, pattern) once per document, text and source, for ``sources``; ``pattern``: all of these sources that hold the
    text, under any document id."""
    held = m.filter(F.col("source").isin(sources)).select("doc_id", "text_key", "source", "tokens").distinct()
    patterns = held.groupBy("text_key").agg(F.concat_ws("|", F.array_sort(F.collect_set("source"))).alias("pattern"))
    return held.join(patterns, "text_key")


def plan(m: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, routes) for measured documents.

    report: (source, size_tokens, max_repeats, target_share, target_tokens, capacity_tokens, short, blended_tokens, reached_share).
    Targets are shares of the size of all documents; ``short``: the flow leaves the source below its target. routes: (pattern, source, tokens).
    Only the pattern sums of the target sources reach the driver: the targets are a fixed table, and of n of them there are less than 2^n patterns
    (2,047 of 11), each with at most n sums.
    """
    spark = m.sparkSession
    goals = [r.asDict() for r in targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").distinct().collect() if r["source"]]
    names = [g["source"] for g in goals]
    total = float(m.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    sizes = {r["source"]: float(r["tokens"]) for r in m.filter(F.col("source").isin(names)).groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    own = {(r["pattern"], r["source"]): float(r["tokens"]) for r in documents(m, names).groupBy("pattern", "source").agg(F.sum("tokens").alias("tokens")).collect()}
    quota = {g["source"]: (g["target_share"] or 0.0) * total for g in goals}
    repeats = {g["source"]: int(g["max_repeats"] or 1) for g in goals}
    sent = min_cost_flow(own, quota, repeats)
    whole = sum(sent.values())
    rows = []
    for g in goals:
        s = g["source"]
        got = float(sum(v for (_, t), v in sent.items() if t == s))
        rows.append((s, int(sizes.get(s, 0)), repeats[s], float(g["target_share"] or 0.0), quota[s], sizes.get(s, 0.0) * repeats[s], got < quota[s] - 1e-6, got, got / whole if whole else 0.0))
    report = spark.createDataFrame(rows, "source string, size_tokens long, max_repeats int, target_share double, target_tokens double, capacity_tokens double, short boolean, blended_tokens double, reached_share double")
    routes = spark.createDataFrame([(p, s, v) for (p, s), v in sorted(sent.items())], "pattern string, source string, tokens double")
    return report, routes


def select(m: DataFrame, routes: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, copies, tokens): how often each document goes into the blend for its source. Copies of a text under other ids are documents of
    their own.

    A source's documents of a pattern stand in seeded order, laid end to end; the source takes as many token positions from the start as are routed to it,
    going round again for repetitions, so it gets its routed tokens up to the last document.
    """
    names = [r["source"] for r in routes.select("source").distinct().collect()]  # at most as many as targets
    docs = documents(m, names).filter(F.col("tokens") > 0).withColumn("u", F.xxhash64("text_key", "doc_id", F.lit(seed)))
    laid = running_sum(docs, ["pattern", "source"], ["u", "text_key", "doc_id"], F.col("tokens"), "upto", total="whole")
    j = laid.join(F.broadcast(routes.withColumnRenamed("tokens", "routed")), ["pattern", "source"])
    # the document covers (upto - tokens, upto] + k * whole for k = 0, 1, ...: how many of these midpoints lie below what is routed
    copies = F.greatest(F.ceil((F.col("routed") - (F.col("upto") - F.col("tokens") / 2)) / F.col("whole")), F.lit(0))
    return j.select("doc_id", "source", copies.cast("int").alias("copies"), "tokens").filter("copies > 0")
