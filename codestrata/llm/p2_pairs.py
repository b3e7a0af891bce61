"""Problem 2: items that appear together, and how much more often than chance.

Pair counts are exact. The null model is a bipartite configuration model fitted per group: item i and basket c meet with probability
x_i y_c / (1 + x_i y_c), where the x and y are chosen so that every item's frequency and every basket's size are met in expectation. Items
of equal frequency and baskets of equal size have equal parameters, so the fit needs only the two histograms (aggregated by Spark before
anything reaches a Python worker). The number of baskets that hold both items is then Poisson-binomial, with one success probability per
basket size; its upper tail is computed exactly, once per distinct (frequency, frequency, joint count), and held against a Benjamini-
Hochberg threshold over all pairs of the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.ranking import running_sum
from codestrata.session import cut

#: A pair counts as surprising at all if its joint count or a larger one has at most this chance under the null model: less likely than not. The level is wide, it
#: only keeps out what the model explains; ``significant`` is the strict one.
UNLIKELY = 0.5
KINDS = 500_000  # kinds of pairs (frequency, frequency, joint count) sent to every executor at most


def baskets(rows: DataFrame, group: str, basket: str, item: str, low: int, high: int) -> DataFrame:
    """Distinct (group, basket, item) of baskets with ``low`` to ``high`` distinct items; null items are no items, null group or basket
    keys drop the row. The item counts are combined before the shuffle; a basket with a third of all rows is cut off by its count."""
    d = rows.select(F.col(group).alias("g"), F.col(basket).alias("c"), F.col(item).alias("i")).dropna().distinct()
    sizes = d.groupBy("g", "c").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size").between(low, high))
    return d.join(sizes, ["g", "c"])


def pair_counts(b: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Exact counts of pairs with at least ``least`` common baskets, with both items' frequencies; and the items' frequencies.

    A pair can't be more frequent than its rarer item, so items below ``least`` are dropped before pairs are formed: nothing is lost.
    A basket's pairs are formed inside the row of the basket (its size is bounded by ``baskets``) and counted with map-side combining.
    """
    freq = b.groupBy("g", "i").agg(F.count(F.lit(1)).alias("n_i"))
    keep = freq.filter(F.col("n_i") >= least).select("g", "i")
    kept = b.join(keep, ["g", "i"], "left_semi") if least > 1 else b
    lists = kept.groupBy("g", "c").agg(F.array_sort(F.collect_list("i")).alias("items")).filter(F.size("items") > 1)
    a = lists.select("g", "items", F.explode("items").alias("a"))
    p = a.select("g", "a", F.explode(F.filter("items", lambda x: x > F.col("a"))).alias("b"))
    counts = p.groupBy("g", "a", "b").agg(F.count(F.lit(1)).alias("n_ab")).filter(F.col("n_ab") >= least)
    fa = freq.select("g", F.col("i").alias("a"), F.col("n_i").alias("n_a"))
    fb = freq.select("g", F.col("i").alias("b"), F.col("n_i").alias("n_b"))
    return counts.join(fa, ["g", "a"]).join(fb, ["g", "b"]), freq


def fit_configuration(degrees: np.ndarray, d_n: np.ndarray, sizes: np.ndarray, s_n: np.ndarray, rounds: int = 2000, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Fitnesses x per distinct item frequency and y per distinct basket size, by fixed-point rounds on the expected degrees."""
    total = float((degrees * d_n).sum())
    full = degrees >= s_n.sum()  # an item of every basket meets each with probability 1
    x, y = degrees / np.sqrt(total), sizes / np.sqrt(total)
    x = np.where(full, 1e9, x)
    for _ in range(rounds):
        x1 = np.where(full, 1e9, degrees / (s_n * y / (1 + x[:, None] * y)).sum(1))
        y1 = sizes / (d_n * x1 / (1 + x1 * y[:, None])).sum(1)
        done = np.max(np.abs(y1 - y) / y) < tol
        x, y = x1, y1
        if done:
            break
    return x, y


def _fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    d, s = pdf[pdf.kind == "item"].sort_values("k"), pdf[pdf.kind == "basket"].sort_values("k")
    x, y = fit_configuration(d.k.to_numpy(float), d.n.to_numpy(float), s.k.to_numpy(float), s.n.to_numpy(float))
    one = pd.DataFrame({"g": key[0], "degree": d.k.astype("int64"), "x": x})
    one["y"] = [list(y)] * len(one)
    one["y_n"] = [list(s.n.astype(float))] * len(one)
    return one


def tail(k: np.ndarray, q: np.ndarray, n: np.ndarray, direct: int = 1_000) -> np.ndarray:
    """P(X >= k) for X a sum of independent Binomial(n[j, s], q[j, s]) over s, one row each, truncated where the rest is below 1e-12 of the result.
    Counts up to ``direct`` are convolved, larger ones go through ``tilted_tail``. Counts up to the mean come from the complement, where nothing
    cancels; the others from the tail itself."""
    mean = (n * q).sum(1)
    far_out = np.flatnonzero(k > direct)
    out = np.empty(len(k))
    for i in far_out:
        out[i] = tilted_tail(int(k[i]), q[i], n[i])
    low, far = (k <= mean) & (k <= direct), (k > 2 * mean) & (k <= direct)
    near = (k <= direct) & ~low & ~far
    for part, span in ((low, 0), (near, 45 + int(np.ceil(10 * np.sqrt(mean[near].max(initial=0))))), (far, 45)):
        rows = np.flatnonzero(part)
        rows = rows[np.argsort(k[rows], kind="stable")]
        start = 0
        while start < len(rows):
            # rows of like counts together, so many that their table stays small
            size = max(1, min(2048, 1_000_000 // (int(k[rows[min(start + 2047, len(rows) - 1)]]) + span + 1)))
            r = rows[start : start + size]
            start += size
            length = int(k[r].max()) + span + 1
            pmf = np.zeros((len(r), length))
            pmf[:, 0] = 1
            j = np.arange(1, length)
            for s in range(q.shape[1]):
                qs, ns = np.clip(q[r, s], 0, 1 - 1e-12), n[r, s]
                with np.errstate(divide="ignore"):  # by logarithms: the chance of none underflows in large groups
                    steps = np.log(np.maximum(ns[:, None] - j + 1, 0) / j) + np.log(qs / (1 - qs))[:, None]
                one = np.exp((ns * np.log1p(-qs))[:, None] + np.c_[np.zeros(len(r)), np.cumsum(steps, 1)])
                top = int(np.flatnonzero(one.any(0)).max(initial=0)) + 1
                new = np.zeros_like(pmf)
                for d in range(top):
                    new[:, d:] += pmf[:, : length - d] * one[:, d : d + 1]
                pmf = new
            at = np.arange(length)
            out[r] = 1 - (pmf * (at < k[r][:, None])).sum(1) if span == 0 else (pmf * (at >= k[r][:, None])).sum(1)
    return np.clip(out, 0, 1)


def tilted_tail(k: int, q: np.ndarray, n: np.ndarray) -> float:
    """The same for one large count: the success probabilities are tilted until k is the mean, the tilted distribution near k comes from its
    characteristic function by one Fourier transform, and is tilted back. Time and memory grow with the square root of k."""
    q, n = q[(q > 0) & (n > 0)], n[(q > 0) & (n > 0)]
    q = np.minimum(q, 1 - 1e-12)
    if k > n.sum():
        return 0.0
    complement = k <= (n * q).sum()
    at = min(max(k, 0.5), n.sum() - 0.5)
    lo, hi = -60.0, 60.0
    for _ in range(200):
        t = (lo + hi) / 2
        e = np.exp(t)
        lo, hi = (t, hi) if (n * q * e / (1 - q + q * e)).sum() < at else (lo, t)
    r = q * np.exp(t) / (1 - q + q * np.exp(t))
    log_mass = float((n * np.log(1 - q + q * np.exp(t))).sum())
    half = int(14 * np.sqrt((n * r * (1 - r)).sum()) + 60)
    size = 1 << int(2 * half).bit_length()
    first = k - size // 2
    w = 2 * np.pi * np.arange(size) / size
    phi = np.exp((n[:, None] * np.log(1 - r[:, None] + r[:, None] * np.exp(1j * w))).sum(0) - 1j * w * first)
    pmf = np.maximum(np.fft.fft(phi).real / size, 0)
    x = first + np.arange(size)
    pmf[(x < 0) | (x > n.sum())] = 0
    side = x < k if complement else x >= k
    p = float((pmf[side] * np.exp(log_mass - t * x[side])).sum())
    return 1 - p if complement else p


def surprise(rows: DataFrame, group: str, basket: str, item: str, low: int = 2, high: int = 30, least: int = 2, alpha: float = 0.05) -> DataFrame:
    """(g, a, b, n, n_a, n_b, n_ab, lift, p_value, significant) for each pair of items of a group with ``least`` common baskets.
    With ``least`` 1 every observed pair is counted, ranked and tested; above it ``significant`` is null, as ranks over some of the pairs mean nothing.

    n: the group's baskets of ``low`` to ``high`` items. lift = n_ab n / (n_a n_b). p_value: chance of n_ab or more under the null model.
    significant: p_value is under the Benjamini-Hochberg threshold at ``alpha`` over all pairs of the group's items. a < b by code point.
    Repeated rows count once; groups without any basket of that size give no rows.
    """
    b = cut(baskets(rows, group, basket, item, low, high))
    pairs, freq = pair_counts(b, least)
    pairs = cut(pairs)
    sizes = b.groupBy("g", "c").agg(F.first("size").alias("k")).groupBy("g", "k").agg(F.count(F.lit(1)).alias("n"))
    hist = freq.groupBy("g", F.col("n_i").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    both = hist.withColumn("kind", F.lit("item")).unionByName(sizes.withColumn("kind", F.lit("basket")))
    fit = both.groupBy("g").applyInPandas(_fit, "g string, degree long, x double, y array<double>, y_n array<double>")
    totals = sizes.groupBy("g").agg(F.sum("n").alias("n")).join(hist.groupBy("g").agg(F.sum("n").alias("items")), "g")

    @F.pandas_udf("double")
    def tails(k: pd.Series, xa: pd.Series, xb: pd.Series, y: pd.Series, y_n: pd.Series) -> pd.Series:
        if not len(k):
            return pd.Series([], dtype=float)
        wide = max(map(len, y))
        yy, nn = (np.array([np.pad(np.asarray(v, float), (0, wide - len(v))) for v in z]) for z in (y, y_n))
        pa, pb = (z.to_numpy()[:, None] * yy / (1 + z.to_numpy()[:, None] * yy) for z in (xa, xb))
        return pd.Series(tail(k.to_numpy(), pa * pb, nn))

    low_n, high_n = F.least("n_a", "n_b").alias("lo"), F.greatest("n_a", "n_b").alias("hi")
    kinds = pairs.groupBy("g", low_n, high_n, "n_ab").agg(F.count(F.lit(1)).alias("pairs"))
    fa = fit.select("g", F.col("degree").alias("lo"), F.col("x").alias("xa"))
    fb = fit.select("g", F.col("degree").alias("hi"), F.col("x").alias("xb"), "y", "y_n")
    kinds = kinds.join(fa, ["g", "lo"]).join(fb, ["g", "hi"])
    kinds = kinds.select("g", "lo", "hi", "n_ab", "pairs", tails("n_ab", "xa", "xb", "y", "y_n").alias("p_value"))
    ranked = running_sum(kinds, ["g"], ["p_value", "lo", "hi", "n_ab"], F.col("pairs"), "rank").join(totals, "g")
    tests = F.col("items") * (F.col("items") - 1) / 2
    cut_at = ranked.groupBy("g").agg(F.max(F.when(F.col("p_value") <= alpha * F.col("rank") / tests, F.col("p_value"))).alias("cut_at"))
    kinds = ranked.join(cut_at, "g").select("g", "lo", "hi", "n_ab", "n", "p_value", F.coalesce(F.col("p_value") <= F.col("cut_at"), F.lit(False)).alias("significant"))
    kinds = cut(kinds)
    # most rare pairs of a group are of one kind: kinds go to the pairs if they are counted few, else skew handling splits the hot kind
    kinds = F.broadcast(kinds) if kinds.limit(KINDS + 1).count() <= KINDS else kinds
    keyed = pairs.withColumns({"lo": F.least("n_a", "n_b"), "hi": F.greatest("n_a", "n_b")})
    return keyed.join(kinds, ["g", "lo", "hi", "n_ab"]).select(
        "g", "a", "b", "n", "n_a", "n_b", "n_ab", (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"), "p_value", F.col("significant") if least == 1 else F.lit(None).cast("boolean").alias("significant")
    )
