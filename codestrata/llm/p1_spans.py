"""Problem 1: long exact spans shared between records.

1. Anchors. Of every window of ``span - K + 1`` successive K-character hashes the smallest is an anchor (the rightmost of equals), so two
   equal runs of ``span`` characters hold the same anchor at the same place. Around it a run of ``span`` extends at least
   ``(span - K) / 2`` to the left or to the right; anchors whose hash together with that context stands in one record only can't be part of
   a shared run. This filter loses nothing and drops headings that many records share but that are shorter.
2. Shards. The text around each remaining anchor (all of it that a run of ``span`` through the anchor can touch) goes to the shard of its
   anchor hash; equal pieces are indexed once, with their records as members. Equal runs meet in the shard of their anchor: shards are
   independent. An anchor with more than ``block`` different surroundings is split into blocks of index and query rows.
3. FM-index. Each shard builds a compressed FM-index of its pieces (wavelet matrix over packed bits). All pieces are streamed against it by
   backward search from a grid of ends right of the anchor; intervals of the suffix order that hold another piece name the candidates, and
   the run through the anchor is measured exactly in both texts. Runs of ``span`` or more are reported.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.fm_index import FMIndex
from codestrata.session import cut, spread

K = 64
RUNS = "h long, a long, b long, left int, right int"


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * np.uint64(0xD6E8FEB86659FD93) + (y ^ (y >> np.uint64(31))) * np.uint64(0xA0761D6478BD642F)
    return z ^ (z >> np.uint64(32))


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k code points from each place (k a power of two)."""
    h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 1
    while step < k:
        h = _mix(h[: len(h) - step], h[step:])
        step *= 2
    return h


def anchors(text: str, span: int) -> list[tuple[int, int, int | None, int | None]]:
    """(hash, place, left context key, right context key) of the text's anchors; a context that the text is too short for is None."""
    if len(text) < span:
        return []
    h = gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    width, half = span - K + 1, (span - K) // 2
    low = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    at = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    hashes = h[at]

    def context(first: int) -> np.ndarray:
        places = [first + d for d in (*range(0, half - K, K), half - K)]
        key = hashes
        for p in places:
            key = _mix(key, h[np.clip(at + p, 0, len(h) - 1)])
        return key

    left, right = context(-half).view(np.int64), (~context(K)).view(np.int64)
    no_left, no_right = at < half, at + K + half > len(text)
    return [
        (int(x), int(p), None if nl else int(lk), None if nr else int(rk))
        for x, p, lk, rk, nl, nr in zip(hashes.view(np.int64), at, left, right, no_left, no_right)
    ]


def anchor_rows(ids: Iterable[int], texts: Iterable[str], span: int) -> pd.DataFrame:
    """(id, h, place, lk, rk) of the anchors of some texts. Keys are 64-bit integers all the way: a float between would round them."""
    rows = [(i, *a) for i, t in zip(ids, texts) for a in anchors(t, span)]
    i, h, place, lk, rk = zip(*rows) if rows else ((),) * 5
    keys = lambda x: pd.arrays.IntegerArray(np.array([k or 0 for k in x], np.int64), np.array([k is None for k in x], bool))
    return pd.DataFrame({"id": np.array(i, np.int64), "h": np.array(h, np.int64), "place": np.array(place, np.int32), "lk": keys(lk), "rk": keys(rk)})


def shared_runs(pdf: pd.DataFrame, span: int, grid: int = 84) -> pd.DataFrame:
    """Runs between the pieces of one shard: columns h, piece, text, place (of the anchor in the text), role (0: index and query, 1: index, 2: query)."""
    pdf = pdf.sort_values(["h", "piece", "role"], kind="stable").reset_index(drop=True)
    lens = pdf.text.str.len().to_numpy()
    joined = np.frombuffer("\0".join(pdf.text).encode("utf-32-le") + b"\0\0\0\0", np.uint32)
    alphabet, codes = np.unique(joined, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    first = np.r_[0, np.cumsum(lens + 1)[:-1]]
    codes[first + lens] = 0  # 0 stands between the texts only: a NUL inside a text is a character like others
    role, place, h = pdf.role.to_numpy(), pdf.place.to_numpy(), pdf.h.to_numpy()
    one = bool((role == 0).all())
    index_rows = np.flatnonzero(role != 2)
    width = span - K
    mat = np.zeros((len(pdf), 2 * width + K), np.int32)
    for i in range(len(pdf)):
        c = codes[first[i] : first[i] + lens[i]]
        mat[i, width - place[i] : width - place[i] + lens[i]] = c
    if one:
        text, where = codes, first
    else:
        text = np.concatenate([codes[first[i] : first[i] + lens[i] + 1] for i in index_rows]) if len(index_rows) else np.zeros(1, np.int64)
        where = np.r_[0, np.cumsum(lens[index_rows] + 1)[:-1]] if len(index_rows) else np.zeros(1, np.int64)
    index = FMIndex(text, len(alphabet) + 1, span)
    asked = np.flatnonzero(role != 1)
    ends = np.arange(0, width + 1, grid)
    q = np.repeat(asked, len(ends))
    right = np.tile(ends, len(asked))
    left = np.maximum(width - grid + 1 - right, 0)
    fits = (place[q] - left >= 0) & (place[q] + K + right <= lens[q])
    q, right, left = q[fits], right[fits], left[fits]
    start, end = first[q] + place[q] - left, first[q] + place[q] + K + right
    number, lo, hi = index.search(codes, start, end, 2 if one else 1)
    pairs: list[np.ndarray] = []
    order = np.argsort(number, kind="stable")
    number, lo, hi = number[order], lo[order], hi[order]
    bound = np.r_[0, np.cumsum(hi - lo)]
    i = 0
    while i < len(number):  # rows of the suffix order in portions
        j = max(i + 1, int(np.searchsorted(bound, bound[i] + 4_000_000, "right")) - 1)
        n = (hi - lo)[i:j]
        rows = np.repeat(lo[i:j], n) + np.arange(n.sum()) - np.repeat(bound[i:j] - bound[i], n)
        at = index.sa[rows]
        owner = np.searchsorted(where, at, "right") - 1
        asks = np.repeat(number[i:j], n)
        own = index_rows[owner] if not one else owner
        ok = (h[own] == h[q[asks]]) & (at - where[owner] == place[own] - left[asks])
        ok &= own > q[asks] if one else np.ones(len(ok), bool)
        pairs.append(np.unique(np.c_[q[asks][ok], own[ok]], axis=0))
        i = j
    p = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    out = []
    for i in range(0, len(p), 20_000):
        a, b = p[i : i + 20_000].T
        neq = (mat[a] != mat[b]) | (mat[a] == 0)
        le = np.where(neq[:, :width].any(1), np.argmax(neq[:, :width][:, ::-1], 1), width)
        ri = np.where(neq[:, width + K :].any(1), np.argmax(neq[:, width + K :], 1), width)
        ok = ~neq[:, width : width + K].any(1) & (le + K + ri >= span)
        out.append(np.c_[a[ok], b[ok], le[ok], ri[ok]])
    r = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    piece = pdf.piece.to_numpy()
    whole = np.flatnonzero((role == 0) & (lens >= span)) if one else np.zeros(0, np.int64)
    a, b = np.r_[r[:, 0], whole], np.r_[r[:, 1], whole]
    return pd.DataFrame({"h": h[a], "a": piece[a], "b": piece[b], "left": np.r_[r[:, 2], place[whole]].astype("int32"), "right": np.r_[r[:, 3], (lens - place - K)[whole]].astype("int32")})


def spans(files: DataFrame, span: int = 400, shard_chars: int = 2_000_000, block: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """(runs, members) of records (id, text); ``span`` characters (code points) at least, ``span - 64`` must be 64 or more.

    members: (h, piece, id, place), the anchor ``place`` of a record whose surroundings are ``piece``. runs: (h, a, b, left, right): pieces a
    and b agree from ``left`` characters before the anchor to ``right`` after its 64; a = b for a piece that agrees with itself.
    Null ids or texts and texts shorter than ``span`` hold no run; repeated rows count once.
    """
    if span < 3 * K:
        raise ValueError(f"span must be {3 * K} or more")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield anchor_rows(b.id, b.text, span)

    texts = files.select("id", "text").filter(F.col("id").isNotNull() & (F.char_length("text") >= span))
    found = spread(texts).mapInPandas(find, "id long, h long, place int, lk long, rk long")
    keys = found.select("id", "h", "place", F.explode(F.array("lk", "rk")).alias("key")).filter(F.col("key").isNotNull())
    keys = cut(keys)
    several = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    kept = keys.join(several, "key", "left_semi").groupBy("id").agg(F.collect_set(F.struct("place", "h")).alias("at"))
    width = span - K

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, at in zip(b.id, b.text, b["at"]):
                for x in at:
                    p = x["place"]
                    s = max(0, p - width)
                    rows.append((i, x["h"], p, t[s : p + K + width], p - s))
            yield pd.DataFrame(rows, columns=["id", "h", "at", "text", "place"])

    pieces = texts.join(kept, "id").mapInPandas(cut_out, "id long, h long, at int, text string, place int")
    pieces = cut(pieces.withColumn("piece", F.xxhash64("text", "place")))
    members = pieces.select("h", "piece", "id", F.col("at").alias("place")).distinct()
    reps = pieces.groupBy("h", "piece").agg(F.first("text").alias("text"), F.first("place").alias("place"))
    size = pieces.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // shard_chars))
    many = reps.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    split = many.filter(F.col("n") > block).select("h", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    placed = reps.join(split, "h", "left")
    usual = placed.filter(F.col("nb").isNull()).select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("string").alias("shard"), "h", "piece", "text", "place", F.lit(0).alias("role"))
    hot = placed.filter(F.col("nb").isNotNull()).withColumn("mine", F.pmod("piece", F.col("nb")).cast("int"))
    other = hot.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    name = lambda i, j: F.concat_ws("/", F.col("h").cast("string"), i.cast("string"), j.cast("string")).alias("shard")
    # block i of the index meets blocks j >= i of the queries; a block meets itself as a usual shard
    as_index = other.filter(F.col("o") > F.col("mine")).select(name(F.col("mine"), F.col("o")), "h", "piece", "text", "place", F.lit(1).alias("role"))
    as_query = other.filter(F.col("o") < F.col("mine")).select(name(F.col("o"), F.col("mine")), "h", "piece", "text", "place", F.lit(2).alias("role"))
    alone = hot.select(name(F.col("mine"), F.col("mine")), "h", "piece", "text", "place", F.lit(0).alias("role"))
    tasks = usual.unionByName(as_index).unionByName(as_query).unionByName(alone)
    runs = tasks.groupBy("shard").applyInPandas(lambda pdf: shared_runs(pdf, span), RUNS)
    return cut(runs), members


def record_pairs(runs: DataFrame, members: DataFrame) -> DataFrame:
    """(file_a, file_b), smaller id first: records that share a run."""
    m = members.select("h", "piece", "id").distinct()
    a = runs.select("h", "a", "b").distinct().join(m.select("h", F.col("piece").alias("a"), F.col("id").alias("i")), ["h", "a"])
    b = a.join(m.select("h", F.col("piece").alias("b"), F.col("id").alias("j")), ["h", "b"]).filter(F.col("i") != F.col("j"))
    return b.select(F.least("i", "j").alias("file_a"), F.greatest("i", "j").alias("file_b")).distinct()


def shared_lengths(runs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, shared_chars, spans): how many characters of a record stand in runs shared with another record, and in how many stretches.

    Pieces are expanded to their records, not to pairs of records. A record's stretches are merged in one ordered pass over its own anchors.
    """
    sizes = members.groupBy("h", "piece").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    sides = runs.select("h", F.col("a").alias("piece"), F.col("b").alias("other"), "left", "right")
    sides = sides.union(runs.filter("a <> b").select("h", "b", "a", "left", "right"))
    sides = sides.join(sizes.withColumnRenamed("piece", "other"), ["h", "other"]).select("h", "piece", "left", "right", "lo", "hi")
    mine = members.join(sides, ["h", "piece"]).filter((F.col("lo") != F.col("id")) | (F.col("hi") != F.col("id")))
    iv = mine.select("id", (F.col("place") - F.col("left")).alias("s"), (F.col("place") + K + F.col("right")).alias("e")).groupBy("id", "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy("id").orderBy("s")
    upto = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.col("e") - F.greatest(F.col("s"), F.coalesce(upto, F.lit(-1))), F.lit(0))
    opens = F.when(upto.isNull() | (F.col("s") > upto), 1).otherwise(0)
    return iv.select("id", gain.alias("g"), opens.alias("o")).groupBy("id").agg(F.sum("g").alias("shared_chars"), F.sum("o").alias("spans"))
