"""Cloned code: normalised tokens, winnowed fingerprints, maximal runs on the diagonals of two texts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codestrata.session import cut, spread

# Fixed: words that keep their own text when tokens are normalised; all other names become I, numbers N, strings S.
KEYWORDS = (
    "if elif else for while match break continue pass return class class_name extends is in as self signal func static const enum var await and or not true false null super def "
    "from global import lambda nonlocal raise try except finally with yield assert async del None True False switch case default do function new let export type interface map "
    "range go defer public private protected void nil this throw catch typeof instanceof of package struct chan select"
).split()
LITERAL = ["S", "N", ",", ":", "[", "]", "{", "}", "(", ")"]
_STRING = r"\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)*'?"
_REST = r"|[A-Za-z_][A-Za-z_0-9]*|[0-9][0-9A-Za-z_.]*|[^\sA-Za-z_0-9]"
HASH_TOKEN = r"(#.*|" + _STRING + _REST + ")"
SLASH_TOKEN = r"(//.*|/\*.*?\*/|`[^`]*`?|" + _STRING + _REST + ")"
HASHED = r"\.(gd|py|rb|sh|bash)$"


def normal(token: Column) -> Column:
    """The normal form of a token."""
    first = F.left(token, F.lit(1))
    return (
        F.when(first.isin('"', "'", "`"), "S").when(token.rlike("^[0-9]"), "N")
        .when(token.rlike("^[A-Za-z_]") & ~token.isin(KEYWORDS), "I").otherwise(token)
    )


def token_arrays(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(repo, key, toks, lines), one row per file (repo, key, path, text): the normalised tokens of each line, comments left out, with their lines.
    Strings and comments are read line by line. Null texts have none."""
    unified = F.regexp_replace("text", "\r\n?", "\n")
    hashed = F.col("path").rlike(HASHED)
    # lower bound of a comment: its first characters
    keep = lambda t: ~(F.when(hashed, t.startswith("#")).otherwise(t.startswith("//") | t.startswith("/*")))
    find = lambda l: F.when(hashed, F.regexp_extract_all(l, F.lit(HASH_TOKEN), F.lit(1))).otherwise(F.regexp_extract_all(l, F.lit(SLASH_TOKEN), F.lit(1)))
    per = F.transform(F.split(unified, "\n"), lambda l, i: F.transform(F.filter(find(l), keep), lambda t: F.struct(normal(t).alias("tok"), (i + 1).alias("line"))))
    flat = spread(files.filter(F.col("text").isNotNull()).select("repo", key, "path", "text")).select("repo", key, F.flatten(per).alias("x"))
    return flat.select("repo", key, F.col("x.tok").alias("toks"), F.col("x.line").alias("lines"))


def winnow(toks: list[str], k: int, window: int) -> list[tuple[str, int]]:
    """(hash, position from 1): of each ``window`` successive k-gram hashes the smallest, the rightmost of equals, each once."""
    grams = [md5(" ".join(toks[i : i + k]).encode()).hexdigest() for i in range(len(toks) - k + 1)]
    if not grams:
        return []
    out: list[tuple[str, int]] = []
    best: deque[int] = deque()  # places of falling minima; the front is the window's
    for i, h in enumerate(grams):
        while best and grams[best[-1]] >= h:
            best.pop()
        best.append(i)
        if best[0] <= i - window:
            best.popleft()
        if i >= window - 1 or i == len(grams) - 1:
            f = (grams[best[0]], best[0] + 1)
            if not out or out[-1] != f:
                out.append(f)
    return out


def _bytes(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs."""
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0))).tobytes()


def _numbers(b: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_bytes``."""
    return np.frombuffer(b, f"u{len(b) // n}") if n else np.zeros(0, np.uint8)


def packed(arrays: DataFrame, key: str = "file_id") -> DataFrame:
    """(repo, key, words, n, codes, steps) from token arrays (repo, key, toks, lines): a text's distinct tokens, the place of each of its ``n`` tokens
    among them, and how many lines each stands below the one before, as bytes. A token takes two bytes or little more; as rows of Spark it takes twenty."""
    out = f"repo string, {key} {dict(arrays.dtypes)[key]}, words array<string>, n int, codes binary, steps binary"
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks, lines = b.column("toks"), b.column("lines")
            rows: list[tuple] = []
            held = 0
            for k in range(b.num_rows):  # one text at a time
                t = toks[k].values.dictionary_encode()
                codes, ln = t.indices.to_numpy(zero_copy_only=False), lines[k].values.to_numpy(zero_copy_only=False)
                rows.append((b.column("repo")[k].as_py(), b.column(key)[k].as_py(), t.dictionary.to_pylist(), len(codes), _bytes(codes), _bytes(np.diff(ln, prepend=0))))
                held += len(codes)
                if held >= 2_000_000 or k == b.num_rows - 1:
                    yield _batch(rows, schema)
                    rows, held = [], 0

    return arrays.select("repo", key, "toks", "lines").mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], f.type) for n, f in enumerate(schema)], schema=schema)


def _mark(toks: list[str]) -> int:
    """A number of four bytes, equal for equal tokens."""
    return int.from_bytes(md5(" ".join(toks).encode()).digest()[:4], "little", signed=True)


def fingerprints(arrays: DataFrame, key: str = "file_id", k: int = 25, window: int = 10, beside: int = 0) -> DataFrame:
    """(repo, key, h, pos): the winnowed fingerprints of token arrays (repo, key, toks), or of packed ones. One pass over Arrow batches without a
    shuffle. ``beside``: also the marks ``before`` and ``after`` of so many tokens on either side, null where the text has fewer there."""
    kinds, k_ = dict(arrays.dtypes), k
    out = f"repo string, {key} {kinds[key]}, h string, pos int" + ", before int, after int" * (beside > 0)
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k in range(b.num_rows):  # one text at a time: a batch holds millions of tokens
                r, i, t, *rest = (c[k].as_py() for c in b.columns)
                if rest:
                    t = [t[x] for x in _numbers(rest[1], rest[0]).tolist()]
                found = [(r, i, h, p) for h, p in winnow(t, k_, window)]
                if beside > 0:
                    found = [(*x, _mark(t[p - beside : p]) if p >= beside else None, _mark(t[p + k_ : p + k_ + beside]) if p + k_ + beside <= len(t) else None) for x in found for p in (x[3] - 1,)]
                rows += found
                if len(rows) >= 20_000 or k == b.num_rows - 1:
                    yield _batch(rows, schema)
                    rows = []

    return arrays.select("repo", key, *(["toks"] if "toks" in kinds else ["words", "n", "codes"])).mapInArrow(run, out)


def runs_of(x: np.ndarray, y: np.ndarray, lx: np.ndarray, ly: np.ndarray, data: np.ndarray, same: bool, seeds: np.ndarray, k: int, shortest: int, rows: int = 6, literal: float = 0.62, kinds: int = 12) -> list[tuple]:
    """(a_start, b_start, tokens, a_line, a_end_line, b_line, b_end_line, outermost) of two arrays of token numbers, equal for equal tokens, with seeds
    (shift * 2^32 + place in x from 0). ``data``: which of x's numbers are literals."""
    out = []
    by_shift: dict[int, list[int]] = {}
    for d, p in zip((seeds >> 32).tolist(), (seeds & 0xFFFFFFFF).tolist()):
        by_shift.setdefault(d, []).append(p)
    for d, places in by_shift.items():
        lo, hi = max(0, -d), min(len(x), len(y) - d)
        equal = np.concatenate([[False], x[lo:hi] == y[lo + d : hi + d], [False]])
        breaks = np.flatnonzero(~equal) + lo - 1  # a run lies between two successive breaks
        done = set()
        for p in places:
            j = int(np.searchsorted(breaks, p))
            s, t = int(breaks[j - 1]) + 1, int(breaks[j])
            if s in done or p + k > t:
                continue
            done.add(s)
            n = min(t - s, d) if same else t - s
            if n < shortest:
                continue
            counts = np.bincount(x[s : s + n], minlength=len(data))
            if counts[data].sum() > literal * n or np.count_nonzero(counts) < kinds or lx[s + n - 1] - lx[s] + 1 < rows:
                continue
            out.append((s + 1, s + d + 1, n, int(lx[s]), int(lx[s + n - 1]), int(ly[s + d]), int(ly[s + d + n - 1])))
    out.sort(key=lambda r: (-r[2], r[0], r[1]))
    kept: list[tuple] = []
    done_rows = []
    for r in out:
        outer = not any(q[3] <= r[3] and r[4] <= q[4] and q[5] <= r[5] and r[6] <= q[6] for q in kept)
        if outer:
            kept.append(r)
        done_rows.append((*r, outer))
    return done_rows


def pair_seeds(texts: DataFrame, key: str = "file_id", k: int = 25, window: int = 10, most: int = 12, shortest: int = 70) -> DataFrame:
    """(repo, a, b, seeds): which texts of a repository may share a run of ``shortest`` tokens, and on which diagonals (shift * 2^32 + place in a from 0).

    A run of that length around a common fingerprint goes on for half of what the fingerprint leaves of it on one side at least, so a seed whose
    texts differ within that half on both sides is in none. Most pairs have only such seeds, and their texts needn't meet. No run is lost."""
    half = max(0, -((k - shortest) // 2))
    f = cut(fingerprints(texts, key, k, window, half).withColumn("h", F.unhex("h")))
    occ = f.groupBy("repo", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, most)).select("repo", "h")
    f = f.join(occ, ["repo", "h"])
    beside = ["before", "after"] if half else []
    side = lambda name, end: f.select("repo", "h", F.col(key).alias(name), F.col("pos").alias("p" + name), *[F.col(c).alias(c + end) for c in beside])
    pairs = side("a", "_a").join(side("b", "_b"), ["repo", "h"]).filter((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("pb") - F.col("pa") >= k)))
    if half:
        pairs = pairs.filter("before_a = before_b or after_a = after_b")
    seed = (F.col("pb") - F.col("pa")).cast("long") * (1 << 32) + (F.col("pa") - 1)
    return pairs.groupBy("repo", "a", "b").agg(F.collect_set(seed).alias("seeds"))


def clone_runs(arrays: DataFrame, key: str = "file_id", k: int = 25, window: int = 10, most: int = 12, shortest: int = 70) -> DataFrame:
    """(repo, a, b, a_start, b_start, tokens, a_line, a_end_line, b_line, b_end_line, outermost): maximal runs of ``shortest`` or more equal tokens
    between two texts of a repository (a < b) or two places of one (a = b), from token arrays (repo, key, toks, lines).

    Fingerprints that stand 2 to ``most`` times in a repository seed the diagonals; those above ``most`` are boilerplate by the definition of a clone
    here. A run within one file ends where its copy begins. Runs that are mostly literals, of fewer than 12 kinds of tokens or on fewer than six
    lines are data, not logic. ``outermost``: not within a longer run of the same two files, by lines on both sides. A pair's two texts meet in one
    row, packed, with all its seeds (bounded by the two texts), whatever the number of its diagonals.
    """
    kind = dict(arrays.dtypes)[key]
    texts = cut(packed(arrays, key))
    seeds = cut(pair_seeds(texts, key, k, window, most, shortest))
    side = lambda name, end: texts.select("repo", F.col(key).alias(name), *[F.col(c).alias(c + end) for c in ("words", "n", "codes", "steps")])
    d = seeds.join(side("a", "_a"), ["repo", "a"]).join(side("b", "_b"), ["repo", "b"])
    names = ["a_start", "b_start", "tokens", "a_line", "a_end_line", "b_line", "b_end_line"]

    out, k_ = f"repo string, a {kind}, b {kind}, " + ", ".join(f"{n} int" for n in names) + ", outermost boolean", k
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for n in range(batch.num_rows):  # one pair of texts at a time
                r, i, j, _, wa, na, ca, sa, wb, nb, cb, sb = (c[n].as_py() if m != 3 else None for m, c in enumerate(batch.columns))
                at = {w: q for q, w in enumerate(wa)}
                theirs = np.array([at.get(w, -1) for w in wb], np.int32)
                data = np.array([w in LITERAL for w in wa], bool)
                seeds = batch.column(3)[n].values.to_numpy(zero_copy_only=False)
                lines = [np.cumsum(_numbers(s, m), dtype=np.int64) for s, m in ((sa, na), (sb, nb))]
                found = runs_of(_numbers(ca, na), theirs[_numbers(cb, nb)], *lines, data, i == j, seeds, k_, shortest)
                rows += [(r, i, j, *q) for q in found]
            yield _batch(rows, schema)

    return d.select("repo", "a", "b", "seeds", *[c + end for end in ("_a", "_b") for c in ("words", "n", "codes", "steps")]).mapInArrow(run, out)


def outermost(runs: DataFrame) -> DataFrame:
    """Runs that don't lie inside a longer run of the same pair of files on both sides."""
    return runs.filter("outermost").drop("outermost")


def duplicated_lines(runs: DataFrame) -> DataFrame:
    """(repo, file, dup_lines): distinct lines of a file that some outermost run covers, on either side of it."""
    o = outermost(runs)
    a = o.select("repo", F.col("a").alias("file"), F.explode(F.sequence("a_line", "a_end_line")).alias("line"))
    b = o.select("repo", F.col("b").alias("file"), F.explode(F.sequence("b_line", "b_end_line")).alias("line"))
    return a.union(b).distinct().groupBy("repo", "file").agg(F.count(F.lit(1)).alias("dup_lines"))
