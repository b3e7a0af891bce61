"""Snapshots and logs of repositories as DataFrames, and result sinks."""

from __future__ import annotations

import json
import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as X


def directory(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files(path, text), skipped(path, why)) of a directory tree that executors can read. Skipped directories, binary extensions and sizes are
    decided from the listing; a NUL in the first 8,000 bytes makes a file binary; bytes that are no UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    at = F.locate(base, F.col("path"))
    raw = raw.withColumn("rel", F.when(at > 0, F.substring("path", at + len(base), F.lit(1 << 20))).otherwise(F.col("path")))
    nul = F.position(F.lit(b"\0"), F.substring("content", 1, 8000)) > 0
    why = X.skip_reason(F.col("rel"), F.col("length"), nul)
    seen = raw.select(F.col("rel").alias("path"), why.alias("why"), "content")
    files = seen.filter("why is null").select("path", _utf8()("content").alias("text"))
    return files, seen.filter("why is not null").select("path", "why")


def _utf8():
    @F.pandas_udf("string")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: bytes(x).decode("utf-8", "replace"))

    return decode


def _git(root: str, *args: str, feed: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", root, *args], input=feed, capture_output=True, check=True).stdout


def ref_info(root: str, ref: str = "HEAD") -> dict:
    """Of a commit: sha, parent (none for the first), branch that holds it (the first by name), subject and time."""
    sha = _git(root, "rev-parse", ref).decode().strip()
    subject, ts, parents = _git(root, "log", "-1", "--format=%s%x1f%ct%x1f%P", sha).decode().strip("\n").split("\x1f")
    names = sorted(_git(root, "branch", "--contains", sha, "--format=%(refname:short)").decode().split("\n"))
    return {"sha": sha, "parent": parents.split(" ")[0] or None, "branch": next((n for n in names if n and not n.startswith("(")), ""), "subject": subject, "ts": int(ts)}


def at_ref(spark: SparkSession, root: str, ref: str = "HEAD", repo: str = "-", batch: int = 500) -> tuple[DataFrame, DataFrame, str]:
    """(files(repo, path, text), skipped(repo, path, why), sha) of a repository at any commit, without checking it out.

    The driver only lists the tree; the blobs are read by tasks, ``batch`` of them a call, from the repository's folder, which executors must share.
    Skipped directories, binary extensions and sizes are decided from the listing, a NUL in the first 8,000 bytes from the blob.
    """
    sha = _git(root, "rev-parse", ref).decode().strip()
    rows = []
    for entry in _git(root, "ls-tree", "-r", "-z", "--long", sha).split(b"\0"):
        meta, _, path = entry.partition(b"\t")
        kind = meta.split()
        if len(kind) == 4 and kind[1] == b"blob":
            rows.append((path.decode("utf-8", "replace"), kind[2].decode(), int(kind[3]) if kind[3].isdigit() else 0))
    listing = spark.createDataFrame(rows, "path string, blob string, size long").withColumn("why", X.skip_reason(F.col("path"), F.col("size"), F.lit(False)))

    def read(batches):
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                data, at, out = _git(root, "cat-file", "--batch", feed="".join(x + "\n" for x in part.blob).encode()), 0, []
                for path in part.path:
                    eol = data.index(b"\n", at)
                    size = int(data[at:eol].split()[2])
                    blob = data[eol + 1 : eol + 1 + size]
                    at = eol + 2 + size
                    nul = b"\0" in blob[:8000]
                    out.append((path, None if nul else blob.decode("utf-8", "replace"), "binary" if nul else None))
                yield pd.DataFrame(out, columns=["path", "text", "why"])

    got = listing.filter("why is null").mapInPandas(read, "path string, text string, why string")
    name = F.lit(repo).alias("repo")
    skipped = listing.filter("why is not null").select(name, "path", "why").union(got.filter("why is not null").select(name, "path", "why"))
    return got.filter("why is null").select(name, "path", "text"), skipped, sha


LOG_FORMAT = "%x1e%H%x1f%at%x1f%an%x1f%s%x1f%b%x1f"


def write_log(root: str, target: str, ref: str = "HEAD", limit: int = 5000) -> str:
    """Writes a repository's log up to a commit (its last ``limit`` commits, oldest first, no merges, renames followed) to a text file that ``read_log``
    reads; git writes the file itself."""
    with open(target, "wb") as f:
        subprocess.run(["git", "-C", root, "log", ref, "--reverse", "--no-merges", "-M", "--numstat", f"-n{limit}", f"--format={LOG_FORMAT}"], stdout=f, check=True)
    return target


def read_log(spark: SparkSession, path: str, repo: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, commit_files, renames) of log files written by ``write_log``. Binary changes have no counts."""
    raw = spark.read.option("lineSep", "\x1e").text(path).filter(F.length(F.trim("value")) > 0)
    p = F.split("value", "\x1f")
    c = raw.select(F.monotonically_increasing_id().alias("ord"), F.get(p, F.lit(0)).alias("sha"), F.get(p, F.lit(1)).cast("long").alias("ts"), F.get(p, F.lit(2)).alias("author"), F.get(p, F.lit(3)).alias("subject"), F.get(p, F.lit(4)).alias("body"), F.get(p, F.lit(5)).alias("stat"))
    commits = c.select(F.lit(repo).alias("repo"), "ord", "sha", "ts", "author", "subject", "body")
    rows = c.select("sha", "ord", F.explode(F.split("stat", "\n")).alias("r")).select("sha", "ord", F.split("r", "\t").alias("x")).filter(F.size("x") == 3)
    files = rows.select("sha", "ord", F.expr("try_cast(x[0] AS INT)").alias("added"), F.expr("try_cast(x[1] AS INT)").alias("deleted"), F.col("x")[2].alias("spec"))
    from codestrata.operators.history import rename_expansion

    moved = rename_expansion(files.filter(F.contains("spec", F.lit(" => "))))
    plain = files.filter(~F.contains("spec", F.lit(" => "))).select(F.lit(repo).alias("repo"), "sha", F.col("spec").alias("path"), "added", "deleted")
    return commits, plain.unionByName(moved.select(F.lit(repo).alias("repo"), "sha", F.col("new").alias("path"), "added", "deleted")), moved.select(F.lit(repo).alias("repo"), "sha", "ord", "old", "new")


_JSON_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_JSON_SPACE = re.compile(r"[ \t\n\r]*")
_JSON_REST = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")


def _keys_of(text: str) -> set[str]:
    """Every object key of a JSON text; ValueError for an invalid one. Texts that nest deeper than the interpreter's parser can follow are read without
    recursion."""
    keys: set[str] = set()
    try:
        json.loads(text, object_pairs_hook=lambda pairs: keys.update(k for k, _ in pairs), parse_int=len)
        return keys
    except RecursionError:
        keys.clear()
    open_: list[str] = []
    at, want = 0, "value"  # want: value, value or end of list, key, key or end of object, or what follows a value
    skip = lambda k: _JSON_SPACE.match(text, k).end()
    while True:
        at = skip(at)
        c = text[at : at + 1]
        if want == "next":
            if not open_:
                if c:
                    raise ValueError("more than one value")
                return keys
            if c == ",":
                want, at = "key" if open_[-1] == "{" else "value", at + 1
            elif c and c == {"{": "}", "[": "]"}[open_[-1]]:
                open_.pop()
                at += 1
            else:
                raise ValueError("no end")
        elif want in ("value end", "key end") and c == ("]" if want == "value end" else "}"):
            open_.pop()
            want, at = "next", at + 1
        elif want.startswith("key"):
            m = _JSON_STRING.match(text, at)
            if not m or text[(colon := skip(m.end())) : colon + 1] != ":":
                raise ValueError("no key")
            keys.add(json.loads(m[0]))
            want, at = "value", colon + 1
        elif c in ("{", "[") and c:
            open_.append(c)
            want, at = "key end" if c == "{" else "value end", at + 1
        else:
            m = _JSON_STRING.match(text, at) or _JSON_REST.match(text, at)
            if not m:
                raise ValueError("no value")
            want, at = "next", m.end()


def json_keys(texts: DataFrame) -> DataFrame:
    """(repo, path, key): every object key at any depth of JSON texts (repo, path, text) of any size; invalid texts have none. One pass over Arrow
    batches: each text is read once, however deep it nests."""

    def run(batches):
        for b in batches:
            for repo, path, text in zip(b.repo, b.path, b.text):
                try:
                    keys = sorted(_keys_of(text))
                except ValueError:
                    continue
                for k in range(0, len(keys), 100_000):
                    part = keys[k : k + 100_000]
                    yield pd.DataFrame({"repo": [repo] * len(part), "path": [path] * len(part), "key": part})

    return texts.filter(F.col("text").isNotNull()).select("repo", "path", "text").mapInPandas(run, "repo string, path string, key string")


def write_json(df: DataFrame, target: str) -> None:
    """A result as JSON lines."""
    df.write.mode("overwrite").json(target)
