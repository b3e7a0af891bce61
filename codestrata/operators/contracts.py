"""String contracts between files: what is sent, declared, read and written under a name, and what is missing on one side.

All checks are anti-joins within a repository over a few plain relations: table_keys (repo, table_id, key, access, open, handled), sends (repo, table_id, key, file, line,
payload), consumed / produced (key), signals, imports, paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unknown_keys(sends: DataFrame, table_keys: DataFrame, registered: DataFrame | None = None, special: DataFrame | None = None) -> DataFrame:
    """Sends whose key the table does not know: (repo, table_id, key, file, line, severity, id). Blank keys, keys registered at run time and keys
    that a router compares with (repo, table_id, key) are fine. A key that would be indexed into a closed table is high; in another table with
    handlers it is dropped, low; tables without handlers (repo, table_id, key, access, open, handled) drop nothing."""
    on = ["repo", "table_id", "key"]
    miss = sends.filter(F.trim(F.coalesce("key", F.lit(""))) != "").join(table_keys.select(*on).distinct(), on, "left_anti")
    for fine in (registered, special):
        if fine is not None:
            miss = miss.join(fine.select(*on).distinct(), on, "left_anti")
    t = table_keys.groupBy("repo", "table_id").agg(F.bool_or(F.col("access") == "index").alias("indexed"), F.bool_or("open").alias("open"), F.bool_or("handled").alias("handled"))
    high = F.col("indexed") & ~F.col("open")
    j = miss.join(t, ["repo", "table_id"]).filter(high | F.col("handled"))
    return j.select(*on, "file", "line", F.when(high, "high").otherwise("low").alias("severity"), F.when(high, "contract.unknown-key").otherwise("contract.dropped-key").alias("id"))


def unsent_keys(sends: DataFrame, table_keys: DataFrame, literals: DataFrame | None = None, registered: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(repo, table_id, key) of tables with ``least`` sends that nobody sends or registers, nor names as a literal (repo, path, value) in another file
    than the table's (``table_id`` starts with its path and two colons)."""
    busy = sends.groupBy("repo", "table_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("repo", "table_id")
    on = ["repo", "table_id", "key"]
    k = table_keys.select(*on).distinct().join(busy, ["repo", "table_id"], "left_semi").join(sends.select(*on).distinct(), on, "left_anti")
    if registered is not None:
        k = k.join(registered.select(*on).distinct(), on, "left_anti")
    if literals is None:
        return k
    # a literal stands in one file only, or in two different ones at least: that is all that has to be known of its places
    l = literals.groupBy("repo", F.col("value").alias("key")).agg(F.min("path").alias("lo"), F.max("path").alias("hi"))  # noqa: E741
    own = F.substring_index("table_id", "::", 1)
    return k.join(l, ["repo", "key"], "left").filter(F.col("lo").isNull() | ((F.col("lo") == own) & (F.col("hi") == own))).select(*on)


def payload_missing(sends: DataFrame, required: DataFrame) -> DataFrame:
    """(repo, table_id, key, file, line, missing, severity): payload keys that the handler reads hard (repo, table_id, key, field, line, returns) but a
    send with a payload doesn't carry; low from tests (sends may have ``role``), medium where a return stands before the first such read, else high."""
    need = required.groupBy("repo", "table_id", "key").agg(F.array_sort(F.collect_set(F.struct("field", "line"))).alias("need"), F.max("returns").alias("returns"))
    j = sends.filter(F.col("payload").isNotNull()).join(need, ["repo", "table_id", "key"])
    j = j.withColumn("gone", F.filter("need", lambda n: ~F.array_contains("payload", n["field"]))).filter(F.size("gone") > 0)
    first = F.array_min(F.transform("gone", lambda n: n["line"]))
    late = F.coalesce(F.exists("returns", lambda r: r < first), F.lit(False))
    role = F.coalesce(F.col("role") == "test", F.lit(False)) if "role" in sends.columns else F.lit(False)
    sev = F.when(role, "low").when(late, "medium").otherwise("high")
    return j.select("repo", "table_id", "key", "file", "line", F.array_sort(F.array_distinct(F.transform("gone", lambda n: n["field"]))).alias("missing"), sev.alias("severity"))


# Fixed: what stands for a value in a format string.
PLACEHOLDER = r"%[sdfxi]|\{\w*\}"


def composed_pattern(format_: Column) -> Column:
    """A pattern for a format string with ``%s`` / ``%d`` / ``{}`` parts; null if it has none or is three characters or less."""
    quoted = F.regexp_replace(F.regexp_replace(format_, r"([.\\+*?\[\]^$()|{}])", r"\\$1"), r"%[sdfxi]|\\\{\w*\\\}", ".+")
    return F.when((F.char_length(format_) > 3) & format_.rlike(r"%[sdfx]|\{\}|\{\w+\}"), F.concat(F.lit("^"), quoted, F.lit("$")))


def composable(keys: DataFrame, formats: DataFrame, size: int = 3) -> DataFrame:
    """(repo, key) of keys (repo, key) that one of the format strings (repo, value) can have made. No format is forgotten and no key is held against
    all formats: the first ``size`` characters of a format's longest literal piece must stand in the key, so formats and keys meet in an equi-join on
    such pieces. Formats of placeholders alone only ask for a length."""
    f = formats.select("repo", "value").distinct().withColumn("pattern", composed_pattern(F.col("value"))).filter(F.col("pattern").isNotNull())
    pieces = F.split("value", PLACEHOLDER)
    longest = F.element_at(F.array_sort(F.transform(pieces, lambda p: F.struct(F.char_length(p).alias("n"), p.alias("p")))), -1)["p"]
    f = f.withColumns({"piece": F.left(longest, F.lit(size)), "holes": F.size(pieces) - 1})
    k = keys.select("repo", "key").filter(F.col("key").isNotNull()).distinct()
    n = F.char_length("key")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring("key", i, w))))
    e = k.select("repo", "key", F.explode(F.array_distinct(cuts)).alias("piece"))
    hit = e.join(f.filter("piece <> ''").select("repo", "piece", "pattern"), ["repo", "piece"]).filter(F.expr("key rlike pattern")).select("repo", "key")
    bare = f.filter("piece = ''").groupBy("repo").agg(F.min("holes").alias("holes"))
    return hit.union(k.join(bare, "repo").filter(F.char_length("key") >= F.col("holes")).select("repo", "key")).distinct()


def dangling(consumed: DataFrame, produced: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """(repo, key, reads, id): keys that are read (repo, key, guarded) but never written (repo, key) nor composed from a format string (repo, value).
    If all reads are guarded it is a dead branch, else a key never written."""
    c = consumed.join(produced.select("repo", "key").distinct(), ["repo", "key"], "left_anti")
    if formats is not None:
        c = c.join(composable(c, formats), ["repo", "key"], "left_anti")
    g = c.groupBy("repo", "key").agg(F.count(F.lit(1)).alias("reads"), F.bool_and("guarded").alias("guarded"))
    return g.select("repo", "key", "reads", F.when(F.col("guarded"), "contract.dead-branch").otherwise("contract.key-never-written").alias("id"))


def missing_members(refs: DataFrame, declared: DataFrame, ancestors: DataFrame) -> DataFrame:
    """References (repo, class, member, file, line) to members that neither the class nor its ancestors (repo, name, ancestor) declare (repo, class,
    member). Classes without any declaration here (engine types) are left out."""
    own = declared.select("repo", "class").distinct()
    up = ancestors.select("repo", F.col("name").alias("class"), "ancestor").union(own.select("repo", "class", "class"))
    known = up.join(declared.select("repo", F.col("class").alias("ancestor"), "member").distinct(), ["repo", "ancestor"]).select("repo", "class", "member").distinct()
    return refs.join(own, ["repo", "class"], "left_semi").join(known, ["repo", "class", "member"], "left_anti").select("repo", "class", "member", "file", "line")


def signal_state(declared: DataFrame, emitted: DataFrame, connected: DataFrame) -> DataFrame:
    """(repo, name, declared, emits, connects, severity): signals by name; declared but never emitted is medium if something listens, else low."""
    e = emitted.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("emits"))
    c = connected.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("connects"))
    d = declared.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("declared"))
    j = d.join(e, ["repo", "name"], "left").join(c, ["repo", "name"], "left")
    j = j.select("repo", "name", "declared", F.coalesce("emits", F.lit(0)).alias("emits"), F.coalesce("connects", F.lit(0)).alias("connects"))
    return j.withColumn("severity", F.when(F.col("emits") > 0, F.lit(None).cast("string")).when(F.col("connects") > 0, "medium").otherwise("low"))


def not_there(used: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Distinct used rows without a counterpart: meta keys never set, groups never joined, input actions never defined, missing resources."""
    return used.join(known.select(*on).distinct(), on, "left_anti").distinct()


def resolve_first(wanted: DataFrame, candidates: Column, known: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., path): the first of each row's candidate paths (an array in order of preference) that exists in ``known`` (repo, path)."""
    c = wanted.select(*keep, F.posexplode(candidates).alias("pref", "path"))
    hit = c.join(known.select("repo", "path").distinct(), ["repo", "path"])
    return hit.groupBy(*keep).agg(F.min_by("path", "pref").alias("path"))


def longest_prefix(modules: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, module, target) by the longest dotted prefix of ``module`` (repo, module) that is a known dotted name (repo, name, target)."""
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("name")))
    e = modules.select("repo", "module").distinct().select("repo", "module", F.explode(prefixes).alias("p"))
    j = e.select("repo", "module", "p.n", "p.name").join(known.select("repo", "name", "target").distinct(), ["repo", "name"])
    return j.groupBy("repo", "module").agg(F.max_by("target", F.col("n")).alias("target"))


def stale_references(mentions: DataFrame, paths: DataFrame) -> DataFrame:
    """Mentions (doc_id, mention) of paths that match no path (path), wholly or as its tail at a slash: tails are exploded, so it is an equi-join."""
    tails = paths.select(F.split("path", "/").alias("ps")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ps")), lambda i: F.array_join(F.slice("ps", i, F.size("ps")), "/"))).alias("mention")).distinct()
    return mentions.distinct().join(tails, "mention", "left_anti").select(*mentions.columns)


def shared_strings(strings: DataFrame, scope_sizes: DataFrame, first: int = 8, block: int = 200) -> DataFrame:
    """(repo, a, b, n, weight, sample) of files that share strings (repo, path, value): strings in 2 to max(4, a fifth of the files) files count
    idf / (df - 1) each, idf = ln(n / df) / ln(n); the first ``first`` shared strings by name.

    The cap on a string's files is part of the measure: common strings mean nothing. A string's files are cut into blocks of about ``block``, and each
    pair of blocks is a row of its own to be paired, so the pairs of one string are formed by many tasks; they are summed before the shuffle.
    """
    s = strings.select("repo", "path", "value").distinct()
    df = s.groupBy("repo", "value").agg(F.count(F.lit(1)).alias("df")).join(scope_sizes.select("repo", F.col("files").alias("n")), "repo")
    df = df.filter((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.lit(4), F.floor(0.2 * F.col("n")))) & (F.col("df") <= F.col("n")) & (F.col("n") > 1))
    df = df.select("repo", "value", "df", (F.ln(F.col("n") / F.col("df")) / F.ln("n") / (F.col("df") - 1)).alias("w"))
    k = s.join(df, ["repo", "value"]).withColumn("nb", F.ceil(F.col("df") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("path"), F.col("nb")).cast("int"))
    e = k.select("repo", "value", "w", "path", "mine", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    g = e.groupBy("repo", "value", "w", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"))
    g = g.agg(F.collect_list(F.when(F.col("mine") <= F.col("o"), F.col("path"))).alias("xs"), F.collect_list(F.when(F.col("mine") >= F.col("o"), F.col("path"))).alias("ys"))
    p = g.select("repo", "value", "w", "ys", "i", "j", F.explode("xs").alias("x")).select("repo", "value", "w", "x", "i", "j", F.explode("ys").alias("y"))
    p = p.filter((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).select("repo", "value", "w", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    sample = F.slice(F.array_sort(F.collect_list("value")), 1, first)
    return p.groupBy("repo", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), sample.alias("sample"))


def enclosing(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, line, name): the smallest span (key, name, line, end_line) that holds each point (key, line); ties by name. The interval condition
    is joined per key and bucket of 64 lines, so a long file's points don't meet all of its spans."""
    s = spans.select(key, F.col("name"), F.col("line").alias("lo"), F.col("end_line").alias("hi")).filter("hi >= lo").distinct()
    s = s.select("*", F.explode(F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))).alias("bk"))
    p = points.select(key, "line").distinct().withColumn("bk", F.floor(F.col("line") / 64))
    j = p.join(s, [key, "bk"]).filter((F.col("line") >= F.col("lo")) & (F.col("line") <= F.col("hi")))
    return j.groupBy(key, "line").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("n"), "name")).alias("m")).select(key, "line", F.col("m.name").alias("name"))


# Fixed: kinds of references that bind when a script is compiled.
COMPILED = ["class", "autoload", "extends", "preload", "ext_resource", "scene-script"]


def excluded_dependencies(edges: DataFrame, patterns: list[str]) -> DataFrame:
    """Compile-time edges (src, dst, kind) into files that an export pattern (regular expression) leaves out, from files it keeps."""
    out = lambda c: reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns]) if patterns else F.lit(False)
    return edges.filter(F.col("kind").isin(COMPILED) & out(F.col("dst")) & ~out(F.col("src")))


def by_severity(findings: DataFrame, scope: list[str]) -> DataFrame:
    return findings.groupBy(*scope, "severity").agg(F.count(F.lit(1)).alias("n"))


def ordered(findings: DataFrame) -> DataFrame:
    """Findings by severity (high first), category, title."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    return findings.orderBy(rank.desc(), "category", "title")


def gate(findings: DataFrame, bar: str) -> DataFrame:
    """Agent-risk findings at or above a severity: what fails a check."""
    order = ["info", "low", "medium", "high"]
    return findings.filter(F.col("severity").isin(order[order.index(bar) :]) & (F.col("category") == "agent-risk"))


def with_evidence(findings: DataFrame, lines: DataFrame, width: int = 240) -> DataFrame:
    """Findings (.., file_id, line) with their source line, right-trimmed, ``width`` characters at most; null where there is no such line."""
    t = lines.select("file_id", "line", F.left(F.rtrim("text_line"), F.lit(width)).alias("evidence"))
    return findings.join(t, ["file_id", "line"], "left")
