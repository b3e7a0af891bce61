"""Documents as rules: boundaries between files, rules about files, what a reader is pointed to, commands to verify a change; and names that
are nearly right."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators import graph
from codestrata.operators.retrieval import mentions
from codestrata.session import cut

# Fixed: how prose forbids the use of a name, and the kinds of references that such a rule follows.
FORBIDDEN = (
    r"(?i)\b(?:no|not|never|without|must not (?:use|touch|call|reference|depend on|import)|do(?:es)? not (?:use|touch|call|reference|depend on|import)|may not (?:use|touch|call))\s+`([A-Za-z_]\w*)`"
)
FOLLOWED = ["class", "autoload", "extends", "preload", "load", "scene-script"]
PARTS = "repo string, doc string, part string, line int, heading string, text string, cells array<string>, starts_item boolean, size int"
# Fixed: commands that test something, headings they stand under.
TEST_COMMAND = r"(?i)\b(test|tests|smoke|rules|check|lint|pytest|jest|vitest|mocha|cargo test|go test|npm run|make)\b|--\w*(test|smoke|rules)"
VERIFYING = r"(?i)verif|test|before|done|check|run"
# Fixed: words of a rule.
RULE = r"(?i)\b(never|must not|mustn't|must|do not|don't|not negotiable|only|always|stays?|forbidden|cannot|can't|nothing|no\s+\w+|without|not)\b|=\s*false|pillar"


def with_markdown(docs: DataFrame) -> DataFrame:
    """(repo, doc, part, line, heading, text, cells, starts_item, size) of documents (repo, doc, text): sentences, paragraphs, spans (``starts_item``:
    the text around says the thing is gone), table rows (``text``: each cell after its column's name), code blocks (``heading``: language, a line end,
    heading), headings, prompts (``heading``: id, ``text``: status, ``size``: lines) and one row ``doc`` (``size``: lines, ``starts_item``: whether it
    is a collection of prompts)."""
    from codestrata.sources.parsers import markdown

    def run(batches):
        for b in batches:
            rows = []
            for repo, doc, text in zip(b.repo, b.doc, b.text):
                m = markdown(doc, text or "")
                add = lambda part, line, heading, t, cells=None, item=False, size=0: rows.append((repo, doc, part, line, heading, t, cells, item, size))
                for s, ln, h, item in m["sentences"]:
                    add("sentence", ln, h, s, None, item)
                for s, ln in m["paragraphs"]:
                    add("paragraph", ln, "", s)
                for s, ln, gone in m["spans"]:
                    add("span", ln, "", s, None, gone)
                for cells, ln, header in m["rows"]:
                    named = "; ".join(f"{h.rstrip('. ')} {c}" for h, c in zip(header, cells) if c) if header else " | ".join(cells)
                    add("row" if cells is not header else "header", ln, "", named, cells)
                for lang, ln, code, h in m["blocks"]:
                    add("block", ln, f"{lang}\n{h}", code)
                for level, title, ln in m["headings"]:
                    add("heading", ln, str(level), title)
                for i, ln, size, status in m["prompts"]:
                    add("prompt", ln, i, status, None, False, size)
                add("doc", 1, "", "", None, m["is_prompt"], (text or "").count("\n") + 1)
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PARTS.split(", ")])

    return docs.select("repo", "doc", "text").mapInPandas(run, PARTS)


def boundaries(paragraphs: DataFrame, names: DataFrame, edges: DataFrame, roles: DataFrame) -> DataFrame:
    """(repo, doc, line, name, forbidden, src, dst, hops, chain, severity): paragraphs (repo, doc, line, text) that forbid some names of the project
    (repo, name, path) and list others, where a listed file reaches a forbidden one over compile-time edges (repo, src, dst, kind) through source
    files (repo, path, role): the shortest way per paragraph and listed file (ties by name). High for a direct edge, medium through others.

    All listed files are searched from at once; chains are built for the ways that are reported only.
    """
    found = paragraphs.select("repo", "doc", "line", F.regexp_extract_all("text", F.lit(FORBIDDEN), F.lit(1)).alias("no"), F.regexp_extract_all("text", F.lit(r"`([A-Za-z_]\w*)`"), F.lit(1)).alias("all"))
    found = found.filter(F.size("no") > 0)
    n = names.select("repo", "name", "path").distinct()
    no = found.select("repo", "doc", "line", F.explode(F.array_distinct("no")).alias("name")).join(n, ["repo", "name"]).select("repo", "doc", "line", F.col("name").alias("forbidden"), F.col("path").alias("dst"))
    listed = found.select("repo", "doc", "line", F.explode(F.array_distinct(F.array_except("all", "no"))).alias("name")).join(n, ["repo", "name"]).withColumnRenamed("path", "src")
    pair = cut(listed.join(no, ["repo", "doc", "line"]))
    through = roles.filter(F.col("role").isin("code", "generated")).select("repo", "path").distinct()
    e = edges.filter(F.col("kind").isin(FOLLOWED)).join(through.withColumnRenamed("path", "dst"), ["repo", "dst"], "left_semi").select("repo", "src", "dst")
    ways = cut(graph.shortest_chains(e, pair.select(F.col("src").alias("q"), "repo", F.col("src").alias("node")).distinct()))
    j = pair.join(ways.filter("hops > 0").select("repo", F.col("q").alias("src"), F.col("node").alias("dst"), "hops"), ["repo", "src", "dst"])
    best = j.groupBy("repo", "doc", "line", "name", "src").agg(F.min(F.struct("hops", "forbidden", "dst")).alias("m")).select("repo", "doc", "line", "name", "src", "m.*")
    c = graph.chains(ways, best.select(F.col("src").alias("q"), "repo", F.col("dst").alias("node"))).select("repo", F.col("q").alias("src"), F.col("node").alias("dst"), "chain")
    sev = F.when(F.col("hops") == 1, "high").otherwise("medium")
    return best.join(c, ["repo", "src", "dst"]).select("repo", "doc", "line", "name", "forbidden", "src", "dst", "hops", "chain", sev.alias("severity"))


def rules(sentences: DataFrame, rows: DataFrame, names: DataFrame, seeds: DataFrame, top: int = 8) -> DataFrame:
    """(repo, doc, line, text, on_seed, files, score): ruling sentences under 400 characters and table rows (repo, doc, line, text, weight) that name
    files in play (repo, name, path); score = 3 for each seed (repo, path) + up to three files + weight - .004 per character, the best ``top``."""
    ruling = sentences.filter(F.col("text").rlike(RULE) & (F.char_length("text") < 400))
    t = ruling.select("repo", "doc", "line", "text", "weight").union(rows.select("repo", "doc", "line", "text", "weight"))
    seed = seeds.select("repo", "path", F.lit(1).alias("seed")).distinct()
    n = names.join(seed, ["repo", "path"], "left").groupBy("repo", "name").agg(F.max("seed").alias("seed"))
    m = mentions(t, n).join(n, ["repo", "name"]).groupBy("repo", "doc", "line", "text").agg(F.least(F.lit(3), F.count(F.lit(1))).alias("files"), F.count("seed").alias("on_seed"))
    j = t.join(m, ["repo", "doc", "line", "text"]).withColumn("score", 3 * F.col("on_seed") + F.col("files") + F.col("weight") - 0.004 * F.char_length("text"))
    return j.distinct().orderBy(F.desc("score"), "doc", "line", "text").limit(top).select("repo", "doc", "line", "text", "on_seed", "files", "score")


def pointed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(repo, doc, weight): documents (repo, doc, weight) named in spans (repo, doc, span) of documents of weight 3 weigh 2 at least."""
    heavy = docs.filter("weight = 3").select("repo", "doc")
    named = spans.join(heavy, ["repo", "doc"], "left_semi").select("repo", F.col("span").alias("doc")).distinct().withColumn("named", F.lit(True))
    return docs.join(named, ["repo", "doc"], "left").select("repo", "doc", F.when(F.col("named"), F.greatest(F.col("weight"), F.lit(2))).otherwise(F.col("weight")).alias("weight"))


def commands(blocks: DataFrame, top: int = 6) -> DataFrame:
    """(repo, doc, line, text, score): shell blocks (repo, doc, line, heading: language and heading, text, weight) under a heading about checking: weight,
    3 for a test runner, 1 for the first block under its heading, up to 2 for its lines; equal texts and equal sets of options once; the best ``top``."""
    p = F.split("heading", "\n")
    s = blocks.withColumns({"lang": p[0], "under": F.coalesce(F.get(p, F.lit(1)), F.lit("")), "text": F.trim("text")})
    s = s.filter(F.col("lang").isin("", "sh", "bash", "shell", "console", "zsh") & F.col("under").rlike(VERIFYING))
    first = (F.row_number().over(Window.partitionBy("repo", "doc", "under").orderBy("line")) == 1).cast("int")
    newlines = F.least(F.lit(2), F.size(F.split("text", "\n")) - 1)
    s = s.withColumn("score", F.col("weight") + F.when(F.col("text").rlike(TEST_COMMAND), 3).otherwise(0) + first + newlines)
    options = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(--[\w-]+)"), F.lit(1)))), " ")
    s = s.withColumn("same", F.when(options == "", F.col("text")).otherwise(options))
    best = s.groupBy("repo", "same").agg(F.min(F.struct((-F.col("score")).alias("k"), "doc", "line", "text")).alias("m"))
    return best.select("repo", "m.doc", "m.line", "m.text", (-F.col("m.k")).alias("score")).orderBy(F.desc("score"), "doc", "line").limit(top)


def suggestion(wrong: DataFrame, known: DataFrame, group: str, cutoff: float = 0.75) -> DataFrame:
    """(repo, group, key, suggestion): for each unknown key (repo, group, key) the nearest known key of its group by matching blocks (ratio ``cutoff`` or more),
    null if none is near. Unknown keys are compared with keys of their group whose length allows the ratio; ties by name."""
    k = known.select("repo", group, F.col("key").alias("cand")).distinct()
    n, m = F.char_length("key"), F.char_length("cand")
    j = wrong.select("repo", group, "key").distinct().join(k, ["repo", group]).filter(2 * F.least(n, m) >= cutoff * (n + m))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)])

    near = j.withColumn("r", ratio("key", "cand")).filter(F.col("r") >= cutoff)
    best = near.groupBy("repo", group, "key").agg(F.min(F.struct((-F.col("r")).alias("r"), "cand")).getField("cand").alias("suggestion"))
    return wrong.select("repo", group, "key").distinct().join(best, ["repo", group, "key"], "left")


def scene_methods(connections: DataFrame, nodes: DataFrame, methods: DataFrame, scripts: DataFrame) -> DataFrame:
    """(repo, scene, signal, method, line, script): connections (repo, scene, to, signal, method, line) to a node (repo, scene, path, script) whose
    script (repo, script) is known and has, with what it inherits (repo, script, method), no such method."""
    n = nodes.filter(F.col("script").isNotNull()).select("repo", "scene", F.col("path").alias("to"), "script").join(scripts.select("repo", "script").distinct(), ["repo", "script"], "left_semi")
    j = connections.withColumn("to", F.coalesce("to", F.lit("."))).join(n, ["repo", "scene", "to"])
    return j.join(methods.select("repo", "script", "method").distinct(), ["repo", "script", "method"], "left_anti").select("repo", "scene", "signal", "method", "line", "script")


# Fixed: calls that read a name of the engine's.
META_READS = ["get_meta", "has_meta", "remove_meta"]
GROUP_READS = ["is_in_group", "get_nodes_in_group", "call_group", "get_first_node_in_group", "remove_from_group", "set_group", "notify_group", "call_group_flags", "has_group"]
ACTION_READS = ["is_action_pressed", "is_action_just_pressed", "is_action_just_released", "get_action_strength", "get_action_raw_strength", "is_action", "is_action_released", "action_press", "action_release"]


def unknown_engine_names(calls: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, kind, name, path, line, fn): meta keys never set, groups never joined, input actions never defined. calls (repo, path, fn, name, line) are
    reads; known (repo, kind, name) what is set, joined or defined; built-in actions (ui_*) are left out."""
    fn = F.col("fn")
    kind = F.when(fn.isin(META_READS), "meta").when(fn.isin(GROUP_READS), "group").when(fn.isin(ACTION_READS), "action")
    used = calls.withColumn("kind", kind).filter(F.col("kind").isNotNull() & F.col("name").isNotNull() & ~((F.col("kind") == "action") & F.startswith("name", F.lit("ui_"))))
    return used.join(known.select("repo", "kind", "name").distinct(), ["repo", "kind", "name"], "left_anti").select("repo", "kind", "name", "path", "line", "fn").distinct()


def shared_meta(uses: DataFrame, least: int = 2) -> DataFrame:
    """(repo, name, files) of meta keys (repo, name, path) that ``least`` or more files use."""
    return uses.groupBy("repo", "name").agg(F.count_distinct("path").alias("files")).filter(F.col("files") >= least)


def relevant_hub_weights(neighbours: DataFrame, static: DataFrame, hubs: DataFrame, members: DataFrame) -> DataFrame:
    """(repo, src, dst, w): impact edges (repo, src, dst, w, static_w) whose source is a hub (repo, src) keep only as much of their static part as the
    dependant uses members that matter: static_w * (.2 + .8 min(1, 2 * share)), the share of its members (repo, src, dst, members) in the hub's relevant
    ones (repo, src, member)."""
    none = F.array().cast("array<string>")
    at = ["repo", "src", "dst"]
    hub = hubs.select("repo", "src").distinct()
    used = static.join(hub, ["repo", "src"], "left_semi").select(*at, F.explode("members").alias("member"))
    hit = used.join(members.select("repo", "src", "member").distinct().withColumn("hit", F.lit(1)), ["repo", "src", "member"], "left")
    share = hit.groupBy(*at).agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
    known = static.join(hub, ["repo", "src"], "left_semi").select(*at, F.size(F.coalesce("members", none)).alias("n")).join(share, at, "left")
    j = neighbours.join(known, at, "left")
    factor = 0.2 + 0.8 * F.least(F.lit(1.0), 2 * F.coalesce("share", F.lit(0.0)))
    w = F.when(F.col("n").isNotNull() & (F.col("static_w") > 0), F.col("static_w") * factor + (F.col("w") - F.col("static_w"))).otherwise(F.col("w"))
    return j.select(*at, w.alias("w"))
