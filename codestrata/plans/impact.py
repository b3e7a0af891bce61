"""What a change request would touch: seeds by text, constraints of the documents, impact over the graph, and a brief for whoever makes the change.

Only ranked, small results are collected, to be put into words; everything before that stays in DataFrames keyed by (repo, path).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import documents, graph, history, retrieval
from codestrata.session import cut

# Fixed: related words of a request's words.
CONCEPTS = {
    "multiplayer": "network networking online internet server client socket peer lobby sync rpc remote websocket enet versus coop player players matchmaking",
    "online": "network internet server client socket http request sync cloud",
    "network": "internet online server client socket http request multiplayer",
    "inventory": "item items bag owned own collection wardrobe equip equipment loot stash grant slot slots piece pieces",
    "item": "items inventory owned piece pieces grant loot",
    "save": "save load persist storage file json schema migration progress profile userdata restore",
    "cloud": "sync network online server account backup upload",
    "shop": "store purchase buy price cost coin coins currency economy sell booster",
    "economy": "price cost coin coins payout currency reward shop",
    "reward": "payout coin coins prize chest box drop reward",
    "sound": "sfx audio music volume synth tone",
    "audio": "sfx sound music volume synth",
    "music": "sfx sound audio track volume",
    "ui": "screen menu button dialog hud panel layout theme widget",
    "menu": "screen title button dialog navigation router",
    "screen": "ui menu router scene navigation",
    "level": "board stage generation difficulty band map track",
    "difficulty": "band level tune tuning generation balance hard easy",
    "tutorial": "onboarding hint help explain tip guide",
    "achievement": "medal medals trophy badge stat stats tally",
    "medal": "achievement trophy badge stat stats tally",
    "daily": "calendar streak event season tournament day week",
    "event": "daily calendar season tournament",
    "login": "auth account user session password token oauth",
    "account": "login auth user profile session",
    "payment": "purchase iap billing subscription ads monetization store price",
    "ads": "advert advertisement monetization reward payment",
    "analytics": "tracking telemetry metrics event log",
    "notification": "push reminder alert notify",
    "localization": "translation language locale i18n translate text",
    "settings": "options preference preferences config toggle setting",
    "animation": "tween vfx effect particle shake popup motion",
    "effect": "vfx particle tween popup shake animation fx",
    "physics": "collision body velocity gravity rigid",
    "character": "player brownie avatar sprite rig pose",
    "outfit": "wardrobe piece pieces worn wear costume dress house set",
    "powerup": "booster power hammer shuffle rocket bomb rainbow special",
    "test": "smoke rules tests assert check",
}
# Fixed: terms that mean the network, which an export preset can forbid.
NETWORK = {"network", "internet", "online", "server", "multiplayer", "socket", "http", "sync", "cloud", "analytics", "login", "account"}
ORDER = ["breaks", "ripples", "changes-with", "shares-strings"]
LOADED = ["preload", "load", "ext_resource", "scene-script"]


def request_terms(scan, request: str, concepts: dict[str, str] | None = None) -> tuple[dict[str, float], list[str]]:
    """Stems of a request at weight 1 and of related words at .45; and the request's own stems in order."""
    table = CONCEPTS if concepts is None else concepts
    stems = lambda t: scan.spark.createDataFrame([(t,)], "t string").select(X.words(F.col("t")).alias("w"), F.transform(X.words(F.col("t")), X.stem).alias("s")).first()
    row = stems(request)
    own = [(w, s) for w, s in zip(row["w"], row["s"]) if w not in X.STOP_WORDS]
    terms = {s: 1.0 for _, s in own}
    related = " ".join(table.get(w) or table.get(s) or "" for w, s in own)
    for s in stems(related)["s"] if related.strip() else ():
        terms.setdefault(s, 0.45)
    return terms, [s for _, s in own]


def relevant_members(scan, terms: DataFrame, seeds: DataFrame) -> DataFrame:
    """(repo, src, member): symbols of the seeds (repo, path) whose name or documentation speaks to the request."""
    s = scan.part("symbols").join(seeds.select("repo", "path"), ["repo", "path"], "left_semi")
    e = s.select("repo", F.col("path").alias("src"), F.col("name").alias("member"), F.explode(F.array_distinct(retrieval.stems(F.concat_ws(" ", "name", "doc")))).alias("term"))
    return e.join(terms.filter("qw >= 0.45").select("term"), "term", "left_semi").select("repo", "src", "member").distinct()


def constraints(scan, q: DataFrame, seeds: DataFrame, intent: str, terms: dict[str, float], novel: bool, most: int = 8) -> list[dict]:
    """What the documents rule about the request, what it runs into first; and an export preset that forbids the network to a request that needs it."""
    base = X.basename(F.col("path"))
    names = seeds.select("repo", base.alias("name")).union(seeds.join(scan.roles.filter(F.col("class_name").isNotNull()), ["repo", "path"]).select("repo", "class_name")).distinct()
    sentences = scan.docs.filter("part = 'sentence' and weight >= 1 and not is_prompt").select("repo", "doc", "line", "text", "weight")
    c = cut(retrieval.constraints(sentences, q, names, documents.RULE))
    floor = 0.45 if novel else 1.0
    against = [t for t, w in terms.items() if w >= floor]
    if intent in ("add", "change") and against:
        hit = retrieval.conflicts(c.filter("named = 0").select(F.concat_ws("\n", "repo", "doc").alias("doc"), "line", "text"), against).select("doc", "line", "text").distinct()
        hit = hit.select(F.substring_index("doc", "\n", 1).alias("repo"), F.substring_index("doc", "\n", -1).alias("doc"), "line", "text", F.lit(True).alias("conflict"))
        c = c.join(hit, ["repo", "doc", "line", "text"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    else:
        c = c.withColumn("conflict", F.lit(False))
    one = c.groupBy(F.left("text", F.lit(80)).alias("start")).agg(F.min(F.struct((~F.col("conflict")).alias("k"), (-F.col("score")).alias("s"), "repo", "doc", "line", "text", "weight")).alias("m"))
    rows = one.select("m.*").orderBy("k", "s", "doc", "line").limit(most).collect()
    out = [{"doc": r["doc"], "line": r["line"], "text": r["text"], "score": round(-r["s"], 2), "conflict": not r["k"]} for r in rows]
    if NETWORK & set(terms) and intent != "remove":
        p = scan.resources.filter("kind = 'presets'").select("path", F.explode("presets").alias("p")).filter("p.internet = 'false'").select("path", "p.name").orderBy("path", "name").first()
        if p:
            out.insert(0, {"doc": p["path"], "line": 0, "text": f"Export preset \"{p['name']}\" has no internet permission.", "score": 99.0, "conflict": True})
    return out


def neighbours(scan, hubs: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(repo, src, dst, w): who is affected by a change of src; tests and tools are reported, not walked through. Edges out of a hub count as far as the
    dependant uses what the request is about."""
    passive = scan.roles.filter(F.col("role").isin("test", "tool")).select("repo", F.col("path").alias("src"))
    g = scan.graph.join(passive, ["repo", "src"], "left_anti")
    nb = g.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.coalesce(F.try_element_at("kinds", F.lit("static")), F.lit(0.0)).alias("static_w"))
    if hubs is None:
        return nb.select("repo", "src", "dst", "w")
    used = scan.edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"), "members")
    return documents.relevant_hub_weights(nb, used, hubs, members)


def answer(scan, request: str, seeds: list[str] | None = None, most: int = 12, concepts: dict[str, str] | None = None, repo: str | None = None) -> dict:
    """Intent, terms, seeds, impacted files with kind and reason, context, tests, constraints, invariants, rules, files to stop at, commands, budget, a
    summary and the brief. ``seeds``: given paths; ``repo``: only this repository's files are searched (needed where paths repeat)."""
    spark, low = scan.spark, request.lower()
    intent = next((n for n, p in X.INTENTS if re.search(p, low)), "change")
    terms, own = request_terms(scan, request, concepts)
    q = spark.createDataFrame([(0, t, w) for t, w in sorted(terms.items())], "query_id int, term string, qw double")
    here = (lambda df: df.filter(F.col("repo") == repo)) if repo is not None else (lambda df: df)
    index = here(scan.index).withColumn("key", F.concat_ws("\n", "repo", "path"))
    gone = {r["term"] for r in retrieval.missing_terms(q.filter(F.col("term").isin(own)), index).collect()}
    missing = [t for t in dict.fromkeys(own) if t in gone]
    novel = bool(own) and len(missing) == len(set(own))
    scores = cut(retrieval.bm25(index.select("key", "term", "tf"), "key", q))
    code = here(scan.roles).filter(F.col("role").isin("code", "generated", "resource")).select(F.concat_ws("\n", "repo", "path").alias("key"))
    scores = scores.join(code, "key", "left_semi")
    split = lambda key: tuple(key.split("\n", 1))
    if seeds:
        found = [(r["repo"], r["path"]) for r in here(scan.roles).filter(F.col("path").isin(seeds)).select("repo", "path").orderBy("repo", "path").collect()]
    else:
        found = [split(r["key"]) for r in retrieval.seeds(scores, "key").orderBy("place").collect()]
    sd = spark.createDataFrame(found, "repo string, path string")
    out = {
        "request": request, "intent": intent, "terms": {k: round(v, 2) for k, v in terms.items()}, "missing_terms": missing, "novel": novel or not found, "seeds": [p for _, p in found], "impacted": [], "context": [], "tests": [],
        "constraints": constraints(scan, q, sd, intent, terms, novel), "invariants": [], "rules": [], "stop": [], "commands": [], "budget": {}, "summary": "Nothing in the code matches this request.", "pack": "",
    }
    if not found:
        return out
    risk = scan.ranking.select("repo", "path", "tier", F.round("score", 1).alias("score"), "reasons")
    at = spark.createDataFrame([(0, r, p) for r, p in found], "q int, repo string, node string")
    hubs = cut(scan.metrics.join(sd, ["repo", "path"], "left_semi").filter(F.coalesce("fan_in", F.lit(0)) >= 6).select("repo", F.col("path").alias("src")))
    rel = cut(relevant_members(scan, q, sd))
    nb = cut(neighbours(scan, hubs, rel))
    mass = graph.personalized(nb, at).withColumnRenamed("node", "path").join(sd, ["repo", "path"], "left_anti")
    top = mass.join(scan.roles.filter(F.col("role").isin("code", "generated", "resource")).select("repo", "path", "role"), ["repo", "path"]).orderBy(F.desc("mass"), "repo", "path").limit(most).collect()
    best = top[0]["mass"] if top else 0.0
    top = [r for r in top if r["mass"] >= 0.12 * best]
    picked = spark.createDataFrame([(0, r["repo"], r["path"]) for r in top] or [(0, "", "")], "q int, repo string, node string")
    paths = graph.cheapest_paths(nb, at)
    chain = {(r["repo"], r["node"]): r["chain"] for r in graph.chains(paths, picked, 6).collect()}
    # direct references of the picked files to seeds, and what connects the last hop of each chain
    hub_rows = {(r["repo"], r["src"]) for r in hubs.collect()}
    relevant: dict[tuple, set] = {}
    for r in rel.collect():
        relevant.setdefault((r["repo"], r["src"]), set()).add(r["member"])
    wanted = [(r, a, b) for (r, _), c in chain.items() for a, b in zip(c[1:], c[:-1])] + [(r["repo"], r["path"], s) for r in top for rr, s in found if rr == r["repo"]]
    ask = spark.createDataFrame(sorted(set(wanted)) or [("", "", "")], "repo string, src string, dst string")
    links = {(r["repo"], r["src"], r["dst"]): r for r in scan.graph.join(ask, ["repo", "src", "dst"]).join(scan.edges.select("repo", "src", "dst", "kind", "members"), ["repo", "src", "dst"], "left").collect()}
    tiers = {(r["repo"], r["path"]): r for r in risk.join(picked.select("repo", F.col("node").alias("path")).union(sd), ["repo", "path"]).collect()}
    for r in top:
        rp, p = r["repo"], r["path"]
        direct = []
        for s in (s for rr, s in found if rr == rp):
            e = links.get((rp, p, s))
            if e is None or not {"static", "contract"} & set(e["kinds"]):
                continue
            used, hub = set(e["members"] or ()), (rp, s) in hub_rows
            about = used & relevant.get((rp, s), set())
            if hub and "contract" not in e["kinds"] and not about:
                continue
            if e["kind"] in LOADED and not used and intent not in ("remove", "rename", "replace"):
                continue
            direct.append((e["w"], s, sorted(about if hub else used), sorted(e["kinds"])))
        if r["role"] == "resource" and not direct:
            continue
        c = chain.get((rp, p), [])
        if direct:
            w, s, used, kinds = max(direct, key=lambda d: (d[0], d[1]))
            kind, why, c = "breaks", ("uses " + ", ".join(used[:5]) if used else "refers to it"), [s, p]
        else:
            last = links.get((rp, c[-1], c[-2])) if len(c) > 1 else None
            kinds = set(last["kinds"]) if last else set()
            kind = "ripples" if kinds & {"static", "contract"} else "changes-with" if "cochange" in kinds else "shares-strings"
            why = ", ".join(sorted(kinds))
        t = tiers.get((rp, p))
        out["impacted"].append({"path": p, "score": round(r["mass"], 5), "kind": kind, "why": why, "chain": c, "tier": t["tier"] if t else None, "risk": t["score"] if t else None})
    out["impacted"].sort(key=lambda i: (ORDER.index(i["kind"]), -i["score"], i["path"]))
    repo_of = {r["path"]: r["repo"] for r in top}
    hit = [i["path"] for i in out["impacted"]]
    area = spark.createDataFrame(found + [(repo_of[p], p) for p in hit], "repo string, path string").distinct()
    hard = F.array_contains(F.map_keys("kinds"), "static") | F.array_contains(F.map_keys("kinds"), "contract")
    ctx = scan.graph.filter(F.array_contains(F.map_keys("kinds"), "static")).join(sd.withColumnRenamed("path", "src"), ["repo", "src"], "left_semi").join(area.withColumnRenamed("path", "dst"), ["repo", "dst"], "left_anti")
    ctx = scan.in_roles(ctx, "code", "generated", col="dst").groupBy("repo", "dst").agg(F.max("w").alias("w"), F.min("src").alias("src")).orderBy(F.desc("w"), "dst").limit(6)
    out["context"] = [{"path": r["dst"], "from": r["src"]} for r in ctx.collect()]
    seeded = sd.select("repo", F.col("path").alias("dst"), F.lit(1).alias("seed"))
    t = scan.in_roles(scan.graph.filter(hard), "test", col="src").join(area.withColumnRenamed("path", "dst"), ["repo", "dst"], "left_semi").join(seeded, ["repo", "dst"], "left")
    t = t.groupBy("src").agg(F.sum(1 + F.coalesce("seed", F.lit(0))).alias("n")).orderBy(F.desc("n"), "src").limit(6)
    out["tests"] = [r["src"] for r in t.collect()]
    out["invariants"] = invariants(scan, found, hit, repo_of, hub_rows, relevant)
    base = X.basename(F.col("path"))
    names = area.select("repo", "path", base.alias("name")).union(area.join(scan.roles.filter(F.col("class_name").isNotNull()), ["repo", "path"]).select("repo", "path", "class_name"))
    d = scan.docs.filter("weight >= 2 and not is_prompt")
    ruled = documents.rules(d.filter("part = 'sentence'"), d.filter("part = 'row' and weight >= 3"), names, sd)
    out["rules"] = [{"doc": r["doc"], "line": r["line"], "text": r["text"]} for r in ruled.collect()]
    out["stop"] = [{"path": p, "score": r["score"], "reasons": r["reasons"][:3]} for (_, p), r in sorted(tiers.items(), key=lambda x: (-x[1]["score"], x[0])) if r["tier"] in ("do-not-touch", "generated") and p in {*out["seeds"], *hit}][:6]
    out["commands"] = [r.asDict() for r in documents.commands(here(scan.docs).filter("part = 'block' and not is_prompt")).limit(2).collect()]
    lines = 400
    if scan.touched is not None:
        size = scan.touched.join(scan.seasoned.select("repo"), "repo", "left_semi").join(sd.select("repo").distinct(), "repo", "left_semi").groupBy("repo", "sha").agg(F.sum("lines").alias("n"))
        m = history.upper_median(size, "repo", "n", "m").agg(F.max("m")).first()[0]
        lines = int(min(800, max(200, 2 * m))) if m is not None else 400
    out["budget"] = {"files": len(found) + sum(i["kind"] == "breaks" for i in out["impacted"]) + 2, "lines": lines}
    out["summary"] = summary(out)
    out["pack"] = pack(out)
    return out


def invariants(scan, found: list[tuple], hit: list[str], repo_of: dict, hubs: set, relevant: dict, most: int = 16) -> list[dict]:
    """What must stay true in the seeds and the first impacted files: generators, saved data, members that several files use, string contracts, exports."""
    spark, out = scan.spark, []
    near = spark.createDataFrame(found + [(repo_of[p], p) for p in hit[:6]], "repo string, path string").distinct()
    for r in scan.metrics.join(near, ["repo", "path"], "left_semi").select("path", "generated_by", "persists").orderBy("path").collect():
        if r["generated_by"]:
            out.append({"file": r["path"], "line": 1, "text": f"Written by `{r['generated_by']}`: change that and run it again, not the file."})
        if r["persists"]:
            out.append({"file": r["path"], "line": 1, "text": "Saves data: what was saved before the change must still load after it."})
    sd = spark.createDataFrame(found, "repo string, path string")
    e = scan.in_roles(scan.edges.join(sd.withColumnRenamed("path", "dst"), ["repo", "dst"], "left_semi"), "code", "generated", col="src")
    used = e.select("repo", "dst", "src", F.explode("members").alias("member")).groupBy("repo", "dst", "member").agg(F.count_distinct("src").alias("n")).filter("n >= 2")
    at = scan.part("symbols").groupBy("repo", F.col("path").alias("dst"), F.col("name").alias("member")).agg(F.min("line").alias("line"))
    rows = used.join(at, ["repo", "dst", "member"], "left").orderBy("dst", F.desc("n"), "member").collect()
    for rp, p in found:
        mine = [r for r in rows if (r["repo"], r["dst"]) == (rp, p)]
        if (rp, p) in hubs:
            mine = [r for r in mine if r["member"] in relevant.get((rp, p), ())] or mine[:2]
        out += [{"file": p, "line": r["line"] or 1, "text": f"`{r['member']}` is used by {r['n']} files: keep its signature and meaning."} for r in mine[:6]]
    kept = scan.invariants.join(sd, ["repo", "path"], "left_semi").filter(F.col("kind") != "payload").orderBy("path", "line", "text").collect()
    for _, p in found:
        out += [{"file": p, "line": r["line"], "text": r["text"]} for r in [r for r in kept if r["path"] == p][:5]]
    globs = [r["glob"] for r in scan.exclusions.join(sd.select("repo").distinct(), "repo", "left_semi").select("glob").distinct().orderBy("glob").limit(4).collect()]
    if globs:
        out.append({"file": "export_presets.cfg", "line": 0, "text": f"The export leaves out {', '.join(globs)}: shipped code can't name anything there."})
    seen: set[str] = set()
    return [i for i in out if not (i["text"] in seen or seen.add(i["text"]))][:most]


def summary(b: dict) -> str:
    kinds = [i["kind"] for i in b["impacted"]]
    parts = []
    bad = sum(c["conflict"] for c in b["constraints"])
    if bad:
        parts.append(f"{bad} documented rule(s) speak against this request.")
    if b["novel"]:
        parts.append("No file is about " + " or ".join(b["missing_terms"][:2] or ["this"]) + " yet; related words led to these files.")
    parts.append(f"Starts in {', '.join(s.rpartition('/')[2] for s in b['seeds'][:3])}; {len(kinds)} more files: {kinds.count('breaks')} directly, {kinds.count('ripples')} through others, {len(kinds) - kinds.count('breaks') - kinds.count('ripples')} by history or strings.")
    if b["stop"]:
        parts.append(f"{len(b['stop'])} of them should not be touched without asking.")
    if any(i["text"].startswith("Saves data") for i in b["invariants"]):
        parts.append("Saved data is involved.")
    return " ".join(parts)


def pack(b: dict) -> str:
    """The brief in ten sections; empty ones are left out, but for those that always have something to say."""
    short = lambda p: p.rpartition("/")[2]
    place = lambda x: f"{x['doc']}:{x['line']}" if x["line"] else x["doc"]
    clash = [c for c in b["constraints"] if c["conflict"]]
    rules = list(dict.fromkeys((r["text"], place(r)) for r in [*b["rules"], *[c for c in b["constraints"] if not c["conflict"]]]))[:10]
    sections = [
        ("0. Settle first", [f"> {c['text']} ({place(c)})" for c in clash[:4]]),
        ("1. Start here", [f"- `{s}`" for s in b["seeds"]]),
        ("2. Also affected", [f"- `{i['path']}` ({i['kind']}): {i['why']}; {' -> '.join(map(short, i['chain']))}" + (f" [{i['tier']}]" if i["tier"] == "do-not-touch" else "") for i in b["impacted"]] or ["- nothing found"]),
        ("3. Read before", [f"- `{c['path']}`, used by `{c['from']}`" for c in b["context"]]),
        ("4. Keep true", [f"- {i['text']} (`{i['file']}:{i['line']}`)" for i in b["invariants"]]),
        ("5. Documented rules", [f"> {t} ({p})" for t, p in rules]),
        ("6. Ask before touching", [f"- `{s['path']}`: {'; '.join(s['reasons'])}" for s in b["stop"]]),
        ("7. Check with", [f"```\n{c['text']}\n```" for c in b["commands"]] + [f"- `{t}`" for t in b["tests"]] or ["- no test refers to these files; write one first"]),
        ("8. Stop when", [f"- more than about {b['budget'].get('lines', 400)} lines or {b['budget'].get('files', 0)} files change", "- a name from section 4 changes in some places only", "- a check passes only after its expectation was changed"]),
        ("9. Report", ["- changed files and why", "- names from section 4 that changed, and where", "- checks run and their results", "- files of section 2 not looked at"]),
    ]
    lines = [f"# {b['request']}", "", b["summary"]]
    for title, rows in sections:
        if rows:
            lines += ["", f"## {title}", *rows]
    return "\n".join(lines) + "\n"


def backtest(scan, most: int = 300, ks: tuple[int, ...] = (5, 10), low: int = 2, high: int = 20) -> DataFrame:
    """(repo, method, samples, recall_k..., hit_k..., mrr): how well the impact engine foretells what else a commit changes, given the file it changes
    most (ties by name), beside its static and its co-change part alone.

    Samples are the commits of ``low`` to ``high`` source files among a repository's last ``most`` (a parameter of the measure) that aren't its
    first. Each sees the co-change of strictly earlier commits only: pair counts are kept in commit order, one row per pair and commit that changes it,
    and a sample takes each pair's last row before it. References and shared strings are the snapshot's.
    """
    from pyspark.sql import Window

    c = scan.commits.select("repo", "sha", "ord")
    t = scan.in_roles(scan.touched, "code", "generated").join(c, ["repo", "sha"])
    recent = c.join(c.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")), "repo").withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("ord"), "sha"))).filter((F.col("rank") <= most) & (F.col("ord") > F.col("first"))).select("repo", "sha")
    sizes = t.groupBy("repo", "sha", "ord").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("lines")).alias("k"), "path")).alias("m"))
    samples = cut(sizes.filter(F.col("size").between(low, high)).join(recent, ["repo", "sha"], "left_semi").select("repo", F.col("sha").alias("q"), "ord", F.col("m.path").alias("node"), (F.col("size") - 1).alias("truth")))
    seeds = samples.select("q", "repo", "node")
    # co-change as it was before each sample
    full = scan.touched.join(c, ["repo", "sha"])
    small = full.join(full.groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size").between(2, history.MAX_FILES)), ["repo", "sha"])
    one = small.groupBy("repo", "sha", "ord", "size").agg(F.array_sort(F.collect_list("path")).alias("ps"))
    p = one.select("repo", "ord", "size", "ps", F.explode("ps").alias("a")).select("repo", "ord", "size", "a", F.explode(F.filter("ps", lambda x: x > F.col("a"))).alias("b"))
    w = Window.partitionBy("repo", "a", "b").orderBy("ord").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = p.select("repo", "a", "b", "ord", F.count(F.lit(1)).over(w).alias("n"), F.sum(1 / (F.col("size") - 1)).over(w).alias("weight")).distinct()
    at = samples.select("repo", "q", F.col("ord").alias("now")).distinct()
    last = at.join(run, "repo").filter(F.col("ord") < F.col("now")).groupBy("repo", "q", "a", "b").agg(F.max(F.struct("ord", "n", "weight")).alias("m")).select("repo", "q", "a", "b", "m.n", "m.weight").filter("n >= 2")
    changes = at.join(full.select("repo", "path", "ord"), "repo").filter(F.col("ord") < F.col("now")).groupBy("repo", "q", "path").agg(F.count(F.lit(1)).alias("changes"))
    j = last.join(changes.withColumnsRenamed({"path": "a", "changes": "ca"}), ["repo", "q", "a"]).join(changes.withColumnsRenamed({"path": "b", "changes": "cb"}), ["repo", "q", "b"])
    conf = F.greatest(F.col("n") / F.col("ca"), F.col("n") / F.col("cb"))
    co = j.select("repo", "q", "a", "b", (0.8 * conf * F.least(F.lit(1.0), F.col("weight") / 1.5)).alias("w")).filter("w >= 0.08")
    co = cut(co.select("q", "repo", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("cochange").alias("kind"), "w").union(co.select("q", "repo", "b", "a", F.lit("cochange"), "w")))
    kinds = scan.graph.select("repo", "src", "dst", F.explode("kinds").alias("kind", "w")).filter("kind <> 'cochange'")
    passive = scan.roles.filter(F.col("role").isin("test", "tool")).select("repo", F.col("path").alias("src"))
    fixed = at.select("q", "repo").join(kinds, "repo").select("q", "repo", "src", "dst", "kind", "w")
    every = cut(fixed.unionByName(co).join(passive, ["repo", "src"], "left_anti"))
    parts = []
    for method, keep in (("impact", None), ("static", ["static", "contract"]), ("cochange", ["cochange"])):
        e = every if keep is None else every.filter(F.col("kind").isin(keep))
        nb = e.groupBy("q", "repo", F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.least(F.lit(1.5), F.sum("w")).alias("w"))
        mass = scan.in_roles(graph.personalized(nb, seeds).withColumnRenamed("node", "path"), "code", "generated").join(seeds.withColumnRenamed("node", "path"), ["q", "repo", "path"], "left_anti")
        place = F.row_number().over(Window.partitionBy("q", "repo").orderBy(F.desc(F.round("mass", 12)), "path"))
        hits = mass.withColumn("place", place).join(t.select("repo", F.col("sha").alias("q"), "path"), ["repo", "q", "path"], "left_semi")
        per = hits.groupBy("repo", "q").agg(*[F.count_if(F.col("place") <= k).alias(f"h{k}") for k in ks], F.min("place").alias("first"))
        got = lambda k: F.coalesce(f"h{k}", F.lit(0))
        parts.append(cut(samples.join(per, ["repo", "q"], "left").groupBy("repo").agg(
            F.lit(method).alias("method"), F.count(F.lit(1)).alias("samples"), *[F.avg(got(k) / F.col("truth")).alias(f"recall_{k}") for k in ks],
            *[F.avg((got(k) > 0).cast("double")).alias(f"hit_{k}") for k in ks], F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        )))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
