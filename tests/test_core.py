"""Operators of the core on small fixtures, with the edges: nulls, empty tables, ties, repeated rows, clashing column names."""

import pytest
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import clones, contracts, graph, history, ranking, retrieval, scoring, smells


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# Ranking --------------------------------------------------------------------------------------------------------------------------------
def test_running_sum_matches_window(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i // 2, i, i if i % 5 else None) for i in range(200)], "g string, o int, i int, v int")
    got = ranking.running_sum(df, ["g"], ["o", "i"], F.col("v"), "s", total="t")
    assert "v" in got.columns and got.count() == 200
    want, tot = {}, {}
    for r in sorted(df.collect(), key=lambda r: (str(r.g), r.o, r.i)):
        tot[r.g] = tot.get(r.g, 0) + (r.v or 0)
        want[r.i] = tot[r.g]
    for r in got.collect():
        assert r.s == want[r.i] and r.t == tot[r.g]


def test_running_sum_of_nothing(spark):
    assert ranking.running_sum(spark.createDataFrame([], "g string, o int"), ["g"], ["o"], F.lit(1), "s").count() == 0


@pytest.mark.parametrize(("values", "want"), [([1, 2, 2, 3], [0, 2 / 3, 2 / 3, 1]), ([7], [0]), ([4, 4], [1, 1])])
def test_percentile_shares_the_higher_place(spark, values, want):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v int")
    got = scoring.with_percentile(df, "g", "v", "p").orderBy("i").collect()
    assert [round(r.p, 6) for r in got] == [round(x, 6) for x in want]


def test_rank_over_descending(spark):
    df = spark.createDataFrame([("a", 3), ("a", 5), ("b", 1)], "g string, v int")
    assert rows(ranking.rank_over(df, ["g"], ["-v"], "n")) == [("a", 3, 2), ("a", 5, 1), ("b", 1, 1)]


# Text -----------------------------------------------------------------------------------------------------------------------------------
def test_words_and_stems(spark):
    r = spark.createDataFrame([("HTTPServer2 parse_query a 42 entriesBoxes",), (None,)], "t string").select(X.words(F.col("t")).alias("w"), F.transform(X.words(F.col("t")), X.stem).alias("s")).collect()
    assert r[0].w == ["http", "server", "parse", "query", "entries", "boxes"] and r[0].s[-2:] == ["entry", "boxe"] and r[1].w == []


@pytest.mark.parametrize(("word", "want"), [("glass", "glass"), ("cats", "cat"), ("status", "status"), ("loading", "load"), ("moved", "mov"), ("ties", "tie"), ("parties", "party"), ("matches", "match")])
def test_stem_rules(spark, word, want):
    assert spark.range(1).select(X.stem(F.lit(word))).first()[0] == want


def test_paths(spark):
    f = spark.createDataFrame([("tests/a.gd", None), ("tools/x.py", None), ("src/b.ts", "gen.py"), ("src/c.go", None), ("m.tscn", None), ("Makefile", None)], "path string, g string")
    got = {r.path: (r.role, r.lang) for r in f.select("path", X.role(F.col("path"), F.col("g")).alias("role"), X.language(F.col("path")).alias("lang")).collect()}
    assert got == {"tests/a.gd": ("test", "gdscript"), "tools/x.py": ("tool", "python"), "src/b.ts": ("generated", "ts"), "src/c.go": ("code", "go"), "m.tscn": ("resource", None), "Makefile": ("code", None)}
    w = {r.path: r.w for r in spark.createDataFrame([("AGENTS.md",), ("docs/README.md",), ("README.md",), ("docs/x.md",)], "path string").select("path", X.agent_weight(F.col("path")).alias("w")).collect()}
    assert w == {"AGENTS.md": 3, "docs/README.md": 1, "README.md": 2, "docs/x.md": 1}


def test_skip_reasons(spark):
    f = spark.createDataFrame([("node_modules/a.js", 5, False), ("a.png", 5, False), ("a.js", 700_000, False), ("a.js", 5, True), ("b.js", 5, False), ("vendor", 5, False)], "path string, n long, nul boolean")
    assert [r[0] for r in f.select(X.skip_reason(F.col("path"), F.col("n"), F.col("nul"))).collect()] == ["vendored", "binary", "large", "binary", None, None]


@pytest.mark.parametrize(("x", "want"), [(0.0, 0.0), (0.3, 0.0), (0.6, 50.0), (2.0, 100.0)])
def test_ramp(spark, x, want):
    assert spark.range(1).select(X.ramp(F.lit(x), 0.3, 0.9)).first()[0] == want


def test_globs():
    import re

    assert re.search(X.glob_regex("tools/*"), "tools/a/b.gd") and not re.search(X.glob_regex("*.md"), "a.mdx")


# History --------------------------------------------------------------------------------------------------------------------------------
def touches(spark, commits):
    return spark.createDataFrame([("r", s, f"f{i:02}", 1) for s, n in commits for i in range(n)], "repo string, sha string, path string, lines long")


def test_pair_limits(spark):
    p = history.pair_stats(touches(spark, [("a", 1), ("b", 2), ("c", 8), ("d", 9), ("e", 30), ("f", 31)]))
    first = {(r.a, r.b): r for r in p.collect()}["f00", "f01"]
    assert first.n == 4 and first.n_small == 2 and abs(first.weight - (1 + 1 / 7 + 1 / 8 + 1 / 29)) < 1e-9


def test_touched_ignores_repeats_nulls_and_unknown_paths(spark):
    cf = spark.createDataFrame([("r", "a", "x", 1, 2), ("r", "a", "x", 1, 2), ("r", "a", None, 1, 1), ("r", "a", "gone", 1, 1), ("r", "b", "x", None, None)], "repo string, sha string, path string, added int, deleted int")
    code = spark.createDataFrame([("r", "x")], "repo string, path string")
    assert rows(history.touched(cf, code)) == [("r", "a", "x", 3), ("r", "b", "x", 0)]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 9), ("b", 4)], "g string, n int")
    assert rows(history.upper_median(df, "g", "n", "m")) == [("a", 3), ("b", 4)]


def test_rename_chain_last_wins(spark):
    r = spark.createDataFrame([(1, "a => b"), (2, "b => c"), (3, "x/{q => w}/y"), (4, "a => d")], "ord int, spec string").withColumn("repo", F.lit("r"))
    assert [x[1:] for x in rows(history.current_names(history.rename_expansion(r)))] == [("a", "d"), ("b", "c"), ("x/q/y", "x/w/y")]


def test_agents_and_fixes(spark):
    c = spark.createDataFrame([("Co-Authored-By:  Some   Copilot <x>",), (None,), ("Generated with [Codex]",)], "body string")
    assert [r[0] for r in c.select(history.ai_author(F.col("body"))).collect()] == ["Some Copilot", None, "Codex"]


def test_hidden_partners_and_links(spark):
    t = touches(spark, [(f"c{k}", 2) for k in range(4)])
    commits = spark.createDataFrame([(f"c{k}", "x") for k in range(4)], "sha string, subject string")
    pairs = history.with_confidence(history.pair_stats(t), history.file_history(t, commits))
    none = spark.createDataFrame([], "repo string, src string, dst string")
    assert len(rows(history.hidden_partners(pairs, none))) == 2
    linked = spark.createDataFrame([("r", "f01", "f00")], "repo string, src string, dst string")
    assert rows(history.hidden_partners(pairs, linked)) == []


def test_backtest_uses_only_earlier_commits(spark):
    t = spark.createDataFrame([("r", "a", "x", 5), ("r", "a", "y", 1), ("r", "b", "x", 5), ("r", "b", "y", 1), ("r", "c", "z", 9), ("r", "c", "q", 1)], "repo string, sha string, path string, lines long")
    c = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("r", "c", 2)], "repo string, sha string, ord int")
    b = history.backtest(t, c).first()
    assert b.samples == 2 and b.recall_5 == 0.5 and b.mrr == 0.5


# Graphs ---------------------------------------------------------------------------------------------------------------------------------
EDGES = [("a", "b", 1.0), ("b", "c", 0.5), ("c", "a", 0.2), ("b", "d", 0.4), ("e", "d", 0.3)]


@pytest.fixture
def edges(spark):
    """Two repositories, the second one with an edge of its own under the same names."""
    return spark.createDataFrame([("r", *x) for x in EDGES] + [("o", "a", "b", 1.0)], "repo string, src string, dst string, w double")


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame([("r", x) for x in "abcdef"] + [("o", "a"), ("o", "b")], "repo string, node string")


def one(df, *cols):
    return {r.node: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.filter("repo = 'r'").collect()}


def test_pagerank_equals_brute_force(edges, nodes):
    got = graph.pagerank(edges, nodes, rounds=6)
    out = {x: sum(w for s, _, w in EDGES if s == x) for x in "abcdef"}
    rank = dict.fromkeys("abcdef", 1 / 6)
    for _ in range(6):
        loose = sum(rank[x] for x in rank if not out[x])
        rank = {x: 0.15 / 6 + 0.85 * (loose / 6 + sum(rank[s] * w / out[s] for s, d, w in EDGES if d == x)) for x in rank}
    assert all(abs(one(got, "rank")[x] - rank[x]) < 1e-9 for x in rank) and abs(sum(r.rank for r in got.collect()) - 2) < 1e-9


def test_personalized_equals_brute_force(spark, edges):
    seeds = spark.createDataFrame([(1, "r", "a"), (2, "r", "e"), (2, "r", "b")], "q int, repo string, node string")
    rows_ = {(r.q, r.node): r.mass for r in graph.personalized(edges, seeds, rounds=5).collect()}
    for q, start in ((1, ["a"]), (2, ["e", "b"])):
        mass = dict.fromkeys(start, 1 / len(start))
        for _ in range(5):
            nxt = {x: 0.45 / len(start) for x in start}
            for s, d, w in EDGES:
                nxt[d] = nxt.get(d, 0) + 0.55 * mass.get(s, 0) * w / max(1.0, sum(v for x, _, v in EDGES if x == s))
            mass = nxt
        assert all(abs(rows_.get((q, x), 0) - v) < 1e-9 for x, v in mass.items())


def test_reach_and_cycles(edges, nodes):
    assert one(graph.components(edges, nodes), "component", "size") == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1), "e": ("e", 1), "f": ("f", 1)}
    assert one(graph.reach_counts(edges, nodes), "reach") == {"a": 2, "b": 2, "c": 2, "d": 4, "e": 0, "f": 0}


def test_reach_and_components_of_long_chains_with_many_nodes(spark):
    """More nodes than one bit set holds, two cycles of different colour in one chain."""
    n = 1_300
    e = [("r", f"n{i:05}", f"n{i // 2:05}", 1.0) for i in range(1, n)] + [("r", "n00001", "n00007", 1.0), ("r", "n00002", "n00009", 1.0)]
    edges = spark.createDataFrame(e, "repo string, src string, dst string, w double")
    nodes = edges.select("repo", F.col("src").alias("node")).union(edges.select("repo", "dst"))
    back: dict[str, set] = {}
    for _, s, d, _ in e:
        back.setdefault(d, set()).add(s)
    def above(x):
        seen, todo = {x}, [x]
        while todo:
            for y in back.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return len(seen) - 1
    got = one(graph.reach_counts(edges, nodes), "reach")
    assert all(got[x] == above(x) for x in ("n00000", "n00001", "n00002", "n00009", "n00100", "n01299"))
    c = one(graph.components(edges, nodes), "component", "size")
    assert c["n00007"] == c["n00001"] == ("n00001", 3) and c["n00009"] == ("n00002", 3) and c["n00100"][1] == 1


def test_paths_without_a_limit(spark, edges):
    far = spark.createDataFrame([("r", f"n{i:03}", f"n{i + 1:03}", 1.0) for i in range(70)], "repo string, src string, dst string, w double")
    start = spark.createDataFrame([(0, "r", "n000")], "q int, repo string, node string")
    w = graph.shortest_chains(far, start)
    assert w.agg(F.max("hops")).first()[0] == 70
    end = spark.createDataFrame([(0, "r", "n070")], "q int, repo string, node string")
    assert len(graph.chains(w, end).first().chain) == 71 and graph.chains(w, end, 2).first().chain == ["n068", "n069", "n070"]
    p = graph.cheapest_paths(edges, spark.createDataFrame([(0, "r", "a")], "q int, repo string, node string"))
    import math

    assert {k: round(v, 9) for k, v in one(p, "dist").items()} == {"a": 0.0, "b": 0.35, "c": round(0.7 - math.log(0.5), 9), "d": round(0.7 - math.log(0.4), 9)}


def test_merging(spark):
    m = graph.merge_kinds(spark.createDataFrame([("r", "a", "b", "x", 1.0), ("r", "a", "b", "x", 0.4), ("r", "a", "b", "y", 0.9)], "repo string, src string, dst string, kind string, w double")).first()
    assert m.w == 1.5 and m.kinds == {"x": 1.0, "y": 0.9}


def test_concentration(edges, nodes):
    assert {r.repo: (round(r.top_share, 3), round(r.avg_fan_out, 3)) for r in graph.concentration(edges, nodes).collect()} == {"r": (0.8, 0.833), "o": (1.0, 0.5)}


def test_graph_without_edges(spark):
    e = spark.createDataFrame([], "repo string, src string, dst string, w double")
    n = spark.createDataFrame([("r", "a"), ("r", "b")], "repo string, node string")
    assert {tuple(r) for r in graph.pagerank(e, n).collect()} == {("r", "a", 0.5), ("r", "b", 0.5)} and graph.reach_counts(e, n).filter("reach > 0").count() == 0 and graph.components(e, n).count() == 2


# Retrieval ------------------------------------------------------------------------------------------------------------------------------
def test_bm25_orders_and_missing(spark):
    u = spark.createDataFrame([("p", "save game save", 1.0, None), ("q", "menu screen", 1.0, None), ("r", None, 1.0, None)], "k string, text string, weight double, most int")
    ix = retrieval.term_index(u.filter("text is not null"), "k")
    q = spark.createDataFrame([(0, "save", 1.0), (0, "cloud", 0.45)], "query_id int, term string, qw double")
    s = retrieval.bm25(ix, "k", q).collect()
    assert [(r.k, r.hits) for r in s] == [("p", ["save"])] and rows(retrieval.missing_terms(q, ix)) == [(0, "cloud")]


@pytest.mark.parametrize(("text", "hit"), [("There is no network here", True), ("network stays false", True), ("the network is fine, nothing else", False), ("no one two three four five six network", False)])
def test_negation_distance(spark, text, hit):
    s = spark.createDataFrame([(1, 1, text)], "doc int, line int, text string")
    assert (retrieval.conflicts(s, ["network"]).count() == 1) == hit


# Clones ---------------------------------------------------------------------------------------------------------------------------------
BODY = """var best = 0
for item in limit.rows:
    if item.cost > best and not item.used:
        best = item.cost * 2
    elif item.kind == "rare":
        push(item, best - 1)
while best > limit.low:
    best -= step(best) + 3
    if best % 2 == 0: continue
    mark[best] = true
var total = sum(mark) / max(1, best)
return [total, best, {"n": limit.n}] if total >= 4 else clamp(best, 0, limit.high)
"""


def test_clones_renamed_in_one_file_and_across(spark):
    renamed = BODY.replace("best", "top").replace("item", "row").replace("2", "9")
    f = [("r", 1, "a.gd", "pass\n" + BODY), ("r", 2, "b.gd", "extends B\n\n# note\n" + renamed + "done()\n"), ("r", 3, "c.gd", "x"), ("r", 4, "d.gd", None), ("o", 5, "e.gd", BODY), ("p", 6, "f.gd", BODY + "\nother()\n" + renamed)]
    f += [("q", 7, "g.gd", "[" + "1, 'a', " * 200 + "]"), ("q", 8, "h.gd", "[" + "2, 'b', " * 200 + "]")]
    df = spark.createDataFrame(f, "repo string, file_id int, path string, text string")
    runs = clones.clone_runs(clones.token_arrays(df))
    got = {(r.repo, r.a, r.b): r for r in clones.outermost(runs).collect()}
    assert set(got) == {("r", 1, 2), ("p", 6, 6)} and got["r", 1, 2].tokens >= 100 and (got["r", 1, 2].a_line, got["r", 1, 2].b_line) == (2, 4)
    assert {(r.repo, r.file): r.dup_lines for r in clones.duplicated_lines(runs).collect()} == {("r", 1): 12, ("r", 2): 12, ("p", 6): 24}


def test_winnow_takes_the_rightmost_minimum():
    assert [p for _, p in clones.winnow(["a"] * 30, 5, 4)] == list(range(4, 27))


# Contracts ------------------------------------------------------------------------------------------------------------------------------
def test_keys(spark):
    keys = spark.createDataFrame([("r", "f::t", "a", "index", False, False), ("r", "f::t", "b", "index", False, False), ("r", "f::u", "a", "get", False, True), ("r", "f::v", "a", "get", False, False)], "repo string, table_id string, key string, access string, open boolean, handled boolean")
    sends = spark.createDataFrame([("r", t, k, "f", i) for i, (t, k) in enumerate([("f::t", "a"), ("f::t", "z"), ("f::t", ""), ("f::t", None), ("f::t", "y"), ("f::u", "q"), ("f::v", "q")])], "repo string, table_id string, key string, file string, line int")
    fine = spark.createDataFrame([("r", "f::t", "y")], "repo string, table_id string, key string")
    assert {(r.key, r.severity, r.id) for r in contracts.unknown_keys(sends, keys, fine).collect()} == {("z", "high", "contract.unknown-key"), ("q", "low", "contract.dropped-key")}
    assert rows(contracts.unsent_keys(sends, keys)) == [("r", "f::t", "b")]
    where = spark.createDataFrame([("r", "f", "b"), ("r", "g", "b")], "repo string, path string, value string")
    assert rows(contracts.unsent_keys(sends, keys, where)) == [] and rows(contracts.unsent_keys(sends, keys, where.filter("path = 'f'"))) == [("r", "f::t", "b")]


def test_payloads(spark):
    need = spark.createDataFrame([("r", "t", "k", "x", 5, [4]), ("r", "t", "k", "y", 3, [4])], "repo string, table_id string, key string, field string, line int, returns array<int>")
    send = lambda p, role: ("r", "t", "k", "f", 1, p, role)
    s = spark.createDataFrame([send(["x", "y"], "code"), send(["y"], "code"), send([], "code"), send([], "test"), send(None, "code")], "repo string, table_id string, key string, file string, line int, payload array<string>, role string")
    assert {(tuple(r.missing), r.severity) for r in contracts.payload_missing(s, need).collect()} == {(("x",), "medium"), (("x", "y"), "high"), (("x", "y"), "low")}


def test_dangling_keys_with_patterns(spark):
    c = spark.createDataFrame([("r", "k", False), ("r", "slot_3", False), ("r", "g", True), ("r", "w", False), ("o", "w", False)], "repo string, key string, guarded boolean")
    f = spark.createDataFrame([("r", "slot_%d"), ("r", "plain")], "repo string, value string")
    got = contracts.dangling(c, spark.createDataFrame([("r", "w")], "repo string, key string"), f)
    assert rows(got) == [("o", "w", 1, "contract.key-never-written"), ("r", "g", 1, "contract.dead-branch"), ("r", "k", 1, "contract.key-never-written")]


def test_inherited_members(spark):
    declared = spark.createDataFrame([("r", "Base", "go"), ("r", "Kid", "run")], "repo string, class string, member string")
    refs = spark.createDataFrame([("r", "Kid", "go", "f", 1), ("r", "Kid", "fly", "f", 2), ("r", "Engine", "x", "f", 3)], "repo string, class string, member string, file string, line int")
    anc = graph.ancestors(spark.createDataFrame([("r", "Kid", "Base"), ("r", "Base", None)], "repo string, name string, parent string"))
    assert rows(contracts.missing_members(refs, declared, anc)) == [("r", "Kid", "fly", "f", 2)]


@pytest.mark.parametrize("block", [200, 2])
def test_shared_strings_in_blocks(spark, block):
    s = spark.createDataFrame([("r", f"f{i:02}", v) for i in range(40) for v in (["x"] if i < 7 else []) + (["y"] if i % 9 == 0 else []) + ["all"]], "repo string, path string, value string")
    got = contracts.shared_strings(s, spark.createDataFrame([("r", 40)], "repo string, files int"), block=block)
    n = {(r.a, r.b): r.n for r in got.collect()}
    assert len(n) == 21 + 10 and n["f00", "f01"] == 1 and set(n.values()) == {1}


def test_enclosing_takes_the_smallest(spark):
    p = spark.createDataFrame([(1, 5), (1, 200), (1, 999)], "file_id int, line int")
    s = spark.createDataFrame([(1, "outer", 1, 300), (1, "inner", 4, 8)], "file_id int, name string, line int, end_line int")
    assert rows(contracts.enclosing(p, s, "file_id")) == [(1, 5, "inner"), (1, 200, "outer")]


def test_prefixes_and_tails(spark):
    assert rows(contracts.longest_prefix(spark.createDataFrame([("r", "a.b.c"), ("o", "a.b.c")], "repo string, module string"), spark.createDataFrame([("r", "a", "1"), ("r", "a.b", "2")], "repo string, name string, target string"))) == [("r", "a.b.c", "2")]
    m = spark.createDataFrame([(1, "core/x.gd"), (1, "ui/y.gd")], "doc_id int, mention string")
    assert rows(contracts.stale_references(m, spark.createDataFrame([("src/core/x.gd",)], "path string"))) == [(1, "ui/y.gd")]


def test_normal_paths(spark):
    p = spark.createDataFrame([("a/../b/./c.py",), ("../x",), ("a//b",), ("./a",), ("a/../../b",)], "p string")
    assert [r[0] for r in p.select(X.normal_path(F.col("p"))).collect()] == ["b/c.py", "../x", "a/b", "a", "../b"]


def test_excluded_and_gate(spark):
    e = spark.createDataFrame([("a.gd", "tools/b.gd", "preload"), ("tools/b.gd", "tools/c.gd", "preload"), ("a.gd", "tools/b.gd", "load")], "src string, dst string, kind string")
    assert contracts.excluded_dependencies(e, [X.glob_regex("tools/*")]).count() == 1
    f = spark.createDataFrame([("high", "agent-risk"), ("low", "agent-risk"), ("high", "size")], "severity string, category string")
    assert contracts.gate(f, "medium").count() == 1


# Smells and scores ----------------------------------------------------------------------------------------------------------------------
def test_comment_islands_and_markers(spark):
    t = "x = 1\n# a = 1\n# b = 2\n# c(3)\n## d = 4\n# TODO later\n# ... existing code unchanged"
    l = X.lines_of(spark.createDataFrame([(1, t), (2, None)], "file_id int, text string"), ["file_id"])  # noqa: E741
    assert rows(smells.commented_code(l, "file_id")) == [(1, 2, 3)]
    m = smells.marker_counts(l, ["file_id"]).first()
    assert (m.elision, m.todo, m.chat) == (1, 1, 0)


def test_paragraphs_and_tables(spark):
    l = X.lines_of(spark.createDataFrame([(1, "# h\na\nb\n\n\n\nc\n- d\n- e")], "doc_id int, text string"), ["doc_id"])  # noqa: E741
    assert [r.text for r in smells.paragraphs(l, "doc_id").orderBy("paragraph").collect()] == ["# h a b", "c", "- d", "- e"]
    t = spark.createDataFrame([("d", 1, ["id", "s"]), ("d", 2, ["P1", "done"]), ("d", 9, ["x"])], "doc string, line int, cells array<string>")
    assert [r.header for r in smells.table_headers(t, "doc").orderBy("line").collect()] == [["id", "s"], ["id", "s"], ["x"]]
    p = smells.prompt_status(spark.createDataFrame([("d", "P1"), ("d", "P2")], "doc string, prompt_id string"), t)
    assert {r.prompt_id: r["class"] for r in p.collect()} == {"P1": "done", "P2": "unknown"}


def test_risk_floors(spark):
    m = spark.createDataFrame([("r", "a", 0.1, 1, 10, True, False), ("r", "b", 0.2, 9, 10, False, True), ("r", "c", None, 0, None, False, False)], "repo string, path string, pagerank double, fan_in int, loc int, persists boolean, generated boolean")
    got = {r.path: r for r in scoring.risk(m).collect()}
    assert got["a"].score >= 72 and got["a"].tier == "do-not-touch" and got["b"].tier == "generated" and got["c"].tier == "normal"


def test_score_categories(spark):
    c = spark.createDataFrame([("r", "size", 50.0, 0.0), ("r", "size", None, 0.0), ("r", "agent_risk", 5.0, 10.0)], "repo string, category string, score double, credit double")
    cats = scoring.category_scores(c, ["repo"])
    assert rows(cats) == [("r", "agent_risk", 0.0), ("r", "size", 50.0)] and scoring.total_score(cats, ["repo"]).first().tier == "handover"


def test_directories_take_the_modal_role(spark):
    f = spark.createDataFrame([("r", "a/x", 1, "code"), ("r", "a/y", 2, "code"), ("r", "a/z", 3, "test")], "repo string, path string, loc int, role string")
    assert rows(scoring.directories(f)) == [("r", "a", 3, 6, "code")]
