"""Rules in documents, near names, scene connections and engine names."""

from pyspark.sql import functions as F

from codestrata.operators import documents


def rows(df):
    return sorted(tuple(r) for r in df.collect())


DOC = """# Rules
`Model` is pure: no `Screen`. The `Screen` may use the `Model`.

- The Model must never be late.

| file | note |
|---|---|
| Model | pure |

## Verify

```sh
pytest tests
```
See `notes.md`.
"""


def parts(spark):
    return documents.with_markdown(spark.createDataFrame([("r", "AGENTS.md", DOC), ("r", "notes.md", None)], "repo string, doc string, text string"))


def test_boundary_through_helpers(spark):
    s = parts(spark).filter("part = 'paragraph'")
    names = spark.createDataFrame([("r", "Model", "m.gd"), ("r", "Screen", "s.gd")], "repo string, name string, path string")
    roles = spark.createDataFrame([("r", x, "code") for x in ("m.gd", "h.gd", "i.gd", "s.gd")], "repo string, path string, role string")
    e = lambda *rows: spark.createDataFrame([("r", *x) for x in rows], "repo string, src string, dst string, kind string")
    got = lambda edges: [(r.src, r.dst, r.hops, r.severity, r.chain) for r in documents.boundaries(s, names, edges, roles).collect()]
    assert got(e(("m.gd", "s.gd", "class"))) == [("m.gd", "s.gd", 1, "high", ["m.gd", "s.gd"])]
    assert got(e(("m.gd", "h.gd", "class"), ("h.gd", "i.gd", "preload"), ("i.gd", "s.gd", "class"), ("m.gd", "s.gd", "ref"))) == [("m.gd", "s.gd", 3, "medium", ["m.gd", "h.gd", "i.gd", "s.gd"])]
    assert documents.boundaries(s.limit(0), names, e(("m.gd", "s.gd", "class")), roles).count() == 0


def test_rules_pointed_and_commands(spark):
    w = parts(spark).withColumn("weight", F.lit(3))
    names = spark.createDataFrame([("r", "m.gd", "Model")], "repo string, path string, name string")
    got = documents.rules(w.filter("part = 'sentence'"), w.filter("part = 'row'"), names, spark.createDataFrame([("r", "m.gd")], "repo string, path string")).collect()
    assert {r.text for r in got} == {"The Model must never be late.", "file Model; note pure"} and all(r.on_seed == 1 for r in got)
    docs = spark.createDataFrame([("r", "AGENTS.md", 3), ("r", "notes.md", 1), ("r", "x.md", 1), ("o", "notes.md", 1)], "repo string, doc string, weight int")
    assert {(r.repo, r.doc): r.weight for r in documents.pointed(docs, w.filter("part = 'span'").select("repo", "doc", F.col("text").alias("span"))).collect()} == {("r", "AGENTS.md"): 3, ("r", "notes.md"): 2, ("r", "x.md"): 1, ("o", "notes.md"): 1}
    assert [r.text for r in documents.commands(w.filter("part = 'block'")).collect()] == ["pytest tests"]


def test_suggestion(spark):
    wrong = spark.createDataFrame([("r", "t", "colr"), ("r", "t", "zzz"), ("r", "u", "color")], "repo string, table_id string, key string")
    known = spark.createDataFrame([("r", "t", "color"), ("r", "t", "cold"), ("r", "t", "colors")], "repo string, table_id string, key string")
    assert {(r.table_id, r.key): r.suggestion for r in documents.suggestion(wrong, known, "table_id").collect()} == {("t", "colr"): "color", ("t", "zzz"): None, ("u", "color"): None}


def test_scene_and_engine_names(spark):
    c = spark.createDataFrame([("r", "a", ".", "p", "go", 1), ("r", "a", None, "p", "gone", 2), ("r", "a", "K", "p", "x", 3)], "repo string, scene string, to string, signal string, method string, line int")
    n = spark.createDataFrame([("r", "a", ".", "s.gd"), ("r", "a", "K", None)], "repo string, scene string, path string, script string")
    known = spark.createDataFrame([("r", "s.gd")], "repo string, script string")
    assert [r.method for r in documents.scene_methods(c, n, spark.createDataFrame([("r", "s.gd", "go")], "repo string, script string, method string"), known).collect()] == ["gone"]
    calls = spark.createDataFrame([("r", "f", "get_meta", "k", 1), ("r", "f", "is_in_group", "g", 2), ("r", "f", "is_action_pressed", "ui_up", 3), ("r", "f", "is_action_pressed", "fly", 4), ("r", "f", "print", "x", 5)], "repo string, path string, fn string, name string, line int")
    assert sorted((r.kind, r.name) for r in documents.unknown_engine_names(calls, spark.createDataFrame([("r", "group", "g")], "repo string, kind string, name string")).collect()) == [("action", "fly"), ("meta", "k")]
    assert rows(documents.shared_meta(spark.createDataFrame([("r", "k", "a"), ("r", "k", "b"), ("r", "j", "a"), ("o", "j", "b")], "repo string, name string, path string"))) == [("r", "k", 2)]


def test_hub_edges_are_damped(spark):
    nb = spark.createDataFrame([("r", "hub", "a", 1.0, 0.8), ("r", "hub", "b", 1.0, 0.8), ("r", "x", "a", 0.5, 0.5)], "repo string, src string, dst string, w double, static_w double")
    st = spark.createDataFrame([("r", "hub", "a", ["save"]), ("r", "hub", "b", ["coins"])], "repo string, src string, dst string, members array<string>")
    got = documents.relevant_hub_weights(nb, st, spark.createDataFrame([("r", "hub")], "repo string, src string"), spark.createDataFrame([("r", "hub", "save")], "repo string, src string, member string"))
    assert {(r.src, r.dst): round(r.w, 6) for r in got.collect()} == {("hub", "a"): 1.0, ("hub", "b"): 0.36, ("x", "a"): 0.5}
