"""Parsers, sources, streaming and whole scans over small invented projects."""

import subprocess

import pytest
from pyspark.sql import functions as F

from codestrata.operators import contracts, routing
from codestrata.plans import impact
from codestrata.plans.scan import Scan, scored_timeline
from codestrata.sources import parsers, snapshot
from codestrata.streaming import cochange

BLOCK = """	var best = 0
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
	match total:
		0: return null
		1: emit_more(total, -best)
	await wait(total)
	return [total, best, {"n": limit.n}] if total >= 4 else clamp(best, 0, limit.high)
"""
PROJECT = {
    "project.godot": '[autoload]\nHub="*res://core/hub.gd"\n[input]\njump={\n}\n[debug]\ngdscript/warnings/a=0\ngdscript/warnings/b=0\ngdscript/warnings/c=0\n',
    "export_presets.cfg": '[preset.0]\nname="phone"\nexclude_filter="tools/*"\n[preset.0.options]\npermissions/internet=false\n',
    "core/hub.gd": 'extends Node\nvar open_table = {"shop": _shop, "title": _title, "board": _board}\nfunc go(name, info = {}):\n\tif name == "back":\n\t\treturn\n\topen_table[name].call(info)\nfunc _shop(info):\n\tprint(info["price"])\nfunc _title(info):\n\tpass\nfunc _board(info):\n\tpass\nfunc hint(k):\n\treturn names.get(k, "")\nvar names = {"a_hint": _title, "b_hint": _board}\n',
    "core/far.gd": 'class_name Far\nextends Node\nfunc jump_to(where):\n\tHub.go(where)\nsignal reached(n)\nsignal lost(n)\nfunc f():\n\treached.emit(1)\n',
    "state/vault.gd": 'class_name Vault\nsignal opened(n)\nvar coins = 3\n## Saves the whole purse to disk.\nfunc keep(data):\n\tvar f = open_file("user://purse.dat")\n\tf.store_string(data["coins"])\n\topened.emit(1)\nfunc twin(limit):\n' + BLOCK,
    "ui/board.gd": 'extends Control\nconst C = "a1b2c3"\nfunc show():\n\tVault.keep({"coins": 4})\n\tVault.fly()\n\tvar t = {}\n\tprint(t["colour"])\n\tif t.has("never"):\n\t\tprint(t["never"])\n\tHub.go("shop", {"cost": 1})\n\tHub.go("sho")\n\tHub.go("back")\n\tHub.hint("c_hint")\n\tVault.shut.connect(show)\n',
    "ui/list.gd": 'extends Control\nconst C = "a1b2c3"\n# ... existing code unchanged\n# for simplicity\n# placeholder\nfunc show():\n\tVault.keep({})\n\tVault.coins += 1\n\tFar.jump_to("title")\n\tHub.go("title")\n\tget_meta("gone")\n\tis_in_group("nobody")\n\tis_action_pressed("fly")\n\tFar.reached.connect(show)\nfunc twin(limit):\n' + BLOCK,
    "ui/old_menu_v2.gd": 'extends Control\nconst C = "a1b2c3"\n```\nfunc show():\n\tvar s = preload("res://tools/maker.gd")\n\tvar a = load("res://art/none.png")\n\tif file_exists("res://maybe.png"):\n\t\tload("res://maybe.png")\n',
    "ui/main.tscn": '[ext_resource path="res://ui/list.gd" id="1"]\n[node name="R"]\nscript = ExtResource("1")\n[connection signal="p" from="." to="." method="show"]\n[connection signal="p" from="." to="." method="vanish"]\n',
    "tests/test_vault.gd": 'extends Node\nfunc test_keep():\n\tVault.keep({})\n\tHub.go("shop", {})\n',
    "tools/maker.gd": "extends Node\nfunc make():\n\tpass\n",
    "AGENTS.md": "# Rules\n\n`Vault` is pure data: no `Hub`, no `Far`.\n\nThe list must never lose a coin of the Vault.\nThere is no network here.\n\n`core/lacking.gd` says more, see `core/far.gd`. It replaced the dead `core/dead.gd`. Call `Vault.fly()`.\n\n| file | note |\n|---|---|\n| vault.gd | saves |\n\n## Verify\n\n```sh\npytest tests\n```\n",
    "docs/prompts.md": "# Prompt 1 go\n\ntext\n\n# Prompt 2 more\n\nDo not run 2.\n",
    "core/main.py": "import helper\nfrom core.deep import x\nfrom .helper import run\n\ndef go():\n    return helper.run()\n",
    "core/helper.py": "def run():\n    return 1\n",
    "core/broken.py": "def f(:\n    pass\n",
    "web/app.ts": 'import { a } from "../web/./util";\nexport const go = (x: number) => {\n  return a(x);\n};\n',
    "web/util.ts": "export function a(x) {\n  return x;\n}\n",
    "web/big.py": "def f():\n" + "    x = 1\n" * 720,
}
PROJECT["state/vault.gd"] += "func reach():\n\tFar.f()\n"
# a second repository with the same names, where nothing is wrong
OTHER = {
    "core/hub.gd": 'class_name Hub\nextends Node\nsignal lost(n)\nfunc f():\n\tlost.emit(1)\n\tvar d = {"colour": 1}\n\tprint(d["colour"])\n',
    "state/vault.gd": "class_name Vault\nfunc fly():\n\tpass\n",
    "core/helper.py": "def run():\n    return 1\n",
}


@pytest.fixture(scope="module")
def scan(spark):
    files = spark.createDataFrame([("r", *x) for x in PROJECT.items()] + [("o", *x) for x in OTHER.items()], "repo string, path string, text string")
    c = [("r", f"s{k}", k, 100 + k, "me", "fix it" if k == 2 else "work", None) for k in range(6)]
    cf = [("r", f"s{k}", p, 3, 1) for k in range(6) for p in ("core/broken.py", "core/helper.py")]
    commits = spark.createDataFrame(c, "repo string, sha string, ord int, ts long, author string, subject string, body string")
    return Scan(spark, files, commits, spark.createDataFrame(cf, "repo string, sha string, path string, added int, deleted int"))


def test_edges(scan):
    got = {(r.repo, r.src, r.dst, r.kind) for r in scan.edges.collect()}
    assert {("r", "ui/board.gd", "state/vault.gd", "class"), ("r", "web/app.ts", "web/util.ts", "import"), ("r", "core/main.py", "core/helper.py", "import"), ("r", "ui/board.gd", "core/hub.gd", "autoload"), ("r", "ui/main.tscn", "ui/list.gd", "scene-script")} <= got
    assert not [e for e in got if e[0] == "o"]


def test_every_finding_is_found_once_where_it_is(scan):
    rows = scan.findings.collect()
    got = {(r.id, r.path) for r in rows if r.repo == "r"}
    want = {
        ("contract.unknown-key", "ui/board.gd"), ("contract.dropped-key", "ui/board.gd"), ("contract.unsent-key", "core/hub.gd"), ("contract.payload-missing", "ui/board.gd"), ("contract.payload-missing", "tests/test_vault.gd"),
        ("contract.dead-branch", "ui/board.gd"), ("contract.key-never-written", "ui/board.gd"), ("godot.missing-member", "ui/board.gd"), ("godot.signal-never-emitted", "core/far.gd"), ("godot.connect-unknown-signal", "ui/board.gd"),
        ("godot.unknown-input-action", "ui/list.gd"), ("godot.meta-never-set", "ui/list.gd"), ("godot.group-never-joined", "ui/list.gd"), ("godot.scene-connection-missing-method", "ui/main.tscn"),
        ("godot.export-excluded-dependency", "ui/old_menu_v2.gd"), ("path.missing-resource", "ui/old_menu_v2.gd"), ("smell.elision-marker", "ui/list.gd"), ("smell.chat-voice", "ui/list.gd"), ("smell.stub", "ui/list.gd"),
        ("smell.markdown-fence", "ui/old_menu_v2.gd"), ("smell.versioned-file", "ui/old_menu_v2.gd"), ("smell.warnings-silenced", "project.godot"), ("smell.scattered-constants", "ui/board.gd"), ("docs.stale-reference", "AGENTS.md"),
        ("docs.dead-prompts", "docs/prompts.md"), ("boundary.documented-rule-violated", "AGENTS.md"), ("size.god-file", "web/big.py"), ("duplication.clone", "state/vault.gd"), ("coupling.hidden", "core/broken.py"),
    }
    assert want - got == set() and {i for i, _ in want} == {i for i, _ in got}
    assert [r.title for r in rows if r.id == "godot.signal-never-emitted" and r.repo == "r"] == ["Signal never emitted: lost"] and not [r for r in rows if r.repo == "o" and r.id.startswith(("godot", "contract"))]
    by = {(r.id, r.path): r for r in rows}
    assert by["contract.payload-missing", "tests/test_vault.gd"].severity == "low" and by["contract.payload-missing", "ui/board.gd"].severity == "high"
    assert "did you mean `shop`" in by["contract.unknown-key", "ui/board.gd"].title and "board" in by["contract.unsent-key", "core/hub.gd"].title
    assert [r.title for r in rows if r.id == "docs.stale-reference"] == ["AGENTS.md cites 2 names that no longer exist: Vault.fly(), core/lacking.gd"]
    assert [r.title for r in rows if r.id == "path.missing-resource"] == ["Missing resource art/none.png"]


def test_forwarded_sends_and_contract_edges(scan):
    sent = {(r.file, r.key) for r in scan.sends.collect() if r.table_id == "core/hub.gd::open_table"}
    assert ("ui/list.gd", "title") in sent and ("ui/board.gd", "back") in sent
    assert {(r.func, r.file) for r in scan.routes.collect()} >= {("go", "core/hub.gd"), ("jump_to", "core/far.gd")}
    assert "contract" in scan.graph.filter("src = 'ui/board.gd' and dst = 'core/hub.gd'").first().kinds
    assert {r.kind for r in scan.invariants.collect()} >= {"routing", "payload", "signal", "scene"}


def test_names_of_an_unrelated_file_make_a_send_unclear(spark):
    calls = spark.createDataFrame([("r", "a.gd", "go", "thing", None), ("r", "b.gd", "go", None, None)], "repo string, path string, fn string, recv string, func string")
    routers = spark.createDataFrame([("r", "go", "b.gd")], "repo string, func string, file string")
    none = spark.createDataFrame([], "repo string, name string, path string")
    up = spark.createDataFrame([("r", "c.gd", "b.gd")], "repo string, path string, ancestor string")
    one = spark.createDataFrame([("r", "go", "b.gd"), ("r", "go", "c.gd")], "repo string, name string, path string")
    two = one.union(spark.createDataFrame([("r", "go", "z.gd")], one.schema))
    assert {r.path for r in routing.reached(calls, routers, one, none, up).collect()} == {"a.gd", "b.gd"}
    assert {r.path for r in routing.reached(calls, routers, two, none, up).collect()} == {"b.gd"}


def test_formats_beyond_any_limit(spark):
    f = spark.range(12_000).select(F.lit("r").alias("repo"), F.concat(F.lit("slot"), "id", F.lit("_%d")).alias("value"))
    k = spark.createDataFrame([("r", "slot11999_7"), ("r", "slot12000_7"), ("r", "x.y"), ("o", "slot1_1")], "repo string, key string")
    more = f.union(spark.createDataFrame([("r", "x.%s"), ("r", "(%s")], "repo string, value string"))
    assert sorted(r.key for r in contracts.composable(k, more).collect()) == ["slot11999_7", "x.y"]


def test_check_and_evidence(scan):
    lines: list[str] = []
    assert scan.check("high", lines.append) == 1 and any(x.startswith("ui/board.gd:5: high:") for x in lines)
    e = {(r.path, r.line): r.evidence for r in scan.findings_with_evidence().filter("repo = 'r'").collect()}
    assert e["ui/board.gd", 5] == "\tVault.fly()"


def test_ranking(scan):
    r = {x.path: x for x in scan.ranking.filter("repo = 'r'").collect()}
    v = r["state/vault.gd"]
    assert v.tier == "do-not-touch" and v.tested and r["core/broken.py"].hidden == 1 and r["core/broken.py"].churn_commits == 6 and r["core/hub.gd"].autoload and r["core/hub.gd"].contracts > 5 and r["ui/board.gd"].uses_persist


def test_scores(scan):
    s = {(r.category, r.component): r for r in scan.score().filter("repo = 'r'").collect()}
    assert len(s) == 20 and s["agent_risk", "broken contracts"].credit == 10 and s["prompt_archaeology", "dead prompts"].value == 1 and s["coupling", "hidden co-change"].value > 0
    assert {r.repo for r in scan.total().collect()} == {"r", "o"}


def test_blast(scan):
    b = scan.blast("remove the purse saving of the vault", repo="r")
    assert b["intent"] == "remove" and b["seeds"][0] == "state/vault.gd" and {"ui/board.gd", "ui/list.gd"} <= {i["path"] for i in b["impacted"]}
    assert {i["kind"] for i in b["impacted"] if i["path"] == "ui/board.gd"} == {"breaks"} and b["tests"] == ["tests/test_vault.gd"] and "state/vault.gd" in b["pack"]
    assert [c["text"] for c in b["commands"]] == ["pytest tests"] and any("Saves data" in i["text"] for i in b["invariants"]) and any("coin" in r["text"] for r in b["rules"]) and b["stop"]
    assert scan.blast("zzz qqq")["seeds"] == []
    n = scan.blast("add network play", repo="r")
    assert any(c["conflict"] for c in n["constraints"]) and "## 0." in n["pack"] or not n["seeds"]


def test_impact_backtest(scan):
    got = {r.method: r for r in impact.backtest(scan).collect()}
    assert got["impact"].samples == 5 and got["impact"].recall_5 == got["cochange"].recall_5 == 0.8 and got["static"].recall_5 == 0.0


def test_broken_python_is_reported(scan):
    assert {r.path for r in scan.facts.filter("parse_error is not null").collect()} == {"core/broken.py"}


def test_parser_details():
    f = parsers.parse("a.gd", 'func f(a, b):\n\tbus.send("k", {"x": 1})\n\tcall_deferred("emit_signal", "done")\n\tw["n"] += 1\n\ts = "# not a comment" # one\n', "gdscript")
    send = next(c for c in f["calls"] if c["fn"] == "send")
    assert send["recv"] == "bus" and send["func"] == "f" and send["args"][0] == {"k": "str", "s": "k", "d": None} and send["args"][1] == {"k": "dict", "s": None, "d": 0}
    assert f["emits"] == [{"value": "done", "line": 3}] and f["subs"][0]["mode"] == "rw" and [c["value"] for c in f["comments"]] == ["# one"]
    assert parsers.parse("e.py", "", "python")["loc"] == 0
    p = parsers.parse("a.py", 'T = {"a": f, "b": g}\ndef f(x):\n    return x["k"]\ndef g(x): pass\ndef run(k):\n    return T[k]\n', "python")
    assert p["routes"] == [{"func": "run", "idx": 0, "name": "T"}] and p["needs"][0]["field"] == "k" and p["tables"][0]["access"] == "index"
    long = "f(" + ", ".join(f'"a{i}"' for i in range(400)) + ")\n"
    assert len(parsers.parse("a.gd", long, "gdscript")["calls"][0]["args"]) == 400
    assert parsers.parse("a.gd", "var a = b %C\nvar q = %Unique.x\n", "gdscript")["node_paths"] == [{"value": "Unique", "line": 2}]


def test_configuration_scene_documents():
    p = parsers.project('[autoload]\nGame="*res://g.gd"\n[debug]\ngdscript/warnings/x=0\n')
    assert p["autoloads"] == {"Game": "res://g.gd"} and p["warnings_off"] == ["x"]
    assert parsers.presets('[preset.0]\nname="web"\nexclude_filter="tools/*, *.md"\n[preset.0.options]\npermissions/internet=false\n') == [{"name": "web", "exclude": ["tools/*", "*.md"], "internet": "false"}]
    s = parsers.scene('[ext_resource path="res://a.gd" id="1"]\n[node name="R"]\nscript = ExtResource("1")\n[node name="K" parent="."]\n[connection signal="p" from="K" to="." method="go"]\n')
    assert s["nodes"][0]["script"] == "res://a.gd" and s["nodes"][1]["path"] == "K" and s["connections"][0]["method"] == "go"
    m = parsers.markdown("a.md", "# T\nOne. Two `x`.\n- item\n| a | b |\n|---|---|\n| 1 | 2 |\n```py\ncode\n```\n")
    assert [x[0] for x in m["sentences"]] == ["One.", "Two `x`.", "item"] and m["sentences"][2][3] and [x[:2] for x in m["rows"]] == [(["a", "b"], 4), (["1", "2"], 6)] and m["blocks"] == [("py", 7, "code", "T")]
    assert parsers.markdown("b.md", "One two\nthree. Four\nfive.\n")["sentences"] == [("One two three.", 1, "", False), ("Four five.", 2, "", False)]
    assert len(parsers.ignore_patterns("/build/\n*.tmp\n!keep\n# c")) == 2


def test_directory_snapshot(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b.bin2": b"\0\0", "node_modules/c.js": b"y", "d.png": b"z", "e.txt": b"\xff\xfeok"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files, skipped = snapshot.directory(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"a.py", "e.txt"} and {r.path: r.why for r in skipped.collect()} == {"b.bin2": "binary", "node_modules/c.js": "vendored", "d.png": "binary"}


@pytest.fixture(scope="module")
def checkout(tmp_path_factory):
    root = tmp_path_factory.mktemp("checkout")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (root / "a.py").write_text("x = 1\n" * 20)
    (root / "d.png").write_bytes(b"\0")
    (root / "n.txt").write_bytes(b"a\0b")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "c.js").write_text("y")
    git("add", "."), git("commit", "-qm", "first")
    git("mv", "a.py", "b.py"), git("commit", "-qm", "fix name", "-m", "body text")
    return root


def test_git_log(spark, checkout, tmp_path):
    c, f, r = snapshot.read_log(spark, snapshot.write_log(str(checkout), str(tmp_path / "log.txt")), "me")
    assert [(x.subject, x.body.strip()) for x in c.orderBy("ord").collect()] == [("first", ""), ("fix name", "body text")]
    assert ("a.py", 20) in {(x.path, x.added) for x in f.collect()} and ("b.py", 0) in {(x.path, x.added) for x in f.collect()} and [(x.old, x.new) for x in r.collect()] == [("a.py", "b.py")]


def test_git_snapshot_at_any_ref(spark, checkout):
    files, skipped, sha = snapshot.at_ref(spark, str(checkout), "HEAD~1", "me")
    assert [(r.repo, r.path, r.text) for r in files.collect()] == [("me", "a.py", "x = 1\n" * 20)] and len(sha) == 40
    assert {r.path: r.why for r in skipped.collect()} == {"node_modules/c.js": "vendored", "d.png": "binary", "n.txt": "binary"}
    about = snapshot.ref_info(str(checkout), "HEAD")
    assert about["subject"] == "fix name" and about["branch"] == "main" and about["parent"] == sha


def test_command_line(checkout, tmp_path, capsys):
    from codestrata.cli import main

    assert main(["scan", str(checkout), "--out", str(tmp_path / "out"), "--ask", "change x"]) == 0
    assert (tmp_path / "out" / "result.json").exists() and (tmp_path / "out" / "context.md").read_text().startswith("#")
    assert main(["check", str(checkout)]) == 0


def test_facts_are_handed_on_piece_by_piece(spark, monkeypatch):
    import pyarrow as pa

    from codestrata.sources import parsers

    class Caught:
        def mapInArrow(self, run, schema):
            return lambda b: list(run(iter([b])))

        def mapInPandas(self, run, schema):
            return lambda b: list(run(iter([b.to_pandas()])))

    files = spark.createDataFrame([], "repo string, path string, text string, lang string")
    with monkeypatch.context() as m:
        m.setattr(parsers, "spread", lambda df: Caught())
        run = parsers.facts(files)
    text = "x = f(1, 'a')\n" * 2000
    rows = [{"repo": "r", "path": f"a{k}.py", "text": f"# {k}\n{text}", "lang": "python", "names": []} for k in range(100)]
    pieces = run(pa.RecordBatch.from_pylist(rows))
    assert sum(map(len, pieces)) == 100 and max(map(len, pieces)) * len(text) < 1_000_000
    got = parsers.facts(spark.createDataFrame([("r", "a.py", "x = f(1, 'a')", "python"), ("r", "b.gd", "@tool\nfunc f(): pass", "gdscript"), ("q", "a.py", "x = f(1, 'a')", "python")], "repo string, path string, text string, lang string"))
    got = {(r.repo, r.path): r for r in got.collect()}
    assert got["r", "b.gd"].annotations == {"tool": 1} and got["q", "a.py"].calls == got["r", "a.py"].calls and got["q", "a.py"].calls[0].args[1].s == "a"


def test_fingerprints_are_handed_on_piece_by_piece(spark):
    import pyarrow as pa

    from codestrata.operators import clones

    class Arrays:
        dtypes = [("repo", "string"), ("path", "string"), ("toks", "array<string>")]

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return lambda b: list(run(iter([b])))

        def mapInPandas(self, run, schema):
            return lambda b: list(run(iter([b.to_pandas()])))

    toks = [[f"t{k * j % 997}" for j in range(2000)] for k in range(1, 121)]
    run = clones.fingerprints(Arrays(), "path")
    pieces = run(pa.RecordBatch.from_pylist([{"repo": "r", "path": f"p{k}", "toks": t} for k, t in enumerate(toks)]))
    assert sum(map(len, pieces)) == sum(len(clones.winnow(t, 25, 10)) for t in toks) and max(map(len, pieces)) < 22_000 < sum(map(len, pieces))


def test_texts_without_room_for_a_run_do_not_meet(spark):
    from codestrata.operators import clones

    def text(name, start, n):  # n tokens of a common stretch, from its start or its end, between tokens of the text's own
        common = [f"c{i}" for i in range(90)][start : start + n]
        return [f"{name}{i}" for i in range(40)] + common + [f"{name}{i}" for i in range(40, 80)]

    toks = {"all": text("u", 0, 90), "half": text("v", 0, 60), "head": text("w", 0, 75), "tail": text("x", 15, 75), "bare": [f"c{i}" for i in range(70)]}
    df = spark.createDataFrame([("r", p, t, list(range(1, len(t) + 1))) for p, t in toks.items()], "repo string, path string, toks array<string>, lines array<int>")
    got = {(r.a, r.b) for r in clones.pair_seeds(clones.packed(df, "path"), "path").collect()}
    long_ = {("all", "bare"), ("all", "head"), ("all", "tail"), ("bare", "head")}  # the others have 60 tokens in common at most
    assert long_ <= got
    assert {(r.a, r.b) for r in clones.clone_runs(df, "path").collect()} == long_
    # 40 tokens in common leave no seed
    short = spark.createDataFrame([("r", p, text(p, 20, 40), list(range(1, 121))) for p in "ab"], "repo string, path string, toks array<string>, lines array<int>")
    p = clones.packed(short, "path")
    assert clones.pair_seeds(p, "path", shortest=25).count() == 1 and clones.pair_seeds(p, "path").count() == 0


def test_texts_of_clones_are_packed(spark):
    from codestrata.operators import clones

    # more kinds of tokens than a byte counts, and a gap in the lines that a byte can't hold
    toks, lines = [f"t{j}" for j in range(5000)], [1] * 2500 + [70_001] * 2500
    df = spark.createDataFrame([("r", "a", toks, lines), ("r", "b", toks[1:], lines[1:]), ("r", "c", [], []), ("r", "d", ["I", "(", ")"] * 2000, list(range(1, 6001)))], "repo string, path string, toks array<string>, lines array<int>")
    p = {r.path: r for r in clones.packed(df, "path").collect()}
    back = lambda r: [r.words[x] for x in clones._numbers(r.codes, r.n)]
    assert back(p["a"]) == toks and back(p["b"]) == toks[1:] and back(p["c"]) == [] and back(p["d"]) == ["I", "(", ")"] * 2000
    assert clones._numbers(p["a"].steps, p["a"].n).cumsum().tolist() == lines and len(p["d"].codes) + len(p["d"].steps) == 2 * 6000
    # the rows in which two texts meet hold no array with an element for each token
    runs = clones.clone_runs(df, "path")
    wide = [f for f in runs._jdf.queryExecution().analyzed().children().head().output().mkString(",").split(",") if "toks" in f or "lines" in f]
    assert wide == [] and [(r.a, r.b, r.a_start, r.b_start, r.tokens, r.a_line, r.b_end_line) for r in clones.outermost(runs).collect() if r.a != r.b] == [("a", "b", 2, 1, 4999, 1, 70_001)]


def test_json_keys(spark):
    deep = '{"k": ' * 90 + "1" + "}" * 90
    t = spark.createDataFrame([("r", "a", '{"x": {"y": [{"z": 1}]}}'), ("r", "b", "no json"), ("r", "c", None), ("r", "d", deep.replace('"k": 1', '"last": 1'))], "repo string, path string, text string")
    assert sorted({r.key for r in snapshot.json_keys(t).collect()}) == ["k", "last", "x", "y", "z"]


def test_json_keys_of_any_size_and_depth(spark):
    long, deep = '{"long": [' + "1, " * 200_000 + '{"late": "' + "x" * 1000 + '"}]}', '{"k": [' * 30_000 + '{"deepest": -1.5e3}' + "]}" * 30_000
    t = spark.createDataFrame([("r", "a", long), ("r", "b", deep), ("r", "c", deep[:-1]), ("r", "d", '{"n": ' + "9" * 5000 + "}")], "repo string, path string, text string")
    assert sorted((r.path, r.key) for r in snapshot.json_keys(t).collect()) == [("a", "late"), ("a", "long"), ("b", "deepest"), ("b", "k"), ("d", "n")]


def test_keys_of_a_large_json_file_count_as_written(spark):
    code = "def f(d):\n    a = d['late']\n    return a + d['lost']\n"
    s = Scan(spark, spark.createDataFrame([("a.py", code), ("b.json", "[" + "1, " * 200_000 + '{"late": 1}]')], "path string, text string"))
    assert {r.key for r in s.dangling.collect()} == {"lost"}


def test_stream_counts_match_batch(spark, tmp_path):
    rows = [("r", f"s{k % 7}", f"p{k % 5}", k) for k in range(35)]
    df = spark.createDataFrame(rows, "repo string, sha string, path string, k int")
    df.drop("k").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, sha string, path string").parquet(str(tmp_path / "in"))
    cochange.run_pairs(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("repo", "a", "b").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cochange.pairs_of_batch(df).collect()))


def test_empty_snapshot(spark):
    s = Scan(spark, spark.createDataFrame([], "path string, text string"))
    assert s.findings.count() == 0 and s.ranking.count() == 0 and s.score().count() == 0


def test_scores_of_versions(spark):
    v = spark.createDataFrame([("r", "s0", "a.py", "x = 1\n"), ("r", "s1", "a.py", "x = 2\n"), ("r", "s1", "tests/test_a.py", "from a import x\n")], "repo string, sha string, path string, text string")
    assert {r.sha for r in scored_timeline(spark, v).collect()} == {"s0", "s1"}
