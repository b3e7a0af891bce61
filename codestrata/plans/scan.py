"""The auditor's commands over snapshots of any number of repositories at once: scan, check, score and timeline.

A ``Scan`` is a set of lazy DataFrames, all keyed by (repo, path); no name of one repository is held against another's. What several results need
(facts, edges, tables) is cut once. Requests to a scan are in ``codestrata.plans.impact``.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import clones, contracts, documents, graph, history, ranking, retrieval, routing, scoring, smells
from codestrata.session import cut
from codestrata.sources import parsers, snapshot

# Fixed: how strongly a kind of reference binds.
EDGE_WEIGHT = {
    "extends": 1.0, "scene-script": 1.0, "class": 0.8, "autoload": 0.8, "preload": 0.7, "load": 0.5, "import": 0.7, "include": 0.7, "ext_resource": 0.6, "ref": 0.4, "autoload-decl": 0.3, "main_scene": 0.3,
}
# Fixed: members that every scripted class inherits from the engine's base classes; a longer list is a parameter of the scan.
ENGINE_MEMBERS = """
new free get set call callv call_deferred connect disconnect is_connected emit_signal has_method has_signal get_class is_class get_script set_script get_meta set_meta has_meta
remove_meta notification to_string get_instance_id set_deferred add_child remove_child get_child get_children get_child_count get_node get_node_or_null has_node get_parent
find_child get_tree is_inside_tree queue_free reparent get_index get_path owner name process_mode add_to_group remove_from_group is_in_group create_tween get_viewport ready
tree_entered tree_exiting tree_exited visible modulate position rotation scale global_position show hide instantiate script duplicate resource_path
""".split()  # noqa: SIM905
# Fixed: arguments (from 0) of calls that name the engine's vocabulary, not a contract of the project.
ENGINE_ARGUMENTS = {
    "tween_property": [1], "add_theme_color_override": [0], "add_theme_constant_override": [0], "add_theme_font_size_override": [0], "add_theme_stylebox_override": [0], "add_theme_font_override": [0],
    "add_theme_icon_override": [0], "get_theme_color": [0, 1], "get_theme_constant": [0, 1], "get_theme_font": [0, 1], "get_theme_font_size": [0, 1], "get_theme_stylebox": [0, 1], "get_theme_icon": [0, 1],
    "has_theme_color": [0, 1], "set": [0], "get": [0], "has_method": [0], "is_class": [0], "print": [0], "push_error": [0], "push_warning": [0], "assert": [1], "printerr": [0], "prints": [0], "print_debug": [0], "format": [0],
}
# Fixed: calls that write data which outlives the program, and calls that ask whether a path exists.
WRITES = ["store_string", "store_line", "store_var", "store_buffer", "store_csv_line", "setItem", "writeFile", "writeFileSync", "dump", "save_png", "save_webp"]
EXIST = ["exists", "file_exists", "dir_exists", "dir_exists_absolute", "has_file"]
# Fixed: bases whose keys come from outside, calls that load settings or database rows.
OUTSIDE = (
    r"^(Time|OS|Engine|ProjectSettings|JSON|DisplayServer|Input|ClassDB|Performance|IP|RenderingServer)\.|get_(property|method|signal)_list|get_datetime|get_date_dict|get_time_dict|environ|os\.|sys\.|json\."
    r"|response|headers|request|argv|kwargs"
)
LOADERS = ["update", "load", "loads", "populate", "read_dict", "read_file", "read_string"]
ROW_CALLS = ["fetchone", "fetchall", "fetchmany", "fetchrow", "fetchval"]
# Fixed: extensions of source files whose absence makes a mention stale; what a path and a member look like in prose.
SOURCE_EXTENSIONS = "gd py ts tsx js jsx mjs cjs cs tscn tres gdshader gdshaderinc go rs swift kt java rb php c cpp h hpp lua dart sh".split()
PATH_LIKE = r"^[\w.\-]+(/[\w.\-]+)+/?$|^[\w\-]+\.(gd|py|ts|tsx|js|jsx|cs|tscn|tres|gdshader|go|rs|swift|kt)$"
MEMBER_LIKE = r"^([A-Z][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)(\(\))?$"
COLOUR = r"^#?[0-9a-fA-F]{6}([0-9a-fA-F]{2})?$"
SCRIPT_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte"]
K = ["repo", "path"]
NODES = ["code", "generated", "test", "tool", "resource"]
DEPENDANTS = ["code", "generated", "resource"]


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def resource_path(spec: Column, root: Column) -> Column:
    return X.normal_path(F.concat(F.coalesce(root, F.lit("")), F.regexp_replace(spec, "^res://", "")))


class Scan:
    """Snapshots: ``files`` ([repo,] path, text), optionally ``commits`` ([repo,] sha, ord, ts, author, subject, body) with ``commit_files`` ([repo,] sha,
    path, added, deleted), ``renames`` ([repo,] ord, old, new), ``assets`` ([repo,] path) that exist without text, and ``excluded`` export patterns
    (shell style, for all repositories). Without ``repo`` everything is one repository. The engine's own checks run in repositories with a
    project file; ``engine`` runs them in all (for tables that hold source files only)."""

    def __init__(
        self, spark: SparkSession, files: DataFrame, commits: DataFrame | None = None, commit_files: DataFrame | None = None, assets: DataFrame | None = None, excluded: list[str] = (),
        engine_members: list[str] | None = None, engine: bool = False, renames: DataFrame | None = None,
    ):
        keyed = "repo" in files.columns
        own = lambda df: None if df is None else df if keyed else df.withColumn("repo", F.lit("-"))
        self.spark, self.files = spark, own(files).select("repo", "path", "text").filter(F.col("path").isNotNull())
        self.commits, self.commit_files, self.assets, self.renames = own(commits), own(commit_files), own(assets), own(renames)
        self.engine_members = ENGINE_MEMBERS if engine_members is None else engine_members
        self.excluded, self.always = list(excluded), engine

    # -- relations ----------------------------------------------------------------------------------------------------------------
    @cached_property
    def resources(self) -> DataFrame:
        return cut(parsers.resources(self.files))

    @cached_property
    def projects(self) -> DataFrame:
        """(repo, root, project, autoloads, actions, warnings_off, warnings_line): each repository's project file with the shortest path."""
        p = self.resources.filter("kind = 'project'")
        row = F.struct(F.char_length("path").alias("n"), "path", F.struct("autoloads", "actions", "warnings_off", "warnings_line").alias("x"))
        one = p.groupBy("repo").agg(F.min_by(row, F.struct(F.char_length("path"), "path")).alias("r"))
        return one.select("repo", F.regexp_replace("r.path", r"project\.godot$", "").alias("root"), F.col("r.path").alias("project"), "r.x.*")

    @cached_property
    def engines(self) -> DataFrame:
        """(repo) where the engine's checks run."""
        return self.files.select("repo").distinct() if self.always else self.projects.select("repo")

    @cached_property
    def autoloads(self) -> DataFrame:
        """(repo, name, path)."""
        a = self.projects.select("repo", "root", F.explode("autoloads").alias("name", "spec")).filter(F.startswith("spec", F.lit("res://")))
        return a.select("repo", "name", resource_path(F.col("spec"), F.col("root")).alias("path"))

    @cached_property
    def exclusions(self) -> DataFrame:
        """(repo, root, pattern, glob): export patterns of the presets beside a project file, and those given, as regular expressions."""
        ps = self.resources.filter("kind = 'presets'").join(self.projects.select("repo", "root"), "repo").filter(F.col("path") == F.concat("root", F.lit("export_presets.cfg")))
        globs = ps.select("repo", "root", F.explode("presets").alias("p")).select("repo", "root", F.explode("p.exclude").alias("glob"))
        if self.excluded:
            given = self.files.select("repo").distinct().join(self.projects.select("repo", "root"), "repo", "left").select("repo", F.coalesce("root", F.lit("")).alias("root"), F.explode(F.array(*map(F.lit, self.excluded))).alias("glob"))
            globs = globs.union(given)
        quoted = F.regexp_replace("glob", r"([.\\+^$()|{}])", r"\\$1")
        body = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"\*+$", "*"), r"\*", ".*"), r"\?", ".")
        return globs.distinct().select("repo", "root", "glob", F.concat(F.lit("^"), body, F.lit("$")).alias("pattern"))

    def left_out(self, paths: DataFrame) -> DataFrame:
        """Paths (repo, path) that an export pattern leaves out. A repository's patterns are one expression."""
        one = self.exclusions.groupBy("repo", "root").agg(F.array_join(F.array_sort(F.collect_set("pattern")), "|").alias("pattern"))
        inside = F.when(F.startswith("path", F.col("root")), F.expr("substring(path, length(root) + 1)")).otherwise(F.col("path"))
        return paths.select(*K).distinct().join(one, "repo").filter(F.regexp_like(inside, F.col("pattern"))).select(*K)

    @cached_property
    def facts(self) -> DataFrame:
        f = self.files.withColumn("lang", X.language(F.col("path")))
        names = self.projects.select("repo", F.map_keys("autoloads").alias("names"))
        return cut(parsers.facts(f.join(names, "repo", "left")))

    def part(self, name: str) -> DataFrame:
        return parsers.exploded(self.facts, name)

    @cached_property
    def roles(self) -> DataFrame:
        """(repo, path, role, lang, loc, lines, class_name, extends, generated_by, doc): source files, scenes and configuration."""
        cols = ["lang", "loc", "lines", "class_name", "extends", "generated_by", "doc"]
        none = [F.lit(None).cast(t).alias(c) for c, t in (("class_name", "string"), ("extends", "string"), ("generated_by", "string"), ("doc", "string"))]
        f = self.facts.select(*K, *cols)
        r = self.resources.select(*K, F.concat(F.lit("engine-"), "kind").alias("lang"), "loc", F.col("loc").alias("lines"), *none)
        f = _all([f, r]).join(self.left_out(f).withColumn("out", F.lit(True)), K, "left").join(self.projects.select("repo", "root"), "repo", "left")
        at = F.when(F.startswith("path", F.coalesce("root", F.lit(""))), F.expr("substring(path, length(coalesce(root, '')) + 1)")).otherwise(F.col("path"))
        role = X.role(F.col("path"), F.col("generated_by"), F.coalesce("out", F.lit(False)) | at.rlike(X.TOOL_PATH))
        return cut(f.select(*K, role.alias("role"), *cols))

    def in_roles(self, df: DataFrame, *roles: str, col: str = "path") -> DataFrame:
        return df.join(self.roles.filter(F.col("role").isin(*roles)).select("repo", F.col("path").alias(col)), ["repo", col], "left_semi")

    @cached_property
    def paths(self) -> DataFrame:
        p = self.files.select(*K)
        return cut((p.union(self.assets.select(*K)) if self.assets is not None else p).distinct())

    @cached_property
    def places(self) -> DataFrame:
        """(repo, path): everything that exists, folders included."""
        return cut(self.paths.union(self.paths.select("repo", F.explode(X.folders(F.col("path"))).alias("path"))).distinct())

    @cached_property
    def globals(self) -> DataFrame:
        """(repo, name, path, kind): autoloads, and classes that aren't named like one (the first declaring path)."""
        c = self.roles.filter(F.col("class_name").isNotNull()).groupBy("repo", F.col("class_name").alias("name")).agg(F.min("path").alias("path"))
        a = self.autoloads
        return cut(a.withColumn("kind", F.lit("autoload")).unionByName(c.join(a, ["repo", "name"], "left_anti").withColumn("kind", F.lit("class"))))

    @cached_property
    def parents(self) -> DataFrame:
        """(repo, path, ancestor) of scripts by what they extend."""
        e = self.roles.filter(F.col("extends").isNotNull()).join(self.projects.select("repo", "root"), "repo", "left")
        direct = e.filter(F.startswith("extends", F.lit("res://"))).select("repo", "path", resource_path(F.col("extends"), F.col("root")).alias("parent"))
        named = e.join(self.globals.filter("kind = 'class'").select("repo", F.col("name").alias("extends"), F.col("path").alias("parent")), ["repo", "extends"]).select("repo", "path", "parent")
        up = graph.ancestors(direct.union(named).filter("path <> parent").select("repo", F.col("path").alias("name"), "parent"))
        return cut(up.select("repo", F.col("name").alias("path"), "ancestor"))

    @cached_property
    def imports(self) -> DataFrame:
        """(repo, src, spec, line, how, target): every import with the path it names in the repository, null where it names none."""
        i = self.part("imports").join(self.roles.select(*K, "lang"), K).withColumnRenamed("path", "src")
        scene = self.resources.select("repo", F.col("path").alias("src"), F.explode("resources").alias("r")).select("repo", "src", F.col("r.path").alias("spec"), F.col("r.line").alias("line"), F.lit("ext_resource").alias("how"), F.lit("engine-scene").alias("lang"))
        i = i.select("repo", "src", "spec", "line", "how", "lang").unionByName(scene).join(self.projects.select("repo", "root"), "repo", "left").distinct()
        keep = ["repo", "src", "spec", "line", "how"]
        res = F.startswith("spec", F.lit("res://"))
        engine = i.filter(res).select(*keep, resource_path(F.col("spec"), F.col("root")).alias("target"))
        base = X.dirname(F.col("src"))
        joined = lambda a, b: X.normal_path(F.concat(a, F.lit("/"), b))
        dots = F.char_length(F.regexp_extract("spec", r"^(\.*)", 1))
        up = F.concat(base, F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))))
        module = F.regexp_replace(F.regexp_replace("spec", r"^\.+", ""), r"\.", "/")
        py = i.filter(~res & (F.col("lang") == "python"))
        near = py.filter(dots > 0)
        known = self.files.select(*K)
        relative = contracts.resolve_first(near, F.array(F.concat(joined(up, module), F.lit(".py")), joined(up, F.concat(module, F.lit("/__init__.py")))), known, keep)
        modules = self.files.filter(F.endswith("path", F.lit(".py"))).select("repo", F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), "/", ".").alias("name"), F.col("path").alias("target"))
        dotted = py.filter(dots == 0).withColumns({"m1": F.col("spec"), "m2": F.concat(F.regexp_replace(base, "/", "."), F.lit("."), "spec")})
        asked = dotted.select("repo", F.col("m1").alias("module")).union(dotted.filter(base != "").select("repo", "m2")).distinct()
        got = cut(contracts.longest_prefix(asked, modules))
        first = dotted.join(got.select("repo", F.col("module").alias("m1"), F.col("target").alias("t1")), ["repo", "m1"], "left").join(got.select("repo", F.col("module").alias("m2"), F.col("target").alias("t2")), ["repo", "m2"], "left")
        absolute = first.select(*keep, F.coalesce("t1", "t2").alias("target"))
        other = i.filter(~res & (F.col("lang") != "python") & F.col("how").isin("import", "include") & (F.startswith("spec", F.lit(".")) | (F.col("how") == "include")))
        stem = joined(base, F.col("spec"))
        ends = F.array(stem, *[F.concat(stem, F.lit(e)) for e in SCRIPT_ENDINGS], *[F.concat(stem, F.lit("/index" + e)) for e in SCRIPT_ENDINGS[:4]])
        script = contracts.resolve_first(other, ends, known, keep)
        found = _all([engine, relative.withColumnRenamed("path", "target"), absolute, script.withColumnRenamed("path", "target")]).filter(F.col("target").isNotNull())
        return cut(i.select(*keep, "lang").join(found, keep, "left"))

    @cached_property
    def edges(self) -> DataFrame:
        """Static edges (repo, src, dst, kind, weight, lines, members)."""
        w = F.create_map(*[F.lit(x) for kv in EDGE_WEIGHT.items() for x in kv])
        gd = self.roles.filter("lang = 'gdscript'").select("repo", F.col("path").alias("src"), "extends", "class_name")
        g = self.globals.select("repo", "name", F.col("path").alias("dst"), F.col("kind").alias("as"))
        refs = self.part("refs").withColumnRenamed("path", "src").join(gd, ["repo", "src"]).filter(~F.col("name").eqNullSafe(F.col("class_name"))).join(g, ["repo", "name"])
        kind = F.when(F.col("as") == "autoload", "autoload").when((F.col("name") == F.col("extends")) & F.col("member").isNull(), "extends").otherwise("class")
        refs = refs.select("repo", "src", "dst", kind.alias("kind"), "line", "member")
        none = F.lit(None).cast("string").alias("member")
        how = F.when((F.col("how") == "ext_resource") & F.endswith("target", F.lit(".gd")), "scene-script").when(F.col("how") == "from", "import").otherwise(F.col("how"))
        imp = self.imports.filter(F.col("target").isNotNull()).select("repo", "src", F.col("target").alias("dst"), how.alias("kind"), "line", none)
        nodes = self.resources.select("repo", F.col("path").alias("src"), F.explode("nodes").alias("n")).filter(F.col("n.script").isNotNull()).join(self.projects.select("repo", "root"), "repo", "left")
        scene = nodes.select("repo", "src", resource_path(F.col("n.script"), F.col("root")).alias("dst"), F.lit("scene-script").alias("kind"), F.col("n.line").alias("line"), none)
        e = _all([refs, imp, scene]).filter("src <> dst").join(self.roles.select("repo", F.col("path").alias("dst")), ["repo", "dst"], "left_semi")
        return cut(graph.merge_references(e.withColumn("weight", F.coalesce(F.try_element_at(w, F.col("kind")), F.lit(0.4)))))

    @cached_property
    def strings(self) -> DataFrame:
        """(repo, a, b, n, weight, sample): identifiers that source files (tools aside) share as strings, engine vocabulary left out."""
        s = self.in_roles(self.part("strings"), "code", "test", "generated")
        s = s.filter(F.col("value").rlike(r"^[A-Za-z_][A-Za-z_0-9.:/\-]{2,48}$") & ~F.startswith("value", F.lit("res://")) & ~((F.upper("value") == F.col("value")) & (F.char_length("value") <= 3)))
        places = F.create_map(*[x for f, i in ENGINE_ARGUMENTS.items() for x in (F.lit(f), F.array(*map(F.lit, i)))])
        calls = self.part("calls").withColumn("at", F.try_element_at(places, F.col("fn"))).filter(F.col("at").isNotNull())
        words = calls.select(*K, "line", F.posexplode("args").alias("p", "a"), "at").filter(F.array_contains("at", F.col("p")) & (F.col("a.k") == "str")).select(*K, "line", F.col("a.s").alias("value")).distinct()
        n = self.roles.filter(F.col("role").isin("code", "test", "tool", "generated")).groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
        return cut(contracts.shared_strings(s.join(words, [*K, "line", "value"], "left_anti").select(*K, "value"), n))

    # -- history --------------------------------------------------------------------------------------------------------------------
    @cached_property
    def touched(self) -> DataFrame | None:
        """(repo, sha, path, lines): what commits touch, under the files' current names."""
        if self.commits is None or self.commit_files is None:
            return None
        cf = self.commit_files
        if self.renames is not None:
            now = history.current_names(self.renames).select("repo", F.col("old").alias("path"), "current")
            cf = cf.join(now, K, "left").withColumn("path", F.coalesce("current", "path")).drop("current")
        return cut(history.touched(cf, self.roles))

    @cached_property
    def seasoned(self) -> DataFrame:
        """(repo, commits) of repositories with five commits or more."""
        return self.commits.groupBy("repo").agg(F.count(F.lit(1)).alias("commits")).filter("commits >= 5")

    @cached_property
    def pairs(self) -> DataFrame | None:
        if self.touched is None:
            return None
        return cut(history.with_confidence(history.pair_stats(self.touched), history.file_history(self.touched, self.commits)))

    @cached_property
    def hidden(self) -> DataFrame | None:
        """(repo, path, partner, n, confidence) of files that change together without any reference or shared strings."""
        if self.pairs is None:
            return None
        links = self.edges.select("repo", "src", "dst").union(self.strings.select("repo", "a", "b"))
        return cut(history.hidden_partners(self.pairs.join(self.seasoned.select("repo"), "repo", "left_semi"), links))

    # -- contracts ------------------------------------------------------------------------------------------------------------------
    def _source(self, name: str) -> DataFrame:
        return self.in_roles(self.part(name), "code", "test", "tool", "generated")

    @cached_property
    def calls(self) -> DataFrame:
        return cut(self._source("calls"))

    @cached_property
    def tables(self) -> DataFrame:
        """(repo, table_id, path, line, access, open, handled, key, key_line, special)."""
        t = self._source("tables").select("repo", "path", routing.table_id(F.col("path"), F.col("name")).alias("table_id"), "line", "access", "open", "handled", "special", F.explode("keys").alias("k"))
        return cut(t.select("repo", "table_id", "path", "line", "access", "open", "handled", F.col("k.key").alias("key"), F.col("k.line").alias("key_line"), "special"))

    @cached_property
    def routes(self) -> DataFrame:
        return routing.route_table(self._source("routes"), self.calls, self._source("funcs"), self.globals, self.parents)

    @cached_property
    def sends(self) -> DataFrame:
        """(repo, table_id, key, file, line, fn, payload, role)."""
        s = routing.sends(self.routes, self.calls, self.part("dicts"), self._source("funcs"), self.globals, self.parents)
        return cut(s.join(self.roles.select("repo", F.col("path").alias("file"), "role"), ["repo", "file"], "left"))

    @cached_property
    def registered(self) -> DataFrame:
        return routing.registered(self._source("writers"), self.calls)

    @cached_property
    def needs(self) -> DataFrame:
        """(repo, table_id, key, field, line, returns, path, handler) of tables that something is sent to."""
        n = self._source("needs").select("repo", "path", routing.table_id(F.col("path"), F.col("name")).alias("table_id"), "key", "handler", "field", "line", "returns")
        return n.join(self.sends.select("repo", "table_id").distinct(), ["repo", "table_id"], "left_semi")

    @cached_property
    def members(self) -> DataFrame:
        """(repo, path, member) that scripts declare."""
        m = self.part("symbols").select(*K, F.col("name").alias("member")).union(self.part("funcs").select(*K, "name"))
        return m.join(self.roles.filter("lang = 'gdscript'").select(*K), K, "left_semi").distinct()

    def missing_members(self, refs: DataFrame) -> DataFrame:
        """References (repo, name, member, file, line) to members of globals that neither the script nor its ancestors nor the engine declare."""
        g = self.globals.join(self.roles.filter("lang = 'gdscript'").select(*K), K, "left_semi").select("repo", "name", F.col("path").alias("class"))
        known = self.spark.createDataFrame([(m,) for m in self.engine_members], "member string") if self.engine_members else None
        r = refs.filter(F.col("member").isNotNull()).join(g, ["repo", "name"])
        if known is not None:
            r = r.join(F.broadcast(known), "member", "left_anti")
        # a script without any declaration of its own still counts as known
        declared = self.members.withColumnRenamed("path", "class").unionByName(g.select("repo", "class", F.lit("").alias("member")).distinct())
        up = self.parents.select("repo", F.col("path").alias("name"), "ancestor")
        lost = contracts.missing_members(r.select("repo", "class", "member", "file", "line"), declared, up)
        return r.join(lost.distinct(), ["repo", "class", "member", "file", "line"], "left_semi")

    @cached_property
    def signals(self) -> DataFrame:
        """(repo, path, value, line, emits, connects, listeners, severity) of declared signals."""
        d = self._source("signals").join(self.engines, "repo", "left_semi")
        state = contracts.signal_state(*[self._source(x).select("repo", F.col("value").alias("name")) for x in ("signals", "emits", "connects")])
        heard = self._source("connects").groupBy("repo", "value").agg(F.collect_set("path").alias("heard"))
        j = d.join(state.select("repo", F.col("name").alias("value"), "emits", "connects", "severity"), ["repo", "value"]).join(heard, ["repo", "value"], "left")
        none = F.array().cast("array<string>")
        return cut(j.select(*K, "value", "line", "emits", "connects", F.size(F.array_remove(F.coalesce("heard", none), F.col("path"))).alias("listeners"), "severity"))

    @cached_property
    def engine_calls(self) -> DataFrame:
        """(repo, path, fn, name, line): calls whose first argument is a literal."""
        c = self.calls.join(self.engines, "repo", "left_semi").withColumn("a", F.get("args", F.lit(0))).filter("a.k = 'str'")
        return c.select(*K, "fn", F.col("a.s").alias("name"), "line")

    @cached_property
    def scene_connections(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Connections (repo, scene, to, signal, method, line), nodes (repo, scene, path, script), methods with inheritance (repo, script, method); a
        script under an engine class of its own has no less: what the engine adds is unknown only above it."""
        root = self.projects.select("repo", "root")
        s = self.resources.filter("kind = 'scene'").join(self.engines, "repo", "left_semi").join(root, "repo", "left")
        c = s.select("repo", F.col("path").alias("scene"), F.explode("connections").alias("c")).select("repo", "scene", "c.to", "c.signal", "c.method", "c.line")
        n = s.select("repo", F.col("path").alias("scene"), "root", F.explode("nodes").alias("n")).select("repo", "scene", "n.path", resource_path(F.col("n.script"), F.col("root")).alias("script"))
        own = self.part("funcs").select("repo", F.col("path").alias("script"), F.col("name").alias("method")).distinct()
        got = self.parents.withColumnsRenamed({"path": "script", "ancestor": "up"}).join(own.withColumnRenamed("script", "up"), ["repo", "up"]).select("repo", "script", "method")
        return c, n, own.union(got).distinct()

    @cached_property
    def invariants(self) -> DataFrame:
        """(repo, path, kind, line, text): what other files count on in a file without a reference: routing keys, payload fields, signals, meta keys and
        methods that scenes call."""
        parts = []
        sent = self.sends.groupBy("repo", "table_id", "key").agg(F.count(F.lit(1)).alias("n"))
        t = self.tables.join(sent, ["repo", "table_id", "key"])
        parts.append(t.select(*K, F.lit("routing").alias("kind"), F.col("key_line").alias("line"), F.format_string("'%s' is a key of %s, sent from %d site%s", "key", F.substring_index("table_id", "::", -1), "n", F.when(F.col("n") == 1, "").otherwise("s")).alias("text")))
        parts.append(self.needs.select(*K, F.lit("payload").alias("kind"), "line", F.format_string("handler %s requires info['%s'] for event '%s'", "handler", "field", "key").alias("text")))
        g = self.signals.filter("listeners > 0")
        parts.append(g.select(*K, F.lit("signal").alias("kind"), "line", F.format_string("signal %s has listeners in %d other file%s", "value", "listeners", F.when(F.col("listeners") == 1, "").otherwise("s")).alias("text")))
        m = self.engine_calls.filter(F.col("fn").isin("set_meta", *documents.META_READS))
        both = documents.shared_meta(m).select("repo", "name")
        parts.append(m.filter("fn = 'set_meta'").join(both, ["repo", "name"], "left_semi").select(*K, F.lit("meta").alias("kind"), "line", F.format_string("meta key '%s' is read in other files", "name").alias("text")))
        c, n, methods = self.scene_connections
        by_name = c.withColumn("to", F.coalesce("to", F.lit("."))).join(n.select("repo", "scene", F.col("path").alias("to"), "script"), ["repo", "scene", "to"]).join(methods, ["repo", "script", "method"], "left_semi")
        at = self.part("funcs").groupBy("repo", F.col("path").alias("script"), F.col("name").alias("method")).agg(F.min("line").alias("at"))
        s = by_name.join(at, ["repo", "script", "method"], "left")
        parts.append(s.select("repo", F.col("script").alias("path"), F.lit("scene").alias("kind"), F.coalesce("at", F.lit(0)).alias("line"), F.format_string("%s() is called by name from %s", "method", "scene").alias("text")))
        return cut(_all(parts).distinct())

    # -- documents --------------------------------------------------------------------------------------------------------------------
    @cached_property
    def docs(self) -> DataFrame:
        """Parts of the documents (see ``documents.with_markdown``) with ``weight`` and ``is_prompt``."""
        d = self.files.filter(F.col("text").isNotNull() & X.is_doc(F.col("path"))).withColumnRenamed("path", "doc")
        p = cut(documents.with_markdown(d))
        head = p.filter("part = 'doc'").select("repo", "doc", F.col("starts_item").alias("is_prompt"))
        return cut(p.join(head, ["repo", "doc"]).withColumn("weight", X.agent_weight(F.col("doc"))))

    @cached_property
    def stale(self) -> DataFrame:
        """(repo, doc, line, mention, kind): files, folders and members that documents name although they don't exist (any more), at their first mention.
        Mentions in a context that speaks of removal, and paths that an ignore file covers, don't count."""
        s = F.regexp_replace(F.trim("text"), r"[.,;:]+$", "")
        m = self.docs.filter((F.col("part") == "span") & ~F.col("starts_item")).select("repo", "doc", "line", s.alias("mention"))
        m = m.filter(~F.col("mention").rlike(r"[ *<]|://|^(-|\$|~|user:|/)")).groupBy("repo", "doc", "mention").agg(F.min("line").alias("line"))
        last = F.substring_index("mention", "/", -1)
        file = F.col("mention").rlike(PATH_LIKE) & F.contains(last, F.lit("."))
        folder = F.endswith("mention", F.lit("/")) & F.regexp_replace("mention", "/$", "").rlike(PATH_LIKE)
        rel = F.regexp_replace("mention", r"^[./]+", "")
        near = X.normal_path(F.concat(X.dirname(F.col("doc")), F.lit("/"), rel))
        f = m.filter(file & X.extension(F.col("mention")).isin(SOURCE_EXTENSIONS)).withColumns({"rel": rel, "near": near})
        tails = self.paths.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), i, F.size(F.split("path", "/"))), "/"))).alias("rel")).distinct()
        f = f.join(tails, ["repo", "rel"], "left_anti").join(self.places.withColumnRenamed("path", "rel"), ["repo", "rel"], "left_anti").join(self.places.withColumnRenamed("path", "near"), ["repo", "near"], "left_anti")
        d = m.filter(folder & ~file).withColumn("rel", F.regexp_replace("mention", "/$", ""))
        d = d.join(self.places.withColumnRenamed("path", "rel"), ["repo", "rel"], "left_anti").withColumn("near", F.col("rel"))
        both = _all([f.withColumn("kind", F.lit("file")), d.withColumn("kind", F.lit("dir"))])
        ignored = both.join(self.ignored, "repo").withColumn("at", F.when(F.col("base") == "", F.col("rel")).when(F.startswith("rel", F.concat("base", F.lit("/"))), F.expr("substring(rel, length(base) + 2)")))
        ignored = ignored.filter(F.coalesce(F.regexp_like("at", F.col("pattern")), F.lit(False))).select("repo", "doc", "mention")
        both = both.join(ignored, ["repo", "doc", "mention"], "left_anti").select("repo", "doc", "line", "mention", "kind")
        mem = m.filter(F.col("mention").rlike(MEMBER_LIKE) & ~file).join(self.engines, "repo", "left_semi")
        mem = mem.select("repo", F.col("doc").alias("file"), "line", "mention", F.regexp_extract("mention", MEMBER_LIKE, 1).alias("name"), F.regexp_extract("mention", MEMBER_LIKE, 2).alias("member"))
        gone = self.missing_members(mem).select("repo", F.col("file").alias("doc"), "line", "mention", F.lit("member").alias("kind"))
        return cut(both.unionByName(gone))

    @cached_property
    def ignored(self) -> DataFrame:
        """(repo, base, pattern): what the ignore files cover, one expression per file."""
        rows = self.files.filter(X.basename(F.col("path")) == ".gitignore").filter(F.col("text").isNotNull())

        def read(batches):
            import pandas as pd

            for b in batches:
                out = [(r, p.rpartition("/")[0], "|".join(parsers.ignore_patterns(t))) for r, p, t in zip(b.repo, b.path, b.text)]
                yield pd.DataFrame([x for x in out if x[2]], columns=["repo", "base", "pattern"])

        return rows.mapInPandas(read, "repo string, base string, pattern string")

    @cached_property
    def doc_weights(self) -> DataFrame:
        """(repo, doc, weight): documents, those that an agent's own file points at weighing 2 at least."""
        d = self.docs.filter("part = 'doc'").select("repo", "doc", "weight")
        return documents.pointed(d, self.docs.filter("part = 'span'").select("repo", "doc", F.trim("text").alias("span")))

    @cached_property
    def prompts(self) -> DataFrame:
        """(repo, doc, prompt_id, line, lines, status, class)."""
        return self.docs.filter("part = 'prompt'").select("repo", "doc", F.col("heading").alias("prompt_id"), "line", F.col("size").alias("lines"), F.col("text").alias("status"), X.status_class(F.col("text")).alias("class"))

    # -- graph and metrics ------------------------------------------------------------------------------------------------------------
    @cached_property
    def graph(self) -> DataFrame:
        """(repo, src, dst, w, kinds): static references, contracts, shared strings and co-change between source files."""
        pick = lambda df, kind: df.select("repo", "src", "dst", F.lit(kind).alias("kind"), "w")
        table = F.substring_index("table_id", "::", 1)
        sent = self.sends.select("repo", F.col("file").alias("src"), table.alias("dst"), "table_id", "key").filter("src <> dst")
        parts = [pick(graph.static_weights(self.edges), "static"), pick(graph.contract_weights(sent), "contract"), pick(graph.string_weights(self.strings), "strings")]
        if self.pairs is not None:
            parts.append(pick(history.cochange_edges(self.pairs, self.seasoned), "cochange"))
        e = _all(parts).filter("src <> dst")
        e = self.in_roles(self.in_roles(e, *NODES, col="src"), *NODES, col="dst")
        return cut(graph.merge_kinds(e))

    @cached_property
    def clone_runs(self) -> DataFrame:
        src = self.in_roles(self.files, "code", "test", "tool")
        return cut(clones.clone_runs(clones.token_arrays(src, "path"), "path"))

    @cached_property
    def longest(self) -> DataFrame:
        """(repo, path, longest_func, longest_name, longest_line, funcs, long_funcs)."""
        f = self.part("funcs").withColumn("n", F.col("end") - F.col("line") + 1)
        g = f.groupBy(*K).agg(F.max(F.struct("n", (-F.col("line")).alias("l"), "name")).alias("m"), F.count(F.lit(1)).alias("funcs"), F.count_if(F.col("n") >= 80).alias("long_funcs"))
        return g.select(*K, F.col("m.n").alias("longest_func"), F.col("m.name").alias("longest_name"), (-F.col("m.l")).alias("longest_line"), "funcs", "long_funcs")

    @cached_property
    def metrics(self) -> DataFrame:
        """One row per source file: size, links, rank, contracts, churn, clones, persistence."""
        role = self.roles.select("repo", "path", "role")
        e = self.edges.join(role.withColumnsRenamed({"path": "src", "role": "src_role"}), ["repo", "src"]).join(role.withColumnsRenamed({"path": "dst", "role": "dst_role"}), ["repo", "dst"])
        count = lambda df, by, what, out: df.groupBy("repo", F.col(by).alias("path")).agg(F.count_distinct(what).alias(out))
        fan_in = count(e.filter(F.col("src_role").isin(DEPENDANTS)), "dst", "src", "fan_in")
        fan_out = count(e.filter(F.col("dst_role").isin(DEPENDANTS)), "src", "dst", "fan_out")
        tested = count(e.filter("src_role = 'test'"), "dst", "src", "tests")
        nodes = self.roles.filter(F.col("role").isin(DEPENDANTS)).select("repo", F.col("path").alias("node"))
        weight = F.coalesce(F.try_element_at("kinds", F.lit("static")), F.lit(0.0)) + F.coalesce(F.try_element_at("kinds", F.lit("contract")), F.lit(0.0))
        pr = graph.pagerank(self.graph.select("repo", "src", "dst", weight.alias("w")), nodes).select("repo", F.col("node").alias("path"), F.col("rank").alias("pagerank"))
        code = self.roles.filter(F.col("role").isin("code", "generated")).select("repo", F.col("path").alias("node"))
        reach = graph.reach_counts(self.edges.filter("kind <> 'ref'"), code).select("repo", F.col("node").alias("path"), "reach")
        c = self.calls
        saver = (F.coalesce(F.col("recv").isin("ResourceSaver", "ConfigFile"), F.lit(False)) & (F.col("fn") == "save")) | (F.coalesce(F.col("recv") == "DirAccess", F.lit(False)) & F.col("fn").isin("rename", "rename_absolute"))
        opened = (F.col("fn") == "open") & F.exists("args", lambda a: F.coalesce(a["s"].isin("w", "wb", "a"), F.lit(False)))
        writes = c.groupBy(*K).agg(F.bool_or(F.col("fn").isin(WRITES) | saver).alias("w"), F.bool_or(opened).alias("o"))
        user = self.part("strings").groupBy(*K).agg(F.bool_or(F.startswith("value", F.lit("user://"))).alias("u"))
        own = F.substring_index("table_id", "::", 1)
        tables = self.tables.groupBy("repo", "path").agg(F.count_distinct("table_id").alias("tables"))
        across = self.sends.filter(F.col("file") != own)
        sends_in = across.groupBy("repo", own.alias("path")).agg(F.count(F.lit(1)).alias("sends_in"))
        sends_out = across.groupBy("repo", F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("sends_out"))
        pinned = self.invariants.groupBy(*K).agg(F.count(F.lit(1)).alias("invariants"))
        auto = self.autoloads.groupBy(*K).agg(F.min("name").alias("autoload_name"))
        dup = clones.duplicated_lines(self.clone_runs).withColumnRenamed("file", "path")
        out = self.left_out(self.roles).withColumn("export_excluded", F.lit(True))
        m = self.roles.filter(F.col("role").isin(NODES))
        for d in (fan_in, fan_out, tested, pr, reach, self.longest, writes, user, tables, sends_in, sends_out, pinned, auto, dup, out):
            m = m.join(d, K, "left")
        if self.touched is not None:
            h = history.file_history(self.touched, self.commits).select(*K, F.col("changes").alias("churn_commits"), F.col("churn").alias("churn_lines"), F.col("fixes").alias("fix_commits"))
            m = m.join(h, K, "left").join(self.hidden.groupBy(*K).agg(F.count(F.lit(1)).alias("hidden")), K, "left")
        yes = lambda x: F.coalesce(F.col(x), F.lit(False))
        persists = F.col("role").isin("code", "generated") & ((yes("w") & yes("u")) | (yes("o") & (F.col("lang") == "python")))
        num = lambda x: F.coalesce(x, F.lit(0))
        m = cut(m.withColumns({
            "persists": persists, "testable": ~F.col("lang").isin("shader", "shell", "engine-scene", "engine-project", "engine-presets"), "generated": F.col("role") == "generated", "tested": num("tests") > 0,
            "autoload": F.col("autoload_name").isNotNull(), "contracts": num("invariants") + num("sends_in") + 2 * num("tables"), "export_excluded": yes("export_excluded"),
        }).drop("w", "o", "u"))
        owners = m.filter("persists").select("repo", F.col("path").alias("dst"))
        uses = self.edges.filter(F.size("members") > 0).join(owners, ["repo", "dst"], "left_semi").select("repo", F.col("src").alias("path"), F.lit(True).alias("uses_persist")).distinct()
        return cut(m.join(uses, K, "left").withColumn("uses_persist", yes("uses_persist")))

    @cached_property
    def ranking(self) -> DataFrame:
        """Source files with risk score, tier, signals and reasons; repositories with fewer than five commits are ranked without history."""
        code = self.metrics.filter(F.col("role").isin("code", "generated"))
        if self.touched is None:
            return scoring.risk(code, with_history=False)
        old = code.join(self.seasoned.select("repo"), "repo", "left_semi")
        new = code.join(self.seasoned.select("repo"), "repo", "left_anti")
        return cut(scoring.risk(old).unionByName(scoring.risk(new, with_history=False)))

    @cached_property
    def secret_controllers(self) -> DataFrame:
        return scoring.secret_controllers(self.metrics.filter("role = 'code'"))

    # -- findings ---------------------------------------------------------------------------------------------------------------------
    @cached_property
    def source_lines(self) -> DataFrame:
        return X.lines_of(self.in_roles(self.files, "code", "generated", "tool", "test"), K)

    @cached_property
    def comments(self) -> DataFrame:
        """(repo, path, line, body, raw, role): comments without their signs."""
        c = self._source("comments").select(*K, "line", F.trim(F.regexp_replace("value", r"^[#/*! \t]+", "")).alias("body"), F.trim("value").alias("raw"))
        return cut(c.join(self.roles.select(*K, "role"), K))

    @cached_property
    def dangling(self) -> DataFrame:
        """(repo, key, reads, id, path, line): keys read but never written, at their first read."""
        subs = self.part("subs")
        one = lambda c: F.element_at(c, -1)
        made = [self.part("dicts").select("repo", F.explode("keys").alias("k")).select("repo", F.col("k.key").alias("key")), subs.filter("mode = 'write'").select("repo", one("keys").alias("key"))]
        first = F.get("args", F.lit(0))
        made.append(self.part("calls").filter(F.col("fn").isin("set_meta", "get_or_add", "merge") & (first["k"] == "str")).select("repo", first["s"].alias("key")))
        made.append(snapshot.json_keys(self.files.filter(F.endswith("path", F.lit(".json")))).select("repo", "key"))
        last = lambda c: F.regexp_extract(c, r"([^.]*)$", 1)
        bare = lambda c: F.regexp_replace(last(c), r"\[.*$", "")
        calls = self.part("calls")
        open_ = _all([
            self.part("name_subs").filter("mode = 'write'").select(*K, last(F.col("base")).alias("name")),
            calls.filter(F.startswith("fn", F.lit("from_")) | F.col("fn").isin(LOADERS)).select(*K, last(F.coalesce("recv", F.lit(""))).alias("name")),
            calls.filter(F.col("assigned").isNotNull() & F.col("fn").isin(ROW_CALLS)).select(*K, F.col("assigned").alias("name")),
        ]).filter("name <> ''").distinct()
        asked = calls.filter(F.col("fn").isin("has", "get") & (first["k"] == "str")).select(*K, F.coalesce("func", F.lit("")).alias("func"), F.coalesce("recv", F.lit("")).alias("base"), first["s"].alias("key")).distinct().withColumn("guarded", F.lit(True))
        r = subs.filter("mode <> 'write'").join(self.roles.filter(F.col("role").isin("code", "test", "generated")).select(*K, "lang"), K)
        r = r.filter(~F.col("base").rlike(OUTSIDE) & ((F.col("mode") == "read") | (F.col("lang") == "gdscript"))).withColumn("name", bare(F.col("base")))
        r = r.join(open_, [*K, "name"], "left_anti").select(*K, F.coalesce("func", F.lit("")).alias("func"), "base", "line", F.explode("keys").alias("key"))
        r = r.join(asked, [*K, "func", "base", "key"], "left").withColumn("guarded", F.coalesce("guarded", F.lit(False)))
        # a literal of the same name on another line of the file: probably a key that a variable holds
        spots = self.part("strings").groupBy(*K, F.col("value").alias("key")).agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
        r = r.join(spots, [*K, "key"], "left").filter(F.col("guarded") | F.col("lo").isNull() | ((F.col("lo") == F.col("line")) & (F.col("hi") == F.col("line"))))
        r = cut(r.select("repo", "path", "line", "key", "guarded"))
        d = contracts.dangling(r, _all(made), self.part("strings").select("repo", "value"))
        at = r.groupBy("repo", "key").agg(F.min(F.struct("path", "line")).alias("m")).select("repo", "key", "m.path", "m.line")
        return d.join(at, ["repo", "key"])

    @cached_property
    def findings(self) -> DataFrame:
        """(repo, id, severity, category, title, path, line) of all checks."""
        rows: list[DataFrame] = []

        def add(df: DataFrame, id_, severity, category: str, title: Column) -> None:
            lit = lambda x: F.lit(x) if isinstance(x, str) else x
            # each check is a job of its own: all of them as one plan fill the driver's memory
            rows.append(cut(df.select("repo", lit(id_).alias("id"), lit(severity).alias("severity"), F.lit(category).alias("category"), title.alias("title"), "path", F.col("line").cast("int").alias("line"))))

        say, risk, prompt = F.format_string, "agent-risk", "prompt-archaeology"
        name = F.substring_index("table_id", "::", -1)
        own = F.substring_index("table_id", "::", 1)
        special = self.tables.select("repo", "table_id", F.explode("special").alias("key"))
        u = contracts.unknown_keys(self.sends, self.tables, self.registered, special)
        near = documents.suggestion(u.filter("id = 'contract.unknown-key'"), self.tables, "table_id")
        u = u.groupBy("repo", "table_id", "key", "id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "line")).alias("m")).join(near, ["repo", "table_id", "key"], "left")
        hint = F.when(F.col("suggestion").isNotNull(), say(" (did you mean `%s`?)", "suggestion")).otherwise("")
        title = F.when(F.col("id") == "contract.unknown-key", say("`%s` is sent but %s has no such key%s", "key", name, hint)).otherwise(say("`%s` is sent %d times but %s has no handler for it", "key", "n", name))
        add(u.withColumns({"path": F.col("m.file"), "line": F.col("m.line")}), F.col("id"), F.col("severity"), risk, title)
        dead = contracts.unsent_keys(self.sends, self.tables, self._source("strings"), self.registered).groupBy("repo", "table_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
        lines = self.tables.groupBy("repo", "table_id").agg(F.min("line").alias("line"))
        add(dead.join(lines, ["repo", "table_id"]).withColumn("path", own), "contract.unsent-key", "info", prompt, say("%d keys of %s are never sent anywhere: %s", F.size("keys"), name, F.array_join("keys", ", ")))
        pay = contracts.payload_missing(self.sends, self.needs)
        add(pay.withColumnRenamed("file", "path"), "contract.payload-missing", F.col("severity"), risk, say("`%s` sent without %s, which its handler reads unguarded", "key", F.array_join("missing", ", ")))
        d = self.dangling
        add(d.filter("id = 'contract.dead-branch'"), "contract.dead-branch", "low", prompt, say("Nothing ever produces the key `%s`, so the branches that check for it never run", "key"))
        add(d.filter("id <> 'contract.dead-branch'"), "contract.key-never-written", "medium", risk, say("Key read but never written: %s", "key"))
        # engine names
        refs = self.part("refs").join(self.engines, "repo", "left_semi").join(self.roles.filter("lang = 'gdscript'").select(*K, "class_name"), K).filter(~F.col("name").eqNullSafe(F.col("class_name")))
        lost = self.missing_members(refs.select("repo", "name", "member", F.col("path").alias("file"), "line"))
        lost = lost.groupBy("repo", "name", "member").agg(F.min(F.struct("file", "line")).alias("m")).select("repo", "name", "member", F.col("m.file").alias("path"), F.col("m.line").alias("line"))
        add(lost, "godot.missing-member", "high", risk, F.concat_ws(".", "name", "member"))
        add(self.signals.filter(F.col("severity").isNotNull()), "godot.signal-never-emitted", F.col("severity"), prompt, say("Signal never emitted: %s", "value"))
        con = self._source("connects").join(self.engines, "repo", "left_semi").withColumn("name", F.regexp_extract(F.coalesce("recv", F.lit("")), r"^([^.\[]*)", 1)).join(self.globals.select("repo", "name", F.col("path").alias("to")), ["repo", "name"])
        known = self.part("signals").select("repo", F.col("path").alias("to"), "value").distinct()
        flat = self.roles.filter(F.col("extends").isNull()).select("repo", F.col("path").alias("to"))
        add(con.join(flat, ["repo", "to"], "left_semi").join(known, ["repo", "to", "value"], "left_anti"), "godot.connect-unknown-signal", "high", risk, say("`%s.%s.connect` names a signal that is not declared", "name", "value"))
        c = self.engine_calls
        there = _all([
            c.filter("fn = 'set_meta'").select("repo", F.lit("meta").alias("kind"), "name"), c.filter("fn = 'add_to_group'").select("repo", F.lit("group").alias("kind"), "name"),
            self.projects.select("repo", F.lit("action").alias("kind"), F.explode("actions").alias("name")),
        ])
        n = documents.unknown_engine_names(c, there).groupBy("repo", "kind", "name").agg(F.min(F.struct("path", "line")).alias("m"), F.bool_or(F.col("fn") == "get_meta").alias("hard")).withColumns({"path": F.col("m.path"), "line": F.col("m.line")})
        add(n.filter("kind = 'action'"), "godot.unknown-input-action", "high", risk, say("Input action `%s` is not defined in the project", "name"))
        add(n.filter("kind = 'meta'"), "godot.meta-never-set", F.when(F.col("hard"), "medium").otherwise("low"), risk, say("Meta key `%s` is read but never set", "name"))
        add(n.filter("kind = 'group'"), "godot.group-never-joined", "medium", risk, say("Group `%s` is queried but nothing joins it in code", "name"))
        sc, sn, methods = self.scene_connections
        scripts = self.facts.select("repo", F.col("path").alias("script"))
        add(documents.scene_methods(sc, sn, methods, scripts).withColumnRenamed("scene", "path"), "godot.scene-connection-missing-method", "high", risk, say("`%s` is connected to `%s()`, which %s does not define", "signal", "method", "script"))
        gone = self.left_out(self.roles).withColumn("out", F.lit(True))
        e = self.edges.filter(F.col("kind").isin(contracts.COMPILED)).join(gone.select("repo", F.col("path").alias("dst")), ["repo", "dst"], "left_semi").join(gone.select("repo", F.col("path").alias("src")), ["repo", "src"], "left_anti")
        e = self.in_roles(e, "code", "generated", "resource", "config", col="src")
        add(e.select("repo", F.col("src").alias("path"), F.coalesce(F.get("lines", F.lit(0)), F.lit(1)).alias("line"), "dst"), "godot.export-excluded-dependency", "high", risk, say("Depends on an excluded file: %s", "dst"))
        # resources
        first = F.get("args", F.lit(0))
        exist = self.part("calls").filter(F.col("fn").isin(EXIST) & (F.size("args") > 0))
        asked = exist.filter(first["k"] == "str").select("repo", F.col("path").alias("src"), first["s"].alias("spec")).distinct()
        loose = exist.filter(first["k"] != "str").select("repo", F.col("path").alias("src"), F.lit("ref").alias("how")).distinct()
        lost = self.imports.filter(F.startswith("spec", F.lit("res://")) & ~F.col("spec").rlike(r"[%{]|/$") & F.col("target").isNotNull() & ~F.col("target").isin("", "."))
        lost = lost.join(self.places.withColumnRenamed("path", "target"), ["repo", "target"], "left_anti").join(asked, ["repo", "src", "spec"], "left_anti").join(loose, ["repo", "src", "how"], "left_anti")
        hard = F.col("how").isin("preload", "extends", "ext_resource", "autoload")
        lost = lost.groupBy("repo", F.col("src").alias("path"), "spec").agg(F.min("line").alias("line"), F.bool_or(hard).alias("hard"))
        add(lost, "path.missing-resource", F.when(F.col("hard"), "high").otherwise("medium"), risk, say("Missing resource %s", F.regexp_replace("spec", "^res://", "")))
        # leftovers
        com = self.comments
        add(com.filter(F.col("body").rlike(smells.ELISION)), "smell.elision-marker", "high", prompt, F.lit("Elision marker"))
        add(com.filter(F.col("body").rlike(smells.CHAT)), "smell.chat-voice", "medium", prompt, F.lit("Chat voice in a comment"))
        add(com.filter(F.col("body").rlike(smells.STUB) & (F.col("role") != "test")), "smell.stub", "low", prompt, F.lit("Stub note"))
        own_code = self.roles.filter(F.col("role").isin("code", "generated"))
        add(smells.fenced(self.in_roles(self.files, "code", "generated")), "smell.markdown-fence", "high", prompt, F.lit("Markdown code fence in source"))
        add(smells.versioned(own_code).withColumn("line", F.lit(1)), "smell.versioned-file", "medium", prompt, F.concat(F.lit("Version-suffixed file: "), "path"))
        off = self.projects.filter(F.size("warnings_off") >= 3)
        add(off.select("repo", F.col("project").alias("path"), F.col("warnings_line").alias("line"), "warnings_off"), "smell.warnings-silenced", "medium", risk, say("%d warnings are switched off project-wide: %s", F.size("warnings_off"), F.array_join("warnings_off", ", ")))
        sca = self.scattered
        add(sca.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line")).alias("m")).withColumns({"path": F.col("m.path"), "line": F.col("m.line")}), "smell.scattered-constants", "low", "duplication", say("%d colour values are typed out in 3 or more files each", "n"))
        # documents
        st = self.stale.groupBy("repo", "doc").agg(F.array_sort(F.collect_set("mention")).alias("names"), F.min("line").alias("line")).join(self.doc_weights, ["repo", "doc"]).withColumnRenamed("doc", "path")
        add(st, "docs.stale-reference", F.when(F.col("weight") >= 2, "medium").otherwise("low"), prompt, say("%s cites %d names that no longer exist: %s", "path", F.size("names"), F.array_join("names", ", ")))
        pr = self.prompts.filter(F.col("class") == "dead").groupBy("repo", F.col("doc").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
        add(pr, "docs.dead-prompts", "medium", prompt, say("%d prompts marked do-not-run still sit in %s", "n", "path"))
        paras = self.docs.filter("part = 'paragraph' and weight >= 2 and not is_prompt").select("repo", "doc", "line", "text")
        b = documents.boundaries(paras, self.globals.select("repo", "name", "path"), self.edges, self.roles)
        add(b.withColumnRenamed("doc", "path"), "boundary.documented-rule-violated", F.col("severity"), risk, say("`%s` is declared free of `%s`, but reaches it: %s", "name", "forbidden", F.array_join("chain", " -> ")))
        # size, duplication, coupling
        big = self.roles.join(self.longest, K, "left").filter((F.col("role") == "code") & ((F.col("loc") >= 700) | (F.coalesce("longest_func", F.lit(0)) >= 150))).withColumn("line", F.coalesce("longest_line", F.lit(1)))
        add(big, "size.god-file", F.when((F.col("loc") >= 1000) | (F.coalesce("longest_func", F.lit(0)) >= 200), "medium").otherwise("low"), "size", F.concat(F.lit("Large file: "), "path"))
        cl = self.in_roles(self.in_roles(clones.outermost(self.clone_runs).filter("tokens >= 110"), "code", col="a"), "code", col="b")
        add(cl.select("repo", F.col("a").alias("path"), F.col("a_line").alias("line"), "a_end_line", "b", "b_line", "b_end_line", "tokens"), "duplication.clone", F.when(F.col("tokens") >= 180, "medium").otherwise("low"), "duplication", say("Lines %d-%d are copied in %s:%d-%d", "line", "a_end_line", "b", "b_line", "b_end_line"))
        if self.hidden is not None:
            h = self.hidden_pairs
            add(h.select("repo", F.col("a").alias("path"), F.lit(1).alias("line"), "b", "n"), "coupling.hidden", F.when(F.col("n") >= 4, "medium").otherwise("low"), "coupling", say("Changes together with %s (%d commits) with no reference between them", "b", "n"))
        return cut(_all(rows).distinct())

    @cached_property
    def hidden_pairs(self) -> DataFrame:
        h = self.in_roles(self.in_roles(self.hidden, "code", "generated"), "code", "generated", col="partner")
        return h.groupBy("repo", F.least("path", "partner").alias("a"), F.greatest("path", "partner").alias("b")).agg(F.max("n").alias("n"))

    @cached_property
    def scattered(self) -> DataFrame:
        """(repo, value, files, path, line): colour literals that stand in three or more source files."""
        s = self.in_roles(self.part("strings"), "code").join(self.roles.select(*K, "lang"), K).filter(F.col("value").rlike(COLOUR) & (F.startswith("value", F.lit("#")) | (F.col("lang") == "gdscript")))
        g = s.groupBy("repo", F.lower("value").alias("value")).agg(F.count_distinct("path").alias("files"), F.min(F.struct("path", "line")).alias("m")).filter("files >= 3")
        return g.select("repo", "value", "files", "m.path", "m.line")

    def findings_with_evidence(self) -> DataFrame:
        l = X.lines_of(self.files, K).select(*K, "line", F.left(F.rtrim("text_line"), F.lit(240)).alias("evidence"))  # noqa: E741
        return contracts.ordered(self.findings.join(l, [*K, "line"], "left"))

    def failing(self, bar: str = "high") -> DataFrame:
        """(repo, line_text) of what fails a check: ``file:line: severity: title``, all of it."""
        f = contracts.gate(self.findings, bar)
        return f.select("repo", F.format_string("%s:%d: %s: %s", "path", "line", "severity", "title").alias("line_text"))

    def check(self, bar: str = "high", write=print) -> int:
        """Writes what fails line by line, in order and streamed partition by partition, and gives the exit code."""
        n = 0
        for r in self.failing(bar).orderBy("repo", "line_text").toLocalIterator():
            write(r["line_text"])
            n += 1
        return int(n > 0)

    # -- scores -----------------------------------------------------------------------------------------------------------------------
    def score(self) -> DataFrame:
        """(repo, category, component, value, score, credit): the components of each repository's maintenance score."""
        code = self.metrics.filter("role = 'code'")
        num = lambda c: F.coalesce(c, F.lit(0))
        base = code.groupBy("repo").agg(
            F.greatest(F.lit(1), num(F.sum("loc"))).alias("loc"), F.count(F.lit(1)).alias("files"), num(F.sum("dup_lines")).alias("dup"), num(F.sum(F.when(F.col("loc") >= 600, F.col("loc")))).alias("big"),
            num(F.max("loc")).alias("largest"), F.count_if(~F.col("tested")).alias("untested"), num(F.sum("long_funcs")).alias("long_funcs"),
        )
        nodes = code.select("repo", F.col("path").alias("node"))
        e = self.in_roles(self.in_roles(self.edges, "code", col="src"), "code", col="dst").select("repo", "src", "dst")
        hubs = graph.concentration(e, nodes)
        cyc = graph.components(e, nodes).groupBy("repo").agg((F.count_if(F.col("size") > 1) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("cycle_share"))
        strong = self.strings.filter("weight >= 1").groupBy("repo").agg(F.count(F.lit(1)).alias("strong"))
        sent = self.sends.groupBy("repo").agg(F.count(F.lit(1)).alias("sends"), F.count_distinct("file", "table_id").alias("routed"))
        points = F.when(F.col("severity") == "high", 10).when(F.col("severity") == "medium", 4).when(F.col("severity") == "low", 1).otherwise(0)
        f = self.findings.groupBy("repo").agg(
            F.sum(F.when((F.col("category") == "agent-risk") & ~F.startswith("id", F.lit("smell.warnings")), points).otherwise(0)).alias("weighted"),
            F.count_if(F.col("id").isin("contract.unsent-key", "contract.dead-branch", "godot.signal-never-emitted", "contract.dropped-key")).alias("unwired"),
        )
        marks = self.comments.groupBy("repo").agg(*[F.count_if(F.col(c).rlike(p) & cond).alias(n) for n, c, p, cond in (("elision", "body", smells.ELISION, F.lit(True)), ("chat", "body", smells.CHAT, F.lit(True)), ("stub", "body", smells.STUB, F.col("role") != "test"), ("todo", "raw", smells.TODO, F.lit(True)))])
        old_code = smells.commented_code(self.source_lines, K).groupBy("repo").agg(F.count(F.lit(1)).alias("commented"))
        ignores = self.source_lines.groupBy("repo").agg(F.sum(F.regexp_count("text_line", F.lit(smells.IGNORES))).alias("ignores"))
        marked = self.facts.groupBy("repo").agg(F.sum(num(F.try_element_at("annotations", F.lit("warning_ignore"))) + num(F.try_element_at("annotations", F.lit("warning_ignore_start")))).alias("marked"))
        silenced = self.projects.select("repo", F.size("warnings_off").alias("silenced"))
        colours = self.scattered.groupBy("repo").agg(F.count(F.lit(1)).alias("scattered"))
        stale = self.stale.join(self.doc_weights.filter("weight >= 2"), ["repo", "doc"]).groupBy("repo").agg(F.count(F.lit(1)).alias("stale"))
        dead = self.prompts.filter(F.col("class") == "dead").groupBy("repo").agg(F.count(F.lit(1)).alias("dead_prompts"))
        t = self.metrics.filter("role = 'test'")
        tests = t.groupBy("repo").agg(num(F.sum("loc")).alias("test_loc"), F.count(F.lit(1)).alias("tests"), F.bool_or(F.col("path").rlike(r"(?i)architect|boundar|contract|dependency|layer|lint")).alias("guarded"))
        guides = self.docs.filter("part = 'doc' and weight >= 3").select("repo", F.lit(True).alias("guides")).distinct()
        parts = [hubs.withColumnRenamed("edges", "links"), cyc, strong, sent, f, marks, old_code, ignores, marked, silenced, colours, stale, dead, tests, guides]
        if self.hidden is not None:
            parts.append(self.seasoned.join(self.hidden_pairs.groupBy("repo").agg(F.count(F.lit(1)).alias("pairs")), "repo", "left").select("repo", num(F.col("pairs")).alias("hidden_pairs")))
        a = self.roles.select("repo").distinct().join(base, "repo", "left")
        for p in parts:
            a = a.join(p, "repo", "left")
        x = lambda c: num(F.col(c))
        loc, files = F.greatest(x("loc"), F.lit(1)), F.greatest(x("files"), F.lit(1))
        k = loc / 1000
        c = lambda cat, name, value, score, credit=None: F.struct(F.lit(cat).alias("category"), F.lit(name).alias("component"), value.cast("double").alias("value"), score.cast("double").alias("score"), (credit if credit is not None else F.lit(0.0)).cast("double").alias("credit"))
        r = lambda cat, name, value, lo, hi, credit=None: c(cat, name, value, X.ramp(value, lo, hi), credit)
        implicit = (x("routed") + x("strong")) / F.greatest(x("links"), F.lit(1))
        noise = F.greatest(X.ramp(x("silenced"), 1, 10), X.ramp((x("ignores") + x("marked")) / k, 0, 3))
        credit = F.when(F.coalesce("guides", F.lit(False)), 10.0).otherwise(0.0) + F.when(F.coalesce("guarded", F.lit(False)), 10.0).otherwise(0.0)
        some = x("tests") > 0
        share = x("untested") / files
        hidden = F.col("hidden_pairs") / files * 10 if self.hidden is not None else F.lit(None).cast("double")
        comp = [
            r("coupling", "hub concentration", x("top_share"), 0.15, 0.5), r("coupling", "average fan-out", x("avg_fan_out"), 3, 10), r("coupling", "cycles", x("cycle_share"), 0.05, 0.35), r("coupling", "implicit coupling", implicit, 0.3, 1.2), r("coupling", "hidden co-change", hidden, 0.5, 5),
            r("duplication", "cloned code", 100 * x("dup") / loc, 3, 15), r("duplication", "copied constants", x("scattered") / k, 0, 2),
            r("size", "large files", x("big") / loc, 0.1, 0.6), r("size", "long functions", x("long_funcs") / k, 0.2, 2), r("size", "largest file", x("largest"), 600, 2500),
            r("agent_risk", "broken contracts", x("weighted") / k, 0, 4, credit), r("agent_risk", "stringly-typed density", (x("sends") + x("strong")) / k, 4, 30, credit), c("agent_risk", "silenced analysis", x("silenced") + x("ignores") + x("marked"), noise, credit),
            c("test_protection", "untested files", share, F.when(some, X.ramp(share, 0.3, 0.9)).otherwise(100.0)), c("test_protection", "test volume", x("test_loc") / loc, F.when(some, 100 - X.ramp(x("test_loc") / loc, 0.05, 0.4))),
            r("prompt_archaeology", "stale references", x("stale"), 0, 20), r("prompt_archaeology", "dead prompts", x("dead_prompts"), 0, 6), r("prompt_archaeology", "leftovers", (5 * x("elision") + 3 * x("chat") + x("stub") + 0.2 * x("todo")) / k, 0, 5),
            r("prompt_archaeology", "commented-out code", x("commented") / k, 0, 3), r("prompt_archaeology", "unwired plumbing", x("unwired"), 0, 15),
        ]
        return cut(a.select("repo", F.explode(F.array(*comp)).alias("x")).select("repo", "x.*"))

    def total(self) -> DataFrame:
        """(repo, total, tier)."""
        return scoring.total_score(scoring.category_scores(self.score(), ["repo"]), ["repo"])

    def architecture(self) -> tuple[DataFrame, DataFrame]:
        """Folders (repo, dir, files, loc, role) and their references and contracts (repo, src_dir, dst_dir, n)."""
        hard = F.array_contains(F.map_keys("kinds"), "static") | F.array_contains(F.map_keys("kinds"), "contract")
        return scoring.directories(self.roles.filter(F.col("role").isin(NODES))), scoring.directory_edges(self.graph.filter(hard))

    # -- retrieval --------------------------------------------------------------------------------------------------------------------
    @cached_property
    def index(self) -> DataFrame:
        """(repo, path, term, tf): what each source file is about."""
        unit = lambda df, text, w, most: df.select(*K, text.alias("text"), F.lit(float(w)).alias("weight"), F.lit(most).cast("int").alias("most"))
        f, sy = self.roles.filter(F.col("role").isin("code", "generated", "resource", "test")), self.part("symbols")
        # the first 400 strings and 300 comments of a file, by definition of the index
        first = lambda what, n: self.facts.select(*K, F.explode(F.slice(what, 1, n)).alias("x")).select(*K, "x.value")
        st = first("strings", 400).filter((F.char_length("value") > 2) & (F.char_length("value") < 40) & ~F.startswith("value", F.lit("res://")))
        u = [unit(f, F.regexp_replace("path", r"\.[^.]*$", ""), 3, None), unit(f, F.col("class_name"), 3, None), unit(f, F.col("doc"), 1, 120), unit(sy, F.col("name"), 1, None), unit(sy, F.col("doc"), 0.6, 60), unit(st, F.col("value"), 0.4, None), unit(first("comments", 300), F.col("value"), 0.25, 30)]
        u = self.in_roles(_all(u).filter(F.col("text").isNotNull()), "code", "generated", "resource", "test")
        return cut(retrieval.term_index(u, K))

    def blast(self, request: str, seeds: list[str] | None = None, **options) -> dict:
        """What a request would touch (see ``impact.answer``)."""
        from codestrata.plans import impact

        return impact.answer(self, request, seeds, **options)


def timeline(commits: DataFrame, touched: DataFrame) -> DataFrame:
    """The state of a repository's log after each commit."""
    return history.prefix_state(commits, touched)


def scored_timeline(spark: SparkSession, versions: DataFrame, commits: DataFrame | None = None, commit_files: DataFrame | None = None) -> DataFrame:
    """(repo, sha, total, tier): the score at each commit from ``versions`` (repo, sha, path, text), the files at each commit. All versions are scanned
    as repositories of their own in one go, with the log (repo, sha, ord, ...) up to each of them."""
    files = versions.select(F.concat_ws("@", "repo", "sha").alias("repo"), "path", "text")
    c = cf = None
    if commits is not None and commit_files is not None:
        at = versions.select("repo", "sha").distinct().join(commits.select("repo", "sha", F.col("ord").alias("upto")), ["repo", "sha"])
        c = commits.join(at.select("repo", F.col("sha").alias("version"), "upto"), "repo").filter("ord <= upto").withColumn("repo", F.concat_ws("@", "repo", "version"))
        cf = commit_files.join(c.select(F.col("repo").alias("r"), "sha"), "sha").drop("repo").withColumnRenamed("r", "repo")
        c = c.drop("version", "upto")
    t = Scan(spark, files, c, cf).total()
    return t.select(F.substring_index("repo", "@", 1).alias("repo"), F.substring_index("repo", "@", -1).alias("sha"), "total", "tier")
