"""Registered queries of the core operators, each with the DuckDB SQL it is checked against where SQL can express it on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import clones, contracts, documents, graph, history, retrieval, scoring, smells
from codestrata.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def r6(c) -> F.Column:
    return F.round(c, 6)


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return table(s, d, name)


# History ------------------------------------------------------------------------------------------------------------------------------
def _commits(s, d):
    return history.commits_once(_t(s, d, "commits"))


def _touched(s, d):
    return history.touched(_t(s, d, "commit_files"), _t(s, d, "files"))


def _pairs(s, d):
    t = _touched(s, d)
    return history.with_confidence(history.pair_stats(t), history.file_history(t, _commits(s, d)))


_FIX = r"\b(fix(es|ed|ing)?|bug|broke|broken|crash(es|ed)?|regression|revert(s|ed)?|hotfix|oops|typo|restore[sd]?|repair(s|ed)?|wrong|missing|again|undo|workaround)\b"
_C = "c AS (SELECT repo, sha, ord, ts, author, subject, body FROM commits QUALIFY row_number() OVER (PARTITION BY sha ORDER BY loaded_at) = 1)"
_T = (
    "t AS (SELECT repo, sha, path, CAST(sum(coalesce(added, 0) + coalesce(deleted, 0)) AS BIGINT) AS lines FROM (SELECT DISTINCT repo, sha, path, added, deleted FROM commit_files WHERE path IS NOT NULL)"
    " SEMI JOIN files USING (repo, path) GROUP BY ALL)"
)
_PAIRS = (
    "z AS (SELECT repo, sha, count(*) AS size FROM t GROUP BY ALL HAVING count(*) BETWEEN 2 AND 30),"
    " k AS (SELECT t.repo, t.sha, path, size FROM t JOIN z USING (repo, sha)),"
    " h AS (SELECT repo, path, count(*) AS changes FROM t GROUP BY ALL),"
    " p AS (SELECT x.repo, x.path AS a, y.path AS b, count(*) AS n, sum(1.0 / (x.size - 1)) AS weight, count(*) FILTER (x.size <= 8) AS n_small FROM k x JOIN k y ON x.repo = y.repo AND x.sha = y.sha AND x.path < y.path GROUP BY ALL),"
    " q AS (SELECT p.*, n / ha.changes AS conf_ab, n / hb.changes AS conf_ba FROM p JOIN h ha ON ha.repo = p.repo AND ha.path = a JOIN h hb ON hb.repo = p.repo AND hb.path = b)"
)


@query(f"WITH {_T}, {_PAIRS} SELECT repo, a, b, n, round(weight, 6) AS weight, n_small, round(conf_ab, 6) AS conf_ab, round(conf_ba, 6) AS conf_ba FROM q")
def cochange_pairs(s, d):
    return _pairs(s, d).select("repo", "a", "b", "n", r6("weight").alias("weight"), "n_small", r6("conf_ab").alias("conf_ab"), r6("conf_ba").alias("conf_ba"))


@query(
    f"WITH {_C}, {_T}, {_PAIRS}, r AS (SELECT repo FROM c GROUP BY repo HAVING count(*) >= 5),"
    " e AS (SELECT repo, a, b, 0.8 * greatest(conf_ab, conf_ba) * least(1, weight / 1.5) AS w FROM q SEMI JOIN r USING (repo) WHERE n >= 2)"
    " SELECT repo, a AS src, b AS dst, round(w, 6) AS w FROM e WHERE w >= 0.08 UNION ALL SELECT repo, b, a, round(w, 6) FROM e WHERE w >= 0.08"
)
def cochange_edges(s, d):
    n = _commits(s, d).groupBy("repo").agg(F.count(F.lit(1)).alias("commits"))
    return history.cochange_edges(_pairs(s, d), n).withColumn("w", r6("w"))


@query(f"WITH {_C}, {_T} SELECT t.repo, path, count(*) AS changes, CAST(sum(lines) AS BIGINT) AS churn, count(*) FILTER (regexp_matches(coalesce(subject, ''), '{_FIX}', 'i')) AS fixes FROM t LEFT JOIN c USING (sha) GROUP BY ALL")
def file_history(s, d):
    return history.file_history(_touched(s, d), _commits(s, d))


@query(f"WITH {_T}, z AS (SELECT repo, sha, count(*) AS n, sum(lines) AS l FROM t GROUP BY ALL), r AS (SELECT repo, n, row_number() OVER (PARTITION BY repo ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY repo) AS m FROM z) SELECT repo, n AS median_files FROM r WHERE i = m // 2")
def commit_size_upper_median(s, d):
    z = _touched(s, d).groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("n"))
    return history.upper_median(z, "repo", "n", "median_files")


@query(
    f"WITH {_C}, {_T} SELECT c.repo, count(*) AS commits, count(*) FILTER (regexp_matches(coalesce(subject, ''), '{_FIX}', 'i')) AS fixes, count(*) FILTER (NOT EXISTS (SELECT 1 FROM t WHERE t.sha = c.sha)) AS without_code,"
    " min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT author) AS authors FROM c GROUP BY c.repo"
)
def history_summary(s, d):
    code = _touched(s, d).select("sha").distinct().withColumn("code", F.lit(True))
    c = _commits(s, d).join(code, "sha", "left")
    fix = F.coalesce(F.col("subject").rlike(X.FIX_SUBJECT), F.lit(False))
    return c.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.count_if(fix).alias("fixes"), F.count_if(F.col("code").isNull()).alias("without_code"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("author").alias("authors"))


_AI = r"co-authored-by:\s*([^<\n]*?(?:claude|codex|gpt|openai|copilot|cursor|devin|gemini|aider|jules|windsurf|cline|astra|amp|sweep|factory|augment|replit|lovable|bolt|v0)[^<\n]*)"


@query(
    f"WITH {_C}, x AS (SELECT sha, subject, trim(regexp_replace(regexp_extract(coalesce(body, ''), '{_AI}', 1, 'i'), '\\s+', ' ', 'g')) AS n, regexp_extract(coalesce(body, ''), 'generated with \\[?(claude code|codex|cursor|aider|copilot)', 1, 'i') AS g FROM c)"
    f" SELECT sha, CASE WHEN n <> '' THEN n WHEN g <> '' THEN g END AS agent, regexp_matches(coalesce(subject, ''), '{_FIX}', 'i') AS fixlike FROM x"
)
def commit_classes(s, d):
    return _commits(s, d).select("sha", history.ai_author(F.col("body")).alias("agent"), F.coalesce(F.col("subject").rlike(X.FIX_SUBJECT), F.lit(False)).alias("fixlike"))


_RENAMES = [(1, "a/{x => y}/b.gd"), (2, "old.py => new.py"), (3, "{lib => core}/k.ts"), (4, "src/{deep => }/m.go"), (5, "core/k.ts => core/n.ts"), (6, "new.py => newer.py"), (7, "old.py => other.py")]
_RENAME_VALUES = "v(ord, spec) AS (VALUES " + ", ".join(f"({o}, '{x}')" for o, x in _RENAMES) + ")"
_RENAME_SQL = (
    _RENAME_VALUES + r", x AS (SELECT ord, CASE WHEN regexp_matches(spec, '^.*\{.* => .*\}.*$') THEN regexp_replace(regexp_replace(spec, '^(.*)\{(.*) => (.*)\}(.*)$', '\1\2\4'), '/+', '/', 'g') ELSE regexp_extract(spec, '^(.*?) => ', 1) END AS old,"
    r" CASE WHEN regexp_matches(spec, '^.*\{.* => .*\}.*$') THEN regexp_replace(regexp_replace(spec, '^(.*)\{(.*) => (.*)\}(.*)$', '\1\3\4'), '/+', '/', 'g') ELSE regexp_replace(spec, '^.*? => ', '') END AS new FROM v)"
)


@query(f"WITH {_RENAME_SQL} SELECT * FROM x")
def rename_expansion(s, d):
    return history.rename_expansion(s.createDataFrame(_RENAMES, "ord int, spec string")).select("ord", "old", "new")


@query(
    f"WITH RECURSIVE {_RENAME_SQL}, m AS (SELECT old, max_by(new, ord) AS new FROM x GROUP BY old), r AS (SELECT old, new AS cur, 1 AS i FROM m UNION ALL SELECT r.old, m.new, i + 1 FROM r JOIN m ON m.old = r.cur WHERE i < 50)"
    " SELECT old, max_by(cur, i) AS current FROM r GROUP BY old"
)
def rename_alias_closure(s, d):
    return history.current_names(history.rename_expansion(s.createDataFrame(_RENAMES, "ord int, spec string").withColumn("repo", F.lit("r")))).select("old", "current")


_PYTHON_IMPORT, _SCRIPT_IMPORT = r"^\s*(?:from|import)\s+(\.*[A-Za-z_][A-Za-z_0-9.]*)", r"(?:from|import|require\()\s*[\"'](\.[^\"']+)[\"']"
_IMPORTS = (
    r"""l AS (SELECT repo, path, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM files WHERE regexp_matches(path, '\.(js|ts|py)$')),"""
    f" w AS (SELECT DISTINCT repo, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, CASE WHEN path LIKE '%.py' THEN regexp_extract(line, '{_PYTHON_IMPORT}', 1) ELSE regexp_extract(line, '{_SCRIPT_IMPORT.replace(chr(39), chr(39) * 2)}', 1) END AS spec FROM l),"
    r""" i AS (SELECT *, CASE WHEN path LIKE '%.py' THEN regexp_replace(ltrim(spec, '.'), '\.', '/', 'g') ELSE regexp_replace(spec, '^\./', '') END AS rel FROM w WHERE spec <> '' AND NOT regexp_matches(spec, '^\.\./')),"""
    r""" n AS (SELECT repo, path, spec, unnest(CASE WHEN path LIKE '%.py' THEN [dir || '/' || rel || '.py', rel || '.py', regexp_replace(dir, '[^/]*$', '') || rel || '.py'] ELSE [dir || '/' || rel || '.ts', dir || '/' || rel || '.js', dir || '/' || rel] END) AS cand, unnest([1, 2, 3]) AS pref FROM i),"""
    r""" e AS (SELECT n.repo, n.path AS src, min_by(cand, pref) AS dst, spec FROM n JOIN files f ON f.repo = n.repo AND f.path = cand GROUP BY n.repo, n.path, spec)"""
)


def _imports(s, d):
    l = X.lines_of(_t(s, d, "files").filter(F.col("path").rlike(r"\.(js|ts|py)$")), ["repo", "path"])  # noqa: E741
    py = F.col("path").endswith(".py")
    spec = F.when(py, F.regexp_extract("text_line", _PYTHON_IMPORT, 1)).otherwise(F.regexp_extract("text_line", _SCRIPT_IMPORT, 1))
    return l.select("repo", "path", spec.alias("spec")).filter("spec <> '' and not startswith(spec, '../')").distinct()


def _import_edges(s, d):
    dir_, py = X.dirname(F.col("path")), F.col("path").endswith(".py")
    rel = F.when(py, F.regexp_replace(F.regexp_replace("spec", r"^\.+", ""), r"\.", "/")).otherwise(F.regexp_replace("spec", r"^\./", ""))
    here, up = F.concat(dir_, F.lit("/"), rel), F.concat(F.regexp_replace(dir_, "[^/]*$", ""), rel)
    cand = F.when(py, F.array(F.concat(here, F.lit(".py")), F.concat(rel, F.lit(".py")), F.concat(up, F.lit(".py")))).otherwise(F.array(F.concat(here, F.lit(".ts")), F.concat(here, F.lit(".js")), here))
    i = _imports(s, d).select("repo", F.col("path").alias("src"), "spec", cand.alias("cand"))
    return contracts.resolve_first(i, F.col("cand"), _t(s, d, "files"), ["repo", "src", "spec"]).withColumnRenamed("path", "dst")


@query(f"WITH {_IMPORTS} SELECT i.repo, path AS src, i.spec, dst FROM (SELECT DISTINCT repo, path, spec FROM i) i LEFT JOIN e ON e.repo = i.repo AND e.src = path AND e.spec = i.spec")
def import_targets(s, d):
    """Every import with the file it names, null where it names none."""
    return _imports(s, d).withColumnRenamed("path", "src").join(_import_edges(s, d), ["repo", "src", "spec"], "left")


@query(f"WITH {_IMPORTS} SELECT DISTINCT repo, path AS src, spec FROM i ANTI JOIN (SELECT repo, src AS path, spec FROM e) USING (repo, path, spec)")
def broken_imports(s, d):
    used = _imports(s, d).withColumnRenamed("path", "src")
    return contracts.not_there(used, _import_edges(s, d), ["repo", "src", "spec"])


@query(
    f"WITH {_T}, {_PAIRS}, {_IMPORTS}, o AS (SELECT repo, a, b, n, conf_ab, conf_ba FROM q WHERE n >= 3 AND n_small >= 2 AND weight >= 0.6),"
    " b2 AS (SELECT repo, a AS path, b AS partner, n, conf_ab AS confidence FROM o UNION ALL SELECT repo, b, a, n, conf_ba FROM o),"
    " lk AS (SELECT repo, src AS path, dst AS partner FROM e UNION SELECT repo, dst, src FROM e)"
    " SELECT repo, path, partner, n, round(confidence, 6) AS confidence FROM b2 ANTI JOIN lk USING (repo, path, partner) WHERE confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY n DESC, confidence DESC, partner) <= 6"
)
def hidden_partners(s, d):
    return history.hidden_partners(_pairs(s, d), _import_edges(s, d)).withColumn("confidence", r6("confidence"))


@query(
    f"WITH {_C}, {_T}, y AS (SELECT sha, sum(lines) AS l FROM t GROUP BY sha), w AS (SELECT repo, ord, c.sha, coalesce(l, 0) AS l, CASE WHEN regexp_matches(coalesce(subject, ''), '{_FIX}', 'i') THEN 1 ELSE 0 END AS f FROM c LEFT JOIN y USING (sha))"
    " SELECT repo, ord, sha, count(*) OVER v AS commits, CAST(sum(f) OVER v AS BIGINT) AS fixes, CAST(sum(l) OVER v AS BIGINT) AS churn FROM w WINDOW v AS (PARTITION BY repo ORDER BY ord, sha ROWS UNBOUNDED PRECEDING)"
)
def timeline_prefix(s, d):
    return history.prefix_state(_commits(s, d), _touched(s, d))


@query(
    f"WITH {_C}, {_T}, u AS (SELECT t.repo, t.sha, ord, path, lines FROM t JOIN c USING (repo, sha)), z AS (SELECT repo, sha, ord, count(*) AS size FROM u GROUP BY ALL),"
    " sd AS (SELECT repo, sha, ord, path AS seed FROM u QUALIFY row_number() OVER (PARTITION BY repo, sha ORDER BY lines DESC, path) = 1),"
    " sm AS (SELECT repo, sha, ord, seed, size - 1 AS truth FROM sd JOIN z USING (repo, sha, ord) WHERE size BETWEEN 2 AND 20 AND ord > 0),"
    " oc AS (SELECT u.* FROM u JOIN z USING (repo, sha, ord) WHERE size BETWEEN 2 AND 30),"
    " vt AS (SELECT sm.repo, sm.sha, o2.path, count(*) AS n FROM sm JOIN oc o1 ON o1.repo = sm.repo AND o1.path = sm.seed AND o1.ord < sm.ord JOIN oc o2 ON o2.repo = o1.repo AND o2.sha = o1.sha AND o2.path <> sm.seed GROUP BY ALL),"
    " rk AS (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY n DESC, path) AS place FROM vt),"
    " ht AS (SELECT rk.repo, rk.sha, count(*) FILTER (place <= 5) AS h5, count(*) FILTER (place <= 10) AS h10, min(place) AS first FROM rk JOIN t USING (repo, sha, path) WHERE place <= 10 GROUP BY ALL)"
    " SELECT repo, count(*) AS samples, round(avg(coalesce(h5, 0) / truth), 6) AS recall_5, round(avg(coalesce(h10, 0) / truth), 6) AS recall_10, round(avg(CASE WHEN h5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_5,"
    " round(avg(CASE WHEN h10 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM sm LEFT JOIN ht USING (repo, sha) GROUP BY repo"
)
def backtest_recall(s, d):
    b = history.backtest(_touched(s, d), _commits(s, d))
    return b.select("repo", "samples", *[r6(c).alias(c) for c in b.columns[2:]])


# Windows and ranks --------------------------------------------------------------------------------------------------------------------
_LATEST = "m AS (SELECT * FROM metrics WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST) = 1)"
_PCT = "CASE WHEN count({0}) OVER (PARTITION BY repo) > 1 THEN (count({0}) OVER (PARTITION BY repo ORDER BY {0} RANGE UNBOUNDED PRECEDING) - 1) / (count({0}) OVER (PARTITION BY repo) - 1) ELSE 0 END"


def _metrics(s, d):
    m = _t(s, d, "metrics")
    cols = [c for c in m.columns if c not in ("file_id", "scanned_at")]
    top = m.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max(F.struct("scanned_at", *cols)).alias("r"))
    return top.select("file_id", *[F.col("r")[c].alias(c) for c in cols])


@query(f"WITH {_LATEST}, x AS (SELECT file_id, repo, coalesce(churn_commits, 0) AS v, loc FROM m) SELECT file_id, repo, round({_PCT.format('v')}, 6) AS churn_pct, round({_PCT.format('loc')}, 6) AS loc_pct FROM x")
def risk_percentile_high(s, d):
    m = _metrics(s, d).select("file_id", "repo", F.coalesce("churn_commits", F.lit(0)).alias("v"), "loc")
    m = scoring.with_percentile(scoring.with_percentile(m, "repo", "v", "churn_pct"), "repo", "loc", "loc_pct")
    return m.select("file_id", "repo", r6("churn_pct").alias("churn_pct"), r6("loc_pct").alias("loc_pct"))


@query(
    f"WITH {_LATEST}, x AS (SELECT file_id, repo, path, fan_in, loc, coalesce(pagerank, 0) AS p, count(*) OVER (PARTITION BY repo) AS n FROM m), y AS (SELECT *, {_PCT.format('p')} AS pp, {_PCT.format('loc')} AS lp FROM x)"
    " SELECT file_id, repo, path, fan_in, loc FROM y WHERE n >= 6 AND pp >= 0.8 AND lp <= 0.5 AND fan_in >= 4"
)
def secret_controllers(s, d):
    return scoring.secret_controllers(_metrics(s, d)).select("file_id", "repo", "path", "fan_in", "loc")


_LEAN = (
    "e AS (SELECT repo, a AS src, b AS dst, conf_ab AS w FROM q WHERE n >= 2 AND conf_ab >= 0.5 UNION ALL SELECT repo, b, a, conf_ba FROM q WHERE n >= 2 AND conf_ba >= 0.5), nd AS (SELECT DISTINCT repo, path AS node FROM files)"
)
_GRAPH = f"{_T}, {_PAIRS}, {_LEAN}"
_REACH = "rc AS (SELECT DISTINCT repo, src, dst FROM e UNION SELECT rc.repo, rc.src, e.dst FROM rc JOIN e ON e.repo = rc.repo AND e.src = rc.dst)"


def _lean(s, d):
    """(repo, src, dst, w): src changes together with dst in half of its commits or more, twice at least: what leans on what."""
    p = _pairs(s, d).filter("n >= 2")
    a = p.select("repo", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("conf_ab").alias("w"))
    return a.union(p.select("repo", "b", "a", "conf_ba")).filter("w >= 0.5")


def _nodes(s, d):
    return _t(s, d, "files").select("repo", F.col("path").alias("node")).distinct()


_HIDDEN = (
    "o AS (SELECT repo, a, b, n, conf_ab, conf_ba FROM q WHERE n >= 3 AND n_small >= 2 AND weight >= 0.6), b2 AS (SELECT repo, a AS path, b AS partner, conf_ab AS confidence FROM o UNION ALL SELECT repo, b, a, conf_ba FROM o),"
    " hd AS (SELECT repo, path, least(6, count(*)) AS hidden FROM b2 WHERE confidence >= 0.5 GROUP BY ALL)"
)


@query(
    f"WITH RECURSIVE {_LATEST}, {_GRAPH}, {_REACH}, {_HIDDEN}, rr AS (SELECT repo, dst AS path, count(*) AS reach FROM rc WHERE src <> dst GROUP BY ALL), lf AS (SELECT file_id, max(end_line - line + 1) AS longest FROM (SELECT DISTINCT * FROM funcs) GROUP BY file_id),"
    " sv AS (SELECT DISTINCT file_id FROM files WHERE contains(text, 'user://') OR contains(text, 'writeFile')),"
    " x AS (SELECT m.file_id, m.repo, m.path, coalesce(fan_in, 0) AS fan_in, coalesce(loc, 0) AS loc, coalesce(pagerank, 0) AS p, coalesce(churn_commits, 0) AS v, coalesce(reach, 0) AS re, coalesce(longest, 0) AS longest, coalesce(hidden, 0) AS hidden, sv.file_id IS NOT NULL AS saves"
    " FROM m LEFT JOIN rr ON rr.repo = m.repo AND rr.path = m.path LEFT JOIN hd ON hd.repo = m.repo AND hd.path = m.path LEFT JOIN lf ON lf.file_id = m.file_id LEFT JOIN sv ON sv.file_id = m.file_id),"
    f" y AS (SELECT *, {_PCT.format('p')} AS pp, {_PCT.format('re')} AS rp, {_PCT.format('v')} AS cp FROM x),"
    " w AS (SELECT file_id, repo, path, greatest(CASE WHEN saves THEN 72 ELSE 0 END, 100 * (0.24 * (0.5 * pp + 0.5 * rp) + 0.06 * least(1, fan_in / 15) + 0.12 * (0.6 * least(1, loc / 700) + 0.4 * least(1, longest / 120)) + 0.12 * CASE WHEN v > 0 THEN cp ELSE 0 END + 0.12 + 0.12 * CASE WHEN saves THEN 1 ELSE 0 END + 0.08 * least(1, hidden / 3))) AS sc FROM y)"
    " SELECT file_id, repo, path, round(sc, 4) AS score, CASE WHEN sc >= 62 THEN 'do-not-touch' WHEN sc >= 45 THEN 'careful' ELSE 'normal' END AS tier FROM w"
)
def risk_rank_tiers(s, d):
    """Risk from measured rank, links, size and churn, longest functions, reach and hidden partners of the log, and texts that save data."""
    m = _metrics(s, d)
    reach = graph.reach_counts(_lean(s, d), _nodes(s, d)).select("repo", F.col("node").alias("path"), "reach")
    hidden = history.hidden_partners(_pairs(s, d), s.createDataFrame([], "repo string, src string, dst string")).groupBy("repo", "path").agg(F.count(F.lit(1)).alias("hidden"))
    longest = _t(s, d, "funcs").groupBy("file_id").agg(F.max(F.col("end_line") - F.col("line") + 1).alias("longest_func"))
    saves = _t(s, d, "files").filter(F.contains("text", F.lit("user://")) | F.contains("text", F.lit("writeFile"))).select("file_id", F.lit(True).alias("persists")).distinct()
    m = m.join(reach, ["repo", "path"], "left").join(hidden, ["repo", "path"], "left").join(longest, "file_id", "left").join(saves, "file_id", "left")
    return scoring.risk(m).select("file_id", "repo", "path", F.round("score", 4).alias("score"), "tier")


# Paths, roles, words ------------------------------------------------------------------------------------------------------------------
_EXT = "CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '\\.') THEN lower(regexp_extract(path, '[^./]*$')) ELSE '' END"
_ROLE = (
    f"CASE WHEN {_EXT} IN ('tscn', 'tres') THEN 'resource' WHEN {_EXT} IN ('godot', 'cfg') THEN 'config' WHEN coalesce(generated_by, '') <> '' THEN 'generated'"
    f" WHEN regexp_matches(path, '{X.TEST_PATH}') THEN 'test' WHEN regexp_matches(path, '{X.TOOL_PATH}') THEN 'tool' ELSE 'code' END"
)


@query(f"SELECT file_id, CASE {_EXT} WHEN 'gd' THEN 'gdscript' WHEN 'py' THEN 'python' WHEN 'js' THEN 'js' WHEN 'ts' THEN 'ts' WHEN 'go' THEN 'go' END AS lang, {_ROLE} AS role FROM file_facts")
def language_and_role(s, d):
    f = _t(s, d, "file_facts")
    return f.select("file_id", X.language(F.col("path")).alias("lang"), X.role(F.col("path"), F.col("generated_by")).alias("role"))


@query(
    "WITH p AS (SELECT c.repo, c.path, coalesce(max(strlen(text)), 0) AS bytes, coalesce(bool_or(contains(text, chr(0))), false) AS nul FROM (SELECT DISTINCT repo, path FROM commit_files WHERE path IS NOT NULL) c LEFT JOIN files f ON f.repo = c.repo AND f.path = c.path GROUP BY ALL), x AS (SELECT repo, path, bytes, nul, string_split(path, '/')[:-2] AS ps, "
    + _EXT
    + " AS ext FROM p) SELECT repo, path, CASE WHEN list_has_any(ps, ["
    + ", ".join(f"'{x}'" for x in X.SKIPPED_DIRS)
    + "]) THEN 'vendored' WHEN ext IN ("
    + ", ".join(f"'{x}'" for x in X.BINARY_EXTENSIONS)
    + ") THEN 'binary' WHEN bytes > 600000 THEN 'large' WHEN nul THEN 'binary' END AS why, CASE WHEN ext IN ('md', 'markdown', 'mdx', 'rst', 'txt') THEN CASE lower(regexp_extract(path, '[^/]*$')) WHEN 'agents.md' THEN 3 WHEN 'claude.md' THEN 3 WHEN 'gemini.md' THEN 3 WHEN 'copilot-instructions.md' THEN 3 WHEN 'codex.md' THEN 3"
    " WHEN 'readme.md' THEN CASE WHEN contains(path, '/') THEN 1 ELSE 2 END WHEN 'contributing.md' THEN 2 WHEN 'architecture.md' THEN 2 ELSE 1 END ELSE 0 END AS doc_weight FROM x"
)
def path_classes(s, d):
    f = _t(s, d, "files").groupBy("repo", "path").agg(F.max(F.octet_length("text")).alias("bytes"), F.bool_or(F.contains("text", F.lit("\0"))).alias("nul"))
    p = _t(s, d, "commit_files").select("repo", "path").filter(F.col("path").isNotNull()).distinct().join(f, ["repo", "path"], "left")
    return p.select("repo", "path", X.skip_reason(F.col("path"), F.coalesce("bytes", F.lit(0)), F.coalesce("nul", F.lit(False))).alias("why"), F.when(X.is_doc(F.col("path")), X.agent_weight(F.col("path"))).otherwise(0).alias("doc_weight"))


@query("WITH s AS (SELECT DISTINCT subject FROM commits) SELECT subject, " + "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(subject, '')), '{p}') THEN '{n}'" for n, p in X.INTENTS) + " ELSE 'change' END AS intent, left(regexp_replace(regexp_replace(lower(subject), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM s")
def subject_intents(s, d):
    return _t(s, d, "commits").select("subject").distinct().select("subject", X.intent(F.col("subject")).alias("intent"), X.slug(F.col("subject")).alias("slug"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{n}'" for n, p in X.STATUS) + " WHEN coalesce(text, '') <> '' THEN 'open' ELSE 'unknown' END AS class FROM documents")
def doc_status_class(s, d):
    """The status words of whole documents."""
    return _t(s, d, "documents").select("doc_id", X.status_class(F.col("text")).alias("class"))


_WORDS = (
    "list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(coalesce({0}, ''), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda w: lower(w)),"
    " lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+'))"
)
_STEM = (
    "CASE WHEN length({0}) > 4 AND {0} LIKE '%ies' THEN left({0}, length({0}) - 3) || 'y' WHEN length({0}) > 5 AND regexp_matches({0}, '(sses|shes|ches|xes)$') THEN left({0}, length({0}) - 2)"
    " WHEN length({0}) > 3 AND {0} LIKE '%s' AND NOT regexp_matches({0}, '(ss|us|is)$') THEN left({0}, length({0}) - 1) WHEN length({0}) > 5 AND {0} LIKE '%ing' THEN left({0}, length({0}) - 3)"
    " WHEN length({0}) > 4 AND {0} LIKE '%ed' THEN left({0}, length({0}) - 2) ELSE {0} END"
)


@query("WITH x AS (SELECT DISTINCT symbol FROM symbols), y AS (SELECT symbol, unnest(" + _WORDS.format("symbol") + ") AS word FROM x) SELECT symbol, word, " + _STEM.format("word") + " AS stem, count(*) AS n FROM y GROUP BY ALL")
def symbol_words_stems(s, d):
    y = _t(s, d, "symbols").select("symbol").distinct().select("symbol", F.explode(X.words(F.col("symbol"))).alias("word"))
    return y.select("symbol", "word", X.stem(F.col("word")).alias("stem")).groupBy("symbol", "word", "stem").agg(F.count(F.lit(1)).alias("n"))


# Retrieval ----------------------------------------------------------------------------------------------------------------------------
def _units(s, d):
    """Weighted texts of files: path and class 3, symbols 1, their documentation .6 (60 words), file documentation 1 (120 words)."""
    ff = _t(s, d, "file_facts").distinct()
    sy = _t(s, d, "symbols").distinct()
    u = lambda df, text, w, most: df.select("file_id", text.alias("text"), F.lit(float(w)).alias("weight"), F.lit(most).cast("int").alias("most"))
    path = F.regexp_replace("path", r"\.[^./]*$", "")
    parts = [u(ff, path, 3, None), u(ff, F.col("class_name"), 3, None), u(ff, F.col("doc"), 1, 120), u(sy, F.col("symbol"), 1, None), u(sy, F.col("doc"), 0.6, 60)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("text").isNotNull())


_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_INDEX = (
    "u AS (SELECT file_id, regexp_replace(path, '\\.[^./]*$', '') AS text, 3.0 AS w, 1000000 AS most FROM (SELECT DISTINCT * FROM file_facts) UNION ALL SELECT file_id, class_name, 3.0, 1000000 FROM (SELECT DISTINCT * FROM file_facts)"
    " UNION ALL SELECT file_id, doc, 1.0, 120 FROM (SELECT DISTINCT * FROM file_facts) UNION ALL SELECT file_id, symbol, 1.0, 1000000 FROM (SELECT DISTINCT * FROM symbols) UNION ALL SELECT file_id, doc, 0.6, 60 FROM (SELECT DISTINCT * FROM symbols)),"
    " wd AS (SELECT file_id, w, unnest((" + _WORDS.format("text") + ")[:most]) AS word FROM u),"
    " st AS (SELECT file_id, w, " + _STEM.format("word") + " AS term FROM wd), tf AS (SELECT file_id, term, sum(w) AS tf FROM st WHERE length(term) > 1 AND term NOT IN (" + _STOPS + ") GROUP BY ALL),"
    " ix AS (SELECT file_id, term, round(least(tf, 30.0), 2) AS tf FROM tf QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY round(tf, 6) DESC, term) <= 220)"
)


def _requests(s, d):
    """Query terms of the evaluation items (a fixed, small set): stems without stop words, weight 1."""
    q = _t(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(F.filter(X.words(F.col("item_text")), lambda w: ~w.isin(X.STOP_WORDS))).alias("w"))
    return q.select("query_id", X.stem(F.col("w")).alias("term"), F.lit(1.0).alias("qw")).distinct()


_REQ = "rq AS (SELECT DISTINCT query_id, " + _STEM.format("w") + " AS term FROM (SELECT item_id AS query_id, unnest(list_filter(" + _WORDS.format("item_text") + ", lambda w: NOT list_contains([" + _STOPS + "], w))) AS w FROM eval_items))"
_BM25 = (
    "ln AS (SELECT file_id, sum(tf) AS len FROM ix GROUP BY ALL), sx AS (SELECT count(*) AS n, avg(len) AS av FROM ln), df AS (SELECT term, count(*) AS df FROM ix GROUP BY ALL),"
    " sc AS (SELECT query_id, file_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.4 + 0.6 * len / av))) AS score, count(*) AS hits FROM rq JOIN ix USING (term) JOIN df USING (term) JOIN ln USING (file_id), sx GROUP BY ALL)"
)


@query(f"WITH {_INDEX} SELECT file_id, term, tf FROM ix")
def term_index_topk(s, d):
    return retrieval.term_index(_units(s, d), "file_id")


@query(f"WITH {_INDEX}, {_REQ}, {_BM25} SELECT query_id, file_id, round(score, 4) AS score, hits FROM sc")
def bm25_search(s, d):
    b = retrieval.bm25(retrieval.term_index(_units(s, d), "file_id"), "file_id", _requests(s, d))
    return b.select("query_id", "file_id", F.round("score", 4).alias("score"), F.size("hits").cast("long").alias("hits"))


@query(f"WITH {_INDEX}, {_REQ}, {_BM25}, pl AS (SELECT query_id, file_id, round(score, 8) AS score, row_number() OVER v AS place, max(round(score, 8)) OVER (PARTITION BY query_id) AS best FROM sc WINDOW v AS (PARTITION BY query_id ORDER BY round(score, 8) DESC, file_id)) SELECT query_id, file_id, place FROM pl WHERE place <= 5 AND score >= 0.4 * best")
def seeds_relative_cutoff(s, d):
    b = retrieval.bm25(retrieval.term_index(_units(s, d), "file_id"), "file_id", _requests(s, d)).withColumn("score", F.round("score", 8))
    return retrieval.seeds(b, "file_id").select("query_id", "file_id", "place")


@query(f"WITH {_INDEX}, {_REQ} SELECT query_id, term FROM rq ANTI JOIN ix USING (term)")
def missing_terms(s, d):
    return retrieval.missing_terms(_requests(s, d), retrieval.term_index(_units(s, d), "file_id"))


# Strings, contracts -------------------------------------------------------------------------------------------------------------------
def _strings(s, d):
    x = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r'"([A-Za-z_][A-Za-z_0-9/]{2,38})"'), F.lit(1))
    return _t(s, d, "files").select("repo", "path", F.explode(F.array_distinct(x)).alias("value"))


_STR = "st AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(text, '\"([A-Za-z_][A-Za-z_0-9/]{2,38})\"', 1)) AS value FROM files)"


@query(
    f"WITH {_STR}, n AS (SELECT repo, count(DISTINCT path) AS n FROM files GROUP BY repo), df AS (SELECT repo, value, count(*) AS df FROM st GROUP BY ALL),"
    " k AS (SELECT repo, value, ln(n / df) / ln(n) / (df - 1) AS w FROM df JOIN n USING (repo) WHERE df >= 2 AND df <= greatest(4, floor(0.2 * n)) AND df <= n AND n > 1)"
    " SELECT x.repo, x.path AS a, y.path AS b, count(*) AS n, round(sum(w), 6) AS weight, array_to_string(list_sort(list(x.value))[:8], ',') AS sample FROM st x JOIN st y ON x.repo = y.repo AND x.value = y.value AND x.path < y.path JOIN k ON k.repo = x.repo AND k.value = x.value GROUP BY ALL"
)
def shared_string_edges(s, d):
    n = _t(s, d, "files").groupBy("repo").agg(F.count_distinct("path").alias("files"))
    e = contracts.shared_strings(_strings(s, d), n)
    return e.select("repo", "a", "b", "n", r6("weight").alias("weight"), F.array_join("sample", ",").alias("sample"))


@query(f"WITH {_STR} SELECT repo, value, count(*) AS files FROM st GROUP BY ALL HAVING count(*) >= 3")
def scattered_constants(s, d):
    return smells.scattered_constants(_strings(s, d))


_CALLED, _KEYED, _ASKED = r"\b[a-z_][a-z_0-9]*\.([a-z_][a-z_0-9]*)\(", r"\"([A-Za-z_][A-Za-z_0-9]*)\"\s*:", r"\(\"([A-Za-z_][A-Za-z_0-9]*)\""
_CODE = r"l AS (SELECT repo, path, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT repo, path, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM files WHERE text IS NOT NULL))"
_SENT = (
    f"{_CODE}, sn AS (SELECT repo, path AS file, line, unnest(regexp_extract_all(x, '{_CALLED}', 1)) AS key FROM l), tk AS (SELECT DISTINCT f.repo, func_name AS key FROM funcs JOIN files f USING (file_id) WHERE func_name IS NOT NULL)"
)


def _grab(s, d, pattern, out):
    l = X.lines_of(_t(s, d, "files").filter(F.col("text").isNotNull()), ["repo", "path"])  # noqa: E741
    return l.select("repo", "path", "line", F.explode(F.regexp_extract_all("text_line", F.lit(pattern), F.lit(1))).alias(out))


def _method_sends(s, d):
    """Calls through a receiver, by name, against the functions that a repository declares: its table of methods."""
    sends = _grab(s, d, _CALLED, "key").select("repo", F.lit("methods").alias("table_id"), "key", F.col("path").alias("file"), "line")
    f = _t(s, d, "funcs").join(_t(s, d, "files").select("file_id", "repo"), "file_id").filter(F.col("func_name").isNotNull())
    keys = f.select("repo", F.lit("methods").alias("table_id"), F.col("func_name").alias("key"), F.lit("index").alias("access"), F.lit(False).alias("open"), F.lit(True).alias("handled")).distinct()
    return sends, keys


@query(f"WITH {_SENT} SELECT repo, key, file, line, 'high' AS severity, count(*) AS n FROM sn ANTI JOIN tk USING (repo, key) WHERE repo IN (SELECT repo FROM tk) GROUP BY ALL")
def unknown_method_keys(s, d):
    u = contracts.unknown_keys(*_method_sends(s, d))
    return u.groupBy("repo", "key", "file", "line", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SENT}, busy AS (SELECT repo FROM sn GROUP BY repo HAVING count(*) >= 3) SELECT repo, key FROM tk SEMI JOIN busy USING (repo) ANTI JOIN sn USING (repo, key)")
def unsent_method_keys(s, d):
    return contracts.unsent_keys(*_method_sends(s, d)).select("repo", "key")


@query(
    f"WITH {_CODE}, pr AS (SELECT DISTINCT repo, unnest(regexp_extract_all(x, '{_KEYED}', 1)) AS key FROM l), co AS (SELECT repo, unnest(regexp_extract_all(x, '{_ASKED}', 1)) AS key FROM l)"
    " SELECT repo, key, count(*) AS reads, 'contract.key-never-written' AS id FROM co ANTI JOIN pr USING (repo, key) GROUP BY ALL"
)
def dangling_keys(s, d):
    """Names handed to calls that no dictionary of the repository holds."""
    return contracts.dangling(_grab(s, d, _ASKED, "key").withColumn("guarded", F.lit(False)), _grab(s, d, _KEYED, "key"))


@query(
    "WITH u AS (SELECT DISTINCT f.repo, f.path, line, regexp_extract(func_name, '^[A-Za-z][a-z]*') AS key, params FROM funcs JOIN files f USING (file_id) WHERE func_name IS NOT NULL AND params IS NOT NULL), k AS (SELECT DISTINCT repo, path, line, key, unnest(params) AS field FROM u), n AS (SELECT repo, key, count(*) AS n FROM u GROUP BY ALL),"
    " need AS (SELECT repo, key, field FROM k JOIN n USING (repo, key) GROUP BY repo, key, field, n HAVING count(*) >= n / 4) SELECT u.repo, u.path, line, u.key, array_to_string(list_sort(list(field)), ',') AS missing, 'high' AS severity FROM u JOIN need ON need.repo = u.repo AND need.key = u.key WHERE NOT list_contains(params, field) GROUP BY ALL"
)
def payload_missing_keys(s, d):
    """Functions that lack a parameter which a quarter of the functions with the same first word in the repository take."""
    e = _t(s, d, "funcs").select("file_id", "line", F.regexp_extract("func_name", "^[A-Za-z][a-z]*", 0).alias("key"), F.col("params").alias("payload")).filter("key is not null and payload is not null")
    e = e.join(_t(s, d, "files").select("file_id", "repo", F.col("path").alias("file")), "file_id").select("repo", F.lit("functions").alias("table_id"), "key", "file", "line", "payload").distinct()
    n = e.groupBy("repo", "key").agg(F.count(F.lit(1)).alias("n"))
    need = e.select("repo", "key", "file", "line", F.explode(F.array_distinct("payload")).alias("field")).groupBy("repo", "key", "field").agg(F.count(F.lit(1)).alias("k")).join(n, ["repo", "key"]).filter(F.col("k") >= F.col("n") / 4)
    need = need.select("repo", F.lit("functions").alias("table_id"), "key", "field", F.lit(1).alias("line"), F.array().cast("array<int>").alias("returns"))
    return contracts.payload_missing(e, need).select("repo", F.col("file").alias("path"), "line", "key", F.array_join("missing", ",").alias("missing"), "severity")


@query()
def fuzzy_suggestion(s, d):
    """The nearest declared signal for each signal that is emitted or connected but not declared (matching blocks: rows only, tested in full)."""
    dec, em, con = _signals(s, d)
    used = em.union(con).distinct().join(dec.distinct(), ["repo", "name"], "left_anti")
    return documents.suggestion(used.withColumnRenamed("name", "key").withColumn("t", F.lit("signals")), dec.withColumnRenamed("name", "key").withColumn("t", F.lit("signals")), "t", 0.5)


_MENTION = r"[A-Za-z_0-9]+(?:/[A-Za-z_0-9.]+)+\.(?:gd|py|js|ts|go)\b"


@query(
    "WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '" + _MENTION + "')) AS mention FROM documents), p AS (SELECT DISTINCT string_split(path, '/') AS ps FROM files), t AS (SELECT DISTINCT array_to_string(ps[i:], '/') AS mention FROM (SELECT ps, unnest(range(1, len(ps) + 1)) AS i FROM p))"
    " SELECT doc_id, mention FROM m ANTI JOIN t USING (mention)"
)
def stale_references(s, d):
    m = _t(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(" + _MENTION + ")"), F.lit(1))).alias("mention"))
    return contracts.stale_references(m, _t(s, d, "files").select("path").distinct())


def _signals(s, d):
    files = _t(s, d, "files")
    dec = _t(s, d, "symbols").distinct().filter("kind = 'signal'").join(files.select("file_id", "repo"), "file_id").select("repo", F.col("symbol").alias("name"))
    gd = X.lines_of(files.filter(F.col("path").endswith(".gd")), ["repo"])
    grab = lambda p: gd.select("repo", F.explode(F.regexp_extract_all("text_line", F.lit(p), F.lit(1))).alias("name"))
    return dec, grab(r"([A-Za-z_][A-Za-z_0-9]*)\.emit\("), grab(r"([A-Za-z_][A-Za-z_0-9]*)\.connect\(")


@query(
    r"WITH sg AS (SELECT f.repo, symbol AS name, count(*) AS declared FROM (SELECT DISTINCT * FROM symbols) y JOIN files f USING (file_id) WHERE kind = 'signal' GROUP BY ALL),"
    r" l AS (SELECT repo, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM files WHERE path LIKE '%.gd'), em AS (SELECT repo, name, count(*) AS emits FROM (SELECT repo, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z_0-9]*)\.emit\(', 1)) AS name FROM l) GROUP BY ALL),"
    r" cn AS (SELECT repo, name, count(*) AS connects FROM (SELECT repo, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z_0-9]*)\.connect\(', 1)) AS name FROM l) GROUP BY ALL)"
    " SELECT sg.repo, sg.name, declared, coalesce(emits, 0) AS emits, coalesce(connects, 0) AS connects, CASE WHEN coalesce(emits, 0) > 0 THEN NULL WHEN coalesce(connects, 0) > 0 THEN 'medium' ELSE 'low' END AS severity"
    " FROM sg LEFT JOIN em ON em.repo = sg.repo AND em.name = sg.name LEFT JOIN cn ON cn.repo = sg.repo AND cn.name = sg.name"
)
def signal_state(s, d):
    return contracts.signal_state(*_signals(s, d))


@query("WITH y AS (SELECT DISTINCT file_id, line FROM symbols), f AS (SELECT DISTINCT file_id, func_name, line AS lo, end_line AS hi FROM funcs WHERE end_line >= line) SELECT y.file_id, y.line, func_name AS name FROM y JOIN f ON f.file_id = y.file_id AND y.line BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY y.file_id, y.line ORDER BY hi - lo, func_name) = 1")
def smallest_enclosing_function(s, d):
    return contracts.enclosing(_t(s, d, "symbols"), _t(s, d, "funcs").withColumnRenamed("func_name", "name"), "file_id")


@query(r"WITH y AS (SELECT DISTINCT file_id, line FROM symbols), l AS (SELECT file_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM files) SELECT file_id, line, left(rtrim(ls[line], ' '), 240) AS evidence FROM y JOIN l USING (file_id)")
def evidence_text(s, d):
    y = _t(s, d, "symbols").select("file_id", "line").distinct()
    return contracts.with_evidence(y, X.lines_of(_t(s, d, "files"), ["file_id"]))


# Smells and documents -----------------------------------------------------------------------------------------------------------------
_LINES = r"l AS (SELECT file_id, unnest(string_split(t, chr(10))) AS x, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line FROM (SELECT file_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM files WHERE text IS NOT NULL))"
_COM = r"regexp_matches(x, '^\s*(#|//|/\*|\*)')"


def _sql_pattern(p: str) -> str:
    return p.replace("'", "''")


@query(
    f"WITH {_LINES} SELECT file_id, count(*) FILTER ({_COM} AND regexp_matches(x, '{_sql_pattern(smells.ELISION)}')) AS elision, count(*) FILTER ({_COM} AND regexp_matches(x, '{_sql_pattern(smells.CHAT)}')) AS chat,"
    f" count(*) FILTER ({_COM} AND regexp_matches(x, '{_sql_pattern(smells.STUB)}')) AS stub, count(*) FILTER ({_COM} AND regexp_matches(x, '{smells.TODO}')) AS todo, count(*) FILTER (regexp_matches(x, '{smells.IGNORES}')) AS ignores, count(*) FILTER (regexp_matches(x, '{smells.PRINTS}')) AS prints FROM l GROUP BY file_id"
)
def smell_counts(s, d):
    return smells.marker_counts(X.lines_of(_t(s, d, "files"), ["file_id"]), ["file_id"])


@query(
    f"WITH {_LINES}, c AS (SELECT file_id, line, trim(regexp_replace(trim(x, ' '), '^[#/*! \\t]+', ''), ' ') AS body, trim(x, ' ') AS raw FROM l WHERE {_COM}), k AS (SELECT file_id, line, line - row_number() OVER (PARTITION BY file_id ORDER BY line) AS i FROM c WHERE NOT regexp_matches(raw, '^(##|///|/\\*\\*)') AND regexp_matches(body, '{_sql_pattern(smells.CODEISH)}'))"
    " SELECT file_id, min(line) AS first_line, count(*) AS n FROM k GROUP BY file_id, i"
)
def comment_islands(s, d):
    """All runs of comment lines that look like code, of any length: three and more are leftovers."""
    return smells.commented_code(X.lines_of(_t(s, d, "files"), ["file_id"]), "file_id", 1)


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents) SELECT word FROM w WHERE regexp_matches(word, '{_sql_pattern(smells.VERSIONED)}')")
def versioned_names(s, d):
    """The rule for version and copy marks in file names, over all words of the documents, where some do carry one."""
    w = _t(s, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1)))).alias("path")).distinct()
    return smells.versioned(w).select(F.col("path").alias("word"))


@query(
    r"WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)), k AS (SELECT * FROM l WHERE trim(x, ' ') <> ''),"
    r" n AS (SELECT doc_id, line, x, CASE WHEN lag(line) OVER v IS NULL OR line - lag(line) OVER v > 2 OR regexp_matches(x, '^\s*([-*+]|[0-9]+[.)])\s') OR regexp_matches(x, '^#{1,6}\s') THEN 1 ELSE 0 END AS nw FROM k WINDOW v AS (PARTITION BY doc_id ORDER BY line)),"
    " g AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS paragraph FROM n) SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, min(line) AS first_line, max(line) AS last_line, count(*) AS lines, md5(string_agg(trim(x, ' '), ' ' ORDER BY line)) AS text_md5 FROM g GROUP BY ALL"
)
def paragraph_groups(s, d):
    p = smells.paragraphs(X.lines_of(_t(s, d, "documents"), ["doc_id"]), "doc_id")
    return p.select("doc_id", "paragraph", "first_line", "last_line", "lines", F.md5("text").alias("text_md5"))


_NEG = ", ".join(f"'{w}'" for w in X.NEGATIONS)
_TERMS = ["market", "table", "scene"]


@query(
    "WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: lower(w)) AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM t), q AS (SELECT doc_id, i, w, "
    + _STEM.format("w")
    + " AS s FROM e) SELECT DISTINCT a.doc_id FROM q a JOIN q b ON a.doc_id = b.doc_id AND ((a.w IN ("
    + _NEG
    + ") AND b.s IN ('market', 'table', 'scene') AND b.i - a.i BETWEEN 1 AND 6) OR (a.s IN ('market', 'table', 'scene') AND b.w = 'false' AND b.i - a.i BETWEEN 1 AND 4))"
)
def negation_conflicts(s, d):
    t = _t(s, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("line"), "text").filter(F.col("text").isNotNull())
    return retrieval.conflicts(t, _TERMS).select(F.col("doc").alias("doc_id")).distinct()


@query(
    f"WITH {_LINES}, m AS (SELECT file_id, CASE WHEN regexp_matches(x, '{_sql_pattern(smells.ELISION)}') THEN 'high' WHEN regexp_matches(x, '{_sql_pattern(smells.CHAT)}') THEN 'medium' WHEN regexp_matches(x, '{_sql_pattern(smells.STUB)}') THEN 'low' ELSE 'info' END AS severity FROM l WHERE {_COM})"
    " SELECT repo, severity, count(*) AS n FROM m JOIN files USING (file_id) GROUP BY ALL"
)
def severity_rollup(s, d):
    """Comments by what they give away."""
    c = smells.comment_lines(X.lines_of(_t(s, d, "files"), ["repo"]))
    sev = F.when(F.col("text_line").rlike(smells.ELISION), "high").when(F.col("text_line").rlike(smells.CHAT), "medium").when(F.col("text_line").rlike(smells.STUB), "low").otherwise("info")
    return contracts.by_severity(c.select("repo", sev.alias("severity")), ["repo"])


# Clones -------------------------------------------------------------------------------------------------------------------------------
_KEEP = ", ".join(f"'{w}'" for w in clones.KEYWORDS)
_LIT = ", ".join(f"'{w}'" for w in clones.LITERAL)
_TOKS = (
    "ln AS (SELECT repo, file_id, path, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT repo, file_id, path, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM files WHERE text IS NOT NULL)),"
    f" lt AS (SELECT repo, file_id, line, CASE WHEN regexp_matches(path, '{clones.HASHED}') THEN list_filter(regexp_extract_all(l, '{_sql_pattern(clones.HASH_TOKEN)}', 1), lambda x: NOT starts_with(x, '#'))"
    f" ELSE list_filter(regexp_extract_all(l, '{_sql_pattern(clones.SLASH_TOKEN)}', 1), lambda x: NOT (starts_with(x, '//') OR starts_with(x, '/*'))) END AS ts FROM ln),"
    " tp0 AS (SELECT repo, file_id, line, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM lt),"
    f" tp AS (SELECT repo, file_id, line, row_number() OVER (PARTITION BY file_id ORDER BY line, i) AS pos, CASE WHEN left(t, 1) IN (chr(34), chr(39), chr(96)) THEN 'S' WHEN regexp_matches(t, '^[0-9]') THEN 'N' WHEN regexp_matches(t, '^[A-Za-z_]') AND t NOT IN ({_KEEP}) THEN 'I' ELSE t END AS tok FROM tp0),"
    " tk AS (SELECT repo, file_id, list(tok ORDER BY pos) AS toks FROM tp GROUP BY ALL),"
    " gr AS (SELECT repo, file_id, i AS pos, md5(array_to_string(toks[i:i + 24], ' ')) AS h, len(toks) - 24 AS n FROM (SELECT repo, file_id, toks, unnest(range(1, len(toks) - 23)) AS i FROM tk WHERE len(toks) >= 25)),"
    " mn AS (SELECT repo, file_id, pos, n, min(h || lpad(CAST(1000000000 - pos AS VARCHAR), 10, '0')) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m FROM gr),"
    " fp AS (SELECT DISTINCT repo, file_id, left(m, 32) AS h, 1000000000 - CAST(right(m, 10) AS INTEGER) AS pos FROM mn WHERE pos <= greatest(n - 9, 1))"
)


def _arrays(s, d):
    return clones.token_arrays(_t(s, d, "files"))


@query(f"WITH {_TOKS} SELECT repo, file_id, h, pos FROM fp")
def clone_winnow_fingerprints(s, d):
    return clones.fingerprints(_arrays(s, d))


_RUNS = (
    "oc AS (SELECT repo, h FROM fp GROUP BY repo, h HAVING count(*) BETWEEN 2 AND 12), fk AS (SELECT fp.* FROM fp JOIN oc USING (repo, h)),"
    " sd AS (SELECT x.repo, x.file_id AS a, y.file_id AS b, y.pos - x.pos AS sh, x.pos AS pa FROM fk x JOIN fk y ON x.repo = y.repo AND x.h = y.h AND (x.file_id < y.file_id OR (x.file_id = y.file_id AND y.pos - x.pos >= 25))), dg AS (SELECT DISTINCT repo, a, b, sh FROM sd),"
    " mt AS (SELECT dg.repo, a, b, sh, x.pos FROM dg JOIN tp x ON x.file_id = a JOIN tp y ON y.file_id = b AND y.pos = x.pos + sh AND y.tok = x.tok),"
    " il AS (SELECT repo, a, b, sh, pos, pos - row_number() OVER (PARTITION BY a, b, sh ORDER BY pos) AS i FROM mt), r0 AS (SELECT repo, a, b, sh, min(pos) AS s, max(pos) AS t FROM il GROUP BY repo, a, b, sh, i),"
    " r1 AS (SELECT repo, a, b, sh, s, CASE WHEN a = b THEN least(t - s + 1, sh) ELSE t - s + 1 END AS n FROM r0 WHERE EXISTS (SELECT 1 FROM sd WHERE sd.a = r0.a AND sd.b = r0.b AND sd.sh = r0.sh AND sd.pa >= r0.s AND sd.pa + 24 <= r0.t)),"
    f" r2 AS (SELECT r1.*, toks[s:s + n - 1] AS part FROM r1 JOIN tk ON tk.file_id = a WHERE n >= 70), r3 AS (SELECT * FROM r2 WHERE len(list_filter(part, lambda x: x IN ({_LIT}))) <= 0.62 * n AND len(list_distinct(part)) >= 12),"
    " rn AS (SELECT r3.repo, a, b, s AS a_start, s + sh AS b_start, n AS tokens, x1.line AS a_line, x2.line AS a_end_line, y1.line AS b_line, y2.line AS b_end_line FROM r3 JOIN tp x1 ON x1.file_id = a AND x1.pos = s JOIN tp x2 ON x2.file_id = a AND x2.pos = s + n - 1"
    " JOIN tp y1 ON y1.file_id = b AND y1.pos = s + sh JOIN tp y2 ON y2.file_id = b AND y2.pos = s + sh + n - 1 WHERE x2.line - x1.line >= 5),"
    " ot AS (SELECT * FROM rn r WHERE NOT EXISTS (SELECT 1 FROM rn q WHERE q.a = r.a AND q.b = r.b AND q.a_line <= r.a_line AND q.a_end_line >= r.a_end_line AND q.b_line <= r.b_line AND q.b_end_line >= r.b_end_line"
    " AND (-q.tokens, q.a_start, q.b_start) < (-r.tokens, r.a_start, r.b_start)))"
)


def _clone_runs(s, d):
    return clones.clone_runs(_arrays(s, d))


@query(f"WITH {_TOKS}, {_RUNS} SELECT repo, a, b, a_start, b_start, tokens FROM rn")
def clone_runs(s, d):
    return _clone_runs(s, d).select("repo", "a", "b", "a_start", "b_start", "tokens")


@query(f"WITH {_TOKS}, {_RUNS} SELECT repo, a, b, a_line, a_end_line, b_line, b_end_line, tokens FROM ot")
def clone_pairs_outermost(s, d):
    return clones.outermost(_clone_runs(s, d)).select("repo", "a", "b", "a_line", "a_end_line", "b_line", "b_end_line", "tokens")


@query(f"WITH {_TOKS}, {_RUNS}, dl AS (SELECT repo, a AS file, unnest(range(a_line, a_end_line + 1)) AS line FROM ot UNION SELECT repo, b, unnest(range(b_line, b_end_line + 1)) FROM ot) SELECT repo, file, count(*) AS dup_lines FROM dl GROUP BY ALL")
def duplicated_lines(s, d):
    return clones.duplicated_lines(_clone_runs(s, d))


# Graphs: the files of each repository, by what leans on what in the log ----------------------------------------------------------------------
def _starts(s, d):
    """One search per repository, from the first file that leans on another."""
    return _lean(s, d).groupBy("repo").agg(F.min("src").alias("node")).select(F.col("repo").alias("q"), "repo", "node")


_START = "sd AS (SELECT repo, min(src) AS node FROM e GROUP BY repo)"


@query(f"WITH {_GRAPH} SELECT repo, src, dst, round(w, 6) AS w FROM e")
def leaning_graph(s, d):
    return _lean(s, d).withColumn("w", r6("w"))


@query(
    f"WITH RECURSIVE {_GRAPH}, nn AS (SELECT repo, count(*) AS n FROM nd GROUP BY repo), o AS (SELECT repo, src, sum(w) AS t FROM e GROUP BY ALL), a AS (SELECT e.repo, e.src, dst, w / t AS w FROM e JOIN o ON o.repo = e.repo AND o.src = e.src),"
    " lk AS (SELECT x.repo, x.node AS src, y.node AS dst, n, o.src IS NULL AS loose, coalesce(a.w, 0) AS w FROM nd x JOIN nd y ON x.repo = y.repo JOIN nn ON nn.repo = x.repo LEFT JOIN o ON o.repo = x.repo AND o.src = x.node LEFT JOIN a ON a.repo = x.repo AND a.src = x.node AND a.dst = y.node),"
    " pr AS (SELECT 0 AS i, repo, node, 1.0::DOUBLE / n AS r FROM nd JOIN nn USING (repo) UNION ALL SELECT i + 1, lk.repo, lk.dst, 0.15 / n + 0.85 * sum(r * CASE WHEN loose THEN 1.0 / n ELSE w END) FROM pr JOIN lk ON lk.repo = pr.repo AND lk.src = pr.node WHERE i < 60 GROUP BY i, lk.repo, lk.dst, n)"
    " SELECT repo, node, round(r, 8) AS rank FROM pr WHERE i = 60"
)
def pagerank_60(s, d):
    return graph.pagerank(_lean(s, d), _nodes(s, d)).select("repo", "node", F.round("rank", 8).alias("rank"))


@query(
    f"WITH RECURSIVE {_GRAPH}, {_START}, o AS (SELECT repo, src, sum(w) AS t FROM e GROUP BY ALL), a AS (SELECT e.repo, e.src, dst, 0.55 * w / greatest(t, 1) AS w FROM e JOIN o ON o.repo = e.repo AND o.src = e.src),"
    " lk AS (SELECT x.repo, x.node AS src, y.node AS dst, coalesce(a.w, 0) AS w FROM nd x JOIN nd y ON x.repo = y.repo LEFT JOIN a ON a.repo = x.repo AND a.src = x.node AND a.dst = y.node),"
    " pp AS (SELECT 0 AS i, nd.repo, nd.node, CASE WHEN sd.node IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS r FROM nd LEFT JOIN sd ON sd.repo = nd.repo AND sd.node = nd.node"
    " UNION ALL SELECT i + 1, lk.repo, lk.dst, sum(r * w) + CASE WHEN (lk.repo, lk.dst) IN (SELECT repo, node FROM sd) THEN 0.45 ELSE 0 END FROM pp JOIN lk ON lk.repo = pp.repo AND lk.src = pp.node WHERE i < 40 GROUP BY i, lk.repo, lk.dst) SELECT repo, node, round(r, 8) AS mass FROM pp WHERE i = 40 AND r >= 0.000001"
)
def personalized_pagerank_40(s, d):
    return graph.personalized(_lean(s, d), _starts(s, d)).filter("mass >= 0.000001").select("repo", "node", F.round("mass", 8).alias("mass"))


@query(f"WITH RECURSIVE {_GRAPH}, {_REACH} SELECT nd.repo, node, count(rc.src) AS reach FROM nd LEFT JOIN rc ON rc.repo = nd.repo AND rc.dst = node AND rc.src <> node GROUP BY ALL")
def reach_closure(s, d):
    return graph.reach_counts(_lean(s, d), _nodes(s, d))


@query(
    f"WITH RECURSIVE {_GRAPH}, {_REACH}, mu AS (SELECT x.repo, x.src AS node, min(x.dst) AS m FROM rc x JOIN rc y ON x.repo = y.repo AND x.src = y.dst AND x.dst = y.src GROUP BY ALL),"
    " c AS (SELECT nd.repo, nd.node, least(nd.node, coalesce(m, nd.node)) AS component FROM nd LEFT JOIN mu ON mu.repo = nd.repo AND mu.node = nd.node) SELECT repo, node, component, count(*) OVER (PARTITION BY repo, component) AS size FROM c"
)
def cycle_components(s, d):
    return graph.components(_lean(s, d), _nodes(s, d))


@query(f"WITH RECURSIVE {_GRAPH}, {_START}, b AS (SELECT repo, node, 0 AS hops FROM sd UNION SELECT e.repo, e.dst, hops + 1 FROM b JOIN e ON e.repo = b.repo AND e.src = b.node WHERE hops < 60) SELECT repo, node, min(hops) AS hops FROM b GROUP BY ALL")
def bfs_hops(s, d):
    return graph.shortest_chains(_lean(s, d), _starts(s, d)).select("repo", "node", "hops")


@query(
    f"WITH RECURSIVE {_GRAPH}, {_START}, c AS (SELECT repo, src, dst, 0.35 - ln(least(1.0, greatest(w, 0.001))) AS c FROM e UNION ALL SELECT repo, node, node, 0.0 FROM nd), b AS (SELECT 0 AS i, repo, node, 0.0::DOUBLE AS dist FROM sd"
    " UNION ALL SELECT i + 1, c.repo, c.dst, min(dist + c) FROM b JOIN c ON c.repo = b.repo AND c.src = b.node WHERE i < 60 GROUP BY i, c.repo, c.dst) SELECT repo, node, round(dist, 6) AS dist FROM b WHERE i = 60"
)
def cheapest_evidence_path(s, d):
    return graph.cheapest_paths(_lean(s, d), _starts(s, d)).select("repo", "node", r6("dist").alias("dist"))


@query(
    f"WITH {_C}, {_T}, {_PAIRS}, {_STR}, n AS (SELECT repo, count(DISTINCT path) AS n FROM files GROUP BY repo), df AS (SELECT repo, value, count(*) AS df FROM st GROUP BY ALL), r AS (SELECT repo FROM c GROUP BY repo HAVING count(*) >= 5),"
    " k2 AS (SELECT repo, value, ln(n / df) / ln(n) / (df - 1) AS w FROM df JOIN n USING (repo) WHERE df >= 2 AND df <= greatest(4, floor(0.2 * n)) AND df <= n AND n > 1),"
    " ss AS (SELECT x.repo, x.path AS a, y.path AS b, sum(w) AS weight FROM st x JOIN st y ON x.repo = y.repo AND x.value = y.value AND x.path < y.path JOIN k2 ON k2.repo = x.repo AND k2.value = x.value GROUP BY ALL),"
    " u AS (SELECT repo, a, b, 'strings' AS kind, 0.35 * least(1, weight / 3) AS w FROM ss WHERE weight >= 0.6 UNION ALL SELECT repo, a, b, 'cochange', 0.8 * greatest(conf_ab, conf_ba) * least(1, weight / 1.5) FROM q SEMI JOIN r USING (repo) WHERE n >= 2 AND 0.8 * greatest(conf_ab, conf_ba) * least(1, weight / 1.5) >= 0.08),"
    " v AS (SELECT repo, a AS src, b AS dst, kind, w FROM u UNION ALL SELECT repo, b, a, kind, w FROM u) SELECT repo, src, dst, round(least(1.5, sum(w)), 6) AS w, count(*) AS kinds FROM (SELECT repo, src, dst, kind, max(w) AS w FROM v GROUP BY ALL) GROUP BY ALL"
)
def graph_merge_weights(s, d):
    n = _t(s, d, "files").groupBy("repo").agg(F.count_distinct("path").alias("files"))
    ss = contracts.shared_strings(_strings(s, d), n)
    e1 = graph.string_weights(ss).withColumn("kind", F.lit("strings"))
    cm = _commits(s, d).groupBy("repo").agg(F.count(F.lit(1)).alias("commits"))
    e2 = history.cochange_edges(_pairs(s, d), cm).withColumn("kind", F.lit("cochange"))
    m = graph.merge_kinds(e1.unionByName(e2))
    return m.select("repo", "src", "dst", r6("w").alias("w"), F.size("kinds").cast("long").alias("kinds"))


@query(
    f"WITH {_GRAPH}, i AS (SELECT repo, dst, count(*) AS n FROM (SELECT DISTINCT repo, src, dst FROM e) GROUP BY ALL), tp AS (SELECT repo, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, dst) AS k FROM i), g AS (SELECT repo, sum(n) AS edges, sum(n) FILTER (k <= 3) AS best FROM tp GROUP BY repo), f AS (SELECT repo, count(*) AS files FROM nd GROUP BY repo)"
    " SELECT f.repo, round(coalesce(best, 0) / greatest(1, coalesce(edges, 0)), 6) AS top_share, round(coalesce(edges, 0) / files, 6) AS avg_fan_out FROM f LEFT JOIN g USING (repo)"
)
def hub_concentration(s, d):
    return graph.concentration(_lean(s, d), _nodes(s, d)).select("repo", r6("top_share").alias("top_share"), r6("avg_fan_out").alias("avg_fan_out"))


# Roll-ups and scores ------------------------------------------------------------------------------------------------------------------
@query("SELECT repo, lang, CAST(sum(loc) AS BIGINT) AS loc, count(*) AS files FROM file_facts GROUP BY ALL")
def language_lines(s, d):
    return _t(s, d, "file_facts").groupBy("repo", "lang").agg(F.sum("loc").alias("loc"), F.count(F.lit(1)).alias("files"))


@query(f"WITH x AS (SELECT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, {_ROLE} AS role, loc FROM file_facts), g AS (SELECT repo, dir, role, count(*) AS n, sum(loc) AS l FROM x GROUP BY ALL) SELECT repo, dir, CAST(sum(n) AS BIGINT) AS files, CAST(sum(l) AS BIGINT) AS loc, arg_min(role, (-n, role)) AS role FROM g GROUP BY repo, dir")
def architecture_rollup(s, d):
    f = _t(s, d, "file_facts")
    return scoring.directories(f.select("repo", "path", "loc", X.role(F.col("path"), F.col("generated_by")).alias("role")))


_MARKS = f"mk AS (SELECT file_id, 5 * count(*) FILTER (regexp_matches(x, '{_sql_pattern(smells.ELISION)}')) + 3 * count(*) FILTER (regexp_matches(x, '{_sql_pattern(smells.CHAT)}')) + count(*) FILTER (regexp_matches(x, '{_sql_pattern(smells.STUB)}')) + 0.2 * count(*) FILTER (regexp_matches(x, '{smells.TODO}')) AS lo FROM l WHERE {_COM} GROUP BY file_id)"
_RAMP = "round(least(1, greatest(0, ({0} - {1}) / ({2} - {1}))) * 100, 1)"
_COMPONENTS = (
    f"{_LINES}, {_MARKS}, {_GRAPH}, "
    "lf AS (SELECT f.repo, count(*) AS long FROM (SELECT DISTINCT file_id, line, end_line FROM funcs) u JOIN files f USING (file_id) WHERE end_line - line + 1 >= 80 GROUP BY ALL), lm AS (SELECT repo, sum(lo) AS lo FROM mk JOIN files USING (file_id) GROUP BY repo),"
    " fi AS (SELECT repo, dst, count(*) AS n FROM (SELECT DISTINCT repo, src, dst FROM e) GROUP BY ALL), ft AS (SELECT repo, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, dst) AS k FROM fi), hb AS (SELECT repo, sum(n) FILTER (k <= 3) / sum(n) AS top FROM ft GROUP BY repo),"
    " g AS (SELECT repo, greatest(1, sum(loc)) AS l, sum(CASE WHEN loc >= 600 THEN loc ELSE 0 END) AS big, max(loc) AS biggest FROM file_facts GROUP BY repo),"
    " x AS (SELECT g.repo, l / 1000 AS k, big / l AS bs, biggest, coalesce(long, 0) AS long, coalesce(lo, 0) AS lo, coalesce(top, 0) AS top FROM g LEFT JOIN lf ON lf.repo = g.repo LEFT JOIN lm ON lm.repo = g.repo LEFT JOIN hb ON hb.repo = g.repo),"
    f" cp AS (SELECT repo, 'size' AS category, {_RAMP.format('bs', 0.1, 0.6)} AS score FROM x UNION ALL SELECT repo, 'size', {_RAMP.format('long / k', 0.2, 2)} FROM x UNION ALL SELECT repo, 'size', {_RAMP.format('biggest', 600, 2500)} FROM x"
    f" UNION ALL SELECT repo, 'prompt_archaeology', {_RAMP.format('lo / k', 0, 5)} FROM x UNION ALL SELECT repo, 'coupling', {_RAMP.format('top', 0.15, 0.5)} FROM x UNION ALL SELECT repo, 'coupling', NULL FROM x),"
    " ct AS (SELECT repo, category, greatest(0, coalesce(avg(score), 0)) AS score FROM cp GROUP BY repo, category)"
)


def _components(s, d):
    """Measured components of three categories: sizes, leftovers in comments, and how much leans on few files (one not measured: null)."""
    num = lambda c: F.coalesce(c, F.lit(0))
    repo_of = _t(s, d, "files").select("file_id", "repo").distinct()
    g = _t(s, d, "file_facts").groupBy("repo").agg(F.greatest(F.lit(1), F.sum("loc")).alias("l"), F.sum(F.when(F.col("loc") >= 600, F.col("loc")).otherwise(0)).alias("big"), F.max("loc").alias("biggest"))
    long = _t(s, d, "funcs").select("file_id", "line", "end_line").distinct().filter(F.col("end_line") - F.col("line") + 1 >= 80).join(repo_of, "file_id").groupBy("repo").agg(F.count(F.lit(1)).alias("long"))
    m = smells.marker_counts(X.lines_of(_t(s, d, "files"), ["repo"]), ["repo"]).select("repo", (5 * F.col("elision") + 3 * F.col("chat") + F.col("stub") + 0.2 * F.col("todo")).alias("lo"))
    hubs = graph.concentration(_lean(s, d), _nodes(s, d)).select("repo", "top_share")
    x = g.join(long, "repo", "left").join(m, "repo", "left").join(hubs, "repo", "left").withColumn("k", F.col("l") / 1000)
    part = lambda cat, v: F.struct(F.lit(cat).alias("category"), v.alias("score"))
    parts = [
        part("size", X.ramp(F.col("big") / F.col("l"), 0.1, 0.6)), part("size", X.ramp(num(F.col("long")) / F.col("k"), 0.2, 2)), part("size", X.ramp(F.col("biggest"), 600, 2500)),
        part("prompt_archaeology", X.ramp(num(F.col("lo")) / F.col("k"), 0, 5)), part("coupling", X.ramp(num(F.col("top_share")), 0.15, 0.5)), part("coupling", F.lit(None).cast("double")),
    ]
    return x.select("repo", F.explode(F.array(*parts)).alias("p")).select("repo", "p.category", "p.score", F.lit(0.0).alias("credit"))


@query(f"WITH {_COMPONENTS} SELECT repo, category, round(score, 4) AS score FROM ct")
def ramp_score_components(s, d):
    return scoring.category_scores(_components(s, d), ["repo"]).withColumn("score", F.round("score", 4))


@query(f"WITH {_COMPONENTS}, tt AS (SELECT repo, sum(score * CASE category WHEN 'size' THEN 0.15 WHEN 'prompt_archaeology' THEN 0.15 ELSE 0.2 END) AS total FROM ct GROUP BY repo) SELECT repo, round(total, 4) AS total, CASE WHEN total < 25 THEN 'handover' WHEN total < 45 THEN 'pack' WHEN total < 65 THEN 'supervised' ELSE 'stabilize' END AS tier FROM tt")
def weighted_total_tier(s, d):
    return scoring.total_score(scoring.category_scores(_components(s, d), ["repo"]), ["repo"]).select("repo", F.round("total", 4).alias("total"), "tier")


# Whole scans (rows only: parsing and iteration are not SQL; tested on constructed snapshots) --------------------------------------------------
def _scan(s, d):
    """All repositories at once, each on its own. The table holds source files only, so the engine's checks run without a project file."""
    from codestrata.plans.scan import Scan

    c = _commits(s, d).select("repo", "sha", "ord", "ts", "author", "subject", "body")
    return Scan(s, _t(s, d, "files").select("repo", "path", "text").distinct(), c, _t(s, d, "commit_files").filter(F.col("path").isNotNull()), engine=True)


@query()
def parsed_facts(s, d):
    """Counts of what the parsers find per file."""
    f = _scan(s, d).facts
    n = lambda c: F.size(c).alias(f"n_{c}")
    return f.select("repo", "path", "lang", "lines", "loc", "class_name", "generated_by", F.col("parse_error").isNotNull().alias("broken"), *[n(c) for c in ("funcs", "symbols", "refs", "imports", "calls", "dicts", "subs", "strings", "comments", "norm", "tables", "routes")])


@query()
def scan_findings(s, d):
    return _scan(s, d).findings


@query()
def scan_risk(s, d):
    return _scan(s, d).ranking.select("repo", "path", "role", "loc", "fan_in", "fan_out", "pagerank", "reach", "churn_commits", "score", "tier", "reasons")


@query()
def scan_score(s, d):
    return _scan(s, d).score()


@query()
def blast_impacted(s, d):
    r = _scan(s, d).blast("replace the save format of the market inventory")
    return s.createDataFrame([(i["path"], i["score"], i["kind"], len(i["chain"])) for i in r["impacted"]], "path string, score double, kind string, hops int")
