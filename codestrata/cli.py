"""Command line: scan, blast, check, timeline and backtest of a local repository or folder.

    python -m codestrata.cli scan REPO [--ref REF] [--out DIR] [--ask "request" ...]
    python -m codestrata.cli blast REPO "request" [--ref REF] [--seed PATH ...] [--json]
    python -m codestrata.cli check REPO [--ref REF] [--fail-on high|medium|low]
    python -m codestrata.cli timeline REPO [--ref REF] [--out FILE]
    python -m codestrata.cli backtest REPO [--ref REF] [--out FILE]
"""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import tempfile

from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.plans import impact
from codestrata.plans.scan import Scan, scored_timeline
from codestrata.session import session
from codestrata.sources import snapshot


def slug(text: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", "-", text.lower()).strip("-")[:60] or "request"


def is_git(root: str) -> bool:
    return subprocess.run(["git", "-C", root, "rev-parse", "--git-dir"], capture_output=True).returncode == 0


def load(spark, root: str, ref: str) -> tuple[Scan, dict]:
    """The scan of a repository at a commit with its log up to there, or of a plain folder."""
    if not is_git(root):
        files, skipped = snapshot.directory(spark, os.path.abspath(root))
        return Scan(spark, files, assets=skipped.select("path")), {"sha": None, "subject": "", "branch": ""}
    about = snapshot.ref_info(root, ref)
    files, skipped, sha = snapshot.at_ref(spark, root, ref)
    log = snapshot.write_log(root, os.path.join(tempfile.mkdtemp(prefix="codestrata-log-"), "log.txt"), sha)
    commits, touched, renames = snapshot.read_log(spark, log, "-")
    return Scan(spark, files, commits, touched, assets=skipped.select("repo", "path"), renames=renames), about


def result(scan: Scan, about: dict) -> dict:
    """Everything a scan has to say about one repository, assembled from ranked and summed results."""
    rows = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]
    folders, between = scan.architecture()
    total = scan.total().first()
    m = scan.metrics
    out = {
        "repo": about, "stats": rows(m.groupBy("role", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))), "score": total.asDict() if total else None, "components": rows(scan.score()),
        "findings": rows(scan.findings_with_evidence()), "risk": rows(scan.ranking.select("path", F.round("score", 1).alias("score"), "tier", "signals", "reasons", "doc").orderBy(F.desc("score"), "path")),
        "secret_controllers": rows(scan.secret_controllers.select("path", "loc", "fan_in").orderBy(F.desc("fan_in"), "loc", "path")), "folders": rows(folders.orderBy("dir")), "between": rows(between.orderBy(F.desc("n"), "src_dir", "dst_dir")),
        "tables": rows(scan.tables.groupBy("table_id", "access", "open").agg(F.count(F.lit(1)).alias("keys")).join(scan.sends.groupBy("table_id").agg(F.count(F.lit(1)).alias("sends"), F.count_distinct("file").alias("senders")), "table_id").orderBy("table_id")),
        "signals": rows(scan.signals.drop("repo").orderBy("path", "line")), "invariants": rows(scan.invariants.drop("repo").orderBy("path", "line")), "prompts": rows(scan.prompts.drop("repo").orderBy("doc", "line")),
        "agent_docs": rows(scan.docs.filter("part = 'doc' and weight >= 3").select("doc", F.col("size").alias("lines")).orderBy("doc")),
    }
    if scan.commits is not None:
        from codestrata.operators.history import ai_author

        code = scan.touched.select("sha").distinct().withColumn("code", F.lit(True))
        c = scan.commits.withColumns({"agent": ai_author(F.col("body")), "fix": F.col("subject").rlike(X.FIX_SUBJECT)}).join(code, "sha", "left")
        out["history"] = rows(c.agg(F.count(F.lit(1)).alias("commits"), F.count("agent").alias("by_agents"), F.count_if("fix").alias("fixes"), F.count_if(F.col("code").isNull()).alias("without_code"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))[0]
        out["agents"] = rows(c.filter("agent is not null").groupBy("agent").agg(F.count(F.lit(1)).alias("commits")).orderBy(F.desc("commits"), "agent"))
    return out


def context(r: dict, findings: int = 30, risky: int = 15, folders: int = 30) -> str:
    """The facts of a result as text, for a reviewer: the worst findings with their lines, the riskiest files, folder references, routing tables."""
    lines = [f"# {r['repo'].get('branch') or 'folder'} {str(r['repo'].get('sha') or '')[:7]}: {r['repo'].get('subject', '')}", ""]
    lines += ["Files: " + ", ".join(f"{s['files']} {s.get('lang')} ({s['role']}, {s.get('loc', 0)} lines)" for s in r["stats"])]
    if "history" in r:
        h = r["history"]
        lines += [f"History: {h['commits']} commits, {h['by_agents']} by agents ({', '.join(a['agent'] + ' ' + str(a['commits']) for a in r['agents']) or 'none'}), {h['without_code']} without code."]
    if r["score"]:
        lines += ["", f"## Score {r['score']['total']:.1f} ({r['score']['tier']})", *[f"- {c['category']}: {c['component']} = {c.get('value')} -> {c.get('score')}" for c in r["components"]]]
    lines += ["", "## Findings", *[f"- [{f['severity']}] {f['title']} ({f['path']}:{f.get('line')}) `{(f.get('evidence') or '').strip()}`" for f in r["findings"][:findings]]]
    lines += ["", "## Riskiest files", *[f"- {x['path']} {x['score']} [{x['tier']}]: {'; '.join(x['reasons'])}" + (f" -- {x['doc']}" if x.get("doc") else "") for x in r["risk"][:risky]]]
    lines += ["", "## Short files that much depends on", *[f"- {x['path']}: {x['loc']} lines, {x['fan_in']} dependants" for x in r["secret_controllers"]]]
    lines += ["", "## References between folders", *[f"- {x['src_dir'] or '.'} -> {x['dst_dir'] or '.'} ({x['n']})" for x in r["between"][:folders]]]
    lines += ["", "## Routing tables", *[f"- {t['table_id']}: {t['keys']} keys, {t['sends']} sends from {t['senders']} files, {t['access']}{', open' if t['open'] else ''}" for t in r["tables"]]]
    lines += ["", "## Instructions for agents", *[f"- {d['doc']} ({d['lines']} lines)" for d in r["agent_docs"]]]
    return "\n".join(lines) + "\n"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codestrata")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name, out in (("scan", "codestrata-out"), ("blast", None), ("check", None), ("timeline", "timeline.json"), ("backtest", "backtest.json")):
        s = sub.add_parser(name)
        s.add_argument("repo")
        if name == "blast":
            s.add_argument("request")
            s.add_argument("--seed", action="append")
            s.add_argument("--json", action="store_true")
        s.add_argument("--ref", default="HEAD")
        if out:
            s.add_argument("--out", default=out)
        if name == "scan":
            s.add_argument("--ask", action="append", default=[])
        if name == "check":
            s.add_argument("--fail-on", default="high", choices=["high", "medium", "low"])
    a = p.parse_args(argv)
    spark = session("codestrata")
    scan, about = load(spark, a.repo, a.ref)
    if a.cmd == "check":
        return scan.check(a.fail_on)
    if a.cmd == "blast":
        b = scan.blast(a.request, a.seed)
        print(json.dumps({k: v for k, v in b.items() if k != "pack"}, indent=1) if a.json else b["pack"])
        return 0
    if a.cmd == "backtest":
        rows = [r.asDict() for r in impact.backtest(scan).orderBy("method").collect()]
    elif a.cmd == "timeline":
        versions = None
        for sha in [r["sha"] for r in scan.commits.orderBy("ord").select("sha").collect()]:
            f = snapshot.at_ref(spark, a.repo, sha)[0].withColumn("sha", F.lit(sha))
            versions = f if versions is None else versions.unionByName(f)
        t = scored_timeline(spark, versions, scan.commits, scan.commit_files)
        rows = [r.asDict() for r in t.join(scan.commits.select("sha", "ord", "ts", "subject"), "sha").orderBy("ord").collect()]
    else:
        r = result(scan, about)
        os.makedirs(os.path.join(a.out, "briefs"), exist_ok=True)
        r["requests"] = [scan.blast(x) for x in a.ask]
        for b in r["requests"]:
            with open(os.path.join(a.out, "briefs", slug(b["request"]) + ".md"), "w", encoding="utf-8") as f:
                f.write(b["pack"])
        for name, data in (("context.md", context(r)), ("result.json", json.dumps(r, indent=1, default=str))):
            with open(os.path.join(a.out, name), "w", encoding="utf-8") as f:
                f.write(data)
        print(f"{r['score']['total']:.1f} ({r['score']['tier']}), {len(r['findings'])} findings: {a.out}" if r["score"] else a.out)
        return 0
    with open(a.out, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=1, default=str)
    for row in rows:
        print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
