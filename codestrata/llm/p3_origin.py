"""Problem 3: generated, minified or vendored source files, and data saved as source.

A linear support-vector classifier reads hashed character 4-grams of the body, of the opening comment and path components. It is trained here
on weak labels: files that betray their origin (``evidence``). So that it doesn't merely learn the giveaways, every labelled file is also
shown with its opening comment masked (unless nothing else could tell), and the threshold is set on repositories that were held out.
Where the classifier is sure it decides; where it is in doubt, evidence does.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread
from codestrata.llm.lexers import unified

DIM = 1 << 16
SCHEMA = "file_id long, repo string, path string, score double, kind string, found boolean"

# Fixed patterns of generated-file notices, at the start of a comment line.
NOTICE = re.compile(
    r"^(?:@generated\b|(?:!!+\s*)?(?:this (?:file|code|module|source) (?:is|was|has been) )?(?:automatically |auto-?|machine[- ]?|tool-?)(?:generated|made|created|written|gen)\b|autogen(?:erated)?\b"
    r"|(?:this (?:file|code|module|source) (?:is|was|has been) )?(?:created|generated|produced|written|built|emitted) (?:automatically|by machine)\b|(?:code |file )?generated (?:by|with|from|using|on|at)\b"
    r"|(?:this (?:file|code|module|source) (?:is|was|has been) )(?:generated|created|produced|written) (?:by|with|from)\b|(?:please )?do not (?:edit|modify|change|touch)\b|don'?t (?:edit|modify)\b|changes made here (?:are|will be) (?:lost|overwritten)"
    r"|automatisch (?:erzeugt|generiert|erstellt)|nicht von hand|(?:fichier |code )?(?:généré|produit|créé) (?:automatiquement|par (?:un outil|machine))|ne pas modifier"
    r"|(?:archivo |código )?(?:generado|producido|creado) (?:automáticamente|automaticamente|por (?:máquina|maquina|una herramienta))|no (?:editar|modificar))",
    re.I,
)
NOT_NOTICE = re.compile(r"\bhand-?written\b|\b(?:result|output|table|file|rest) (?:is|are|was) (?:then )?generated (?:with|by)\b.*\bre-?run it after\b", re.I)
# Fixed names of places for other projects' code.
PLACES = {"vendor", "vendored", "vendors", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules", "bower_components", "external", "externals", "deps", "addons", "site-packages", "pods", "jspm_packages", "godeps", "_vendor"}
GENERATED_PLACES = {"gen", "generated", "autogen", "__generated__", "auto_generated", "codegen"}
GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.py|\.pb\.go|\.gen\.\w+|\.generated\.\w+|_generated\.\w+|\.g\.\w+|\.min\.\w+|-min\.\w+|\.bundle\.\w+)$", re.I)
#: How opening lines name the project that a file comes from; a name with a slash is a repository of the collection.
ATTRIBUTION = re.compile(
    r"(?:^|\b)(?:(?:\(c\)|copyright)(?:\s*\(c\))?\s*(?:\d{4}(?:\s*[-–,]\s*\d{4})?,?\s*)+(?:by\s+|the people of\s+|the\s+)?(?P<a>[\w.\-/]+)(?:\s+(?:authors?|developers?|contributors?|project|team|foundation))?"
    r"|(?:taken|copied|vendored|imported|borrowed|adapted) from (?:the )?(?P<b>[\w.\-/]+)|part of (?:the )?(?P<c>[\w.\-/]+)|^(?P<d>[\w.\-]+) v\d+\.\d+[\w.]*\s*\||(?:under|of) the (?P<e>[\w.\-]+) licen[cs]e)",
    re.I,
)
_COPYRIGHT = re.compile(r"(?i)(?:\(c\)|copyright)\b")
_SIGNS = re.compile(r"^(?:/\*+!?|\*+/?|//+!?|#+!?|<!--|\"\"\"|'''|;+|--+)\s*|\s*(?:\*/|-->)\s*$")
_NUMBERS = re.compile(r"^[\s\[\](){},]*(?:(?:0x[\da-f]+|-?\d+(?:\.\d+)?(?:e[+-]?\d+)?|\"[^\"\s]{24,}\"|'[^'\s]{24,}')[\s,;)\]}]*)+$", re.I)
_RECORD = re.compile(r"^[\s\[\](){},]*(?:\"[^\"\n]*\"|'[^'\n]*'|\w+)\s*:\s*[\[{](?:[^A-Za-z]|\"[^\"]*\"|'[^']*'|\b\w{1,12}\b\s*:)*[\]}][\s,;]*$")
_SHAPE_STRING, _SHAPE_NUMBER, _SHAPE_WORD = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"\d+(?:\.\d+)?"), re.compile(r"[^\W\d_]\w*(?:\s+[^\W\d_]\w*)*|_\w+")
_TABLE = bytes(ord("9") if 48 <= b < 58 else b for b in range(256))


def opening(text: str) -> list[str]:
    """All comment lines a text opens with, without comment signs; code ends them (a package clause or blank lines may precede)."""
    out, inside = [], ""
    for raw in text.split("\n"):
        s = raw.strip()
        if not s:
            continue
        if inside:
            out.append(_SIGNS.sub("", s))
            if inside in s:
                inside = ""
        elif s.startswith("/*"):
            out.append(_SIGNS.sub("", _SIGNS.sub("", s.partition("*/")[0])))
            inside = "" if "*/" in s else "*/"
        elif s.startswith(("//", "#", "--", "<!--", ";")):
            out.append(_SIGNS.sub("", s))
        else:
            break
    return out


_DOCSTRING = re.compile(r"(?:\s*#[^\n]*\n|\s)*[rRuU]?(\"\"\"|''')([\s\S]*?)(?:\1|$)")


def module_docstring(path: str, text: str) -> list[str]:
    """The lines of the docstring that opens a Python module."""
    m = _DOCSTRING.match(text) if path.endswith(".py") else None
    return [x.strip() for x in m[2].split("\n") if x.strip()] if m else []


def is_other_project(name: str, repo: str | None) -> bool:
    """Whether an attributed name is neither a repository of the collection (owner/name) nor a part of this file's own."""
    n = name.strip(".-/").lower()
    return bool(n) and "/" not in n and n not in (repo or "").lower().split("/") and not n.isdigit() and n not in ("the", "this", "a", "all", "our", "us", "me", "licence", "license", "people", "contributors", "authors")


def minified(text: str) -> bool:
    """Scripts whose statements are packed into few long lines with hardly any blanks."""
    rows = [r for r in text.split("\n") if r.strip()]
    body = [r for r in rows if not r.lstrip().startswith(("//", "/*", "*"))]
    n = sum(map(len, body))
    if n < 200:
        return False
    packed = [r for r in body if len(r) >= 200 and r.count(" ") < 0.06 * len(r) and sum(r.count(c) for c in ";{}()=,") > 0.12 * len(r)]
    return sum(map(len, packed)) > 0.6 * n


def data_share(text: str) -> float:
    """Share of the characters that stand in rows of nothing but numbers, long encoded strings or flat records."""
    rows = [r.strip() for r in text.split("\n")]
    rows = [r for r in rows if r]
    n = sum(map(len, rows))
    return sum(len(r) for r in rows if _NUMBERS.match(r) or _RECORD.match(r)) / n if n and len(rows) > 4 else 0.0


def repeated(text: str, shapes: int = 6) -> float:
    """Share of the body's rows that have one of its ``shapes`` commonest shapes (words, numbers and strings alike); 0 for short bodies."""
    rows = [_SHAPE_STRING.sub("s", r.strip()) for r in masked(text).split("\n")]
    rows = [_SHAPE_NUMBER.sub("9", _SHAPE_WORD.sub("w", r)) for r in rows if r]
    return sum(n for _, n in Counter(rows).most_common(shapes)) / len(rows) if len(rows) >= 16 else 0.0


def evidence(path: str, text: str, repo: str | None) -> str:
    """What betrays a file's origin: ``vendored``, ``generated``, ``minified``, ``data`` or nothing."""
    parts = [p.lower() for p in (path or "").split("/")]
    if PLACES & set(parts[:-1]):
        return "vendored"
    head, told = opening(text), module_docstring(path or "", text)
    for lines in (head, told):
        # a line that says the file is hand-written speaks for the notices around it
        if not any(NOT_NOTICE.search(" ".join(lines[k : k + 3])) for k in range(len(lines))) and any(NOTICE.match(x) for x in lines):
            return "generated"
    for line in [*head, *[x for x in told if _COPYRIGHT.match(x)]]:
        for m in ATTRIBUTION.finditer(line):
            if is_other_project(next(g for g in m.groups() if g is not None), repo):
                return "vendored"
    if GENERATED_PLACES & set(parts[:-1]) or GENERATED_NAME.search(parts[-1]):
        return "minified" if ".min." in parts[-1] else "generated"
    if path and path.endswith((".js", ".ts")) and minified(text):
        return "minified"
    if data_share(text) > 0.6:
        return "data"
    return "generated" if repeated(text) >= 0.9 else ""


def masked(text: str) -> str:
    """The text without its opening comment lines."""
    rows, k, inside = text.split("\n"), 0, ""
    while k < len(rows):
        s = rows[k].strip()
        if inside:
            inside = "" if inside in s else inside
        elif s.startswith("/*"):
            inside = "" if "*/" in s else "*/"
        elif s and not s.startswith(("//", "#", "--", "<!--", ";")):
            break
        k += 1
    return "\n".join(rows[k:])


def _grams(data: str, salt: int) -> np.ndarray:
    """Hashed 4-grams of the UTF-8 bytes; digits count as one character."""
    b = np.frombuffer(data.encode("utf-8", "replace").translate(_TABLE), np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.int64)
    x = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) + np.uint32(salt)
    x = x * np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    return (x & np.uint32(DIM - 1)).astype(np.int64)


def _unit(index: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    if not len(index):
        return index, np.zeros(0, np.float32)
    c = np.bincount(index, minlength=DIM)
    u = np.flatnonzero(c)
    v = np.log1p(c[u]).astype(np.float32)
    return u, v * np.float32(weight / np.sqrt((v * v).sum()))


def path_parts(path: str) -> list[str]:
    p = (path or "").lower().split("/")
    name = p[-1].split(".")
    return [f"d:{x}" for x in p[:-1]] + [f"s:{x}" for x in name[1:]] + [f"w:{x}" for x in re.split(r"[_\-]", name[0])[-1:]]


def features(path: str, text: str, show_opening: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector: body n-grams, opening-comment n-grams (with owner/name written as R/R), path components; each block of unit length."""
    body = _unit(_grams(masked(text), 0), 1.0)
    head = "\n".join(opening(text)).lower() if show_opening else ""
    head = re.sub(r"[\w.\-]+/[\w.\-]+", "R/R", head)
    top = _unit(_grams(head, 7919), 1.0)
    comps = np.array(sorted({zlib.crc32(c.encode()) & (DIM - 1) for c in path_parts(path)}), np.int64)
    place = comps, np.full(len(comps), 1.0 / max(1, len(comps)) ** 0.5, np.float32)
    idx = np.concatenate([body[0], top[0] + DIM, place[0] + 2 * DIM])
    return idx, np.concatenate([body[1], top[1], place[1]])


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 20_000, lam: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Linear SVM (hinge loss, classes weighed equally) by about ``steps`` averaged Pegasos steps; the last weight is the bias."""
    epochs = max(5, -(-steps // max(1, len(y))))
    rng = np.random.default_rng(seed)
    w, total, scale, t = np.zeros(3 * DIM + 1), np.zeros(3 * DIM + 1), 1.0, 0
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    kept = 0
    for e in range(epochs):
        for i in rng.permutation(len(y)):
            t += 1
            eta = 1 / (lam * (t + 1 / lam))
            idx, val = rows[i]
            margin = y[i] * scale * ((w[idx] * val).sum() + w[-1])
            scale *= 1 - eta * lam
            if margin < 1:
                step = eta * y[i] * weight[i] / scale
                w[idx] += step * val
                w[-1] += step * 0.3
        if e >= epochs // 2:
            total += w * scale
            kept += 1
    return total / max(1, kept)


def _learn(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row (weights, threshold, report) from the sample's features."""
    import json

    y = np.where(pdf.kind != "", 1.0, -1.0)
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(pdf.idx, pdf.val)]
    held = np.array([zlib.crc32(r.encode()) % 5 == 0 for r in pdf.repo], bool)
    shown = pdf.show.to_numpy(bool)
    if (y > 0).sum() < 4 or (y < 0).sum() < 4:
        return pd.DataFrame([(np.zeros(3 * DIM + 1, np.float32).tobytes(), -1.0, json.dumps({"trained": False}))], columns=["weights", "threshold", "report"])
    use = ~held if (y[~held] > 0).sum() > 3 and (y[held] > 0).sum() > 3 else np.ones(len(y), bool)
    w = train_svm([r for r, u in zip(rows, use) if u], y[use]).astype(np.float32)
    test = ~use if not use.all() else use
    s = np.array([(w[i] * v).sum() + w[-1] * 0.3 for i, v in rows])
    pos = np.sort(s[test & shown & (y > 0)])
    neg = s[test & shown & (y < 0)]
    threshold = float(min(0.0, pos[0] - 0.5)) if len(pos) else 0.0
    sure = float(max(0.0, neg.max() + 0.25)) if len(neg) else 0.0
    right = (s > 0) == (y > 0)
    report = {"trained": True, "rows": len(y), "held_out_accuracy": float(right[test & shown].mean()), "held_out_masked": float(right[test & ~shown].mean()), "threshold": threshold, "sure": sure}
    return pd.DataFrame([(w.tobytes(), threshold, json.dumps(report))], columns=["weights", "threshold", "report"])


def fit(files: DataFrame, sample: int = 3_000) -> tuple[np.ndarray, float, dict]:
    """(weights, threshold, report) from at most about ``sample`` files, chosen by a hash of their ids (a documented bound for the fit).

    A fifth of the repositories is held out and sets two marks. From ``sure`` on (the classifier's own boundary 0, or a quarter of a margin above the
    highest held-out file that nothing betrays) the classifier decides alone. Below ``threshold``, half a margin under the lowest held-out file that is
    betrayed, nothing is found. Between them evidence is asked for. With too few betrayed files to learn from, everything is a candidate. The sample is learnt in one task of an
    executor; only the weights (a fixed number) come to the driver.
    """
    import json

    n = files.count()
    part = files if n <= sample else files.filter(F.pmod(F.xxhash64("file_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for repo, path, text in zip(b.repo, b.path, b.text):
                u = unified(text or "")
                kind = evidence(path or "", u, repo)
                for show in (True, False):
                    if not show and kind in ("generated", "vendored") and not opening(u):
                        continue
                    if not show and kind == "vendored" and not PLACES & set((path or "").lower().split("/")[:-1]):
                        continue
                    idx, val = features(path or "", u, show)
                    out.append((repo or "", kind, show, idx.astype(np.int32).tobytes(), val.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["repo", "kind", "show", "idx", "val"])

    got = part.select("repo", "path", "text").mapInPandas(read, "repo string, kind string, show boolean, idx binary, val binary")
    row = got.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_learn, "weights binary, threshold double, report string").first()
    if row is None:
        return np.zeros(3 * DIM + 1, np.float32), -1.0, {"trained": False}
    return np.frombuffer(bytes(row["weights"]), np.float32), row["threshold"], json.loads(row["report"])


def origins(files: DataFrame, sample: int = 3_000) -> DataFrame:
    """(file_id, repo, path, score, kind, found): one row per file (file_id, repo, path, text).

    ``found``: the classifier is sure, or it is in doubt and there is evidence (see ``fit``). ``kind``: the evidence, ``learned`` without any. Null
    and empty texts have no body: only their place can speak. Exact duplicate rows give one row.
    """
    src = spread(files.select("file_id", "repo", "path", "text"))
    w, threshold, report = fit(src, sample)
    sure = report.get("sure", 0.0)
    held = files.sparkSession.sparkContext.broadcast(w.astype("float32"))
    trained = bool(w.any())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = held.value
        for b in batches:
            out = []
            for i, repo, path, text in zip(b.file_id, b.repo, b.path, b.text):
                u = unified(text or "")
                idx, val = features(path or "", u, True)
                part = weights[idx] * val
                bias = float(weights[-1]) * 0.3
                score = float(part.sum()) + bias
                kind = ""
                if score > threshold or not trained:
                    kind = evidence(path or "", u, repo)
                if not kind and trained and score >= sure:
                    kind = "learned"
                out.append((i, repo, path, score, kind, kind != ""))
            yield pd.DataFrame(out, columns=["file_id", "repo", "path", "score", "kind", "found"])

    return src.mapInPandas(run, SCHEMA).distinct()
