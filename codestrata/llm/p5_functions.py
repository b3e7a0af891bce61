"""Problem 5: functions paired with their documentation.

Files are parsed into trees (``outline``); for each function node the comment block directly above it (or above its decorators) and the
docstring that opens its body are taken, cleaned and judged. Rows of the function table are matched to nodes by line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.lexers import unified
from codestrata.llm.outline import comment_above, functions, outline
from codestrata.llm.p6_syntax import language_of

# Fixed word lists and patterns of what is no description.
GENERAL_WORDS = set(
    "a an and are args argument arguments as at be by call called calls class code do does doc docs documentation for from function functions given helper here in input "
    "instance into is it its item method methods name named none object of on one or output param parameter parameters params private procedure public returned returning "
    "returns return result results routine self some something static stuff that the their then these this to type use used uses using utility value values void which with".split()
)
DIRECTIVE = re.compile(
    r"^(?:@?(?:noqa|nosec|nolint|eslint|tslint|jshint|jslint|prettier|istanbul|pylint|flake8|mypy|pyright|ruff|isort|gdlint|gdformat|warning-ignore|codespell|sonar|nosonar|c8|v8)\b"
    r"|pragma\b|type: ?ignore|fmt: ?(?:on|off|skip)|go:\w+|\+build|@ts-\w+|ts-\w+|lint:|coverage:|noinspection\b|@warning_ignore|region\b|endregion\b|-\*-)",
    re.I,
)
STAMP = re.compile(
    r"^(?:@?(?:author|authors|since|date|version|copyright|maintainer|last[ -]modified|last[ -]updated|modified|updated|changed|created|written)\b\s*(?:[:=]|(?:on|by|at|in)\b|[\d@(<]).*"
    r"|@(?:author|since|date|version)\b.*|\W*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\W*)$",
    re.I,
)
PLACEHOLDER = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|tbd|hack|wip|tba|n/?a)\b.*|\.{2,}|\W*(?:description|summary|docstring|documentation|comment)\W*"
    r"|(?:please )?(?:add|insert|write|put|enter|fill in)\b.*\b(?:description|summary|documentation|docs?|docstring|comment|text)\b.*"
    r"|(?:a |the )?(?:description|summary|documentation|docs?|comment|text)\b.*\b(?:goes here|pending|missing|to follow|to come|here|to be (?:done|written|added))\W*"
    r"|(?:missing|no) (?:description|documentation|docs?|docstring|summary|comment)\b.*|(?:see|same as) (?:above|below)\W*|not documented(?: yet)?\W*|undocumented\W*|lorem ipsum.*|to be (?:documented|written|done)\W*"
    r"|document (?:me|this)\W*)$",
    re.I,
)
TAG = re.compile(
    r"^(?:[@\\](?:param|arg|argument|return|returns|throws|raises|exception|type|rtype|yield|yields)\b|:(?:param|arg|type|return|returns|rtype|raises|raise|throws|yields)\b)\s*(?P<rest>.*)$", re.I
)
SECTION = re.compile(r"^(?:args|arguments|parameters|params|returns?|raises|yields|throws|keyword args|attributes|example|examples|note|notes)\s*:?\s*$", re.I)
CODE = re.compile(
    r"^(?:[\w.\[\]'\"]+\s*(?:[-+*/|&]?=|:=)(?!=)\s*\S.*|(?:await\s+)?[\w.$]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?\s*[{:]?|(?:return|var|let|const|if|for|while|func|def|elif|import|from|await|print)\b.*[;:{})\d\]\"'].*|.*[;{}]|return\s+[\w.]+|(?:else|try|finally|pass|break|continue)\s*:?)$"
)
_PIECES = re.compile(r"[A-ZÀ-ÖØ-Þ]?[^\W\d_A-ZÀ-ÖØ-Þ]+|[A-ZÀ-ÖØ-Þ]+(?![^\W\d_A-ZÀ-ÖØ-Þ])|[^\W\d_]+")
_WORDS = re.compile(r"[^\W_](?:[\w'’]*[^\W_])?")


def pieces(name: str) -> list[str]:
    """Lower-case words of an identifier."""
    return [p.lower() for p in _PIECES.findall(name)]


def bare(word: str) -> set[str]:
    """A word and what it may be inflected from."""
    out = {word}
    for end, instead in (("s", ""), ("es", ""), ("ies", "y"), ("ed", ""), ("ed", "e"), ("d", ""), ("ing", ""), ("ing", "e")):
        if word.endswith(end) and len(word) > len(end) + 1:
            out.add(word[: -len(end)] + instead)
    return out


def description(raw: str | None, params: list[str] = ()) -> str:
    """The describing text of a raw comment or docstring: without comment signs, empty tags, directives, stamps, rulers, placeholders, code."""
    kept = []
    for line in (raw or "").split("\n"):
        s = line.strip()
        s = re.sub(r"^/\*+!?|\*+/$", "", s).strip()
        s = re.sub(r"^(?:\*(?!\*)|///?|##?|//!)\s?", "", s).strip()
        if not any(c.isalpha() for c in s):
            continue
        tag = TAG.match(s)
        if tag:
            rest = re.sub(r"^\{[^}]*\}\s*", "", tag["rest"]).strip()
            if s.split()[0].lstrip("@\\:").rstrip(":").lower() not in ("return", "returns", "rtype", "yield", "yields"):
                rest = re.sub(r"^\[?[\w.$]+\]?(?:=\S+)?\s*:?\s*-?\s*", "", rest, count=1)
            s = rest.lstrip(":- ").strip()
            if not any(c.isalpha() for c in s):
                continue
        elif SECTION.match(s):
            continue
        else:
            named = re.match(r"^(\w+)\s*(?:\([^)]*\))?\s*:\s*(.*)$", s)
            if named and named[1] in params:
                s = named[2].strip()
                if not any(c.isalpha() for c in s):
                    continue
        if DIRECTIVE.match(s) or STAMP.match(s) or PLACEHOLDER.match(s) or CODE.match(s):
            continue
        kept.append(s)
    return " ".join(kept)


def is_real(text: str, name: str, params: list[str]) -> bool:
    """Whether a cleaned description says more than the function's name and parameters: four words at least, one of them new."""
    if PLACEHOLDER.match(text):
        return False
    words = _WORDS.findall(text)
    if len(words) < 4:
        return False
    known = {w for x in (name, *params) for p in pieces(x) for w in bare(p)} | GENERAL_WORDS
    for w in words:
        parts = pieces(w) or [w.lower()]
        for p in parts:
            if not p.isdigit() and not (bare(p) & known):
                return True
    return False


def param_names(text: str) -> list[str]:
    """Names in a parameter list (of any of the languages): the first word of each part at depth 0."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text + ","):
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        elif c == "," and depth <= 0:
            m = re.search(r"[^\W\d]\w*", text[start:k])
            if m:
                out.append(m[0])
            start = k + 1
    return out


def pairs_of(path: str, text: str, wanted: list[tuple[int, int, str, list[str]]]) -> list[tuple[int, str, str, str, bool]]:
    """(line, code, description, origin, real) for wanted functions (line, end_line, name, params) of a file.

    A wanted function without a node at its line (damaged text) gets the range its row gives.
    """
    language = language_of(path)
    u = unified(text)
    lines = u.split("\n")
    if language is None:
        return [(ln, "", "", "", False) for ln, *_ in wanted]
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    by_line = {}
    from bisect import bisect_right

    for _, f in functions(outline(language, u)):
        by_line.setdefault(bisect_right(starts, f.start), f)
    out = []
    for line, end_line, name, params in wanted:
        if not 1 <= line <= len(lines):
            out.append((line, "", "", "", False))
            continue
        node = by_line.get(line)
        names = list(params) + (param_names(node.params) if node else [])
        code = u[node.start : node.end] if node else "\n".join(lines[line - 1 : max(line, end_line or line)])
        choices = []
        if node and node.doc is not None:
            choices.append(("docstring", node.doc))
        choices.append(("comment", comment_above(lines, line - 1, language)))
        best = ("", "", False)
        for origin, raw in choices:
            d = description(raw, names)
            real = is_real(d, name or "", names)
            if real or (d and not best[0]):
                best = (d, origin, real)
            if real:
                break
        out.append((line, code, *best))
    return out


def documented(funcs: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, path, func_name, line, params, code, description, origin, real), one row per function (file_id, line) of ``funcs``.

    Functions whose file is missing or has no text are left out; null names count as empty. A file's functions meet its text in one row (a
    file is read once and holds them all), so nothing is collected beyond one text.
    """
    f = funcs.filter(F.col("file_id").isNotNull() & F.col("line").isNotNull())
    packed = f.groupBy("file_id").agg(
        F.array_sort(F.collect_set(F.struct("line", F.coalesce("end_line", "line").alias("end_line"), F.coalesce("func_name", F.lit("")).alias("func_name"), F.coalesce("params", F.array().cast("array<string>")).alias("params")))).alias("fs")
    )
    j = files.filter(F.col("text").isNotNull()).select("file_id", "path", "text").join(packed, "file_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, path, text, fs in zip(b.file_id, b.path, b.text, b.fs):
                wanted = [(x["line"], x["end_line"], x["func_name"], [p for p in x["params"] if p]) for x in fs]
                for w, (line, code, d, origin, real) in zip(wanted, pairs_of(path, text, wanted)):
                    rows.append((i, path, w[2], line, w[3], code, d, origin, real))
            yield pd.DataFrame(rows, columns=["file_id", "path", "func_name", "line", "params", "code", "description", "origin", "real"])

    return j.mapInPandas(run, "file_id long, path string, func_name string, line int, params array<string>, code string, description string, origin string, real boolean")
