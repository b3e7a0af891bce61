"""Syntax trees of source files, down to functions: classes and functions with exact ranges, parameters, decorators and documentation.

Python is read with the interpreter's parser. For the other languages, and for damaged Python, the scanner reads only what shapes the tree (strings, comments, brackets, line starts, declaring words) and jumps over the rest. It is
tolerant: a damaged file yields the nodes before and, as far as brackets allow, after the damage.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Node:
    kind: str  # "function" or "class"
    name: str
    start: int  # place of the signature
    end: int  # place after the last character
    body: int  # place where the body begins
    params: str = ""  # text between the signature's brackets
    doc: str | None = None  # docstring that opens the body
    children: list["Node"] = field(default_factory=list)


_STR = r"""(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*(?:\"\"\"|$)|'''(?:[^'\\]|\\[\s\S]|'(?!''))*(?:'''|$)|"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|$)|'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|$))"""
_INDENTED = re.compile(r"(?P<S>" + _STR + r")|(?P<C>#[^\n]*)|(?P<F>\b(?:def|func|class)\b[ \t]+(?P<N>[^\W\d]\w*))|(?P<O>[(\[{])|(?P<E>[)\]}])")
_BRACED = re.compile(
    r"""(?P<S>"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|$)|'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|$)|`(?:[^`\\]|\\[\s\S])*(?:`|$))|(?P<C>//[^\n]*|/\*[\s\S]*?(?:\*/|$))"""
    r"|(?P<R>(?:(?<=[=(,:\[!&|?{};>\n])|(?<=\breturn))[ \t]*/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[\w$]*)"
    r"|(?P<K>\bclass\b[ \t]+(?P<KN>[^\W\d][\w$]*))|(?P<F>\bfunction\b[ \t]*\*?[ \t]*(?P<FN>(?:[^\W\d]|\$)[\w$]*))"
    r"|(?P<G>\bfunc\b[ \t]*(?:\([^()\n]*\)[ \t]*)?(?P<GN>[^\W\d]\w*)[ \t]*(?=[(\[]))"
    r"|(?P<V>\b(?:const|let|var)[ \t]+(?P<VN>(?:[^\W\d]|\$)[\w$]*)[^=\n;{}]*=[ \t]*(?:async[ \t]*)?(?=\(|function\b|(?:[^\W\d]|\$)[\w$]*[ \t]*=>|<))"
    r"|(?P<O>[(\[{])|(?P<E>[)\]}])"
)
_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)[ \t]+)*\*?[ \t]*(?P<N>\#?(?:[^\W\d]|\$)[\w$]*)[ \t]*(?:<[^<>\n]*>)?[ \t]*\Z")
_NOT_METHOD = {"if", "for", "while", "switch", "catch", "return", "function", "with"}


def outline(language: str, text: str) -> list[Node]:
    """The module's nodes in order; functions and classes nest as in the source. ``text`` has ``\\n`` line ends. Python that parses is read from its
    syntax tree, everything else by the tolerant scanner."""
    if language == "python":
        tree = _python(text)
        if tree is not None:
            return tree
    return _indented(text, language) if language in ("python", "gdscript") else _braced(text, language)


def _python(text: str) -> list[Node] | None:
    """The nodes of a Python module from its abstract syntax tree; None if it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)

    def place(line: int, column: int) -> int:
        """Character place of a line (from 1) and a column in UTF-8 bytes."""
        row = lines[line - 1]
        return starts[line - 1] + (column if row.isascii() else len(row.encode()[:column].decode("utf-8", "ignore")))

    def node(n: ast.AST) -> Node:
        a, z, first = place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset), n.body[0]
        is_class = isinstance(n, ast.ClassDef)
        args = "" if is_class else ast.unparse(n.args)
        return Node("class" if is_class else "function", n.name, a, z, place(first.lineno, first.col_offset), args, None if is_class else ast.get_docstring(n, clean=False), below(n))

    def below(n: ast.AST) -> list[Node]:
        out = []
        for c in ast.iter_child_nodes(n):
            out += [node(c)] if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else below(c)
        return out

    return below(tree)


def functions(nodes: list[Node], owner: str = "") -> list[tuple[str, Node]]:
    """(enclosing class, function) of all function nodes, outer before inner."""
    out = []
    for n in nodes:
        if n.kind == "function":
            out.append((owner, n))
        out += functions(n.children, n.name if n.kind == "class" else owner)
    return out


def _nest(flat: list[Node]) -> list[Node]:
    top: list[Node] = []
    open_: list[Node] = []
    for n in sorted(flat, key=lambda n: (n.start, -n.end)):
        while open_ and open_[-1].end <= n.start:
            open_.pop()
        (open_[-1].children if open_ else top).append(n)
        open_.append(n)
    return top


def _close(text: str, tokens: list[tuple[str, int, int]], k: int) -> int:
    """Number of the token that closes the bracket opened by token k; the last one if none does."""
    depth = 0
    for j in range(k, len(tokens)):
        kind = tokens[j][0]
        depth += (kind == "O") - (kind == "E")
        if depth == 0:
            return j
    return len(tokens) - 1


def _indented(text: str, language: str) -> list[Node]:
    tokens = [(m.lastgroup if m.lastgroup != "N" else "F", m.start(), m.end(), m["N"]) for m in _INDENTED.finditer(text)]
    flat = []
    n = len(text)
    for k, (kind, a, b, name) in enumerate(tokens):
        if kind != "F":
            continue
        line = text.rfind("\n", 0, a) + 1
        lead = text[line:a]
        if lead.strip() and lead.split()[-1] not in ("async", "static"):
            continue  # a lambda or a word inside other code
        is_class = text[a] == "c"
        j = k + 1
        params, body = "", b
        if j < len(tokens) and tokens[j][0] == "O" and not text[b : tokens[j][1]].strip():
            e = _close(text, tokens, j)
            params, body = text[tokens[j][1] + 1 : tokens[e][1]], tokens[e][2]
        # the colon of the signature: the first one outside strings and brackets
        colon, eol, k2 = -1, -1, bisect_right(tokens, body - 1, key=lambda t: t[1])
        at_ = body
        while colon < 0 and eol < 0:
            nxt = tokens[k2] if k2 < len(tokens) else ("", n, n, None)
            c, e = text.find(":", at_, nxt[1]), text.find("\n", at_, nxt[1])
            if c >= 0 and (e < 0 or c < e):
                colon = c
            elif e >= 0:
                eol = e
            elif k2 >= len(tokens):
                break
            else:
                if nxt[0] == "O":
                    k2 = _close(text, tokens, k2)
                at_, k2 = tokens[k2][2], k2 + 1
        eol = text.find("\n", max(body, colon))
        eol = n if eol < 0 else eol
        body = colon + 1 if 0 <= colon < eol else eol
        width = len(lead) - len(lead.lstrip(" \t"))
        end = eol
        pos = eol + 1
        while pos <= n - 1:
            e = text.find("\n", pos)
            e = n if e < 0 else e
            row = text[pos:e]
            s = row.lstrip(" \t")
            if s:
                if len(row) - len(s) <= width and not _inside(tokens, pos):
                    if s[0] != "#":
                        break
                else:
                    end = e
            pos = e + 1
        doc = None
        if not is_class:
            m = re.compile(r"(?:\s|#[^\n]*\n)*([rRuUbB]{0,2})(" + _STR + ")").match(text, body)
            if m and m.end() <= end + 1:
                doc = _unquote(m[2])
        flat.append(Node("class" if is_class else "function", name, line + len(lead) - len(lead.lstrip(" \t")), end, body, params, doc))
    return _nest(flat)


def _inside(tokens: list[tuple], pos: int) -> bool:
    """Whether a string that began before ``pos`` goes on there."""
    k = bisect_right(tokens, pos, key=lambda t: t[1]) - 1
    return k >= 0 and tokens[k][0] == "S" and tokens[k][2] > pos


def _unquote(s: str) -> str:
    q = s[:3] if s[:3] in ('"""', "'''") else s[:1]
    return s[len(q) : -len(q)] if len(s) >= 2 * len(q) and s.endswith(q) else s[len(q) :]


def _braced(text: str, language: str) -> list[Node]:
    tokens = [(m.lastgroup, m.start(), m.end(), m) for m in _BRACED.finditer(text)]
    names = {"KN": "K", "FN": "F", "GN": "G", "VN": "V"}
    tokens = [(names.get(kind, kind), a, b, m) for kind, a, b, m in tokens]
    flat: list[Node] = []
    n = len(text)
    close: dict[int, int] = {}
    stack: list[int] = []
    for k, t in enumerate(tokens):
        if t[0] == "O":
            stack.append(k)
        elif t[0] == "E" and stack:
            close[stack.pop()] = k

    def end_of(k: int) -> int:
        return tokens[close[k]][2] if k in close else n

    def function(k: int, name: str, start: int) -> None:
        """The function whose signature's tokens begin at k."""
        j = k
        while j < len(tokens) and not (tokens[j][0] == "O" and text[tokens[j][1]] == "("):
            if tokens[j][0] == "O" and text[tokens[j][1]] == "{" or tokens[j][0] == "E":
                return
            j = close.get(j, j) + 1
        if j >= len(tokens):
            return
        e = close.get(j, len(tokens) - 1)
        params = text[tokens[j][1] + 1 : tokens[e][1]]
        b = e + 1
        eol = text.find("\n", tokens[e][2])
        eol = n if eol < 0 else eol
        while b < len(tokens) and tokens[b][1] <= eol and not (tokens[b][0] == "O" and text[tokens[b][1]] == "{"):
            if tokens[b][0] == "E":
                b = len(tokens)
                break
            b = close.get(b, b) + 1 if tokens[b][0] == "O" else b + 1
        if b < len(tokens) and tokens[b][0] == "O" and text[tokens[b][1]] == "{" and tokens[b][1] <= eol:
            flat.append(Node("function", name, start, end_of(b), tokens[b][2], params))
        else:
            flat.append(Node("function", name, start, eol, tokens[e][2], params))

    def line_start(a: int) -> int:
        s = text.rfind("\n", 0, a) + 1
        while s < a and text[s] in " \t":
            s += 1
        return s

    for k, (kind, a, b, m) in enumerate(tokens):
        if kind == "K" and language != "go":
            j = k + 1
            while j < len(tokens) and text[tokens[j][1]] != "{":
                j += 1
            if j >= len(tokens):
                continue
            flat.append(Node("class", m["KN"], line_start(a), end_of(j), tokens[j][2]))
            i, last = j + 1, close.get(j, len(tokens))
            while i < last:
                if tokens[i][0] == "O":
                    if text[tokens[i][1]] == "(":
                        s = line_start(tokens[i][1])
                        w = _METHOD.match(text[s : tokens[i][1]])
                        if w and w["N"] not in _NOT_METHOD:
                            function(i, w["N"], s)
                    i = close.get(i, last)
                i += 1
        elif kind == "F" and language != "go":
            function(k + 1, m["FN"], line_start(a))
        elif kind == "G" and language == "go":
            function(k + 1, m["GN"], line_start(a))
        elif kind == "V" and language != "go":
            function(k + 1, m["VN"], line_start(a))
    return _nest(flat)


def comment_above(lines: list[str], row: int, language: str) -> str:
    """The comment block that ends directly above line ``row`` (0-based) or above the decorators there; without it an empty string."""
    i = row - 1
    while i >= 0 and lines[i].lstrip().startswith("@"):
        i -= 1
    block: list[str] = []
    if language in ("python", "gdscript"):
        while i >= 0 and lines[i].lstrip().startswith("#"):
            block.append(lines[i].lstrip().lstrip("#"))
            i -= 1
    elif i >= 0 and lines[i].rstrip().endswith("*/"):
        while i >= 0:
            s = lines[i].strip()
            block.append(s)
            if "/*" in s:
                if not s.startswith("/*"):
                    return ""  # the rest of a code line
                break
            i -= 1
    else:
        while i >= 0 and lines[i].lstrip().startswith("//"):
            block.append(lines[i].lstrip().lstrip("/"))
            i -= 1
    return "\n".join(reversed(block))
