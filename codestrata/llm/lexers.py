"""Token streams of Python, GDScript, JavaScript, TypeScript and Go for the derivative parser.

``lex(language, text)`` gives (token classes, their places in the text); a class is the token's own text if the grammar names it, otherwise a
class in capitals. What no rule matches becomes ERR, which no grammar accepts. The text must have ``\\n`` line ends (see ``unified``).
"""

from __future__ import annotations

import re
from functools import lru_cache

from codestrata.llm import grammars
from codestrata.llm.derivative import OPTIONAL, Grammar

#: Language by file extension.
LANGUAGES = {"py": "python", "gd": "gdscript", "js": "javascript", "ts": "typescript", "go": "go"}

_TEXTS = {"python": grammars.PYTHON, "gdscript": grammars.GDSCRIPT, "javascript": grammars.JAVASCRIPT, "typescript": grammars.TYPESCRIPT, "go": grammars.GO}


@lru_cache(None)
def grammar(language: str) -> Grammar:
    return Grammar(_TEXTS[language], "file")


def unified(text: str) -> str:
    """The text with ``\\n`` line ends and without a byte order mark."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text[1:] if text[:1] == "﻿" else text


_LONG = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
_LINE = r"(?P<LINE>(?:#[^\n]*)?\n(?:[ \t\f]*(?:#[^\n]*)?\n)*[ \t\f]*)"

_PYTHON = re.compile(
    r"(?:[ \t\f]|\\\n)*(?:" + _LINE + r"|(?P<COMMENT>#[^\n]*)"
    r"|(?P<STRING>(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:" + _LONG + r""")|(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:"(?!"")(?:[^"\\\n]|\\[\s\S])*"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'))"""
    r"|(?P<NAME>[^\W\d]\w*)|(?P<NUMBER>" + _NUMBER + r"[jJ]?(?!\w))"
    r"|(?P<OP>\.\.\.|\*\*=|//=|>>=|<<=|->|:=|[-+*/%@&|^]=|\*\*|//|<<|>>|[<>=!]=|[-+*/%@&|^~<>()\[\]{},:.;=])|(?P<ERR>[^ \t\f\n]|\\))"
)
_GDSCRIPT = re.compile(
    r"(?:[ \t\f]|\\\n)*(?:" + _LINE + r"|(?P<COMMENT>#[^\n]*)"
    r"|(?P<STRING>r?(?:" + _LONG + r""")|r?(?:"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\]|\\[\s\S])*'))"""
    r"""|(?P<NODE>\$(?:"[^"\n]*"|'[^'\n]*'|%?[^\W\d]\w*(?:/[\w%.]+)*|\.\.?(?:/[\w%.]+)*|/[\w%.]+(?:/[\w%.]+)*))"""
    r"|(?P<NAME>[^\W\d]\w*)|(?P<NUMBER>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?!\w))"
    r"|(?P<OP>\.\.\.|\.\.|\*\*=|<<=|>>=|->|[-+*/%&|^]=|\*\*|<<|>>|&&|\|\||[<>=!]=|[-+*/%&|^~<>()\[\]{},:.;=!@])|(?P<ERR>[^ \t\f\n]|\\))"
)
_SCRIPT = re.compile(
    r"[ \t\f\v\xa0﻿  ]*(?:(?P<LINE>\n\s*)|(?P<COMMENT>//[^\n]*|/\*[\s\S]*?\*/)"
    r"""|(?P<STRING>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<NAME>(?:[^\W\d]|[$])[\w$‌‍]*)|(?P<PRIVATE>\#[^\W\d][\w$]*)"""
    r"|(?P<NUMBER>(?:0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)(?![\w$]))"
    r"|(?P<TICK>`)"
    r"|(?P<OP>\.\.\.|=>|\*\*=|<<=|&&=|\|\|=|\?\?=|===|!==|\?\.(?!\d)|\?\?|\*\*|<<|&&|\|\||\+\+|--|[-+*/%&|^]=|[<>=!]=|[-+*/%&|^~<>()\[\]{},:.;=!?@])|(?P<ERR>\S))"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[\w$]*")
_GO = re.compile(
    r"[ \t\f\v]*(?:(?P<LINE>\n\s*)|(?P<COMMENT>//[^\n]*|/\*[\s\S]*?\*/)"
    r"""|(?P<STRING>"(?:[^"\\\n]|\\[^\n])*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}))')"""
    r"|(?P<NAME>[^\W\d]\w*)|(?P<NUMBER>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))"
    r"|(?P<OP>\.\.\.|<<=|>>=|&\^=|&\^|:=|<-|\+\+|--|&&|\|\||<<|>>|[-+*/%&|^]=|[<>=!]=|[-+*/%&|^~<>()\[\]{},:.;=!])|(?P<ERR>\S))"
)

_AUGMENTED = {o + "=" for o in ("+", "-", "*", "/", "//", "%", "@", "&", "|", "^", ">>", "<<", "**", "&^", "&&", "||", "??")}


@lru_cache(None)
def _classes(language: str) -> tuple[dict[str, str], str]:
    """Operator classes, and the name of the class of compound assignments."""
    known = grammar(language).literals
    ops = "... .. ** // << >> && || ?? === !== == != <= >= < > - + * / % @ & | ^ ~ ( ) [ ] { } , : . ; = ! ? => -> := <- ++ -- ?. &^".split()
    out = {o: o if o in known else "BINARY" for o in ops}
    name = "ASSIGN" if language in ("javascript", "typescript") else "AUGMENTED"
    return out | {a: name for a in _AUGMENTED}, name


def lex(language: str, text: str) -> tuple[list[str], list[int]]:
    if language in ("python", "gdscript"):
        return _indented(language, text)
    return _go(text) if language == "go" else _scripted(language, text)


def _indented(language: str, text: str) -> tuple[list[str], list[int]]:
    known, (ops, _) = grammar(language).literals, _classes(language)
    gd = language == "gdscript"
    kinds: list[str] = []
    places: list[int] = []
    put, at = kinds.append, places.append
    levels, depth, fresh, char = [(0, 0)], 0, True, ""
    outer: list[tuple[int, int]] = []  # brackets around a lambda body of several lines: (depth, levels)
    lam = False

    def indent(space: str, place: int) -> None:
        nonlocal char
        if gd:
            kindsof = set(space)
            if len(kindsof) > 1 or (char and kindsof - {char}):
                put("ERR")
                at(place)
                return
            char = char or space[:1]
            col = (len(space), len(space))
        else:
            wide = 0
            for c in space:
                wide = wide + 8 - wide % 8 if c == "\t" else 0 if c == "\f" else wide + 1
            col = (wide, len(space.rpartition("\f")[2]))
        while col[0] < levels[-1][0]:
            if outer and len(levels) <= outer[-1][1] + 1:
                break
            levels.pop()
            put("DEDENT")
            at(place)
        top = levels[-1]
        if col[0] > top[0] and col[1] > top[1]:
            levels.append(col)
            put("INDENT")
            at(place)
        elif col != top:
            put("ERR")
            at(place)

    def close(place: int) -> None:
        """The end of a lambda body inside brackets."""
        nonlocal depth
        if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
            put("NEWLINE")
            at(place)
        d, n = outer.pop()
        while len(levels) > n:
            levels.pop()
            put("DEDENT")
            at(place)
        depth += d

    pattern = _GDSCRIPT if gd else _PYTHON
    first = re.match(r"(?:[ \t\f]*(?:#[^\n]*)?\n)*[ \t\f]*", text)
    pos = first.end()
    if pos < len(text) and text[pos] != "#":
        indent(text[text.rfind("\n", 0, pos) + 1 : pos], pos)
    for m in pattern.finditer(text, pos):
        kind = m.lastgroup
        if kind == "NAME":
            word = m[kind]
            put(word if word in known else "NAME")
            at(m.start(kind))
            fresh = False
            if word == "func" and gd and depth:
                lam = True
        elif kind == "LINE":
            if depth and lam and kinds[-1] == ":" and gd:
                lam = False
                outer.append((depth, len(levels)))
                depth, fresh = 0, False
            if depth == 0:
                end = m.end()
                if not fresh:
                    put("NEWLINE")
                    at(m.start(kind))
                    fresh = True
                if end < len(text) and text[end] != "#":
                    s = text.rfind("\n", 0, end) + 1
                    width = end - s
                    if outer and width < levels[-1][0] and (len(levels) <= outer[-1][1] or width <= levels[outer[-1][1] - 1][0] or len(levels) == outer[-1][1] + 1):
                        close(end)
                        fresh = False
                    else:
                        indent(text[s:end], end)
        elif kind == "OP":
            op = m[kind]
            place = m.start(kind)
            if op in "([{":
                depth += 1
            elif op in ")]}":
                if outer and depth == 0:
                    close(place)
                depth = max(0, depth - 1)
            put(ops[op])
            at(place)
            fresh = False
        elif kind != "COMMENT":
            put(kind)
            at(m.start(kind))
            fresh = False
    n = len(text)
    if not fresh and depth == 0:
        put("NEWLINE")
        at(n)
    if depth == 0:
        for _ in levels[1:]:
            put("DEDENT")
            at(n)
    return kinds, places


_ENDS = {"NAME", "NUMBER", "STRING", "REGEX", "PRIVATE", "TEMPLATE", "TPLTAIL", ")", "]", "}", "this", "super", "null", "true", "false"}


def _scripted(language: str, text: str) -> tuple[list[str], list[int]]:
    known, (ops, _) = grammar(language).literals, _classes(language)
    soft = {"from", "as", "of", "get", "set", "async", "static", "let", "accessor", "type", "interface", "declare", "namespace", "module", "abstract", "readonly", "public", "private", "protected", "override", "is", "infer", "asserts", "satisfies", "unique", "global", "out"}
    ends = _ENDS | soft
    kinds: list[str] = []
    places: list[int] = []
    put, at = kinds.append, places.append
    braces: list[bool] = []  # open braces; True: of a template's ${
    pos, n = 0, len(text)
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else n
    last = ""

    def template(place: int, opening: bool) -> int:
        """Reads template characters from ``place``; the place after them."""
        k = place
        while k < n:
            c = text[k]
            if c == "\\":
                k += 2
            elif c == "`":
                put("TEMPLATE" if opening else "TPLTAIL")
                at(place)
                return k + 1
            elif c == "$" and text[k + 1 : k + 2] == "{":
                put("TPLHEAD" if opening else "TPLMIDDLE")
                at(place)
                braces.append(True)
                return k + 2
            else:
                k += 1
        put("ERR")
        at(place)
        return n

    while pos < n:
        again = -1
        for m in _SCRIPT.finditer(text, pos):
            kind = m.lastgroup
            if kind == "NAME":
                last = m[kind]
                if last not in known:
                    last = "NAME"
                put(last)
                at(m.start(kind))
            elif kind == "OP":
                op, place = m[kind], m.start(kind)
                if op == "{":
                    braces.append(False)
                elif op == "}":
                    if braces and braces.pop():
                        again = template(place + 1, False)
                        break
                    if last != OPTIONAL:
                        put(OPTIONAL)
                        at(place)
                elif op in ("/", "/=") and last not in ends:
                    r = _REGEX.match(text, place)
                    if r:
                        last = "REGEX"
                        put(last)
                        at(place)
                        again = r.end()
                        break
                last = ops[op]
                put(last)
                at(place)
            elif kind == "LINE":
                if last in ends or last in ("++", "--", "break", "continue", "return", "yield", "debugger"):
                    last = OPTIONAL
                    put(last)
                    at(m.start(kind))
            elif kind == "TICK":
                again = template(m.end(), True)
                break
            elif kind != "COMMENT":
                last = kind
                put(kind)
                at(m.start(kind))
            elif "\n" in m[kind] and last in ends:
                last = OPTIONAL
                put(last)
                at(m.start(kind))
        else:
            break
        pos = again
        last = kinds[-1]
    put(OPTIONAL)
    at(n)
    return kinds, places


_GO_ENDS = {"NAME", "NUMBER", "STRING", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def _go(text: str) -> tuple[list[str], list[int]]:
    known, (ops, _) = grammar("go").literals, _classes("go")
    kinds: list[str] = []
    places: list[int] = []
    put, at = kinds.append, places.append
    last = ""
    for m in _GO.finditer(text):
        kind = m.lastgroup
        if kind == "NAME":
            last = m[kind]
            if last not in known:
                last = "NAME"
        elif kind == "OP":
            last = ops[m[kind]]
        elif kind == "LINE" or kind == "COMMENT":
            if last not in _GO_ENDS or (kind == "COMMENT" and "\n" not in m[kind]):
                continue
            last = ";"
        else:
            last = kind
        put(last)
        at(m.start(kind))
    if last in _GO_ENDS:
        put(";")
        at(len(text))
    return kinds, places
