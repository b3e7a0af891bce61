"""Parsing with memoised derivatives over token classes.

A grammar is a set of rules in extended BNF, without left recursion. Each rule becomes a small automaton over tokens and rule names. The
language still to be read is a set of continuations, each a linked list of automaton states; its derivative by a token replaces the head
of each continuation by what the head may go on with. Heads' derivatives are memoised per (state, token), whole sets' derivatives per
(set, token), with sets and continuations shared by identity, so a repeated construct costs one dictionary look-up per token.

The empty set means that the token can't stand there. At the end of the text the set must be nullable: must hold a continuation that can
end; if it isn't, the text is cut off.
"""

from __future__ import annotations

import re

#: A line end that the lexer can't tell from white space.
OPTIONAL = "NL?"

_EBNF = re.compile(r"""\s*(?:#[^\n]*\n\s*)*('(?:[^'\n]+)'|[A-Za-z_]\w*|[()\[\]|*+=;])""")


class Grammar:
    """Compiled rules: ``states[q]`` = (transitions by token, transitions by rule, final)."""

    def __init__(self, text: str, start: str, limit: int = 400_000):
        self.limit = limit
        parts = _EBNF.findall(text.strip() + "\n")
        self.literals = {p[1:-1] for p in parts if p[0] == "'"}
        self.words = sorted(w for w in self.literals if w[0].isalpha() or w[0] == "_")
        rules: dict[str, tuple] = {}
        i = 0
        while i < len(parts):
            assert parts[i + 1] == "=", parts[i : i + 3]
            node, j = self._alternatives(parts, i + 2)
            assert parts[j] == ";", parts[i : j + 1]
            rules[parts[i]] = node
            i = j + 1
        rules["WORD"] = ("alt", [("tok", w) for w in ["NAME", *self.words]])
        self.rules = rules
        self.tok: list[dict[str, int]] = []
        self.call: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.first: dict[str, int] = {}
        for name, node in rules.items():
            self.first[name] = self._automaton(node)
        self.nullable: set[str] = set()
        while True:
            more = {n for n in rules if n not in self.nullable and self._ends(self.first[n])}
            if not more:
                break
            self.nullable |= more
        self.ends = [self._ends(q) for q in range(len(self.final))]
        self.dead_end = [not self.tok[q] and not self.call[q] for q in range(len(self.final))]
        self._start = start
        self.reset()

    def reset(self) -> None:
        """Forget all memoised derivatives (they are rebuilt as needed)."""
        self.heads: dict[tuple[int, str], list[tuple[int, ...]]] = {}
        self.cells: dict[tuple[int, int], int] = {}
        self.cell: list[tuple[int, int]] = [(-1, -1)]  # 0: the end
        self.sets: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.after: list[dict[str, int]] = []
        self.empty = self._set(frozenset())
        self.begin = self._set(frozenset([self._cons(self.first[self._start], 0)]))

    # -- rules to automata ---------------------------------------------------------------------------------------------------------
    def _alternatives(self, p: list[str], i: int) -> tuple[tuple, int]:
        alts, seq = [], []
        while p[i] not in (";", ")", "]"):
            if p[i] == "|":
                alts.append(("seq", seq))
                seq, i = [], i + 1
                continue
            if p[i] == "(":
                node, i = self._alternatives(p, i + 1)
            elif p[i] == "[":
                node, i = self._alternatives(p, i + 1)
                node = ("opt", node)
            elif p[i][0] == "'":
                node = ("tok", p[i][1:-1])
            else:
                node = ("tok", p[i]) if p[i].isupper() and p[i] != "WORD" else ("ref", p[i])
            i += 1
            while p[i] in ("*", "+"):
                node = ("star", node) if p[i] == "*" else ("seq", [node, ("star", node)])
                i += 1
            seq.append(node)
        alts.append(("seq", seq))
        return (("alt", alts) if len(alts) > 1 else alts[0]), i

    def _automaton(self, node: tuple) -> int:
        """Deterministic automaton of one rule (subset construction over its Thompson automaton); the number of its first state."""
        eps: list[list[int]] = []
        arcs: list[list[tuple[str, str, int]]] = []

        def new() -> int:
            eps.append([])
            arcs.append([])
            return len(eps) - 1

        def build(n: tuple, a: int, b: int) -> None:
            kind, x = n
            if kind in ("tok", "ref"):
                arcs[a].append((kind, x, b))
            elif kind == "seq":
                for k, y in enumerate(x):
                    c = b if k == len(x) - 1 else new()
                    build(y, a, c)
                    a = c
                if not x:
                    eps[a].append(b)
            elif kind == "alt":
                for y in x:
                    build(y, a, b)
            elif kind == "opt":
                c, e = new(), new()
                eps[a] += [c, b]
                eps[e].append(b)
                build(x, c, e)
            else:
                c, e = new(), new()
                eps[a].append(c)
                eps[c].append(b)
                eps[e].append(c)
                build(x, c, e)

        s, t = new(), new()
        build(node, s, t)

        def closure(qs: set[int]) -> frozenset[int]:
            todo, seen = list(qs), set(qs)
            while todo:
                for r in eps[todo.pop()]:
                    if r not in seen:
                        seen.add(r)
                        todo.append(r)
            return frozenset(seen)

        known: dict[frozenset, int] = {}
        todo = [closure({s})]

        def number(c: frozenset) -> int:
            if c not in known:
                known[c] = len(self.tok)
                self.tok.append({})
                self.call.append({})
                self.final.append(t in c)
                todo.append(c)
            return known[c]

        first = number(todo.pop())
        while todo:
            c = todo.pop()
            moves: dict[tuple[str, str], set[int]] = {}
            for q in c:
                for kind, x, r in arcs[q]:
                    moves.setdefault((kind, x), set()).add(r)
            for (kind, x), rs in moves.items():
                (self.tok if kind == "tok" else self.call)[known[c]][x] = number(closure(rs))
        return first

    def _ends(self, q: int, seen: frozenset = frozenset()) -> bool:
        return self.final[q] or any(r in self.nullable and s not in seen and self._ends(s, seen | {q}) for r, s in self.call[q].items())

    # -- derivatives ---------------------------------------------------------------------------------------------------------------
    def _cons(self, q: int, rest: int) -> int:
        if q >= 0 and self.dead_end[q]:
            return rest  # nothing can follow inside this rule: no need to come back to it
        key = (q, rest)
        c = self.cells.get(key)
        if c is None:
            c = self.cells[key] = len(self.cell)
            self.cell.append(key)
        return c

    def _set(self, cells: frozenset) -> int:
        k = self.sets.get(cells)
        if k is None:
            k = self.sets[cells] = len(self.members)
            self.members.append(cells)
            self.after.append({})
        return k

    def _head(self, q: int, t: str) -> list[tuple[int, ...]]:
        """What state q may go on with after reading t: state sequences, the innermost first."""
        key = (q, t)
        have = self.heads.get(key)
        if have is not None:
            return have
        out: set[tuple[int, ...]] = set()
        if t in self.tok[q]:
            out.add((self.tok[q][t],))
        for rule, r in self.call[q].items():
            for seq in self._head(self.first[rule], t):
                out.add(seq if self.dead_end[r] else (*seq, r))
            if rule in self.nullable:
                out.update(self._head(r, t))
        have = self.heads[key] = list(out)
        return have

    def derive(self, state: int, t: str) -> int:
        """The derivative of a set by a token."""
        nxt = self.after[state].get(t)
        if nxt is not None:
            return nxt
        out: set[int] = set()
        todo, seen = list(self.members[state]), set()
        while todo:
            c = todo.pop()
            if c in seen or c == 0:
                continue
            seen.add(c)
            q, rest = self.cell[c]
            for seq in self._head(q, t):
                d = rest
                for r in reversed(seq):
                    d = self._cons(r, d)
                out.add(d)
            if self.ends[q]:
                todo.append(rest)
        nxt = self.after[state][t] = self._set(frozenset(out))
        return nxt

    def maybe(self, state: int, t: str) -> int:
        """The set that may or may not have read t (a line end that can stand for a terminator)."""
        key = t + "?"
        nxt = self.after[state].get(key)
        if nxt is None:
            nxt = self.after[state][key] = self._set(self.members[state] | self.members[self.derive(state, t)])
        return nxt

    def accepts_end(self, state: int) -> bool:
        todo, seen = list(self.members[state]), set()
        while todo:
            c = todo.pop()
            if c == 0:
                return True
            if c not in seen:
                seen.add(c)
                q, rest = self.cell[c]
                if self.ends[q]:
                    todo.append(rest)
        return False

    def failure(self, tokens: list[str]) -> int | None:
        """None for a valid token list; the number of the token that can't stand there; the list's length if the text is cut off.
        The token ``NL?`` may be read as NL or left out."""
        if len(self.members) > self.limit:
            self.reset()
        state, after, empty = self.begin, self.after, self.empty
        for k, t in enumerate(tokens):
            nxt = after[state].get(t)
            if nxt is None:
                nxt = self.maybe(state, "NL") if t == OPTIONAL else self.derive(state, t)
            state = nxt
            if state == empty:
                return k
        return None if self.accepts_end(state) else len(tokens)
