"""The operators for training-data pipelines, against brute force, held-out accuracy or exact cases."""

import ast
import itertools
import math
import random
import re
import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.llm import lexers, p1_spans, p2_pairs, p3_origin, p4_terms, p5_functions, p6_syntax, p7_ranking, p8_leaks, p9_mixing, p10_abuse
from codestrata.llm import queries as llm_queries
from codestrata.llm.fm_index import FMIndex


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 1 ---------------------------------------------------------------------------------------------------------------------------------------
def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta épsilon zeta eta theta".split()) + str(rng.randrange(9)) for _ in range(n))


def shared(a, b, span):
    grams = {a[i : i + span] for i in range(len(a) - span + 1)}
    return any(b[i : i + span] in grams for i in range(len(b) - span + 1))


@pytest.mark.parametrize("block", [2_000, 2])
def test_shared_spans_equal_brute_force(spark, block):
    rng = random.Random(3)
    common = [words(rng, 40) for _ in range(3)]  # over 200 characters each
    texts = [words(rng, 10) + rng.choice(common)[: rng.randrange(150, 320)] + words(rng, 15) for _ in range(24)]
    texts += [texts[0], texts[0], "short", "", None, "x" * 700, "x" * 500]
    f = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "id long, text string")
    runs, members = p1_spans.spans(f, span=200, block=block)
    want = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] and texts[j] and shared(texts[i], texts[j], 200)]
    assert rows(p1_spans.record_pairs(runs, members)) == want and want
    got = dict((r.id, r.shared_chars) for r in p1_spans.shared_lengths(runs, members).collect())
    for i, t in enumerate(texts):
        others = [x for j, x in enumerate(texts) if j != i and x]
        covered = set()
        for k in range(len(t or "") - 199):
            if any(t[k : k + 200] in x for x in others):
                covered |= set(range(k, k + 200))
        assert got.get(i, 0) == len(covered)


def test_context_keys_are_exact_beside_missing_ones():
    texts = [words(random.Random(k), 90) for k in range(8)]
    got = p1_spans.anchor_rows(range(8), texts, 400)
    want = [(k, *a) for k, t in enumerate(texts) for a in p1_spans.anchors(t, 400)]
    sent = [pa.Array.from_pandas(got[c]).to_pylist() for c in ("id", "h", "place", "lk", "rk")]
    assert list(zip(*sent)) == want and any(None in x for x in want) and any(x[3] is not None for x in want)
    assert len(p1_spans.anchor_rows([], [], 400)) == 0


def test_spans_of_nothing(spark):
    runs, members = p1_spans.spans(spark.createDataFrame([], "id long, text string"))
    assert p1_spans.record_pairs(runs, members).count() == 0
    with pytest.raises(ValueError, match="span"):
        p1_spans.spans(spark.createDataFrame([], "id long, text string"), span=100)


def test_fm_index_counts_like_str():
    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(400))
    codes = np.array([ord(c) - 96 for c in text] + [0])
    index = FMIndex(codes, 3, 16)
    at = np.arange(0, 380, 7)
    number, lo, hi = index.search(codes, at, at + 6, 1)
    assert len(number) == len(at)
    for k, a, b in zip(number, lo, hi):
        p = text[at[k] : at[k] + 6]
        assert b - a == sum(text.startswith(p, i) for i in range(len(text))) and all(text.startswith(p, s) for s in index.sa[a:b])


# 2 ---------------------------------------------------------------------------------------------------------------------------------------
def test_tail_is_exact():
    q, n = np.array([[0.3, 0.05], [0.3, 0.05], [0.9, 0.5], [0.01, 0.001]]), np.array([[4.0, 6.0], [4, 6], [3, 4], [500, 900]])
    k = np.array([0, 3, 7, 30])

    def brute(k, q, n):
        pmf = np.ones(1)
        for qs, ns in zip(q, n.astype(int)):
            for _ in range(ns):
                pmf = np.convolve(pmf, [1 - qs, qs])
        return pmf[k:].sum()

    assert np.allclose(p2_pairs.tail(k, q, n), [brute(*x) for x in zip(k, q, n)], rtol=1e-6, atol=0)


def test_fit_meets_frequencies_and_sizes():
    d, dn, s, sn = np.array([1.0, 3.0, 5.0]), np.array([6.0, 2.0, 1.0]), np.array([2.0, 3.0]), np.array([4.0, 3.0])
    x, y = p2_pairs.fit_configuration(d, dn, s, sn)
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert np.allclose((p * sn).sum(1), d, rtol=1e-4) and np.allclose((p * dn[:, None]).sum(0), s, rtol=1e-4)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    cf = [("r", f"s{k}", rng.choice(["hot", "hot", *"abcdefgh"]), 1) for k in range(60) for _ in range(rng.randrange(1, 6))]
    cf += [("r", "s1", None, 1), *cf[:20], *[("r", "big", f"p{i}", 1) for i in range(40)], (None, "s1", "a", 1)]
    got = p2_pairs.surprise(spark.createDataFrame(cf, "repo string, sha string, path string, n int"), "repo", "sha", "path", least=2)
    sets = {}
    for r, s, p, _ in cf:
        if r and p:
            sets.setdefault(s, set()).add(p)
    sets = [x for x in sets.values() if 2 <= len(x) <= 30]
    want = {}
    for a, b in itertools.combinations(sorted(set().union(*sets)), 2):
        n = sum(a in x and b in x for x in sets)
        if n >= 2:
            want[a, b] = (len(sets), sum(a in x for x in sets), sum(b in x for x in sets), n)
    have = {(r.a, r.b): (r.n, r.n_a, r.n_b, r.n_ab) for r in got.collect()}
    assert have == want and all(0 <= r.p_value <= 1 for r in got.collect())


def test_no_baskets_no_pairs(spark):
    assert p2_pairs.surprise(spark.createDataFrame([("r", "s", "a")], "repo string, sha string, path string"), "repo", "sha", "path").count() == 0


def test_surprise_reports_and_ranks_every_observed_pair(spark, tmp_path):
    rng = random.Random(9)
    sets = [{f"a{k}", f"b{k}"} for k in range(6) for _ in range(5)] + [set(rng.sample([f"x{i}" for i in range(12)], 3)) for _ in range(40)]
    cf = [("r", f"s{i}", p) for i, s in enumerate(sets) for p in sorted(s)]
    spark.createDataFrame(cf, "repo string, sha string, path string").write.parquet(str(tmp_path / "commit_files.parquet"))
    got = llm_queries.p2_surprise(spark, str(tmp_path)).collect()
    items = sorted(set().union(*sets))
    want = {(a, b): n for a, b in itertools.combinations(items, 2) if (n := sum({a, b} <= s for s in sets))}
    assert {(r.path_a, r.path_b): r.n_ab for r in got} == want and 1 in want.values()
    p = sorted(r.p_value for r in got)
    tests = len(items) * (len(items) - 1) / 2
    cut_at = max((v for i, v in enumerate(p, 1) if v <= 0.05 * i / tests), default=-1.0)
    assert all(r.significant == (r.p_value <= cut_at) for r in got)
    assert all(r.significant and r.p_value > 0 for r in got if r.path_a[0] == "a")


def test_tail_of_rare_pairs_does_not_cancel():
    q, n = np.array([[1e-4], [1e-5]]), np.array([[50.0], [100.0]])
    got = p2_pairs.tail(np.array([5, 6]), q, n)
    want = [sum(math.comb(m, j) * x**j * (1 - x) ** (m - j) for j in range(k, m + 1)) for k, x, m in ((5, 1e-4, 50), (6, 1e-5, 100))]
    assert np.allclose(got, want, rtol=1e-6, atol=0)
    for k, q1, n1 in ((1200, [0.3, 0.02], [3000.0, 9000.0]), (1500, [0.3, 0.02], [3000.0, 9000.0]), (1001, [0.4, 0.1], [3000.0, 200.0])):
        direct = p2_pairs.tail(np.array([k]), np.array([q1]), np.array([n1]), direct=10_000)[0]
        assert abs(p2_pairs.tilted_tail(k, np.array(q1), np.array(n1)) - direct) <= 1e-6 * direct
    assert p2_pairs.tilted_tail(51_000, np.array([0.5]), np.array([100_000.0])) < 1e-9
    assert 0.4 < p2_pairs.tail(np.array([2000]), np.array([[0.5]]), np.array([[4000.0]]))[0] < 0.6


# 3 ---------------------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("path", "text", "kind"),
    [
        ("a/b.gd", "# Generated by tools/x.py. Do not edit.\nextends Node\n", "generated"),
        ("a/b.py", "# Hand-written. Only t.py is generated by x.py; do not edit that one.\nx = 1\n", ""),
        ("a/b.py", 'B = "# @generated - DO NOT EDIT"\n', ""),
        ("node_modules/k/a.js", "const a = 1;\n", "vendored"),
        ("src/vendor_shop/a.js", "const a = 1;\n", ""),
        ("a/b.go", "// (c) 2020 the people of own/repo\npackage a\n", ""),
        ("a/b.go", "// Copyright 2013 otherkit developers. All rights reserved.\npackage a\n", "vendored"),
        ("a/b.go", "// otherkit v1.2.3 | (c) 2013 the otherkit authors | MIT\npackage a\n", "vendored"),
        ("a/b.js", "!function(){" + "var a=1;b(a,2);if(a>3){c()}else{d=e?f:!1}" * 20 + "}()\n", "minified"),
        ("a/b.py", "D = [\n" + "    1, 2, 3, 4, 5, 6,\n" * 30 + "]\n", "data"),
        ("a/b.py", "", ""),
    ],
)
def test_evidence(path, text, kind):
    assert p3_origin.evidence(path, text, "own/repo") == kind


def test_classifier_learns_bodies_and_generalises(spark):
    rng = random.Random(2)
    made = lambda k, head: (head + "\n" if head else "") + "\n".join(f"def get_{rng.choice('abcdef')}{i}(o):\n    return o.fields[{rng.randrange(9999)}]\n" for i in range(4))
    shapes = ["y = x * {n}", "print(os.path.join(str(y), 'z{n}'))", "if y > {n}:\n        y -= 1", "for k in range({n}):\n        y += k", "z = [a for a in y if a]", "assert y is not None, 'no {n}'", "with open(y) as f:\n        f.read()", "del y[{n}]", "y = {{'a': {n}, 'b': x}}", "raise ValueError(y)", "y, z = z, y", "global w{n}"]

    def hand():
        body = [f"def {rng.choice(['load', 'draw', 'move'])}_{i}(x):\n" + "".join(f"    {rng.choice(shapes).format(n=rng.randrange(99))}\n" for _ in range(6)) + "    return helper(y)\n" for i in range(rng.randrange(2, 6))]
        return "import os\n\n" + "\n".join(body)

    data = [(k, f"o/r{k % 10}", f"src/m{k}.py", made(k, "# @generated") if k % 3 == 0 else hand(), "x") for k in range(150)]
    data += [(1002, None, None, None, None), data[0]]
    f = spark.createDataFrame(data, "file_id long, repo string, path string, text string, extra string")
    w, t, report = p3_origin.fit(f.select("file_id", "repo", "path", "text"))
    assert report["held_out_accuracy"] > 0.95 and report["held_out_masked"] > 0.95
    def score(text):
        idx, val = p3_origin.features("src/unseen.py", text, True)
        return (w[idx] * val).sum() + w[-1] * 0.3

    assert score(made(1000, "")) > 0 > score(hand())  # neither file was in the fit, and neither has an opening comment
    got = {r.file_id: (r.kind, r.found) for r in p3_origin.origins(f).collect()}
    assert got[0] == ("generated", True) and not got[1][1] and not got[1002][1] and len(got) == 151


# 4 ---------------------------------------------------------------------------------------------------------------------------------------
def test_terms(spark):
    u = spark.createDataFrame([("file", "1", "fooBar_bazQux ab"), ("file", "1", "foo"), ("file", "2", "Straßen2ÄnderungBar"), ("file", "3", None), ("commit", "s", "foo")], "record_kind string, record_key string, text string")
    got = {(r.record_kind, r.record_key, r.term): r for r in p4_terms.term_weights(u).collect()}
    assert set(got) == {("file", "1", t) for t in ("foo", "bar", "baz", "qux")} | {("file", "2", t) for t in ("straßen", "änderung", "bar")} | {("commit", "s", "foo")}
    foo = got["file", "1", "foo"]
    assert foo.tf == 2 and foo.neighbours == 3 and foo.df == 1 and foo.records == 2 and got["file", "1", "bar"].df == 2 and got["commit", "s", "foo"].neighbours == 0


# 5 ---------------------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("raw", "real"),
    [
        ("Keeps the cache in step with the disk.", True), ("This method load the map.", False), ("Loads a map.", False), ("TODO: describe this function some day", False), ("Add a description here", False),
        ("@param file\n@returns", False), ("@param file the place where it is kept on disk", True), ("noqa: E501 this line is long", False), ("eslint-disable-next-line no-unused-vars", False), ("Author: Some Body Else", False),
        ("Created on 2020-12-03 by somebody", False), ("=========== ----------", False), ("result = compute_map(7)\nreturn result", False), ("", False), (None, False), ("Function loadMap with parameters file, depth.", False),
    ],
)
def test_descriptions(raw, real):
    assert p5_functions.is_real(p5_functions.description(raw, ["file", "depth"]), "load_map", ["file", "depth"]) == real


def test_pairs_in_all_languages(spark):
    good = "Keeps the cache in step with the disk."
    files = [
        (1, "a.py", f'class A:\n    @deco\n    def f(self, x):\n        """{good}"""\n        return x\n\n# {good}\n\ndef g():\n    pass\n'),
        (2, "a.gd", f"## {good}\n@rpc\nfunc f(a: int) -> int:\n\treturn a\n"),
        (3, "a.js", f"class Q {{\n  /** {good} */\n  run(a, b) {{\n    return a;\n  }}\n}}\n// TODO\nexport const go = (x) => {{\n  return x;\n}};\n"),
        (4, "a.go", f"package p\n\n// F {good}\nfunc (r *T) F(a int) int {{\n\treturn a\n}}\n"),
        (5, "a.ts", f"/*\n * {good}\n */\r\nfunction f(a: string): void {{\r\n}}\r\n"),
        (6, "a.py", None),
    ]
    fs = [(1, 3, "f"), (1, 9, "g"), (2, 3, "f"), (3, 3, "run"), (3, 8, "go"), (4, 4, "F"), (5, 4, "f"), (5, 4, "f"), (6, 1, "f"), (7, 1, "f")]
    u = spark.createDataFrame([(i, n, ln, None, None, "clash") for i, ln, n in fs], "file_id long, func_name string, line int, end_line int, params array<string>, path string")
    got = {(r.file_id, r.line): r for r in p5_functions.documented(u, spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert {k for k, r in got.items() if r.real} == {(1, 3), (2, 3), (3, 3), (4, 4), (5, 4)} and set(got) == {(1, 3), (1, 9), (2, 3), (3, 3), (3, 8), (4, 4), (5, 4)}
    assert got[1, 3].code.startswith("def f(self, x):") and got[1, 3].code.endswith("return x") and got[3, 3].code == "run(a, b) {\n    return a;\n  }"


# 6 ---------------------------------------------------------------------------------------------------------------------------------------
VALID = {
    "python": ["", "x: int = 1\n", "async def f[T](a, /, b=1, *c, d, **e) -> int:\n    async with a as b, c: pass\n    return [x async for x in y if x]\n", "match x:\n    case {'a': [1, *_]} | B(c=2) if z:\n        pass\n", "lambda *a, b=1: (yield)\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nfinally:\n    del a[1:2, ...], b.c\n", "print(f'{a}' \"b\")  # c\nif (y := f(x)) > 1: pass\nelse:\n\tz = {**a, 'b': 1}\n", "type X[T] = list[T]\nmatch = case = 1\n@d.e(1)\nclass A(B, m=C): x = 1; y = 2\n"],
    "gdscript": ["", '@tool\nclass_name A extends Node\nsignal s(a, b: int)\nenum E { A = 1, B, }\nconst C := 1\n@export_range(0, 1) var x: float = 0.5:\n\tset(v):\n\t\tx = v\n\tget:\n\t\treturn x\n', 'func f(a: Array[int] = [], b := 1) -> void:\n\tvar l = func(q): return q\n\tmatch a:\n\t\t[1, ..]:\n\t\t\tpass\n\t\t"x", _:\n\t\t\tpass\n\tif not a is Node and b in c: return\n\tawait $A/B.c\n\tx = 1 if y else 2\n\t%Name.go(&"n", ^"p")\n', 'var s = """\n<<<<<<< a\n"""\nstatic func g():\n\tfor i: int in range(3):\n\t\tcontinue\n\twhile true:\n\t\tbreak\n', "func h():\n\tcall(func():\n\t\tvar a = 1\n\t\treturn a\n\t)\n\tpass\n", "class In extends Node:\n\tvar q = {a = 1, \"b\": [1, 2,],}\n"],
    "javascript": ["", "import a, {b as c} from './x.js'\nexport default class extends B { static #p = 1; get x() { return this.#p } async *g() {} static { } }\n", "const {a, b: [c] = [], ...d} = x ?? y?.z?.[1]?.(2)\nlabel: for (const k of m) { if (k) continue label; else break }\n", "let t = `a${b ? `c${d}` : ''}e`, r = /a[/]b/g.test(s), q = a / b / c\n", "x = async (a, {b} = {}) => { await a }\nfor await (const y of z) ;\ndo x++; while (x < 3)\nswitch (a) { case 1: default: }\n", "export const f = function* () { yield* g(); }, n = 1_000n\nexport * as k from 'm'\ntry { } catch { } finally { }\n"],
    "typescript": ["", "import type { A } from './a'\ninterface I<T extends object = {}> extends J { readonly a?: string; [k: string]: any; (x: number): void; m<U>(u: U): Promise<U[]> }\n", "export type X = A | (B & { c: D[] }) | `a${string}` | [a: number, ...b: string[]]\nenum E { A = 1, B }\nabstract class C<T> implements I<T> { constructor(private readonly x: Map<string, number>) { super() } declare y: string; abstract z(): void }\n", "const f = <T,>(a: T, ...r: unknown[]): a is string => a as any\nlet v = x!.y satisfies Z\nfunction g(this: Window, a?: number): asserts a is number\nfunction g(a) {}\n", "declare module 'm' { export const a: number }\nnamespace N.M { }\nlet fn: (a: number) => void = g<number>(1)\ntype K = keyof typeof o extends infer U ? U : never\n"],
    "go": ["package a", "package a\nimport (\n\t\"fmt\"\n\tb \"x/y\"\n)\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if x := f(); x {\n\t}\n\tfor i := range 10 {\n\t\tgo func() { ch <- <-d }()\n\t}\n\tswitch t := y.(type) {\n\tcase int, *S[string]:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase x = <-c:\n\t}\n\treturn\n}\n", "package a\nvar x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nconst (\n\tA = iota\n\tB\n)\ntype I interface {\n\tM(int) error\n\t~int | string\n}\nfunc f[T any](x T) func() { return func() {} }\nvar r = 'x'\nvar y = a[1:2:3]\n"],
}
INVALID = {
    "python": ["def f(:\n    pass\n", "if x\n    y\n", "x = (1\n", "<<<<<<< HEAD\nx = 1\n", "def f():\nreturn 1\n", "  x = 1\ny = 2\n", "class {{ a }}:\n    pass\n", "x = 'a\n"],
    "gdscript": ["func f()\n\tpass\n", "func f():\n\tvar a = (1\nfunc g():\n\tpass\n", "func f():\n\tif a:\n", "var x: = <% a %>\n", "func f():\n  \tpass\n", "class_name {{a}}\n", "=======\n", "func f():\nvar x = 1\nreturn x\n"],
    "javascript": ["const a = ;\n", "function f( {\n", "if (a {\n}\n", "<!DOCTYPE html>\n", "let x = 'a\n", "@@ -1 +1 @@\n", "export class {{ a }} {\n}\n", "f(1;\n", "const a = {\n  b: 1,\n", "a b\n"],
    "typescript": ["let a: = 1\n", "interface A { b: string\n", "function f(a: Map<string, number): void {}\n", "name: x\nsteps:\n  - run: y\n", "class A { b( { } }\n"],
    "go": ["", "package\n", "func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nfunc f(a int {\n}\n", "package a\nfunc {{ .x }}() {\n}\n", "package a\nvar x = map[string]int{\n\t\"a\": 1\n}\n", "package a\nfunc f() {\n\tif x {\n", "package a\n<<<<<<< HEAD\n"],
}


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid_texts(lang, text):
    ok, reason, line, token = p6_syntax.examine(lang, text)
    assert ok, (reason, line, token)


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid_texts(lang, text):
    assert not p6_syntax.examine(lang, text)[0]


@pytest.mark.parametrize(
    ("lang", "good", "bad"),
    [
        ("python", ["a, *b = c\n", "[a, (b, c)] = d = e\n", "f(x).y += 1\n", "a.b: int = 3\n"], ["f() = 1\n", "a + b = c\n", "1 = x\n", "f() += 1\n"]),
        ("javascript", ["[a, b] = [b, a];\n", "({a, b} = c);\n", "a ? b : c = d;\n", "for (const x of y) {}\n", "x ??= 1;\n"], ["const a;\n", "a + b = c;\n", "f() = 2;\n"]),
        ("typescript", ["declare const q: string;\n", "(x as any) = 3;\n", "declare namespace N { const a: number; }\n"], ["1 = x;\n", "const z: number;\n"]),
        ("go", ["package a\nfunc f() {\n\t*p = 3\n\tf(x).y, a[1] = 1, 2\n}\n"], ["package a\nfunc f() {\n\t1 = x\n}\n", "package a\nfunc f() {\n\tf() = 1\n}\n"]),
        ("gdscript", ["func f():\n\tself.a.b += 3\n\t$N.x = 1\n"], ["func f():\n\tf() = 2\n", "func f():\n\ta + b = c\n"]),
    ],
)
def test_what_can_be_assigned_to(lang, good, bad):
    assert all(p6_syntax.examine(lang, x)[0] for x in good) and not any(p6_syntax.examine(lang, x)[0] for x in bad)


def test_trees_of_annotations_and_regular_expressions():
    f = p5_functions.outline("python", 'def f(a) -> Literal["x:y"]:\n    """Says a."""\n')[0]
    broken = p5_functions.outline("python", 'def f(a) -> Literal["x:y"]:\n    """Says a."""\n    x = (\n')[0]
    js = p5_functions.outline("javascript", "function f() {\n  const re = /[{]/;\n  return re;\n}\nfunction g() {}\n")
    assert f.doc == broken.doc == "Says a." and [(n.name, n.start, n.end) for n in js] == [("f", 0, 49), ("g", 50, 65)]


def test_python_agrees_with_the_interpreter_on_mutations():
    rng = random.Random(7)
    source = open(p6_syntax.__file__, encoding="utf-8").read()
    pieces = [x for x in re.split(r"(\W)", source[:2500]) if x]
    differ = 0
    for _ in range(120):
        k = rng.randrange(len(pieces))
        t = "".join(pieces[:k] + pieces[k + 1 :]) + "\n"
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(t)
                want = True
            except SyntaxError:
                want = False
        differ += p6_syntax.examine("python", t)[0] != want
    assert differ <= 3  # what only the interpreter's later passes refuse


def test_failures_are_placed(spark):
    f = [(1, "r", "a.py", "x = 1\ny = )\n"), (2, "r", "a.js", "function f() {\n  g(\n"), (3, "r", "a.txt", "x"), (4, "r", "a.go", None), (5, "r", "b.py", "ok = 1\r\n"), (5, "r", "b.py", "ok = 1\r\n")]
    res = p6_syntax.syntax(spark.createDataFrame(f, "file_id long, repo string, path string, text string"))
    got = {r.file_id: (r.valid, r.reason, r.line, r.token) for r in res.collect()}
    assert got == {1: (False, "unexpected", 2, ")"), 2: (False, "truncated", 3, None), 3: (None, None, None, None), 4: (None, None, None, None), 5: (True, None, None, None)}
    assert rows(p6_syntax.rates(res)) == [("r", "javascript", 1, 1, 1.0), ("r", "python", 2, 1, 0.5)] and res.count() == 5


def test_memo_is_shared_and_bounded():
    g = lexers.grammar("javascript")
    kinds, _ = lexers.lex("javascript", "f(a);\n" * 2000)
    g.failure(kinds[:60])
    n = len(g.members)
    assert g.failure(kinds) is None and len(g.members) <= n + 2


# 7 ---------------------------------------------------------------------------------------------------------------------------------------
def test_leximin(spark):
    m = [(k, "r", float(k), k, k, k, "x") for k in range(1, 21)] + [(30, "r", 99.0, 0, 0, 0, "x"), (31, "r", None, None, None, None, "x"), (40, "q", 1.0, 1, 1, 1, "x")]
    f = spark.createDataFrame(m, "file_id long, repo string, a double, b int, c int, d int, percentiles string")
    order = p7_ranking.leximin(f, "file_id", "repo", ["a", "b", "c", "d"])
    got = {r.file_id: r for r in order.collect()}
    assert got[20].place == 1 and got[19].place == 2 and got[30].weakest < 0.1 and got[31].weakest == 0 and got[30].place > got[2].place and got[40].place == 1
    assert {r.file_id for r in p7_ranking.tops(order).collect()} == {18, 19, 20, 40} and len(got) == 23
    # the vectors decide: with the weakest score of all the top ones are others
    assert {r.file_id for r in p7_ranking.tops(order, but=0).collect()} == {19, 20, 40} and {r.file_id for r in p7_ranking.tops(order, but=3).collect()} == {18, 19, 20, 30, 40}


def test_latest_rows(spark):
    f = spark.createDataFrame([(1, 5, 2), (1, 9, 1), (1, 7, None), (None, 1, 1), (2, None, None)], "file_id long, v int, at int")
    assert rows(p7_ranking.latest(f, "file_id", "at", ["v"])) == [(1, 5), (2, None)]


# 8 ---------------------------------------------------------------------------------------------------------------------------------------
def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 25)))) for k in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(30):
        t = [rng.choice(vocabulary) for _ in range(10)]
        if d % 2:
            src = items[rng.randrange(12)][1].split()
            t[5:5] = src[: rng.randrange(3, 25)]
        docs.append((d, rng.choice([" ", ", ", "\n> "]).join(t).upper() if d % 3 else " -- ".join(t), "x"))
    docs += [(90, None, "x"), (91, "", "x")]
    got = p8_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, item_text string"), span=5, block_words=60)
    want = set()
    for d, t, _ in docs:
        w = p8_leaks.words(t)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        want |= {(d, k) for k, x in items if any(tuple(p8_leaks.words(x)[i : i + 5]) in grams for i in range(len(p8_leaks.words(x)) - 4))}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want
    for r in got.collect():
        piece = docs[r.doc_id][1][r.start : r.end]
        assert len(p8_leaks.words(piece)) == r.words >= 5


def test_short_items_are_found_whole():
    auto, number = p8_leaks.automaton([(1, "one two three four five"), (2, "one two"), (3, "a b c d e f g h i j k l m")], 12)
    m = lambda t: [(i, t[a:b], n) for i, a, b, n in p8_leaks.matches(t, auto, number, 12)]
    assert m("so One, two - three four FIVE one two") == [(1, "One, two - three four FIVE", 5)] and m("one two three four") == [] and m("x a b c d e f g h i j k l m y")[0][2] == 13


# 9 ---------------------------------------------------------------------------------------------------------------------------------------
def test_flow_prefers_fresh_tokens_and_keeps_shared_ones_for_the_poor():
    own = {("a", "a"): 100.0, ("b", "b"): 10.0, ("a|b", "a"): 10.0, ("a|b", "b"): 40.0}
    sent = p9_mixing.min_cost_flow(own, {"a": 100.0, "b": 80.0}, {"a": 2, "b": 2})
    assert sent["a", "a"] == 100 and sum(v for (_, s), v in sent.items() if s == "b") == 80 and sent["a|b", "b"] >= 50


def test_flow_equals_brute_force_and_fills_what_it_can():
    rng = random.Random(3)
    for _ in range(60):
        own = {(p, s): float(rng.randrange(1, 4)) for p in ("x", "y") for s in ("a", "b") if rng.random() < 0.8}
        quota, reps = {"a": float(rng.randrange(0, 6)), "b": float(rng.randrange(0, 6))}, {"a": rng.randrange(1, 3), "b": rng.randrange(1, 3)}
        sent = p9_mixing.min_cost_flow(own, quota, reps)
        for s in quota:
            assert abs(sum(v for (_, t), v in sent.items() if t == s) - min(quota[s], sum(t * reps[s] for (_, x), t in own.items() if x == s))) < 1e-6

        def price(x):
            total = 0.0
            for p in ("x", "y"):
                size, left, r = sum(t for (q, _), t in own.items() if q == p), sum(v for (q, _), v in x.items() if q == p), 1
                shared = sum(q == p for q, _ in own) - 1
                total += 0.001 * shared * left
                while left > 1e-9:
                    total += r * min(left, size)
                    left, r = left - size, r + 1
            return total

        keys = list(own)
        best = min((price(dict(zip(keys, c))) for c in itertools.product(*[range(int(own[k] * reps[k[1]]) + 1) for k in keys]) if all(sum(v for k, v in zip(keys, c) if k[1] == s) == min(quota[s], sum(own[k] * reps[s] for k in keys if k[1] == s)) for s in quota)), default=0.0)
        assert price(sent) <= best + 1e-6


def test_flow_of_many_patterns_is_quick():
    import time

    rng = random.Random(1)
    names = [f"s{i}" for i in range(11)]
    own = {(f"p{k}", s): float(rng.randrange(1, 999)) for k in range(2047) for s in rng.sample(names, rng.randrange(1, 6))}
    whole = sum(own.values())
    began = time.time()
    sent = p9_mixing.min_cost_flow(own, {s: whole * rng.random() / 3 for s in names}, dict.fromkeys(names, 4))
    assert sent and time.time() - began < 60


def test_blend_reaches_targets(spark):
    docs = [(k, f"text number {k} " + "word " * (5 + k % 7), [" Wiki", "forum ", "FORUM"][k % 3]) for k in range(60)]
    docs += [(100, docs[0][1], "forum"), (101, None, "wiki"), (102, "", None), docs[3], (103, "lonely words here", "other")]
    t = spark.createDataFrame([("wiki", 0.6, 2), ("forum", 0.3, 1), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    m = p9_mixing.measured(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    report, routes = p9_mixing.plan(m, t)
    got = {r.source: r for r in report.collect()}
    assert got["none"].short and got["none"].size_tokens == 0 and not got["wiki"].short and not got["forum"].short
    picked = p9_mixing.select(m, routes)
    sums = {r.source: r.n for r in picked.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("n")).collect()}
    assert all(abs(sums[s] - got[s].blended_tokens) <= 60 for s in sums) and rows(picked) == rows(p9_mixing.select(m, routes))
    assert picked.filter("source = 'forum' and copies > 1").count() == 0


def test_copies_of_a_text_are_documents_of_the_blend(spark):
    docs = [(k, "the same ten words stand in each of these documents", "wiki") for k in range(10)]
    t = spark.createDataFrame([("wiki", 1.0, 1)], "source string, target_share double, max_repeats int")
    m = p9_mixing.measured(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    report, routes = p9_mixing.plan(m, t)
    r, picked = report.first(), p9_mixing.select(m, routes).collect()
    assert not r.short and r.blended_tokens == r.capacity_tokens == r.size_tokens == sum(x.copies * x.tokens for x in picked)
    assert sorted((x.doc_id, x.copies) for x in picked) == [(k, 1) for k in range(10)]


# 10 --------------------------------------------------------------------------------------------------------------------------------------
SCORER = p10_abuse.Scorer({w: 50.0 for w in "you are the your what shut up get lost this code is nobody here likes and a of to in branch table when read".split()})


@pytest.mark.parametrize(
    "text",
    ["You are an 1d10t!", "what a p a t h e t i c loser", "Fuсk you", "you s****d b.a.s.t.a.r.d", "such wooooorthless scum, you moroooon", "Kill yourself and spare us", "Immigrants are vermin", "Send nu​des", "du bist ein Vollidiot", "hijo de puta", "ferme ta gueule", "Nobody here likes you."],
)
def test_abuse_is_found_however_spelt(text):
    assert SCORER.text(text)[0] >= 0.5, SCORER.text(text)


@pytest.mark.parametrize("text", ["You idio**", "f*** you", "sh** you", "you are the " + "  ".join(" ".join(w) for w in "worthless idiot you are the worthless idiot of this code".split())])
def test_end_masks_and_long_stretches_are_read(text):
    assert SCORER.text(text)[0] >= 0.5, SCORER.text(text)


def test_gate_loses_no_evidence():
    auto, free = p10_abuse._gate()
    for t in ["you are a worthless idiot", "kill yourself", "immigrants are vermin", "send nudes", "halt die fresse", "get lost, moron!", "they are all liars and thieves", "nobody here likes you", "fine text"]:
        tried = {i for _, numbers in auto.iter(t) for i in numbers}.union(free)
        assert {i for i, e in enumerate(p10_abuse.EVIDENCE) if e[2].search(t)} <= tried


def test_rates_count_a_document_once(spark):
    docs = spark.createDataFrame([(1, "fine", "a"), (1, "you idiot", "a")], "doc_id long, text string, source string")
    s = spark.createDataFrame([(1, 0.0), (1, 0.9)], "doc_id long, score double")
    assert rows(p10_abuse.rates(s, docs)) == [("a", 1, 1, 1.0)]


def test_emphasis_masks_nothing():
    assert SCORER.restore("**get the shi**") == "**get the shi**" and SCORER.restore("get the shi**") == "get the shits"


def test_decoding_is_exact():
    model = p10_abuse.CharModel({"cab": 50.0, "bad": 5.0}, {"abba": 9.0, "dad": 3.0, "a": 4.0})
    rng = random.Random(2)
    for _ in range(200):
        lat = [rng.choice([[(c, 1.0) for c in "abcd"], [(c, 0.0) for c in rng.choice("abcd")], [("", 0.1), (" ", 0.5)]]) for _ in range(rng.randrange(1, 6))]
        best = []
        for path in itertools.product(*lat):
            text, cost = "".join(x for x, _ in path), sum(c for _, c in path)
            for w in text.split(" "):
                cost += sum(model.cost(("^^^" + w[:k])[-3:], ch, True) for k, ch in enumerate(w + "$")) + 8.0 * (w not in model.vocabulary)
            best.append((cost, text))
        known = [x for x in best if all(w in model.vocabulary for w in x[1].split(" "))]
        got = model.decode(lat, True)
        assert (not known and got == "") or min(c for c, t in best if t == got) <= min(best)[0] + 1e-9


@pytest.mark.parametrize(
    "text",
    ["The watchdog will kill the process and abort its child tasks.", "Sexagesimal angles are used in the cockpit analytics.", "That branch is dead code, strip it and bury the flag.", "The naked node has no child.", "**Bold** text *and* globs *.gd with x86_64, v2.0 and a b c.", "The moderation page says that insults and slurs are removed.", "We hit a nasty race; the dumb terminal mode hides it.", "", None],
)
def test_harsh_technical_words_are_not_abuse(text):
    assert SCORER.text(text)[0] < 0.5, SCORER.text(text)


def test_abuse_of_documents(spark):
    docs = [(1, "Fine text.\nYou worthless idiot!", " A "), (2, "Fine text.", "a"), (3, None, None), (3, None, None), (4, "fine " * 5000 + ". What a m0r0n you are", "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    s = p10_abuse.abuse(d, spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id long, abusive int"))
    assert {r.doc_id: r.score >= 0.5 for r in s.collect()} == {1: True, 2: False, 3: False, 4: True}
    assert rows(p10_abuse.rates(s, d).filter("source is not null")) == [("a", 2, 1, 0.5), ("b", 1, 1, 1.0)]
