from __future__ import annotations

import time

import pytest

from corpusloom.llm.script_grammar import parses
from corpusloom.llm.syntax_check import checked_files, invalid_rates, judge

BOTH = """
#!/usr/bin/env node
const a = 1, { b = 2, ...c } = x || {}, [d, , e] = y
let f = async ({ g }, h = 3) => { for await (const i of j) await i }
label: for (let i = 0, n = 3; i < n; i++) { if (i) continue label; else break }
for (const k in o) delete o[k]
do { x++ } while (x < 3)
switch (a) { case 1: case 'b': { break } default: g() }
try { throw new Error(`x ${a + `${b}`} }`) } catch { } finally { }
class A extends (B, C) { static #p = 1; static { this.q = 2 } get x() { return 1 } async *gen() { yield* 3 } [k] = 4; constructor() { super() } }
export default class { static = 1; get; async }
const r = a / b / c, s = /[/"]}/.test(x), t = (1, 2), u = x ? { y: 1 } : [...z,]
new Foo.Bar; new (f())(1); import('x').then(({ default: d }) => d)
var o = { a, 'b': 1, 3: 2, [c]: 3, get d() { return 1 }, set d(v) { }, async *e() { }, f() { }, ...g }
;[a, b] = [b, a]; ({ a, b: c.d } = o); a ??= b?.c?.[d]?.(e); tag`x${1}`
export { a as b, c as default } from 'x'; export * as ns from 'y'; import d, { e as f } from 'z' with { type: 'json' }
if (a) function q() { }
var async = 1, of = 2, get = 3; async = of; x = async (1)
0x1F + 1_000n + .5e-3 + 1. ; a = b;
/re/.test(c)
""".lstrip()
TYPED = """
interface A<T extends object = {}> extends B<T>, C { readonly [k: string]: any; m?(x: number): void; new (y: T): A<T>; (z): z is string; get p(): number }
type U = { [K in keyof T as `x${K}`]?: T[K] } | (new () => X)[] | [a: string, ...b: number[]] | ((x: A) => x is B) | T extends infer R ? R : never
export type { U } from './u'; import type { V } from 'v'; import { type W, X } from 'w'
enum E { A = 1, B = 'x' } declare module 'm' { export const z: number; } namespace N.M { let q = 1 }
abstract class K<T> extends L<T> implements I, J { private readonly a?: string = 'x'; declare b: number; constructor(private x: T, public readonly y?: number) { super() } abstract m(): void; static async n<T>(this: K<T>, ...r: T[]): Promise<Map<string, Array<number>>> { return <any>r as unknown as Map<string, any[]> } }
function f(a: string): asserts a is 'x'
function f(a: any, b?: typeof import('x').y[]): void { const c = a!.b![0] satisfies D; let e!: number }
const g = <T,>(x: T): T => x, h = async <T>(x: T) => x, i = new Map<string, number>([['a', 1]]), j = f<string>('x')
@dec({ a: 1 }) class D2 { @in1() x: number; @m() y() { } }
for (const k of <any[]>l) { }
let x = a < b && c > d, y = a ? (b) : c, z = (p: number, q = 1): p is number => true
""".lstrip()


def test_scripts_and_modules():
    for typed in (False, True):
        assert parses(BOTH, typed), typed
        assert parses("﻿" + BOTH.replace("\n", "\r\n"), typed)
    assert parses(TYPED, True) and not parses(TYPED, False)


@pytest.mark.parametrize("line", [x for x in TYPED.splitlines() if x])
def test_typed_lines_are_not_scripts(line):
    assert parses(line, True)
    assert not parses(line, False) or line.startswith("let x")


@pytest.mark.parametrize("bad", ["const a", "let a = ;", "f(1", "f(1]]", "retern x;", "return 1", "if (a) else b", "a b", "'abc", "`abc", "/* x", "x = {a: 1, b}}", "class A { m( { } }", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "for (;;", "1 = 2", "f() = 1", "12abc", "import a from b", "const x = 'a\nb'", "a => { return }}", "function () {}", "function f() { await g() }", "throw\nx", "{ import a from 'b' }", "a ? b", "[1, 2", "var 1a", "x = #y", "case 1:", "try { }", "new", "a..b", "x = (a, )"])
def test_errors(bad):
    assert not parses(bad, False) and not parses(bad, True)


def test_judgement():
    assert judge("def f(:\n", "python") == (False, [])
    assert judge("def f():\n    return 1\n", "typescript") == (False, ["python"])
    assert judge("", "python") == (True, ["python"])
    assert set(judge("[1, 2]", "javascript")[1]) == {"javascript", "typescript", "python", "json"}
    assert judge("", "json")[0] is False and judge("{\"a\": NaN}", "json")[0] is False and judge('{"a": [1]}', "json")[0] is True
    assert judge("# ] (", "markdown") == (True, []) and judge("x", None) == (None, [])
    assert judge("[" * 100_000, "json")[0] is False and judge("(" * 5000 + ")" * 5000, "javascript")[0] is False


@pytest.mark.parametrize("good", [
    "if (x) /foo'/.test(y)", "while (a) /[`]/.exec(b)", "x = a\n<!-- old comment's\nb()", "f()\n--> it's one", "using x = f(); { await0() }", "for (using x of y) x.z()",
    "`a${`b${`c${`d${`e${`f${1}`}`}`}`}`}`", "x = `${ { a: `}` }.a }`", "a = b ? c : d ? e : f", "let using = 1; using = 2", "a = b / c / d; `x`", "for (;;) { switch (a) { case 1: continue; default: break } }",
])
def test_delicate_scripts(good):
    assert parses(good, False) and parses(good, True)


def test_types_that_infer_with_a_constraint():
    assert parses("type A<T> = T extends infer U extends string ? U : never", True)
    assert parses("type B<T> = T extends [infer U extends string, ...infer V] ? U : V", True)
    assert parses("type C<T> = T extends (infer U extends number ? 1 : 2) ? U : 0", True)
    assert not parses("type A<T> = T extends infer U extends string", True)


@pytest.mark.parametrize("element", ["const a = <b c='d' e={f} {...g}>text {h ? <i/> : null} it's {/* no */}</b>", "f(<></>)", "x => <A.B c:d={`e${1}`}>{y.map(z => <li key={z}>{z}</li>)}</A.B>"])
def test_elements_in_files_named_so(element):
    assert parses(element, False, True) and parses(element, True, True) and not parses(element, False)
    assert not parses(element + "</b>", False, True) and not parses("const a = <b></c>", False, True) and parses("const f = <T,>(x: T) => x < 3", True, True)


@pytest.mark.parametrize("bad", ["break", "continue;", "if (a) { break }", "while (a) { function f() { break } }", "x => { continue }", "switch (a) { case 1: continue }", "`a${`b${`c${`d${`e${`f${}`}`}`}`}`}`", "class A { static { return } }"])
def test_more_errors(bad):
    assert parses(bad, False) is False and parses(bad, True) is False


def test_depth():
    assert judge("[" * 20_000 + "1" + "]" * 20_000, "json")[0] is True and judge("[" * 20_000 + "1" + "]" * 19_999, "json")[0] is False
    assert judge('{"a":' * 9_000 + "[{}, [], -1.5e3, null]" + "}" * 9_000, "json")[0] is True and judge('{"a":' * 9_000 + "[,]" + "}" * 9_000, "json")[0] is False
    assert parses("x = " + "a ? b : " * 3_000 + "c", False) is True
    assert parses("if (a) b; else " * 3_000 + "c", True) is True
    assert parses("!" * 100_000 + "a", False) is None and judge("x = " + "-" * 200_000 + "1", "python")[0] is None
    began = time.time()
    assert parses("(" * 20_000 + "1" + ")" * 20_000, False) is True and time.time() - began < 5


def test_rows(spark):
    schema = "file_id bigint, repo string, path string, language string, text string, valid string"
    rows = [(1, None, "a.ts", None, "let a: number = 1", ""), (2, "r", "a.js", "JavaScript", "let a: number = 1", ""), (3, "r", "a.py", None, None, ""), (4, "r", None, None, "x", ""), (4, "r", "a.md", None, "#", ""), (4, "r", "a.md", None, "#", "")]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r["file_id"], str(r["valid"]), r["verdict"], str(r["parses_as"])) for r in checked_files(df).collect())
    assert got == [(1, "True", "valid", "None"), (2, "False", "foreign", "typescript"), (3, "None", "unknown", "None"), (4, "None", "unknown", "None"), (4, "True", "valid", "None"), (4, "True", "valid", "None")]
    assert {(r["repo"], r["language"], r["files"], r["invalid_rate"]) for r in invalid_rates(df).collect()} == {(None, "typescript", 1, 0.0), ("r", "javascript", 1, 1.0), ("r", "markdown", 2, 0.0)}
    assert checked_files(df.limit(0)).count() == 0
