"""The module reader on statements of every kind, and on texts of no kind."""

import pytest
from hypothesis import given, settings, strategies as st

from causeway.functions.lexer import script_of, tokens
from causeway.functions.syntax import scan


def read(text, script="ts"):
    found = scan(text, script)
    return [f"{i['relation']}:{i['specifier']}{'!' if i['type_only'] else ''}" for i in found["imports"]], found["exports"]


EXPORTS = [
    ("export const a = 1, b = 2", ["a", "b"]),
    ("export const {a, b: c, d: {e}, f = g(), ...rest} = y, [h, , [i] = [1], ...j] = z;", ["a", "c", "e", "f", "h", "i", "j", "rest"]),
    ("export const { [k]: v, 'str': w, 3: x } = o", ["v", "w", "x"]),
    ("export const m: Map<string, number> = new Map<string, number>(), n = a < b, o = c > d", ["m", "n", "o"]),
    ("export const s = a ? b : c, t = {u: 1, v: 2}, w = [1,2].map((x, y) => x)", ["s", "t", "w"]),
    ("export let a = 1\nexport let b = x\n  .foo()\n  + 2, c\nlet hidden = 1", ["a", "b", "c"]),
    ("export const f = () => {\n return 1\n}\nexport function g() {}", ["f", "g"]),
    ("export default class Foo extends Bar {}\nexport abstract class C {}\nexport const enum E {}", ["C", "E", "Foo", "default"]),
    ("export async function* gen() {}\nexport default async function named() {}", ["default", "gen", "named"]),
    ("export default function () {}", ["default"]),
    ("export default { a: 1 }", ["default"]),
    ("export = q;", ["default"]),
    ("@dec() export class D {}\nexport @dec.x(1) class E2 {}", ["D", "E2"]),
    ("export namespace N { export const inner = 1 }\ndeclare module 'x' { export const y = 1 }\nexport declare function d(): void;", ["d"]),
    ("export as namespace G; export type T = { a: 1 }; export interface I {}", ["I", "T"]),
    ("export { a, b as c, type D, e as 'd e' }", ["D", "a", "c", "d e"]),
    ("// export const a = 1\n/* export const b = 1 */ const s = \"export const c = 1\", t = `\nexport const d = 1`", []),
    ("export const x: { a: string, b: number }, y: [string, number], z: (a: A, b: B) => C", ["x", "y", "z"]),
]
IMPORTS = [
    ("import d, { type A } from './a'; import './f'; import * as z from './e'", ["import:./a", "import:./e", "import:./f"]),
    ("import type from './b'; import type, {q} from './b2'; import type X from './c'; import type { Y } from './d'", ["import:./b", "import:./b2", "import:./c!", "import:./d!"]),
    ("import k = require('./g'); import type l = require('./h'); import A = B.C; export import q = require('./q')", ["import-equals:./g", "import-equals:./h!", "import-equals:./q"]),
    ("export * from './s'; export * as ns from './n'; export type { P } from './p'; export { a } from './x'", ["reexport:./n", "reexport:./p!", "reexport:./s", "reexport:./x"]),
    ("import { t } from './t'; import type { T } from './t'", ["import:./t"]),
    ("const x = `a ${require('b')} ${`c ${import('d')}`} require('no')`", ["dynamic-import:d", "require:b"]),
    ("const r = /require('no')/g; a / require('yes') / b; // require('no')", ["require:yes"]),
    ("if (x) /require('no')/.test(y); const o = {a: 1} / require('div') / 2; x.return / 2 / require('prop')", ["require:div", "require:prop"]),
    ("require(`tpl`); require('a' + b); obj.require('no'); require?.('opt'); new require('no'); import('x', {with: {}})", ["dynamic-import:x", "require:opt", "require:tpl"]),
    ("const t: typeof import('no') = 1; let p: import('no').P; function f(a: import('no').A): Promise<import('no').B> {}; type Z<T> = import('no').Z", []),
    ("const q = c ? import('y') : import('z'); const o = { k: import('w') }; const l = () => import('v')", ["dynamic-import:v", "dynamic-import:w", "dynamic-import:y", "dynamic-import:z"]),
    ("import {a} from 'caf\\u00e9'; import 'it\\'s'", ["import:café", "import:it's"]),
    ("#!/usr/bin/env node 'no'\nimport 'a'; function x() { return import.meta.url }", ["import:a"]),
    ("import j from './j.json' with { type: 'json' }", ["import:./j.json"]),
]
ELEMENTS = [
    ("const el = <div title=\"require('no')\" on={() => import('./lazy')}>don't require('no') {require('./in')} <b/> </div>;\nexport const after = 1", "tsx", ["dynamic-import:./lazy", "require:./in"], ["after"]),
    ("export default () => <><A.B x='1' {...y}>it's</A.B></>;\nexport const z = 2", "jsx", [], ["default", "z"]),
    ("export const f = <T,>(x: T) => x, g = <T extends object>(y: T) => y;\nexport const h = 1;", "tsx", [], ["f", "g", "h"]),
    ("const f = <T>(x: T) => require('a');\nexport const h = 1;", "tsx", ["require:a"], ["h"]),
    ("const f = <T>x;\nexport const h = 'it';", "ts", [], ["h"]),
    ("return (<p>{a < b ? <i>'</i> : '>'}</p>); require('x')", "js", ["require:x"], []),
]


@pytest.mark.parametrize("text,want", EXPORTS)
def test_exports(text, want):
    assert read(text)[1] == want


@pytest.mark.parametrize("text,want", IMPORTS)
def test_imports(text, want):
    assert read(text)[0] == want


@pytest.mark.parametrize("text,script,imports,exports", ELEMENTS)
def test_elements(text, script, imports, exports):
    assert read(text, script) == (imports, exports)


def test_scripts():
    assert [script_of(p) for p in ("a.ts", "b/c.tsx", "d.jsx", "e.cjs", "f.mts", "g")] == ["ts", "tsx", "jsx", "js", "ts", "ts"]


_NAMES = st.lists(st.from_regex(r"v[a-z]{1,5}", fullmatch=True), unique=True, min_size=1, max_size=5)


@settings(max_examples=120, deadline=None)
@given(_NAMES, st.data())
def test_binding_patterns_by_construction(names, data):
    def pattern(own):
        if len(own) == 1 and data.draw(st.booleans()):
            return own[0]
        parts = [pattern([x]) if data.draw(st.booleans()) else x for x in own]
        if data.draw(st.booleans()):
            return "[" + ", ".join(f"{p} = f({{a, b}})" if data.draw(st.booleans()) else p for p in parts) + "]"
        return "{" + ", ".join(f"k: {p} = [1, 2]" if not p.isalpha() or data.draw(st.booleans()) else p for p in parts) + "}"

    assert read(f"export const {pattern(names)} = g(), last = 1\nconst no = 2")[1] == sorted([*names, "last"])


@settings(max_examples=300, deadline=None)
@given(st.text("<>/{}()[]`$'\"ab =:;,.?\n\\*import export from", max_size=60), st.sampled_from(["ts", "tsx", "js", "jsx"]))
def test_any_text_is_read(text, script):
    tokens(text, script)
    scan(text, script)


def read_once(spark, name, tmp_path):
    """The plan of a module query over one text, which reads it a single time, and its rows."""
    from causeway import catalog

    spark.createDataFrame([(1, "one three sixsix seventy")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert plan.count("ArrowEvalPython") == 1
    return sorted(tuple(r) for r in df.collect())


def test_exports_read_each_text_once(spark, tmp_path):
    assert read_once(spark, "module_exports", tmp_path) == [(1, "n_seventy"), (1, "n_seventy_b"), (1, "n_sixsix"), (1, "n_three_e")]


def test_blanks_before_tokens():
    from causeway.functions.lexer import tokens

    assert [tuple(t) for t in tokens(" a  /\n b; x ", "ts")] == [("word", "a", 0, False), ("mark", "/", 0, False), ("word", "b", 0, True), ("mark", ";", 0, False), ("word", "x", 0, False)]
    assert [t.text for t in tokens("x = /a b/g; y = a / b", "ts")] == ["x", "=", "/a b/g", ";", "y", "=", "a", "/", "b"]
    assert [t.text for t in tokens("f( <p> a </p> ) ", "tsx")] == ["f", "(", "<>", ")"]


def test_imports_read_each_text_once(spark, tmp_path):
    assert read_once(spark, "module_imports", tmp_path) == [(1, "dynamic-import", "./n_one", False), (1, "import", "./n_three", False), (1, "require", "./n_sixsix", False)]
