"""Imports and exports of TypeScript and JavaScript texts, and package manifests.

Statements are read from the tokens of ``lexer``: those of the top level, with all names
that a binding pattern binds, and calls of ``import`` and ``require`` with a literal
anywhere, in templates and JSX too. Specifiers built from expressions give no fact. What
isn't understood yields no fact, never a guess.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T

from causeway.functions.lexer import Token, tokens

_S = T.StringType()
_IMPORT = T.StructType([T.StructField("relation", _S), T.StructField("specifier", _S), T.StructField("type_only", T.BooleanType())])
SYNTAX = T.StructType([T.StructField("imports", T.ArrayType(_IMPORT)), T.StructField("exports", T.ArrayType(_S))])
_DEP = T.StructType([T.StructField(c, _S) for c in ("field", "name", "spec")])
_ENTRY = T.StructType([T.StructField(c, _S) for c in ("field", "target", "relation")])
MANIFEST = T.StructType([T.StructField("name", _S), T.StructField("version", _S), T.StructField("dependencies", T.ArrayType(_DEP)), T.StructField("entrypoints", T.ArrayType(_ENTRY)), T.StructField("problem", _S)])

# fixed values
DEPENDENCY_FIELDS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
ENTRY_FIELDS = ("main", "module", "types", "typings", "bin")

_DECLARED = ("function", "class", "interface", "type", "enum")
_BOUND = ("const", "let", "var", "using")
_SAYS = frozenset(("import", "export", "require"))
_LITERAL = ("string", "template")
_GOES_ON = ("in", "instanceof", "as", "satisfies")
_TYPE_MARKS = ("|", "&", "<")


class _Module:
    """The import and export statements of one list of tokens, and its calls."""

    def __init__(self, found: list[Token]):
        self.t = [*found, *[Token("end", "", 0, True)] * 4]
        self.imports: dict[tuple[str, str], bool] = {}
        self.exports: set[str] = set()
        self.spent: set[int] = set()  # the require of an import-equals is no call
        words = [(i, text, depth) for i, (kind, text, depth, _) in enumerate(found) if text in _SAYS and kind == "word"]
        for i, text, depth in words:
            if depth == 0 and text != "require" and not self.is_mark(i - 1, ".", "?.", "@"):
                (self.import_ if text == "import" else self.export)(i + 1)
        for i, text, _ in words:
            if text != "export" and i not in self.spent:
                self.call(i)

    def is_mark(self, i: int, *marks: str) -> bool:
        return i >= 0 and self.t[i].kind == "mark" and self.t[i].text in marks

    def is_word(self, i: int, *words: str) -> bool:
        return self.t[i].kind == "word" and (not words or self.t[i].text in words)

    def add(self, relation: str, i: int, type_only: bool) -> None:
        key = (relation, self.t[i].text)
        # the same specifier by type and by value is one fact, a value import
        self.imports[key] = self.imports.get(key, True) and type_only

    # ------------------------------------------------------------ statements
    def import_(self, i: int) -> None:
        if self.t[i].kind == "string":
            return self.add("import", i, False)
        if self.is_mark(i, "(", "."):
            return None
        type_only = self.is_word(i, "type") and not self.is_mark(i + 1, ",", "=") and (not self.is_word(i + 1, "from") or self.is_word(i + 2, "from") or self.is_mark(i + 2, "="))
        i += type_only
        if self.is_word(i) and self.is_mark(i + 1, "="):
            if self.is_word(i + 2, "require") and self.is_mark(i + 3, "(") and self.t[i + 4].kind in _LITERAL:
                self.spent.add(i + 2)
                self.add("import-equals", i + 4, type_only)
            return None
        while not self.is_word(i, "from") or self.t[i + 1].kind != "string":
            if self.t[i].depth == 0 and not (self.is_word(i) or self.is_mark(i, "*", ",", "{", "}")):
                return None
            i += 1
        return self.add("import", i + 1, type_only)

    def export(self, i: int) -> None:
        if self.is_mark(i, "="):
            self.exports.add("default")
            return
        if self.is_word(i, "import"):
            return self.import_(i + 1)
        type_only = self.is_word(i, "type") and self.is_mark(i + 1, "{", "*")
        i += type_only
        if self.is_mark(i, "*"):
            i += 1
            if self.is_word(i, "as"):
                self.exports.add(self.t[i + 1].text)
                i += 2
            return self.reexport(i, type_only)
        if self.is_mark(i, "{"):
            end = self.closing(i)
            for a, b in self.elements(i, end):
                if b > a:
                    self.exports.add(self.t[b - 1].text)
            return self.reexport(end + 1, type_only)
        if default := self.is_word(i, "default"):
            self.exports.add("default")
            i += 1
        while self.is_mark(i, "@"):
            i += 2
            while self.is_mark(i, ".", "("):
                i = self.closing(i) + 1 if self.is_mark(i, "(") else i + 2
        while self.is_word(i, "declare", "abstract", "async", "await") and self.is_word(i + 1) and not self.t[i + 1].fresh:
            i += 1
        if self.is_word(i, "const") and self.is_word(i + 1, "enum"):
            i += 1
        if self.is_word(i, *_DECLARED):
            i += 1 + self.is_mark(i + 1, "*")
            if self.is_word(i) and not self.is_word(i, "extends", "implements"):
                self.exports.add(self.t[i].text)
        elif self.is_word(i, *_BOUND) and not default:
            self.declarators(i + 1)

    def reexport(self, i: int, type_only: bool) -> None:
        if self.is_word(i, "from") and self.t[i + 1].kind == "string":
            self.add("reexport", i + 1, type_only)

    # -------------------------------------------------------------- bindings
    def closing(self, i: int) -> int:
        """The mark that closes the one at ``i``, or the end."""
        depth = self.t[i].depth
        i += 1
        while self.t[i].kind != "end" and self.t[i].depth > depth:
            i += 1
        return i

    def elements(self, i: int, end: int) -> Iterator[tuple[int, int]]:
        """(start, end) of the parts between commas inside the brackets at ``i``."""
        depth, a = self.t[i].depth + 1, i + 1
        for k in range(i + 1, end + 1):
            if k == end or self.t[k].depth == depth and self.is_mark(k, ","):
                yield a, k
                a = k + 1

    def binding(self, i: int) -> int:
        """Adds the names that a binding pattern binds; its end."""
        if not self.is_mark(i, "{", "["):
            if self.is_word(i):
                self.exports.add(self.t[i].text)
            return i + 1
        end = self.closing(i)
        for a, b in self.elements(i, end):
            a += self.is_mark(a, "...")
            if self.is_mark(i, "{") and a < b:
                key_end = self.closing(a) + 1 if self.is_mark(a, "[") else a + 1
                a = key_end + 1 if self.is_mark(key_end, ":") else a
            if a < b:
                self.binding(a)
        return end + 1

    def declarators(self, i: int) -> None:
        while True:
            i = self.binding(i)
            i += self.is_mark(i, "!")
            if self.is_mark(i, ":"):
                i = self.type_end(i + 1)
            if self.is_mark(i, "="):
                i = self.value_end(i + 1)
            if not self.is_mark(i, ","):
                return
            i += 1

    def type_end(self, i: int) -> int:
        angles = 0
        while self.t[i].kind != "end":
            x = self.t[i]
            if x.depth == 0:
                angles += self.is_mark(i, "<") - (angles > 0 and self.is_mark(i, ">"))
                if not angles and (self.is_mark(i, ",", "=", ";") or x.fresh and x.kind == "word" and not self.is_mark(i - 1, ":", "=>", *_TYPE_MARKS) and not self.is_word(i - 1, "keyof", "typeof", "readonly", "infer", "extends", "is") and not self.is_word(i, "extends", "is")):
                    return i
            i += 1
        return i

    def value_end(self, i: int) -> int:
        """Where an initialiser ends: a comma, a semicolon, or a line after which nothing goes on."""
        begin = i
        while self.t[i].kind != "end":
            x = self.t[i]
            if x.depth == 0:
                if self.is_mark(i, ",", ";"):
                    return i
                if i > begin and x.fresh and self.ends_value(i - 1) and (x.kind in ("word", "number", "string") and not self.is_word(i, *_GOES_ON) or self.is_mark(i, "{", "@", "}", "++", "--")):
                    return i
                if self.is_mark(i, "<") and (end := self.type_arguments(i)):
                    i = end
            i += 1
        return i

    def ends_value(self, i: int) -> bool:
        x = self.t[i]
        return x.kind not in ("mark", "word") or self.is_mark(i, ")", "]", "}", "++", "--", "!", ">") or x.kind == "word" and x.text not in ("return", "typeof", "in", "of", "delete", "void", "new", "instanceof", "yield", "await", "extends", "as", "satisfies", "async")

    def type_arguments(self, i: int) -> int:
        """The ``>`` of the type arguments or parameters that ``<`` opens; 0 if it compares."""
        depth, angles = self.t[i].depth, 0
        while self.t[i].kind != "end":
            if self.t[i].depth == depth:
                angles += self.is_mark(i, "<") - self.is_mark(i, ">")
                if not angles:
                    after = self.t[i + 1]
                    return i if after.kind == "template" or after.kind == "end" or self.is_mark(i + 1, "(", ")", "]", ",", ";", "{", ".") or after.fresh else 0
                if self.t[i].kind == "value" or self.is_mark(i, ";", "=", "==", "===", "&&", "||", "??", "+", "-", "*", "/", "%", "++", "--"):
                    return 0
            i += 1
        return 0

    # ----------------------------------------------------------------- calls
    def call(self, i: int) -> None:
        """``import("x")`` and ``require("x")`` where a value stands, not a type."""
        name, k = self.t[i].text, i + 1
        k += name == "require" and self.is_mark(k, "?.")
        if not self.is_mark(k, "(") or self.t[k + 1].kind not in _LITERAL or not self.is_mark(k + 2, ",", ")"):
            return
        if self.is_mark(i - 1, ".", "?.", "#") or i and self.is_word(i - 1, "function", "new" if name == "require" else "function"):
            return
        if name == "import" and self.in_type(i):
            return
        self.add("dynamic-import" if name == "import" else "require", k + 1, False)

    def in_type(self, i: int) -> bool:
        """Whether ``import`` at ``i`` stands for a type: ``let a: import("x").A``."""
        if not i:
            return False
        if self.is_word(i - 1, "typeof", "keyof", "as", "satisfies", "implements", "is", "readonly", "infer") or self.is_mark(i - 1, *_TYPE_MARKS):
            return True
        depth = self.t[i].depth
        if self.is_mark(i - 1, "="):  # type A<B> = import("x").A
            k = i - 2
            while k > 0 and not (self.t[k].depth == depth and self.is_mark(k, ";", "{", "}", "=") or self.t[k].depth < depth):
                if self.is_word(k, "type") and self.is_word(k + 1) and not self.is_mark(k - 1, "."):
                    return True
                if self.t[k].fresh and not self.is_mark(k, "|", "&", "<"):
                    break
                k -= 1
            return self.is_word(k, "type") and self.is_word(k + 1)
        if not self.is_mark(i - 1, ":"):
            return False
        k, seen = i - 2, 0  # a colon: of a conditional, of a property or label, or of a type
        while k >= 0 and self.t[k].depth >= depth:
            if self.t[k].depth == depth:
                if self.is_mark(k, ";", "=>"):
                    return not self.is_mark(k, "=>")
                if self.is_mark(k, "?") and not self.is_mark(k + 1, ":"):
                    if not seen:
                        return False
                    seen -= 1
                elif self.is_mark(k, ":"):
                    seen += 1
                elif self.is_word(k, "case", "default"):
                    return False
                elif self.is_word(k, "let", "const", "var"):
                    return True
            k -= 1
        if k < 0 or not self.is_mark(k, "{"):
            return True  # a parameter, a variable, or what a function returns
        return not (self.is_mark(k - 1, "=", "(", ",", "[", ":", "?", "&&", "||", "??", "...") or k > 0 and self.is_word(k - 1, "return", "default"))


def scan(text: str, script: str = "ts") -> dict:
    """{"imports": [...], "exports": [...]} of one source text of a script kind (ts, tsx, js, jsx)."""
    m = _Module(tokens(text, script))
    return {"imports": [{"relation": r, "specifier": s, "type_only": t} for (r, s), t in sorted(m.imports.items())], "exports": sorted(m.exports)}


def _targets(value, path: list[str]):
    if isinstance(value, str):
        yield ".".join(path), value, "contract" if "types" in path else "build-entrypoint"
    elif isinstance(value, dict):
        for k in sorted(value):
            yield from _targets(value[k], [*path, k])
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _targets(v, [*path, str(i)])


def manifest(text: str) -> dict:
    """Name, version, dependencies and entry points of a package manifest."""
    empty = {"name": None, "version": None, "dependencies": [], "entrypoints": [], "problem": None}
    try:
        doc = json.loads(text)
    except ValueError as e:
        return empty | {"problem": f"not JSON: {e}"}
    if not isinstance(doc, dict):
        return empty | {"problem": "not an object"}
    word = lambda k: doc[k] if isinstance(doc.get(k), str) and doc[k] else None
    deps = [{"field": f, "name": n, "spec": s} for f in DEPENDENCY_FIELDS if isinstance(doc.get(f), dict) for n, s in sorted(doc[f].items()) if isinstance(s, str)]
    entries = []
    for f in ENTRY_FIELDS:
        if f == "bin" and isinstance(doc.get(f), dict):
            entries += [(f"bin.{k}", v, "build-entrypoint") for k, v in sorted(doc[f].items()) if isinstance(v, str)]
        elif isinstance(doc.get(f), str):
            entries.append((f, doc[f], "contract" if f in ("types", "typings") else "build-entrypoint"))
    entries += _targets(doc.get("exports"), ["exports"])
    return {"name": word("name"), "version": word("version"), "dependencies": deps, "entrypoints": [dict(zip(("field", "target", "relation"), e)) for e in entries], "problem": None}


@F.pandas_udf(SYNTAX)
def syntax_of(text: pd.Series, script: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan(t or "", k) for t, k in zip(text, script)], columns=["imports", "exports"])


# else an explode of the names would have each text read twice, once to filter empty lists,
# and that in the few tasks which read the table
syntax_of = syntax_of.asNondeterministic()


@F.pandas_udf(MANIFEST)
def manifest_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([manifest(t or "") for t in text], columns=MANIFEST.names)
