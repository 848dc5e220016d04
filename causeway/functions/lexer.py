"""Tokens of TypeScript and JavaScript texts.

A stack of what is open (braces, parentheses, template texts and their ``${}``, JSX
tags and children) tells what the next character may begin: after a value ``/``
divides, elsewhere it opens a regular expression, and ``<`` opens a JSX element where
the script kind has them. An element that is never closed was none; lexing goes on
behind its ``<``. Texts that no parser would take give some tokens, never an error.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    """``kind``: word, number, string, template (without substitutions), value (any
    other literal) or mark; ``depth``: how many brackets are open around it; ``fresh``:
    a line ends before it."""

    kind: str
    text: str
    depth: int
    fresh: bool


# fixed values: script kinds by a file's ending, and those that have JSX
SCRIPTS = {".tsx": "tsx", ".jsx": "jsx", ".js": "js", ".mjs": "js", ".cjs": "js"}
JSX = ("tsx", "jsx", "js")
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof yield await default extends export import from as".split())
_BEFORE_OBJECT = _BEFORE_VALUE - {"else", "do"}
_CONDITIONS = frozenset(("if", "while", "for", "with"))

#: One space before a token is passed with it.
_NEXT = re.compile(
    r"""\x20?(?:(?P<word>(?!\d)[\w$\u200c\u200d]+)|(?P<blank>[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<number>\d[\w.]*)
    |(?P<mark>=>|===|==|\.\.\.|\?\.(?!\d)|\?\?|&&|\|\||\+\+|--|.))""",
    re.S | re.X,
)
_LINE = re.compile(r"[\n\r\u2028\u2029]")
_OPEN_OR_SET = frozenset((",", ";", ".", "=", ":", "=>", "?", "...", "?.", "|", "&", "*", "+", "-", "===", "==", "&&", "||", "??", "@", "#"))  # begin a value, open and close nothing
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\\?\Z)", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\s+[^=\s]|=)")
_ELEMENT = re.compile(r"<\s*(?:[\w$][\w$.:-]*|(?=>))")
_TAG = re.compile(r"""(?P<blank>[\s]+|//[^\n]*|/\*.*?\*/)|(?P<name>[\w$][\w$.:-]*|=)|(?P<string>"[^"]*"|'[^']*')|(?P<open>\{)|(?P<empty>/\s*>)|(?P<end>>)""", re.S)
_CLOSING = re.compile(r"<\s*/\s*[\w$.:-]*\s*>")
_CHILD = re.compile(r"[^<{]*")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": "", "\u2028": "", "\u2029": ""}


def cooked(text: str) -> str:
    """What a string literal, given without its quotes, says."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code is None:
            return _PLAIN.get(m[4], m[4])
        return chr(int(code, 16)) if int(code, 16) < 0x110000 else m[0]

    return _ESCAPE.sub(one, text)


def script_of(path: str) -> str:
    return SCRIPTS.get(path[path.rfind(".") :], "ts")


def tokens(text: str, script: str = "ts") -> list[Token]:
    out: list[Token] = []
    open_: list[str] = []  # ( if( { {object ${ ` tag children {jsx
    elements: list[tuple[int, int, int, bool]] = []  # of the outermost open element: (its place, tokens and brackets before it, fresh)
    failed: set[int] = set()
    i, n, value, fresh = (text.find("\n") if text.startswith("#!") and "\n" in text else 0), len(text), False, False
    match, line, put, new = _NEXT.match, _LINE.search, out.append, tuple.__new__

    def add(kind: str, word: str, is_value: bool) -> None:
        nonlocal value, fresh
        out.append(Token(kind, word, len(open_), fresh))
        value, fresh = is_value, False

    def undo() -> None:
        """The element was none: go on behind its ``<``."""
        nonlocal i, fresh, value
        at, k, depth, fresh = elements.pop()
        failed.add(at)
        del out[k:], open_[depth:]
        value, i = False, at

    def ended() -> None:
        """A tag is complete that has no children, or its closing one is."""
        open_.pop()
        if elements and len(open_) == elements[-1][2]:
            elements.pop()
            add("value", "<>", True)

    while True:
        if i >= n:
            if not elements:
                return out
            del elements[1:]
            undo()
        top = open_[-1] if open_ else ""
        if top == "`":
            m = _TEMPLATE.match(text, i)
            i = m.end()
            if m[1] == "${":
                open_.append("${")
                value = False
            else:
                open_.pop()
                add("value", "``", True)
        elif top == "children":
            i = _CHILD.match(text, i).end()
            if i < n and text[i] == "{":
                open_.append("{jsx")
                i, value = i + 1, False
            elif i < n and (m := _CLOSING.match(text, i)):
                i = m.end()
                ended()
            elif i < n and (m := _ELEMENT.match(text, i)):
                i = m.end()
                open_.append("tag")
            else:
                i = n
        elif top == "tag":
            m = _TAG.match(text, i)
            if m is None:
                i = n
                continue
            i = m.end()
            if m.lastgroup == "open":
                open_.append("{jsx")
                value = False
            elif m.lastgroup == "empty":
                ended()
            elif m.lastgroup == "end":
                open_[-1] = "children"
        else:
            m = match(text, i)
            kind = m.lastgroup
            word = m[kind]
            if kind == "blank":
                fresh = fresh or line(word) is not None
                i = m.end()
                continue
            if kind == "word":
                value = word not in _BEFORE_VALUE or bool(out) and out[-1][1] in (".", "?.") and out[-1][0] == "mark"
                put(new(Token, (kind, word, len(open_), fresh)))
                i, fresh = m.end(), False
                continue
            if word in _OPEN_OR_SET:
                put(new(Token, ("mark", word, len(open_), fresh)))
                i, value, fresh = m.end(), False, False
                continue
            i = m.start(kind)
            if word == "/" and not value and (r := _REGEX.match(text, i)):
                i = r.end()
                add("value", r[0], True)
                continue
            if word == "<" and not value and script in JSX and i not in failed and not _GENERIC.match(text, i) and (e := _ELEMENT.match(text, i)):
                elements.append((i, len(out), len(open_), fresh))
                open_.append("tag")
                i = e.end()
                continue
            i = m.end()
            last = out[-1] if out else None
            if kind == "string":
                add("string", cooked(word[1:-1]), True)
            elif kind == "number":
                add("number", word, True)
            elif word == "`":
                t = _TEMPLATE.match(text, i)
                if t[1] == "`":
                    i = t.end()
                    add("template", cooked(t[0][:-1]), True)
                else:
                    open_.append("`")
            elif word in "([{":
                if word == "(" and last is not None and last.kind == "word" and last.text in _CONDITIONS:
                    what = "if("
                elif word == "{":
                    object_ = not value and last is not None and (last.kind == "mark" and last.text not in ("=>", ")", ";", "{", "}") or last.kind == "word" and last.text in _BEFORE_OBJECT)
                    what = "{object" if object_ else "{"
                else:
                    what = word
                add("mark", word, False)
                open_.append(what)
            elif word in ")]}":
                what = open_.pop() if open_ else word
                if what in ("${", "{jsx") and word == "}":
                    value = False
                    continue
                add("mark", word, word == "]" or what in ("(", "{object"))
            else:
                add("mark", word, value and word in ("++", "--", "!"))
