"""Scanners of style sheets, scripts and XML, as Arrow-optimised UDFs over pure Python functions."""

from __future__ import annotations

import re
from xml.parsers import expat

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits on parsed resources.
MAX_REFERENCES = 20_000
MAX_NESTING = 4_096
MAX_ELEMENTS = 200_000
MAX_DEPTH = 4_096
MAX_TEXT = 64 << 20


class BudgetError(ValueError):
    """A resource goes beyond a limit."""


_CSS = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:\\(?:\r\n|.)|[^"\\\n\r\f])*"|'(?:\\(?:\r\n|.)|[^'\\\n\r\f])*')
    |(?P<url>(?i:url)\(\s*(?:(?P<quoted>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<bare>(?:\\.|[^"'()\\\s])*))\s*\))
    |(?P<call>[-\w\\][-\w]*\()
    |(?P<at>@[-\w]+)
    |(?P<word>[-\w]+)
    |(?P<space>\s+)
    |(?P<mark>.)""",
    re.VERBOSE | re.DOTALL,
)
_CSS_ESCAPE = re.compile(r"\\(?:([0-9A-Fa-f]{1,6})(?:\r\n|[ \t\r\n\f])?|(\r\n|[\n\r\f])|(.))", re.DOTALL)


def css_unescape(value: str) -> str:
    def one(found: re.Match) -> str:
        code, end, plain = found.groups()
        if code:
            point = int(code, 16)
            return "�" if point == 0 or point > 0x10FFFF or 0xD800 <= point <= 0xDFFF else chr(point)
        return "" if end else plain

    return _CSS_ESCAPE.sub(one, value)


def css_references(style: str) -> list[str]:
    """References of a style sheet: urls, imports, and the first string of each candidate of an image set."""
    found: dict[str, None] = {}
    #: One entry per open bracket: None, or whether an image set still waits for a candidate.
    open_: list[bool | None] = []
    importing = skipping = False
    for token in _CSS.finditer(style):
        kind = token.lastgroup if token.lastgroup not in ("quoted", "bare") else "url"
        if kind in ("comment", "space"):
            continue
        text = token[0]
        if skipping:
            skipping = text != ";"
            continue
        taken = None
        if kind == "url":
            taken = token["quoted"][1:-1] if token["quoted"] is not None else token["bare"]
        elif kind == "string" and (importing or (open_ and open_[-1] is True)):
            taken = text[1:-1]
        if taken:
            found[css_unescape(taken)] = None
            if len(found) > MAX_REFERENCES:
                raise BudgetError("resource reference budget exceeded")
        importing = False
        if kind == "at":
            importing, skipping = text.lower() == "@import", text.lower() == "@namespace"
        elif kind == "mark" and text == ",":
            if open_ and open_[-1] is not None:
                open_[-1] = True
            continue
        elif kind == "mark" and text == ")":
            if open_:
                open_.pop()
            continue
        if open_ and open_[-1] is not None:
            open_[-1] = False
        if kind == "call" or text == "(":
            open_.append(True if text.lower() in ("image-set(", "-webkit-image-set(") else None)
            if len(open_) > MAX_NESTING:
                raise BudgetError("CSS nesting budget exceeded")
    return sorted(found)


_JS = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\$]|\$(?!\{))*`)
    |(?P<template>`(?:\\.|[^`\\])*`)
    |(?P<name>[A-Za-z_$][\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<space>\s+)
    |(?P<mark>=>|===?|!==?|\?\.|\.\.\.|.)""",
    re.VERBOSE | re.DOTALL,
)
_JS_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|\n)|(.))", re.DOTALL)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_GLOBALS = ("window", "self", "globalThis")


def js_text(literal: str) -> str:
    def one(found: re.Match) -> str:
        long, four, two, end, plain = found.groups()
        code = long or four or two
        if code:
            return chr(min(int(code, 16), 0x10FFFF))
        return "" if end else _PLAIN.get(plain, plain)

    return _JS_ESCAPE.sub(one, literal[1:-1])


class _Script:
    """One pass over the tokens of a script.

    Block scopes are kept as a stack of names; a name is a constant text, another name for a path such as ``fetch``,
    or unknown.  The value of a binding that is assigned again is the last one before its use.
    """

    def __init__(self, source: str):
        self.tokens = [(t.lastgroup, t[0]) for t in _JS.finditer(source) if t.lastgroup not in ("comment", "space")]
        self.scopes: list[dict[str, tuple[str, str] | None]] = [{}]
        self.found: dict[str, None] = {}

    def at(self, i: int) -> tuple[str, str]:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ("", "")

    def lookup(self, name: str) -> tuple[str, str] | None:
        for scope in reversed(self.scopes):
            if name in scope:
                return scope[name]
        return ("path", name)

    def path(self, i: int) -> tuple[str | None, int]:
        """A dotted path from token ``i`` with aliases resolved, and the token after it."""
        if self.at(i)[0] != "name":
            return None, i
        known = self.lookup(self.at(i)[1])
        i += 1
        parts = known[1].split(".") if known and known[0] == "path" else [None]
        while True:
            kind, text = self.at(i)
            if text in (".", "?.") and self.at(i + 1)[0] == "name":
                parts.append(self.at(i + 1)[1])
                i += 2
            elif text == "[" and self.at(i + 1)[0] == "string" and self.at(i + 2)[1] == "]":
                parts.append(js_text(self.at(i + 1)[1]))
                i += 3
            else:
                break
        while len(parts) > 1 and parts[0] in _GLOBALS:
            parts.pop(0)
        return (None if None in parts else ".".join(parts)), i

    def constant(self, i: int) -> tuple[str | None, int]:
        """A constant text from token ``i``: literals and constant names joined by plus; and the token after it."""
        out: str | None = ""
        while True:
            kind, text = self.at(i)
            if kind == "string":
                out = None if out is None else out + js_text(text)
                i += 1
            elif kind == "name":
                known = self.lookup(text)
                out = out + known[1] if out is not None and known and known[0] == "text" else None
                i += 1
            elif text == "(":
                value, after = self.constant(i + 1)
                if self.at(after)[1] != ")":
                    return None, i
                out = None if out is None or value is None else out + value
                i = after + 1
            else:
                return None, i
            if self.at(i)[1] != "+":
                return out, i
            i += 1

    def arguments(self, i: int) -> list[str | None]:
        """Constant arguments of a call whose bracket is token ``i``; null for others."""
        out: list[str | None] = []
        i += 1
        while i < len(self.tokens) and self.at(i)[1] != ")":
            value, after = self.constant(i)
            ends = self.at(after)[1] in (",", ")")
            out.append(value if ends else None)
            depth = 0
            while i < len(self.tokens) and not (depth == 0 and self.at(i)[1] in (",", ")")):
                depth += (self.at(i)[1] in "([{") - (self.at(i)[1] in ")]}") if self.at(i)[0] == "mark" else 0
                i += 1
            if self.at(i)[1] == ",":
                i += 1
        return out

    def add(self, value: str | None) -> None:
        if value:
            self.found[value] = None
            if len(self.found) > MAX_REFERENCES:
                raise BudgetError("resource reference budget exceeded")

    def bind(self, name: str, i: int) -> None:
        """Give ``name`` the value that starts at token ``i``."""
        text, after = self.constant(i)
        ends = (";", ",", "", "}", ")")
        value: tuple[str, str] | None = None
        if text is not None and (self.at(after)[1] in ends or self.at(after)[0] == "name"):
            value = ("text", text)
        else:
            start = i + 1 if self.at(i)[1] == "new" else i
            path, after = self.path(start)
            if start > i and path == "XMLHttpRequest":
                value = ("path", "XMLHttpRequest#")
            elif path is not None and start == i and (self.at(after)[1] in ends or self.at(after)[0] == "name"):
                value = ("path", path)
        for scope in reversed(self.scopes):
            if name in scope:
                scope[name] = value
                return
        self.scopes[0][name] = value

    def run(self) -> list[str]:
        i = 0
        while i < len(self.tokens):
            kind, text = self.at(i)
            if text == "{":
                self.scopes.append({})
            elif text == "}" and len(self.scopes) > 1:
                self.scopes.pop()
            elif kind == "name" and self.at(i - 1)[1] not in (".", "?."):
                i = self.name(i, text)
                continue
            i += 1
        return sorted(self.found)

    def name(self, i: int, text: str) -> int:
        if text in ("const", "let", "var") and self.at(i + 1)[0] == "name":
            self.scopes[-1][self.at(i + 1)[1]] = None
            if self.at(i + 2)[1] == "=":
                self.bind(self.at(i + 1)[1], i + 3)
                return i + 3
            return i + 2
        if text == "import" and self.at(i + 1)[0] == "string":
            self.add(js_text(self.at(i + 1)[1]))
            return i + 2
        if text == "import" and self.at(i + 1)[1] == "(":
            self.add(next(iter(self.arguments(i + 1)), None))
            return i + 2
        if text == "from" and self.at(i + 1)[0] == "string":
            self.add(js_text(self.at(i + 1)[1]))
            return i + 2
        if self.at(i + 1)[1] == "=" and self.at(i - 1)[1] not in ("const", "let", "var"):
            self.bind(text, i + 2)
            return i + 2
        path, after = self.path(i)
        if self.at(after)[1] == "(" and path:
            values = self.arguments(after)
            if path.endswith((".call", ".apply")) and path.rpartition(".")[0] in ("open", "document.open", "fetch"):
                path, values = path.rpartition(".")[0], values[1:]
            if path in ("fetch", "Worker", "SharedWorker"):
                self.add(next(iter(values), None))
            elif path == "importScripts":
                for value in values:
                    self.add(value)
            elif path == "XMLHttpRequest#.open" and len(values) > 1:
                self.add(values[1])
            elif path in ("open", "document.open") and values and (values[0] or "").lower().startswith(("data:", "file:")):
                raise ValueError(f"{values[0].partition(':')[0].lower()} URL in a browsing context")
        return max(after, i + 1)


def js_references(source: str) -> list[str]:
    """Constant references of a script: imports, exports, fetch, workers, importScripts and requests."""
    return _Script(source).run()


def xml_rows(source: bytes) -> list[tuple]:
    """(node, parent, depth, namespace, name, attributes, text) in document order; entities are refused."""
    parser = expat.ParserCreate(namespace_separator="}")
    rows: list[list] = []
    stack: list[int] = []
    size = 0

    def start(name: str, attributes: dict[str, str]) -> None:
        if len(rows) >= MAX_ELEMENTS or len(stack) >= MAX_DEPTH:
            raise BudgetError("XML element budget exceeded")
        namespace, _, local = name.rpartition("}")
        rows.append([len(rows), stack[-1] if stack else None, len(stack), namespace, local, attributes, ""])
        stack.append(len(rows) - 1)

    def data(text: str) -> None:
        nonlocal size
        size += len(text)
        if size > MAX_TEXT:
            raise BudgetError("XML text budget exceeded")
        rows[stack[-1]][6] += text

    def refuse(*_: object) -> None:
        raise BudgetError("entity declarations are refused")

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = data
    parser.EntityDeclHandler = refuse
    parser.buffer_text = True
    parser.Parse(source, True)
    return [tuple(r) for r in rows]


def _guarded(function, value):
    """(result, problem) of a scanner."""
    if value is None:
        return None, None
    try:
        return function(value), None
    except (ValueError, expat.ExpatError) as problem:
        return None, str(problem)


_REFS = "struct<refs:array<string>,problem:string>"
_ROWS = "array<struct<node:int,parent:int,depth:int,namespace:string,name:string,attributes:map<string,string>,text:string>>"


def css_refs(style: Column) -> Column:
    """Struct of the ``refs`` of a style sheet, or the ``problem``."""
    return F.udf(lambda x: _guarded(css_references, x), _REFS, useArrow=True)(style)


def js_refs(script: Column) -> Column:
    """Struct of the ``refs`` of a script, or the ``problem``."""
    return F.udf(lambda x: _guarded(js_references, x), _REFS, useArrow=True)(script)


def xml_flatten(content: Column) -> Column:
    """Struct of the element ``rows`` of an XML document, or the ``problem``."""
    return F.udf(lambda x: _guarded(xml_rows, bytes(x) if x is not None else None), f"struct<rows:{_ROWS},problem:string>", useArrow=True)(content)
