"""Functions and classes of a source file, found on its token stream.

Which constructs count, per language:

* Python: every ``def`` and ``class``; a class's own statements belong to it.
* Java: classes, methods and constructors; bodies of methods are not entered,
  those of interfaces, enums, records and anonymous classes are.
* JavaScript: class and function declarations, methods, and arrows that a
  const, let or var binds; bodies of those are not entered.
* C++: classes with a body and function definitions; namespaces, structs and
  templates are transparent, function bodies are not entered.

A file of a brace language whose brackets do not match gives nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from corpusmill.functions.lexer import Source, lex, python_lines

#: Nesting of syntax after which a walk goes no deeper.
DEPTH = 200
UNKNOWN = "unknown"


@dataclass
class Definition:
    kind: str  # function or class
    name: str
    parent: str | None
    first: int  # token where it starts; for Python without decorators
    last: int
    head: int  # token after its header: the body's opening, or last + 1
    source_first: int
    name_at: int = -1
    params: tuple[int, int] | None = None  # opening and closing bracket
    value: bool = False  # a JavaScript arrow
    constructor: bool = False  # a Java constructor
    source_last: int = -1  # where its source ends, if not at last
    marks: list[str] = field(default_factory=list)  # decorators or annotations
    alone: bool = False  # its syntax node has no comment sibling before it
    qualifier: str | None = None
    members: list[Definition] = field(default_factory=list)


# ---------------------------------------------------------------- Python


def _python_blocks(lines: list[tuple[int, int, int]]) -> list[int]:
    """For each logical line, the line after the block that it opens (its own next line if none)."""
    ends, open_ = [0] * len(lines), []
    for k, (indent, _, _) in enumerate(lines):
        while open_ and lines[open_[-1]][0] >= indent:
            ends[open_.pop()] = k
        open_.append(k)
    for k in open_:
        ends[k] = len(lines)
    return ends


def _python(src: Source) -> Iterator[Definition]:
    lines, tokens = python_lines(src), src.tokens
    ends = _python_blocks(lines)

    def walk(lo: int, hi: int, parent: str | None, depth: int, into: list[Definition] | None) -> Iterator[Definition]:
        k, marks = lo, []
        while k < hi:
            _, a, b = lines[k]
            word = tokens[a].text
            at = a + 1 if word == "async" and a + 1 < b else a
            if word == "@":
                marks.append((a, b))
                k += 1
                continue
            inside = depth + len(marks[:1])
            if tokens[at].text in ("def", "class") and at + 1 < b and tokens[at + 1].kind == "name" and inside <= DEPTH:
                kind = "function" if tokens[at].text == "def" else "class"
                colon = next((i for i in _flat(src, at, b) if tokens[i].text == ":" and tokens[i].kind == "sign"), b - 1)
                end = ends[k]
                last = lines[end - 1][2] - 1
                paren = next((i for i in range(at + 2, colon) if tokens[i].text == "("), None)
                d = Definition(kind, tokens[at + 1].text, parent, a, last, colon, marks[0][0] if marks else a, at + 1, (paren, src.partner[paren]) if paren is not None and paren in src.partner else None, marks=[src.slice(x, y - 1) for x, y in marks])
                yield d
                if into is not None and kind == "function":
                    into.append(d)
                yield from walk(k + 1, end, d.name if kind == "class" else parent, inside + (2 if kind == "function" else 1), d.members if kind == "class" else None)
                k = end
            else:
                compound = ends[k] > k + 1
                if compound:
                    yield from walk(k + 1, ends[k], parent, depth + 2, None)
                k = ends[k]
            marks = []

    yield from walk(0, len(lines), None, 1, None)


def _flat(src: Source, lo: int, hi: int) -> Iterator[int]:
    """Token indexes from lo to hi outside brackets; an opening bracket is met, its inside is not."""
    i = lo
    while i < hi:
        yield i
        i = src.partner[i] if i in src.partner and src.partner[i] > i else i
        i += 1


# ---------------------------------------------------------------- Java

_JAVA_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
_JAVA_NOT_TYPES = frozenset("return new throw else assert case yield super this package import if while for do switch try catch finally".split())


def _annotations(src: Source, lo: int, hi: int) -> tuple[list[str], list[int]]:
    """Annotations' texts, and the header's other tokens."""
    marks, rest, i, tokens = [], [], lo, src.tokens
    while i < hi:
        if tokens[i].text == "@" and i + 1 < hi and tokens[i + 1].text != "interface":
            j = i + 1
            while j + 2 < hi and tokens[j + 1].text == ".":
                j += 2
            if j + 1 < hi and tokens[j + 1].text == "(":
                j = src.partner[j + 1]
            marks.append(src.slice(i, j))
            i = j + 1
        else:
            rest.append(i)
            i += 1
    return marks, rest


def _past_angles(src: Source, i: int) -> int:
    """The token after a bracketed ``< ... >`` that starts at i."""
    depth = 0
    while i < len(src.tokens):
        t = src.tokens[i].text
        depth += (t == "<") - (t.count(">") if set(t) == {">"} else 0)
        i = src.partner[i] + 1 if t in "([{" and i in src.partner else i + 1
        if depth <= 0:
            return i
    return i


def _java(src: Source) -> Iterator[Definition]:
    tokens, n = src.tokens, len(src.tokens)
    text = lambda i: tokens[i].text if 0 <= i < n else ""

    def walk(lo: int, hi: int, parent: str | None, owner: str | None, into: list[Definition] | None, level: int) -> Iterator[Definition]:
        i = start = lo
        while i < hi:
            t = tokens[i]
            if t.text == "@" and text(i + 1) != "interface":
                j = i + 1
                while text(j + 1) == ".":
                    j += 2
                i = src.partner[j + 1] + 1 if text(j + 1) == "(" else j + 1
            elif t.text in ("class", "interface", "enum", "record") and text(i - 1) != "." and i + 1 < hi and tokens[i + 1].kind == "name" and (t.text != "record" or text(i + 2) in ("(", "<")):
                body = next((k for k in _flat(src, i + 2, hi) if tokens[k].text == "{"), None)
                if body is None:
                    i += 1
                    continue
                end = src.partner[body]
                if t.text == "class":
                    marks, _ = _annotations(src, start, i)
                    d = Definition("class", tokens[i + 1].text, parent, start, end, body, start, i + 1, marks=marks)
                    yield d
                    if level <= DEPTH:
                        yield from walk(body + 1, end, d.name, d.name, d.members, level + 2)
                elif level <= DEPTH:
                    yield from walk(body + 1, end, parent, tokens[i + 1].text, None, level + 2)
                i = start = end + 1
            elif t.kind == "name" and text(i + 1) == "(" and (found := method(start, i, hi, owner)):
                marks, head, last, plain = found
                d = Definition("function", t.text, parent, start, last, head, start, i, (i + 1, src.partner[i + 1]), marks=marks)
                yield d
                d.constructor = plain
                if into is not None:
                    into.append(d)
                i = start = last + 1
            else:
                i += 1
                if t.text in (";", "{", "}"):
                    start = i

    def method(start: int, at: int, hi: int, owner: str | None) -> tuple[list[str], int, int, bool] | None:
        k = src.partner[at + 1] + 1
        while text(k) == "[":
            k = src.partner[k] + 1
        if text(k) == "throws":
            while k < hi and text(k) not in ("{", ";"):
                k += 1
        if text(k) == "default":
            while k < hi and text(k) != ";":
                k = src.partner[k] + 1 if text(k) in ("(", "{", "[") else k + 1
        if text(k) not in ("{", ";"):
            return None
        marks, rest = _annotations(src, start, at)
        rest = [i for i in rest if text(i) not in _JAVA_MODIFIERS]
        if rest and text(rest[0]) == "<":
            after = _past_angles(src, rest[0])
            rest = [i for i in rest if i >= after]
        last = src.partner[k] if text(k) == "{" else k
        if not rest:
            return (marks, k, last, True) if text(k) == "{" and text(at) == owner else None
        signs = {"<", ">", ">>", ">>>", ".", ",", "?", "[", "]", "&", "@"}
        if any(tokens[i].kind != "name" and text(i) not in signs or text(i) in _JAVA_NOT_TYPES for i in rest):
            return None
        if text(rest[-1]) in (".", ",", "<", "?", "&", "@") or text(rest[0]) in signs:
            return None
        return marks, k, last, False

    yield from walk(0, n, None, None, None, 1)


# ---------------------------------------------------------------- JavaScript

_JS_CONTROL = frozenset("if for while switch catch with function return typeof await super new delete void throw".split())
_JS_ENDS = frozenset(("number", "string", "template", "regex", "name"))
_JS_GO_ON = frozenset(". ( [ , => ? : + - * / % & | ^ && || ?? = == === != !== < > <= >= << >> >>> ?. ** += -= *= /= instanceof in of".split())


def _js_end(src: Source, at: int, hi: int) -> int:
    """The token after a declaration that starts at at: its semicolon, or where a new line cannot continue it."""
    tokens, last = src.tokens, at
    for i in _flat(src, at, hi):
        t = tokens[i]
        if t.text == ";":
            return i + 1
        if i > at + 1 and src.line(t.start) > src.line(tokens[last].end - 1) and t.text not in _JS_GO_ON and t.kind != "template":
            before = tokens[last]
            if before.text in (")", "]", "}") or before.kind in _JS_ENDS and before.text not in ("const", "let", "var", "in", "of", "instanceof", "typeof", "new", "async", "await"):
                return i
        if t.text == "}" or t.text == ")":
            return i
        last = src.partner.get(i, i) if t.text in "([{" else i
    return hi


def _js_arrow(src: Source, at: int, hi: int) -> tuple[int, int, int] | None:
    """First token, arrow sign and parameters' opening bracket (or name) of an arrow function at at."""
    tokens = src.tokens
    first = at
    if at + 1 < hi and tokens[at].text == "async" and (tokens[at + 1].text == "(" or tokens[at + 1].kind == "name"):
        at += 1
    if at >= hi:
        return None
    sign = src.partner[at] + 1 if tokens[at].text == "(" else at + 1
    if tokens[at].text != "(" and tokens[at].kind != "name":
        return None
    return (first, sign, at) if sign < hi and tokens[sign].text == "=>" else None


def _js(src: Source) -> Iterator[Definition]:
    tokens, n = src.tokens, len(src.tokens)
    text = lambda i: tokens[i].text if 0 <= i < n else ""

    def walk(lo: int, hi: int, parent: str | None, into: list[Definition] | None, level: int) -> Iterator[Definition]:
        i = lo
        while i < hi:
            t, before = tokens[i], text(i - 1)
            opens = i == lo or before in (";", "{", "}", "export", "default", ")", "else", "=>") or src.line(t.start) > src.line(tokens[i - 1].end - 1)
            if before in (".", "?."):
                i += 1
            elif t.text == "class":
                body = next((k for k in _flat(src, i + 1, hi) if text(k) == "{"), None)
                if body is None:
                    i += 1
                    continue
                end, named = src.partner[body], tokens[i + 1].kind == "name" and text(i + 1) != "extends"
                if opens and named and before not in ("=", "=>", "return", ",", "("):
                    d = Definition("class", text(i + 1), parent, i, end, body, i, i + 1, alone=before in ("export", "default"))
                    yield d
                    yield from members(body + 1, end, d.name, d.members, level + 2)
                else:
                    yield from members(body + 1, end, parent, None, level + 2)
                i = end + 1
            elif t.text in ("const", "let", "var") and text(i + 1) not in (":", ",", ")", "}", "=", ".") and not (before == "(" and in_loop(i, hi)):
                end = _js_end(src, i, hi)
                yield from bound(i, end, parent)
                i = max(end, i + 1)
            elif (t.text == "function" or t.text == "async" and text(i + 1) == "function") and opens and before not in ("=", "=>", ":", "return", ",", "(", "[", "?", "&&", "||", "new"):
                at = i + (t.text == "async") + 1
                if tokens[at].kind == "name" and text(at + 1) == "(":
                    body = src.partner[at + 1] + 1
                    end = src.partner.get(body, body)
                    yield Definition("function", text(at), parent, i, end, body, i, at, (at + 1, src.partner[at + 1]), alone=before in ("export", "default"))
                    i = end + 1
                else:  # a generator or a nameless one: only its body is walked
                    i = next((k for k in range(at, min(at + 3, hi)) if text(k) == "("), at)
            elif t.kind in ("name", "string") and text(i + 1) == "(" and before in ("{", ",", "async", "get", "set", "*") and text(src.partner[i + 1] + 1) == "{" and t.text not in _JS_CONTROL:
                d = one_method(i, parent)
                yield d
                i = d.last + 1
            else:
                i += 1

    def in_loop(at: int, hi: int) -> bool:
        """Whether a declaration in round brackets heads a for-in or for-of loop."""
        close = src.partner.get(at - 1, hi)
        return not any(text(k) == ";" for k in _flat(src, at, close))

    def one_method(at: int, parent: str | None) -> Definition:
        first = at
        while text(first - 1) in ("async", "get", "set", "static", "*") and first > 0:
            first -= 1
        body = src.partner[at + 1] + 1
        name = tokens[at].text if tokens[at].kind == "name" and not tokens[at].text.startswith("#") else UNKNOWN
        return Definition("function", name, parent, first, src.partner[body], body, first, at, (at + 1, src.partner[at + 1]))

    def members(lo: int, hi: int, parent: str | None, into: list[Definition] | None, level: int) -> Iterator[Definition]:
        if level > DEPTH:
            return
        i = lo
        while i < hi:
            at = i
            if text(at) == "[" and text(src.partner[at] + 1) == "(":  # a computed name
                at = src.partner[at]
            if text(at + 1) == "(" and (tokens[at].kind in ("name", "string", "number") or text(at) == "]") and text(src.partner[at + 1] + 1) == "{":
                d = one_method(at, parent)
                if text(at) == "]":
                    d.name = UNKNOWN
                yield d
                if into is not None:
                    into.append(d)
                i = d.last + 1
            elif text(i) == "=":
                end = next((k for k in range(i + 1, hi) if text(k) == ";"), hi)
                stop = _js_end(src, i + 1, min(hi, end + 1))
                yield from walk(i + 1, stop, parent, None, level + 2)
                i = max(stop, i + 1)
            else:
                i += 1

    def bound(lo: int, hi: int, parent: str | None) -> Iterator[Definition]:
        at = lo + 1
        while at < hi:
            flat = list(_flat(src, at, hi))
            stop = next((k for k in flat if text(k) == ","), hi)
            equals = next((k for k in flat if k < stop and text(k) == "="), None)
            if equals is not None and (arrow := _js_arrow(src, equals + 1, hi)):
                # An arrow's body runs to the next comma of the declaration.
                first, sign, params = arrow
                last = stop - 1 if stop < hi else hi - 1 - (text(hi - 1) == ";")
                name = text(at) if tokens[at].kind == "name" else UNKNOWN
                yield Definition("function", name, parent, first, last, sign + 1, lo, at, (params, src.partner.get(params, params)), value=True, source_last=hi - 1)
            at = stop + 1

    yield from walk(0, n, None, None, 1)


# ---------------------------------------------------------------- C++

_CPP_AFTER = frozenset("const volatile noexcept override final & && throw requires mutable".split())
_CPP_NOT_NAMES = frozenset("if for while switch catch return sizeof alignof decltype new delete throw static_assert alignas noexcept".split())


def _cpp(src: Source) -> Iterator[Definition]:
    tokens, n = src.tokens, len(src.tokens)
    text = lambda i: tokens[i].text if 0 <= i < n else ""

    def after_params(k: int, hi: int) -> tuple[int, int] | None:
        """Where the body or its stand-in starts, and the definition's last token."""
        while k < hi:
            t = text(k)
            if t in _CPP_AFTER:
                k = src.partner[k + 1] + 1 if text(k + 1) == "(" else k + 1
            elif t == "[" and text(k + 1) == "[":
                k = src.partner[k] + 1
            elif t == "->":
                k += 1
                while k < hi and text(k) not in ("{", ";", "="):
                    k = src.partner[k] + 1 if text(k) in ("(", "[") else k + 1
            elif t == ":":
                k += 1
                while k < hi and text(k) not in (";",):
                    if text(k) == "{" and text(k - 1) in (")", "}"):
                        break
                    k = src.partner[k] + 1 if text(k) in ("(", "[", "{") else k + 1
            elif t == "try":
                k += 1
            elif t == "{":
                last = src.partner[k]
                while text(last + 1) == "catch" and text(last + 2) == "(":
                    last = src.partner[src.partner[last + 2] + 1]
                return k, last
            elif t == "=" and text(k + 1) in ("default", "delete") and text(k + 2) == ";":
                return k, k + 2
            else:
                return None
        return None

    def named(i: int) -> tuple[str, int, int, str | None] | None:
        """Name, its first token, opening bracket and qualifier of a declarator whose name ends or starts at i."""
        t = tokens[i]
        if t.text == "operator":
            j = i + 1
            if text(j) == "(" and text(j + 1) == ")":
                j += 2
            while j < n and text(j) != "(":
                j = src.partner[j] + 1 if text(j) == "[" else j + 1
            cast = tokens[i + 1].kind == "name" and text(i + 1) not in ("new", "delete")
            name = src.text[t.start : tokens[j - 1].end] if cast else src.slice(i, j - 1)
        elif t.kind == "name" and text(i + 1) == "(" and t.text not in _CPP_NOT_NAMES:
            j, name = i + 1, t.text
            if text(i - 1) == "~":
                name = "~" + name
        else:
            return None
        first = i - (name[0] == "~")
        qualifier = None
        if text(first - 1) == "::":
            k = first - 2
            if text(k) == ">":  # the arguments of a template
                depth = 0
                while k >= 0:
                    depth += (text(k) == ">") - (text(k) == "<")
                    k -= 1
                    if depth == 0:
                        break
            elif tokens[k].kind == "name":
                qualifier = tokens[k].text
        return name, i, j, qualifier

    def walk(lo: int, hi: int, parent: str | None, into: list[Definition] | None, level: int) -> Iterator[Definition]:
        i = start = lo
        templated = False
        while i < hi:
            t = tokens[i]
            if t.kind == "directive":
                i += 1
                start = i if start == i - 1 else start
            elif t.text == "template" and text(i + 1) == "<":
                i = _past_angles(src, i + 1)
                start, templated = i, True
            elif t.text == "class" and text(i - 1) != "enum":
                k = i + 1
                while text(k) == "[" or tokens[k].kind == "name" and k + 1 < hi and tokens[k + 1].kind == "name" and text(k + 1) != "final":
                    k = src.partner[k] + 1 if text(k) == "[" else k + 1
                body = k
                while body < hi and text(body) not in ("{", ";", "(", ")", "="):
                    body = body + 1
                if text(body) == "{" and body < hi:
                    d = Definition("class", text(k) if tokens[k].kind == "name" else UNKNOWN, parent, i, src.partner[body], body, i, k, alone=templated)
                    yield d
                    if level <= DEPTH:
                        yield from walk(body + 1, d.last, d.name, d.members, level + 2)
                    i = d.last + 1
                    start, templated = (i + 1 if text(i) == ";" else start), False
                else:
                    i = k
            elif (t.text == "operator" or t.kind == "name") and (found := named(i)) and found[2] in src.partner and (where := after_params(src.partner[found[2]] + 1, hi)):
                name, at, paren, qualifier = found
                first = start
                while text(first) in ("public", "private", "protected", "signals", "slots", ":") and first < at:
                    first += 1
                d = Definition("function", name, parent if parent is not None else qualifier, first, where[1], where[0], first, at, (paren, src.partner[paren]), alone=templated, qualifier=qualifier)
                yield d
                if into is not None:
                    into.append(d)
                i = start = where[1] + 1
                templated = False
            else:
                i = src.partner[i] + 1 if t.text in ("(", "[") and i in src.partner else i + 1
                if t.text in (";", "{", "}") or t.text == ":" and text(i - 2) in ("public", "private", "protected"):
                    start, templated = i, False

    yield from walk(0, n, None, None, 1)


_WALKS = {"Python": _python, "Java": _java, "JavaScript": _js, "C++": _cpp}


def find_definitions(text: str, language: str) -> tuple[Source, list[Definition]]:
    """The lexed file and its definitions in source order, a class before its methods."""
    if language not in _WALKS:
        raise ValueError(f"Unsupported language: {language}")
    src = lex(text, language)
    if language != "Python" and not src.balanced:
        return src, []
    return src, list(_WALKS[language](src))


def split_list(src: Source, opening: int, closing: int) -> list[tuple[int, int]]:
    """First and last tokens of the parts between commas within brackets; ``<`` and ``>`` bind for Java and C++."""
    parts, first, depth = [], opening + 1, 0
    for i in _flat(src, opening + 1, closing):
        t = src.tokens[i].text
        if src.language in ("Java", "C++"):
            depth += (t == "<") - (t.count(">") if set(t) == {">"} else 0)
        if t == "," and depth <= 0:
            if i > first:
                parts.append((first, i - 1))
            first = i + 1
    if closing > first:
        parts.append((first, closing - 1))
    return parts


# ---------------------------------------------------------------- texts of a definition


def clean_block_comment(raw: str) -> str | None:
    """A block comment without its signs; nothing left is None."""
    inner = raw.strip().removesuffix("/").rstrip("*").removeprefix("/").lstrip("*").strip()
    return "\n".join(re.sub(r"^\s*\*\s?", "", x) for x in inner.splitlines()).strip() or None


def comment_before(src: Source, d: Definition) -> str | None:
    """The comment right before a definition, as a docstring."""
    if d.alone or d.value or src.language == "Python":
        return None
    near = [c for c in src.comments if c[2] == d.first]
    if not near:
        return None
    raw = src.text[near[-1][0] : near[-1][1]].strip()
    if raw.startswith("/*"):
        return clean_block_comment(raw) if src.language != "JavaScript" or raw.startswith("/**") else None
    return None if src.language == "Java" else raw.lstrip("/").strip() or None


def unquote_python(raw: str) -> str:
    m = re.fullmatch(r"(?is)([rbfu]*)(\"\"\"|'''|\"|')(.*)\2", raw.strip())
    return m[3] if m else raw.strip()


def python_docstring(src: Source, d: Definition, lines: list[tuple[int, int, int]] | None = None) -> str | None:
    """The first statement of the body that is a single string."""
    tokens = src.tokens
    lines = python_lines(src) if lines is None else lines
    body = [(indent, a, b) for indent, a, b in lines if d.head < a <= d.last] or [(0, d.head + 1, d.last + 1)]
    for indent, a, b in body:
        if indent == body[0][0] and tokens[a].kind == "string" and (a + 1 == b or tokens[a + 1].text == ";"):
            return unquote_python(tokens[a].text).strip()
    return None


def clean_indentation(snippet: str) -> str:
    """Lines after the first lose what their least indent has over four."""
    first, *rest = snippet.split("\n")
    cut = min((len(x) - len(x.lstrip()) for x in rest if x.strip()), default=0) - 4
    return "\n".join([first, *(x[cut:] if len(x) >= cut else x for x in rest)]) if cut > 0 else snippet


def python_stub(src: Source, d: Definition) -> str:
    """The def line, rebuilt."""
    tokens = src.tokens
    prefix = "async def " if tokens[d.first].text == "async" else "def "
    params = src.slice(*d.params) if d.params else "()"
    returns = python_returns(src, d)
    return f"{prefix}{d.name}{params}{f' -> {returns}' if returns else ''}:"


def python_returns(src: Source, d: Definition) -> str | None:
    if not d.params or d.params[1] + 1 >= d.head or src.tokens[d.params[1] + 1].text != "->":
        return None
    return src.slice(d.params[1] + 2, d.head - 1)
