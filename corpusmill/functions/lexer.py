"""Tolerant token streams of Python, Java, JavaScript and C++ source.

A file becomes a list of tokens with bracket partners; comments are kept apart
with the index of the token that follows them. Nothing here raises on broken
code: what no rule takes is a sign of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from typing import NamedTuple

LANGUAGES = ("Python", "Java", "JavaScript", "C++")


class Token(NamedTuple):
    kind: str  # name, number, string, char, template, regex, directive, sign
    text: str
    start: int
    end: int


_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_NUMBER = r"\.?\d(?:[eEpP][+-]|['\w.])*"
_STRING = r'"(?:[^"\\\n]|\\[\s\S])*"?'
_CHAR = r"'(?:[^'\\\n]|\\[\s\S])*'?"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_SIGNS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|<=>|->\*|=>|->|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|::|==|!=|<=|>=|<<|\*\*|//=|//|:=|[-+*/%&|^@]=|[\s\S]"
_GRAMMAR = {
    "Python": rf"(?P<comment>\#[^\n]*)|(?P<string>(?:[rRbBfFuUtT]{{1,2}})?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'))|(?P<number>\.?\d(?:[eE][+-]|[\w.])*)|(?P<name>{_NAME})|(?P<sign>\\\n|>>(?!=)|{_SIGNS})",
    "Java": rf'(?P<comment>{_COMMENT})|(?P<string>"""[\s\S]*?(?:"""|\Z)|{_STRING})|(?P<char>{_CHAR})|(?P<number>{_NUMBER})|(?P<name>{_NAME})|(?P<sign>{_SIGNS})',
    "JavaScript": rf"(?P<comment>{_COMMENT})|(?P<string>{_STRING}|{_CHAR})|(?P<number>{_NUMBER})|(?P<name>\#?(?:{_NAME}))|(?P<sign>{_SIGNS})",
    "C++": rf'(?P<comment>{_COMMENT})|(?P<string>(?:u8|[uUL])?R"(?P<fence>[^()\\\s]{{0,16}})\([\s\S]*?\)(?P=fence)"|(?:u8|[uUL])?{_STRING})|(?P<char>(?:u8|[uUL])?{_CHAR})|(?P<number>{_NUMBER})|(?P<name>{_NAME})|(?P<sign>{_SIGNS})',
}
_RULES = {language: re.compile(rf"\s+|{rule}") for language, rule in _GRAMMAR.items()}
_DIRECTIVE = re.compile(r"#(?:[^\n\\]|\\[\s\S])*")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())
_OPENS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Source:
    """A lexed file."""

    language: str
    text: str
    tokens: list[Token] = field(default_factory=list)
    comments: list[tuple[int, int, int]] = field(default_factory=list)  # start, end, index of the token that follows
    partner: dict[int, int] = field(default_factory=dict)
    balanced: bool = True

    def __post_init__(self) -> None:
        self.starts = [0] + [m.end() for m in re.finditer("\n", self.text)]

    def line(self, at: int) -> int:
        """Line number from 1 of an offset."""
        return bisect_right(self.starts, at)

    def slice(self, first: int, last: int) -> str:
        """Text from token first to token last, both included."""
        return self.text[self.tokens[first].start : self.tokens[last].end] if first <= last else ""


def _template_end(text: str, at: int) -> int:
    """End of the JavaScript template that starts at at."""
    i, inner = at + 1, []  # inner: open braces of each substitution
    while i < len(text):
        ch = text[i]
        if ch == "\\":
            i += 2
            continue
        if not inner or inner[-1] < 0:
            if ch == "`":
                if not inner:
                    return i + 1
                inner.pop()  # a template within a substitution ends
            elif text.startswith("${", i):
                inner.append(0)
                i += 1
        elif ch == "`":
            inner.append(-1)
        elif ch == "{":
            inner[-1] += 1
        elif ch == "}":
            if inner[-1] == 0:
                inner.pop()
            else:
                inner[-1] -= 1
        i += 1
    return len(text)


def lex(text: str, language: str) -> Source:
    """Tokens, comments and bracket partners of a text."""
    out = Source(language, text)
    rule, tokens = _RULES[language], out.tokens
    at, fresh = 0, True  # fresh: nothing but space on this line so far
    while at < len(text):
        if language == "C++" and text[at] == "#" and fresh:
            m = _DIRECTIVE.match(text, at)
            tokens.append(Token("directive", m[0], at, m.end()))
            at = m.end()
            continue
        if language == "JavaScript" and text[at] == "`":
            end = _template_end(text, at)
            tokens.append(Token("template", text[at:end], at, end))
            at, fresh = end, False
            continue
        if language == "JavaScript" and text[at] == "/" and text[at : at + 2] not in ("//", "/*"):
            last = tokens[-1] if tokens else None
            value = last is not None and (last.kind in ("number", "string", "template", "regex") or last.text in ")]}" or last.kind == "name" and last.text not in _BEFORE_REGEX)
            if not value and (m := _REGEX.match(text, at)):
                tokens.append(Token("regex", m[0], at, m.end()))
                at = m.end()
                continue
        m = rule.match(text, at)
        kind = m.lastgroup if m.lastgroup != "fence" else "string"
        if kind is None:
            fresh = fresh or "\n" in m[0]
        elif kind == "comment":
            out.comments.append((at, m.end(), len(tokens)))
        elif m[0] != "\\\n":
            tokens.append(Token(kind, m[0], at, m.end()))
            fresh = False
        at = m.end()
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind != "sign":
            continue
        if t.text in _OPENS:
            stack.append(i)
        elif t.text in (")", "]", "}"):
            if stack and _OPENS[tokens[stack[-1]].text] == t.text:
                out.partner[stack[-1]], out.partner[i] = i, stack[-1]
                stack.pop()
            else:
                out.balanced = False
    out.balanced = out.balanced and not stack
    return out


def python_lines(source: Source) -> list[tuple[int, int, int]]:
    """Logical lines of Python: indent, first token, token after the last; statements after ``;`` stay in their line."""
    out, first, depth, tokens = [], 0, 0, source.tokens
    for i, t in enumerate(tokens):
        if t.kind == "sign" and t.text in _OPENS:
            depth += 1
        elif t.kind == "sign" and t.text in ")]}":
            depth = max(0, depth - 1)
        last = i + 1 == len(tokens)
        gap = "" if last else re.sub(r"\\\r?\n", "", source.text[t.end : tokens[i + 1].start])
        if last or depth == 0 and "\n" in gap:
            begin = source.starts[source.line(tokens[first].start) - 1]
            out.append((len(source.text[begin : tokens[first].start].expandtabs(8)), first, i + 1))
            first = i + 1
    return out
