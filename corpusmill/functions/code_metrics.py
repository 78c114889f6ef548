"""Line, complexity, nesting and operator metrics of one piece of source, on its tokens.

Where the statement structure matters (nesting, logical lines, whether a sign is
binary), it is read off the token stream; no grammar is needed.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from corpusmill.functions.lexer import LANGUAGES, Source, lex, python_lines

_PY_SIMPLE = frozenset("return raise assert del pass break continue import from".split())
_PY_STATEMENT = {"return": "return_statement", "raise": "raise_statement", "assert": "assert_statement", "del": "delete_statement", "import": "import_statement", "from": "import_from_statement", "if": "if_statement", "for": "for_statement", "while": "while_statement", "with": "with_statement", "try": "try_statement", "except": "except_clause"}
_PY_KEYWORDS = frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_KEYWORDS = {
    "Java": frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while record yield".split()),
    "JavaScript": frozenset("async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new of return static super switch this throw try typeof var void while with yield".split()),
    "C++": frozenset("alignas alignof asm auto bool break case catch char class const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern final float for friend goto if inline int long mutable namespace new noexcept operator override private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this thread_local throw try typedef typeid typename union unsigned using virtual void volatile wchar_t while and or not".split()),
}
_BINARY = {
    "Java": frozenset("+ - * / % == != < > <= >= && || & | ^ << >> >>>".split()),
    "JavaScript": frozenset("+ - * / % ** == != === !== < > <= >= && || ?? & | ^ << >> >>>".split()),
    "C++": frozenset("+ - * / % == != < > <= >= && || & | ^ << >>".split()),
}
_ASSIGN = {
    "Java": frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split()),
    "JavaScript": frozenset("= += -= *= /= %= **= &= |= ^= <<= >>= >>>= ??=".split()),
    "C++": frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split()),
}
_EXTRA_SIGNS = {"Java": frozenset("! ~ ++ --".split()), "JavaScript": frozenset("! ~ ++ -- =>".split()), "C++": frozenset("! ~ ++ -- -> .".split())}
_NODES = {
    "Java": {"if": "if_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_expression", "return": "return_statement", "throw": "throw_statement", "try": "try_statement", "catch": "catch_clause", "instanceof": "instanceof_expression"},
    "JavaScript": {"if": "if_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_statement", "return": "return_statement", "throw": "throw_statement", "try": "try_statement", "await": "await_expression", "yield": "yield_expression"},
    "C++": {"if": "if_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_statement", "return": "return_statement", "throw": "throw_statement", "try": "try_statement", "sizeof": "sizeof_expression"},
}
_PY_BINARY = frozenset("+ - * / // % ** & | ^ << >>".split())
_PY_COMPARE = frozenset("== != < > <= >=".split())
_PY_AUGMENTED = frozenset("+= -= *= /= //= %= **= &= |= ^= <<= >>= @=".split())


@dataclass
class Structure:
    """What one pass over the statements counts."""

    branches: int = 0
    deepest: int = 0
    statements: int = 0
    operators: list[str] = field(default_factory=list)
    operands: list[str] = field(default_factory=list)


def _ends_value(src: Source, i: int) -> bool:
    """Whether token i ends an operand, so that a sign after it is binary."""
    if i < 0:
        return False
    t = src.tokens[i]
    if t.kind == "name":
        return t.text not in (_PY_KEYWORDS if src.language == "Python" else _KEYWORDS[src.language]) or t.text in ("this", "super")
    return t.kind in ("number", "string", "char", "template", "regex") or t.text in (")", "]", "}") or t.text in ("++", "--")


# ---------------------------------------------------------------- Python


def _python(src: Source) -> Structure:
    out, tokens = Structure(), src.tokens
    open_: list[tuple[int, int]] = []  # indent and control depth of enclosing compound lines
    for indent, a, b in python_lines(src):
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        depth = open_[-1][1] if open_ else 0
        at = a + 1 if tokens[a].text == "async" and a + 1 < b else a
        word = tokens[at].text
        colon = _python_suite(src, at, b)
        match_ = word in ("match", "case") and colon == b - 1 and b - at > 2
        if colon is not None and (word in ("if", "elif", "else", "for", "while", "with", "try", "except", "finally", "def", "class") or match_):
            inner = depth + (1 if word in ("if", "elif", "else", "for", "while", "with", "try", "finally") or match_ and word == "match" else 2 if word == "except" else 0)
            if word not in ("else", "finally", "elif", "def", "class", "case"):
                out.deepest = max(out.deepest, inner)
            open_.append((indent, inner))
            out.branches += word in ("if", "elif", "for", "while", "except", "with")
            if word in _PY_STATEMENT:
                out.operators.append(_PY_STATEMENT[word])
            parts = [(at, colon, True), (colon + 1, b, False)] if colon + 1 < b else [(at, b, True)]
        else:
            parts = [(at, b, False)]
        for lo, hi, head in parts:
            for x, y in _pieces(src, lo, hi):
                _python_statement(src, x, y, head, out)
    return out


def _python_suite(src: Source, lo: int, hi: int) -> int | None:
    """The colon that ends a compound statement's header."""
    lambdas, i = 0, lo
    while i < hi:
        t = src.tokens[i]
        if t.text == "lambda":
            lambdas += 1
        elif t.text == ":" and t.kind == "sign":
            if not lambdas:
                return i
            lambdas -= 1
        i = src.partner[i] + 1 if t.text in ("(", "[", "{") and i in src.partner else i + 1
    return None


def _pieces(src: Source, lo: int, hi: int):
    """Statements between semicolons."""
    first, i = lo, lo
    while i < hi:
        if src.tokens[i].text == ";":
            if i > first:
                yield first, i
            first = i + 1
        i = src.partner[i] + 1 if src.tokens[i].text in ("(", "[", "{") and i in src.partner else i + 1
    if hi > first:
        yield first, hi


def _python_statement(src: Source, lo: int, hi: int, head: bool, out: Structure) -> None:
    tokens = src.tokens
    word = tokens[lo].text
    flat_assign = 0
    comparing = False
    depth_for: list[bool] = []
    for i in range(lo, hi):
        t, text = tokens[i], tokens[i].text
        if t.kind == "sign" and text in "([{":
            depth_for.append(False)
        elif t.kind == "sign" and text in ")]}":
            if depth_for:
                depth_for.pop()
            comparing = False
        if t.kind == "name" and text in _PY_KEYWORDS:
            if text in ("and", "or"):
                out.branches += 1
                out.operators += ["boolean_operator", text]
                comparing = False
            elif text == "not":
                joint = i > lo and tokens[i - 1].text == "is"
                if not joint and not (i + 1 < hi and tokens[i + 1].text == "in" and _ends_value(src, i - 1)):
                    out.operators.append("not")
            elif text in ("in", "is"):
                joint = "not in" if text == "in" and i > lo and tokens[i - 1].text == "not" and _ends_value(src, i - 2) else "is not" if text == "is" and i + 1 < hi and tokens[i + 1].text == "not" else text
                loop = text == "in" and (head and word == "for" and not depth_for or depth_for and depth_for[-1] is True and not comparing and _loop_in(src, i, lo))
                out.operators.append(joint)
                if not loop and not comparing:
                    out.operators.append("comparison_operator")
                    comparing = True
            elif text == "lambda":
                out.operators += ["lambda", "lambda"]
            elif text == "yield":
                out.operators += ["yield", "yield"]
            elif text == "else" and i > lo:
                out.branches += 1
                out.operators.append("conditional_expression")
            elif text == "for" and depth_for and not depth_for[-1]:
                depth_for[-1] = True
                out.branches += 1
                kind = next((tokens[k].text for k in range(i - 1, lo - 1, -1) if k in src.partner and src.partner[k] > i), "(")
                out.operators.append({"[": "list_comprehension", "(": "generator_expression"}.get(kind, "set_comprehension"))
        elif t.kind == "sign":
            before = _ends_value(src, i - 1) if i > lo else False
            if text in _PY_COMPARE:
                if not comparing:
                    out.operators.append("comparison_operator")
                    comparing = True
                out.operators.append(text)
            elif text in _PY_BINARY:
                if text in ("*", "**") and not before:
                    out.operators.append(text)  # a splat
                else:
                    out.operators += ["binary_operator" if before else "unary_operator", text]
            elif text == "~":
                out.operators += ["unary_operator", text]
            elif text == "=":
                out.operators.append("=")
                if not depth_for:
                    flat_assign += 1
                    out.operators.append("assignment")
                comparing = False
            elif text in _PY_AUGMENTED:
                out.operators.append("augmented_assignment")
                if text != "@=":
                    out.operators.append(text)
                flat_assign += 1
            elif text == ",":
                comparing = False
        elif t.kind in ("number", "string"):
            out.operands.append(text)
            if t.kind == "string" and i + 1 < hi and tokens[i + 1].kind == "string" and (i == lo or tokens[i - 1].kind != "string"):
                last = i
                while last + 1 < hi and tokens[last + 1].kind == "string":
                    last += 1
                out.operands.append(src.slice(i, last))
        elif t.kind == "name":
            out.operands.append(text)
    if head:
        return
    if word in _PY_SIMPLE:
        future = word == "from" and lo + 1 < hi and tokens[lo + 1].text == "__future__"
        out.statements += not future
        out.branches += word == "assert"
        if word in _PY_STATEMENT and not future:
            out.operators.append(_PY_STATEMENT[word])
    elif word not in ("global", "nonlocal", "@", "type"):
        out.statements += 1 + flat_assign  # an expression statement, and each assignment in it


def _loop_in(src: Source, i: int, lo: int) -> bool:
    """Whether the ``in`` at i belongs to the ``for`` before it in the same brackets."""
    k = i - 1
    while k >= lo:
        t = src.tokens[k].text
        if t == "for":
            return True
        if t in ("in", "if") or t in ("(", "[", "{"):
            return False
        k = src.partner[k] - 1 if k in src.partner and src.partner[k] < k else k - 1
    return False


# ---------------------------------------------------------------- Java, JavaScript, C++


class _Braces:
    def __init__(self, src: Source):
        self.src, self.tokens, self.language, self.out = src, src.tokens, src.language, Structure()
        self.n = len(self.tokens)

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < self.n else ""

    def scan(self, lo: int, hi: int, depth: int) -> None:
        i = lo
        while i < hi:
            i = self.item(i, hi, depth)

    def item(self, i: int, hi: int, depth: int) -> int:
        t = self.tokens[i]
        if t.kind == "name" and t.text in ("if", "for", "while", "do", "switch", "try", "catch") and self.text(i - 1) not in (".", "?.", "::") and self.text(i + 1) in ("(", "{", "constexpr", "await") + ((self.text(i + 1),) if t.text == "do" else ()):
            return self.control(i, hi, depth)
        self.count(i)
        if t.text in ("(", "[", "{") and t.kind == "sign" and i in self.src.partner:
            end = min(self.src.partner[i], hi)
            self.scan(i + 1, end, depth)
            return end + 1
        return i + 1

    def body(self, i: int, hi: int, depth: int) -> int:
        """One statement."""
        if i >= hi:
            return i
        if self.text(i) == "{" or self.text(i) in ("if", "for", "while", "do", "switch", "try"):
            return self.item(i, hi, depth)
        while i < hi and self.text(i) != ";":
            i = self.item(i, hi, depth)
        if i < hi:
            self.count(i)
        return i + 1

    def group(self, i: int, hi: int, depth: int) -> int:
        """A bracketed head, if one follows."""
        if self.text(i) == "(" and i in self.src.partner:
            end = min(self.src.partner[i], hi)
            self.scan(i + 1, end, depth)
            return end + 1
        return i

    def control(self, i: int, hi: int, depth: int) -> int:
        word, out = self.text(i), self.out
        start = i
        i += 1 + (self.text(i + 1) in ("constexpr", "await"))
        ranged = word == "for" and self.text(i) == "(" and i in self.src.partner and not any(self.text(k) == ";" for k in range(i + 1, self.src.partner[i]))
        resources = self.language == "Java" and word == "try" and self.text(i) == "("
        d = depth + (0 if ranged and self.language in ("Java", "C++") or resources else 1)
        out.branches += word in ("if", "for", "while", "do", "catch")
        node = ("for_in_statement" if self.language == "JavaScript" else None) if ranged else "for_statement" if word == "for" else None if resources else _NODES[self.language].get(word)
        if node:
            out.operators.append(node)
        out.deepest = max(out.deepest, d)
        if word == "for" and not ranged and self.text(i) == "(":
            names = [k for k in range(i + 1, self.n) if self.text(k) == ";"][:1]
            declared = names and any(self.tokens[k].kind == "name" and self.tokens[k + 1].kind == "name" or self.text(k) in ("let", "var", "const") for k in range(i + 1, names[0]))
            out.statements -= 1 if declared else 2  # its semicolons end no statement, its declaration counts
        if word == "try":
            if resources:
                i = self.group(i, hi, d)
            i = self.body(i, hi, d)
            while self.text(i) == "catch" and i < hi:
                i = self.control(i, hi, d)
            if self.text(i) == "finally" and i < hi:
                i = self.body(i + 1, hi, d)
        elif word == "do":
            i = self.body(i, hi, d)
            if self.text(i) == "while" and i < hi:
                i = self.group(i + 1, hi, d)
                if self.text(i) == ";":
                    i += 1
        else:
            i = self.group(i, hi, d)
            i = self.body(i, hi, d)
            if word == "if" and self.text(i) == "else" and i < hi:
                i = self.body(i + 1, hi, d)
        return max(i, start + 1)

    def generic(self, i: int) -> bool:
        """Whether an angle bracket at i holds type arguments."""
        step, other = (1, ">") if self.text(i) == "<" else (-1, "<")
        k, level = i, 0
        while 0 <= k < self.n and abs(k - i) < 60:
            t = self.tokens[k]
            level += (t.text == "<") - (t.text == ">")
            if level == 0:
                return True
            if not (t.kind == "name" and (t.text not in ("return", "if", "while") and self.text(k)) or t.kind == "number" and self.language == "C++" or t.text in ("<", ">", ",", ".", "?", "[", "]", "&", "*", "::", "@")):
                return False
            k += step
        return False

    def in_parameters(self, i: int) -> bool:
        """Whether token i stands directly in the parameter list of a function with a body."""
        k = i - 1
        while k >= 0 and self.text(k) not in ("(", "{", ";"):
            k = self.src.partner[k] - 1 if k in self.src.partner and self.src.partner[k] < k else k - 1
        after = self.text(self.src.partner.get(k, self.n) + 1)
        return self.text(k) == "(" and self.tokens[k - 1].kind == "name" and self.text(k - 1) not in _KEYWORDS["C++"] and after in ("{", "const", "noexcept", ":", "override")

    def count(self, i: int) -> None:
        t, language, out = self.tokens[i], self.language, self.out
        text = t.text
        if t.kind == "name":
            if text in ("case",):
                end = i + 1
                while end < self.n and self.text(end) not in (":", "->", "{", ";"):
                    end = self.src.partner.get(end, end) + 1 if self.text(end) in ("(", "[") else end + 1
                out.branches += all(self.text(k) != "default" for k in range(i, end))
            elif text in ("and", "or") and language == "C++":
                out.branches += 1
                out.operators.append("binary_expression")
            elif text in _NODES[language] and self.text(i - 1) != ".":
                out.operators.append(_NODES[language][text])
            elif text in ("true", "false", "null", "undefined", "nullptr") or text not in _KEYWORDS[language]:
                property_ = language == "JavaScript" and (self.text(i - 1) in (".", "?.") or self.text(i + 1) == ":" and self.text(i - 1) in ("{", ","))
                if not property_:
                    out.operands.append(text)
            return
        if t.kind in ("number", "string", "char", "template", "regex"):
            out.operands.append(text)
            return
        if t.kind == "directive":
            return
        before = _ends_value(self.src, i - 1)
        if text == "?":
            if not (language == "Java" and self.text(i - 1) in ("<", ",") and not before):
                out.branches += 1
                out.operators.append("conditional_expression" if language == "C++" else "ternary_expression")
        elif text in ("&&", "||") and before:
            reference = language == "C++" and text == "&&" and (self.text(i + 1) in (")", ",", "{", ";", "=") or self.text(i - 1) == "auto" or self.in_parameters(i))
            if not reference:
                out.branches += 1
                out.operators.append("binary_expression")
            out.operators.append(text)
        elif text in ("<", ">") and language in ("Java", "C++") and self.generic(i):
            out.operators.append(text)
        elif text in _BINARY[language]:
            if before and not (language == "C++" and text in ("*", "&") and self.text(i + 1) in (")", ",", ">", "&", "*")):
                out.operators.append("binary_expression")
            elif text in ("*", "&") and language == "C++":
                out.operators.append("pointer_expression")
            elif not before:
                out.operators.append("unary_expression")
            out.operators.append(text)
        elif text in _ASSIGN[language]:
            declared = text == "=" and i > 1 and (self.tokens[i - 2].kind == "name" and self.text(i - 2) not in ("return", "else", "do", "case") or self.text(i - 2) in (">", "]", "*", "&") or language == "JavaScript" and self.text(i - 1) in ("}", "]"))
            if not declared:
                out.operators.append("assignment_expression")
            out.operators.append(text)
        elif text in _EXTRA_SIGNS[language]:
            if text in ("++", "--"):
                out.operators.append("update_expression")
            elif text in ("!", "~") and not (language == "C++" and text == "~" and self.text(i + 2) == "("):
                out.operators.append("unary_expression")
            out.operators.append(text)
        elif text == ";":
            out.statements += self.statement(i)

    def statement(self, i: int) -> int:
        """1 if the semicolon at i ends a statement that counts as a logical line."""
        k = i - 1
        while k >= 0 and self.text(k) not in (";", "{") and not (self.text(k) == "}" and k not in self.src.partner):
            k = self.src.partner[k] - 1 if k in self.src.partner and self.src.partner[k] < k else k - 1
        first = self.text(k + 1)
        if k + 1 == i or first in ("package", "import", "using", "typedef", "export", "#", "do", "while"):
            return 0
        return 1


# ---------------------------------------------------------------- all together


def structure(src: Source) -> Structure:
    if src.language == "Python":
        return _python(src)
    braces = _Braces(src)
    braces.scan(0, braces.n, 0)
    return braces.out


def raw_lines(src: Source, statements: int) -> dict:
    rows = src.text.splitlines()
    single, many = set(), set()
    for start, end, _ in src.comments:
        a, b = src.line(start), src.line(max(start, end - 1))
        (many if b > a else single).update(range(a, b + 1))
    covered = single | many
    loc = len(rows)
    return {
        "loc": loc,
        "sloc": sum(1 for i, x in enumerate(rows, 1) if x.strip() and i not in covered),
        "lloc": max(0, statements),
        "comments": len(single),
        "multi": len(many),
        "blank": sum(1 for x in rows if not x.strip()),
        "comment_ratio": round((len(single) + len(many)) / loc, 4) if loc else 0.0,
    }


def halstead(operators: list[str], operands: list[str]) -> dict:
    h1, h2, n1, n2 = len(set(operators)), len(set(operands)), len(operators), len(operands)
    term = lambda n: n * math.log2(n) if n else 0.0
    volume = (n1 + n2) * math.log2(h1 + h2) if h1 + h2 > 1 else 0.0
    difficulty = h1 / 2 * (n2 / h2) if h2 else 0.0
    effort = difficulty * volume
    exact = {"calculated_length": term(h1) + term(h2), "volume": volume, "difficulty": difficulty, "effort": effort, "time": effort / 18}
    return {"h1": h1, "h2": h2, "N1": n1, "N2": n2, "vocabulary": h1 + h2, "halstead_length": n1 + n2} | {k: round(v, 2) for k, v in exact.items()} | {"bugs": round(volume / 3000, 4)}


def maintainability(volume: float, complexity: int, sloc: int, comment_ratio: float) -> float:
    if sloc <= 0 or volume <= 0:
        return 100.0
    index = 171 - 5.2 * math.log(volume) - 0.23 * complexity - 16.2 * math.log(sloc) + 50 * math.sin(math.sqrt(2.4 * comment_ratio))
    return round(max(0.0, 100 * index / 171), 2)


def compute_metrics(text: str, language: str) -> dict:
    """The 22 measures of one piece of source; empty for an unknown language."""
    if language not in LANGUAGES:
        return {}
    src = lex(text, language)
    found = structure(src)
    lines, operators = raw_lines(src, found.statements), halstead(found.operators, found.operands)
    complexity = 1 + found.branches
    index = maintainability(operators["volume"], complexity, lines["sloc"], lines["comment_ratio"])
    return lines | {"cyclomatic_complexity": complexity, "max_nesting_depth": found.deepest} | operators | {"maintainability_index": index}


def syntax_tree(text: str, language: str, depth: int = 999, leaf: int = 80, signs: bool = True) -> dict:
    """Brackets as nodes and tokens as leaves, in the form type, text, children; long leaf texts end in three dots.

    For a viewer, depth 6, leaf 40 and no signs give a small tree.
    """
    src = lex(text, language)
    cut = lambda s: s if len(s) <= leaf else s[: leaf - 3] + "..."
    root: dict = {"type": "module", "text": None, "children": []}
    path = [root]
    names = {"(": "parenthesized", "[": "bracketed", "{": "block"}
    for i, t in enumerate(src.tokens):
        opens = t.kind == "sign" and t.text in names and i in src.partner
        node = {"type": names[t.text] if opens else t.text if t.kind == "sign" else t.kind, "text": None if opens else cut(t.text), "children": []}
        closes = t.kind == "sign" and i in src.partner and not opens
        if len(path) <= depth and (signs or opens or t.kind != "sign"):
            path[-1]["children"].append(node)
        if opens:
            path.append(node)
        elif closes and len(path) > 1:
            path.pop()
    return root


def tree_features(text: str, language: str) -> tuple[int, int, dict[str, int]]:
    """Depth, number of nodes and nodes by type of the syntax tree."""
    root = syntax_tree(text, language)
    deepest, kinds, stack = 0, Counter(), [(root, 0)]
    while stack:
        node, depth = stack.pop()
        deepest = max(deepest, depth)
        kinds[node["type"]] += 1
        stack += [(c, depth + 1) for c in node["children"]]
    return deepest, sum(kinds.values()), dict(kinds)
