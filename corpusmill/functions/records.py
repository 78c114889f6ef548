"""Records of the functions and classes of one file: names, parameters, texts, imports, measures."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

from corpusmill.functions.code_metrics import compute_metrics, syntax_tree, tree_features
from corpusmill.functions.definitions import Definition, _annotations, _js_end, _past_angles, clean_indentation, comment_before, find_definitions, python_docstring, python_returns, python_stub, split_list
from corpusmill.functions.lexer import Source, python_lines

Imports = list[tuple[str, list[str]]]
#: Longest line, and mean line length, of JavaScript that is not minified.
LONGEST_LINE, MEAN_LINE = 1000, 300
_NOT_CODE = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//[^\n]*|/\*[\s\S]*?\*/|#[^\n]*")
_CPP_QUALIFIERS = frozenset("static extern inline constexpr consteval virtual explicit const volatile mutable register thread_local friend".split())


def minified(text: str) -> bool:
    sizes = [len(x) for x in text.splitlines()]
    return bool(sizes) and (max(sizes) > LONGEST_LINE or sum(sizes) > MEAN_LINE * len(sizes))


# ---------------------------------------------------------------- imports


def _python_imports(src: Source) -> Imports:
    out, tokens = [], src.tokens
    for indent, a, b in python_lines(src):
        first = a
        for i in [*(i for i in range(a, b) if tokens[i].text == ";"), b]:
            word = tokens[first].text if first < i else ""
            if indent == 0 and word in ("import", "from") and not (word == "from" and tokens[first + 1].text == "__future__"):
                names, parts = [], [[]]
                start = first + 1 if word == "import" else next((k + 1 for k in range(first, i) if tokens[k].text == "import"), i)
                for k in range(start, i):
                    if tokens[k].text == ",":
                        parts.append([])
                    elif tokens[k].text not in ("(", ")"):
                        parts[-1].append(tokens[k].text)
                for part in filter(None, parts):
                    names.append(part[-1] if "as" in part else part[0])
                if names:
                    out.append((src.slice(first, i - 1), names))
            first = i + 1
    return out


def _java_imports(src: Source) -> Imports:
    out, tokens, i = [], src.tokens, 0
    while i < len(tokens):
        if tokens[i].text in ("class", "interface", "enum", "{"):
            break
        if tokens[i].text == "import":
            end = next((k for k in range(i, len(tokens)) if tokens[k].text == ";"), len(tokens) - 1)
            path = [tokens[k].text for k in range(i + 1, end) if tokens[k].kind == "name" and tokens[k].text != "static"]
            if len(path) > 1:  # of a wildcard, the last package counts
                out.append((src.slice(i, end), [path[-1]]))
            i = end
        i += 1
    return out


def _js_imports(src: Source) -> Imports:
    out, tokens, i, n = [], src.tokens, 0, len(src.tokens)
    while i < n:
        word = tokens[i].text
        if word == "import" and i + 1 < n and tokens[i + 1].text not in ("(", "."):
            end = next((k for k in range(i, n) if tokens[k].kind == "string"), n - 1)
            end += end + 1 < n and tokens[end + 1].text == ";"
            names, k = [], i + 1
            while k < end and tokens[k].text != "from":
                if tokens[k].kind == "name" and tokens[k].text != "as" and not (k + 1 < end and tokens[k + 1].text == "as"):
                    names.append(tokens[k].text)
                k += 1
            if names:
                out.append((src.slice(i, end), names))
            i = end + 1
        elif word in ("const", "let", "var"):
            end = max(_js_end(src, i, n), i + 1)
            text = src.slice(i, end - 1)
            at = i + 1
            while at < end:
                stop = at
                while stop < end and tokens[stop].text != ",":
                    stop = src.partner.get(stop, stop) + 1 if tokens[stop].text in ("(", "[", "{") else stop + 1
                target = src.partner.get(at, at) if tokens[at].text == "{" else at
                if target + 3 < end and [t.text for t in tokens[target + 1 : target + 4]] == ["=", "require", "("] and src.partner.get(target + 3, 0) + 1 in (stop, end - 1, end):
                    if tokens[at].kind == "name":
                        out.append((text, [tokens[at].text]))
                    elif tokens[at].text == "{":
                        names = [tokens[y].text for x, y in split_list(src, at, target) if tokens[y].kind == "name" and tokens[x].kind == "name"]
                        if names:
                            out.append((text, names))
                at = stop + 1
            i = end
        else:
            i = src.partner[i] + 1 if word in ("(", "[", "{") and i in src.partner else i + 1
    return out


def _cpp_imports(src: Source) -> Imports:
    out, depth = [], 0
    for t in src.tokens:
        if t.kind != "directive":
            continue
        word = re.match(r"#\s*(\w*)", t.text)[1]
        depth += (word in ("if", "ifdef", "ifndef")) - (word == "endif")
        found = re.match(r"#\s*include\s*([<\"])([^>\"\n]*)", t.text)
        if found and depth == 0 and (stem := PurePosixPath(found[2]).stem):
            out.append((t.text + "\n", [stem]))  # the line break is part of the statement
    return out


_IMPORTS = {"Python": _python_imports, "Java": _java_imports, "JavaScript": _js_imports, "C++": _cpp_imports}


def used_imports(imports: Imports, code: str) -> list[str]:
    """Statements that bring in a name of the code, in order; wildcards always."""
    bare = _NOT_CODE.sub(" ", code)
    return [s for s, names in imports if "*" in names or any(re.search(rf"(?<!\.)\b{re.escape(x)}\b", bare) for x in names)]


# ---------------------------------------------------------------- parts of a header


def _strip_annotations(src: Source, d: Definition) -> list[int]:
    return _annotations(src, d.first, d.name_at)[1]


def _java_parts(src: Source, d: Definition) -> tuple[list[str], str | None]:
    """The header's syntax parts, and the return type."""
    from corpusmill.functions.definitions import _JAVA_MODIFIERS as MODIFIERS

    tokens = src.tokens
    rest = [i for i in _strip_annotations(src, d) if tokens[i].text not in MODIFIERS]
    if d.kind == "class":
        rest = [i for i in rest if tokens[i].text != "class"]
    first = rest[0] if rest else d.name_at - (d.kind == "class")
    parts = [src.slice(d.first, first - 1)] if first > d.first else []
    returns = None
    if d.kind == "class":
        parts += ["class", d.name]
        i = d.name_at + 1
        while i < d.head:
            stop = _past_angles(src, i) if tokens[i].text == "<" else i + 1
            while stop < d.head and tokens[stop].text not in ("extends", "implements", "permits"):
                stop = _past_angles(src, stop) if tokens[stop].text == "<" else stop + 1
            parts.append(src.slice(i, stop - 1))
            i = stop
        return parts, None
    if rest:
        kind = rest[0]
        if tokens[kind].text == "<":
            after = _past_angles(src, kind)
            parts.append(src.slice(kind, after - 1))
            kind = after
        returns = src.slice(kind, d.name_at - 1)
        parts.append(returns)
    parts += [d.name, src.slice(*d.params)]
    if d.params[1] + 1 < d.head:
        parts.append(src.slice(d.params[1] + 1, d.head - 1))
    if tokens[d.head].text == ";":
        parts.append(";")
    return parts, returns


def _js_parts(src: Source, d: Definition) -> list[str]:
    if d.kind == "class":
        tail = src.slice(d.name_at + 1, d.head - 1)
        return ["class", d.name, *([tail] if tail else [])]
    return [t.text for t in src.tokens[d.first : d.params[0]]] + [src.slice(*d.params)]


def _cpp_parts(src: Source, d: Definition) -> tuple[list[str], str | None]:
    tokens = src.tokens
    if d.kind == "class":
        base = next((i for i in range(d.name_at, d.head) if tokens[i].text == ":"), d.head)
        return ["class", src.slice(d.name_at, base - 1), *([src.slice(base, d.head - 1)] if base < d.head else [])], None
    declarator = d.name_at - (tokens[d.name_at - 1].text == "~" and d.name_at > d.first)
    while declarator - 2 >= d.first and tokens[declarator - 1].text == "::":  # qualifiers belong to the declarator
        declarator -= 2
        if tokens[declarator].text == ">":
            depth = 0
            while declarator > d.first:
                depth += (tokens[declarator].text == ">") - (tokens[declarator].text == "<")
                declarator -= 1
                if depth == 0:
                    break
    while declarator > d.first and tokens[declarator - 1].text in ("*", "&", "&&", "**"):
        declarator -= 1
    kept, parts, i = [], [], d.first
    while i < declarator:
        if tokens[i].text in _CPP_QUALIFIERS:
            parts.append(tokens[i].text)
            i += 1
            continue
        j = i
        while j < declarator and tokens[j].text not in _CPP_QUALIFIERS:
            j = _past_angles(src, j) if tokens[j].text == "<" else j + 1
        text = src.slice(i, min(j, declarator) - 1)
        parts.append(text)
        kept.append(text)
        i = j
    tail = d.head - 1 if tokens[d.head].text == "{" else d.last
    colon = next((i for i in range(d.params[1] + 1, tail + 1) if tokens[i].text == ":"), None)
    if tokens[d.head].text == "=":
        parts += [src.slice(declarator, d.head - 1), src.slice(d.head, d.last)]
    elif colon is not None:
        parts += [src.slice(declarator, colon - 1), src.slice(colon, tail)]
    else:
        parts.append(src.slice(declarator, tail))
    return parts, " ".join(kept) or None


def _params(src: Source, d: Definition) -> list[str]:
    tokens = src.tokens
    if not d.params:
        return []
    if d.value and tokens[d.params[0]].text != "(":
        return [tokens[d.params[0]].text]
    out = []
    for a, b in split_list(src, *d.params):
        words = [i for i in range(a, b + 1)]
        if src.language in ("Python", "JavaScript"):
            out.append(src.slice(a, b))
        elif src.language == "Java":
            last = [i for i in words if tokens[i].kind == "name"]
            if last and all(tokens[i].text != "..." for i in words) and tokens[last[-1]].text != "this":
                out.append(tokens[last[-1]].text)
        else:
            plain = any(tokens[i].text in ("=", "...") for i in words) or tokens[b].kind != "name"
            types = [i for i in words[:-1] if tokens[i].kind == "name" and tokens[i].text not in ("const", "volatile", "typename", "struct", "class")]
            if plain or not types or tokens[b - 1].text == "::":
                continue
            first = b
            while first - 1 > a and (tokens[first - 1].text in ("*", "&", "&&", "**") or tokens[first - 1].text == "const" and tokens[first - 2].text in ("*", "**")):
                first -= 1
            out.append(src.slice(first, b))
    return out


def _bases(src: Source, d: Definition) -> list[str]:
    tokens = src.tokens
    if src.language == "Python":
        if not d.params:
            return []
        return [src.slice(a, b) for a, b in split_list(src, *d.params) if not (b > a and tokens[a + 1].text == "=")]
    if src.language == "JavaScript":
        at = d.name_at + 1
        return [tokens[at + 1].text] if at + 2 == d.head and tokens[at].text == "extends" and tokens[at + 1].kind == "name" else []
    if src.language == "Java":
        out, i = [], d.name_at + 1
        while i < d.head:
            if tokens[i].text == "<":
                i = _past_angles(src, i)
                continue
            if tokens[i].text in ("extends", "implements"):
                first = i = i + 1
                while i <= d.head:
                    if i == d.head or tokens[i].text in (",", "implements", "permits"):
                        if first < i and not any(tokens[k].text == "." for k in _top(src, first, i)):
                            out.append(src.slice(_annotations(src, first, i)[1][0], i - 1))
                        first = i + 1
                        if i < d.head and tokens[i].text != ",":
                            break
                    i = _past_angles(src, i) if i < d.head and tokens[i].text == "<" else i + 1
                continue
            if tokens[i].text == "permits":
                break
            i += 1
        return out
    colon = next((i for i in range(d.name_at, d.head) if tokens[i].text == ":"), None)
    if colon is None:
        return []
    parts, first, i = [], colon + 1, colon + 1
    while i <= d.head:
        if i == d.head or tokens[i].text == ",":
            names = [k for k in range(first, i) if tokens[k].text not in ("public", "private", "protected", "virtual")]
            if len(names) == 1:
                parts.append(tokens[names[0]].text)
            first = i + 1
        i = _past_angles(src, i) if i < d.head and tokens[i].text == "<" else i + 1
    return parts


def _top(src: Source, lo: int, hi: int):
    i = lo
    while i < hi:
        if src.tokens[i].text == "<":
            i = _past_angles(src, i)
            continue
        yield i
        i += 1


# ---------------------------------------------------------------- signatures and skeletons


def _sign_line(src: Source, d: Definition) -> tuple[str, str | None]:
    """The header on a line, and the return type."""
    if src.language == "Java":
        parts, returns = _java_parts(src, d)
    elif src.language == "C++":
        parts, returns = _cpp_parts(src, d)
    else:
        parts, returns = _js_parts(src, d), None
    return " ".join(parts).strip(), returns


def _signature(src: Source, d: Definition, doc: str | None) -> tuple[str, str | None]:
    if src.language == "Python":
        body = [f'    """{doc}"""'] if doc else []
        return "\n".join([python_stub(src, d), *body, "    pass"]), python_returns(src, d)
    if d.value:
        text = src.slice(d.first, d.last)
        block = src.tokens[d.head].text == "{"
        return f"{d.name} = {text.split('{')[0].rstrip()} {{ }}" if block else f"{d.name} = {text}", None
    line, returns = _sign_line(src, d)
    return "\n".join([*([f"/** {doc} */"] if doc else []), line + " { }"]), returns


def _skeleton(src: Source, d: Definition, doc: str | None, lines: list | None) -> str:
    tokens = src.tokens
    if src.language == "Python":
        out = [src.slice(d.first, d.last).split(":", 1)[0].split("\n")[0] if "\n" in src.slice(d.first, d.head) else src.slice(d.first, d.head)]
        out += [f'    """{doc}"""'] if doc else []
        out.append("")
        for m in d.members:
            out += [f"    {x}" for x in m.marks] + [f"    {python_stub(src, m)}"]
            inner = python_docstring(src, m, lines)
            out += ([f'        """{inner}"""'] if inner else []) + ["        pass", ""]
        return "\n".join(out if d.members else [*out, "    pass"])
    out = [_sign_line(src, d)[0] + " {"] + ([f"    /** {doc} */"] if doc else [])
    marks: list[tuple[int, Definition | str]] = [(m.first, m) for m in d.members if not (src.language == "C++" and m.alone)]
    if src.language == "C++":
        i = d.head + 1
        while i < d.last:
            if tokens[i].text in ("public", "private", "protected") and tokens[i + 1].text == ":":
                marks.append((i, tokens[i].text + ":"))
            i = src.partner[i] + 1 if tokens[i].text in ("(", "[", "{") else i + 1
    for _, m in sorted(marks, key=lambda x: x[0]):
        if isinstance(m, str):
            out.append(m)
            continue
        inner = comment_before(src, m)
        out += ([f"    /** {inner} */"] if inner else []) + [f"    {_sign_line(src, m)[0]} {{ }}", ""]
    return "\n".join([*out, "};" if src.language == "C++" else "}"])


def _constructs(src: Source, d: Definition, methods: list[str]) -> bool:
    if src.language == "Python":
        return "__init__" in methods or any("dataclass" in x.lower() for x in d.marks)
    if src.language == "Java":
        return any(m.constructor for m in d.members)
    return ("constructor" if src.language == "JavaScript" else d.name) in methods and d.name != "unknown"


def extract(text: str, language: str, include_ast: bool = False, measure: bool = True) -> list[dict]:
    """All records of a file in source order; none for minified JavaScript."""
    if language == "JavaScript" and minified(text):
        return []
    src, found = find_definitions(text, language)
    imports = _IMPORTS[language](src)
    lines = python_lines(src) if language == "Python" else None
    out = []
    for d in found:
        doc = python_docstring(src, d, lines) if language == "Python" else comment_before(src, d)
        code = clean_indentation(src.slice(d.source_first, d.source_last if d.source_last >= 0 else d.last))
        row = {"kind": d.kind, "name": d.name, "docstring": doc, "source_code": code, "used_imports": used_imports(imports, code), "start_line": src.line(src.tokens[d.first].start), "end_line": src.line(src.tokens[d.last].end - 1), "decorators": d.marks}
        if d.kind == "function":
            signature, returns = _signature(src, d, doc)
            row |= {"parameters": _params(src, d), "return_annotation": returns, "signature": signature, "is_method": d.parent is not None, "parent_class": d.parent}
        else:
            methods = [m.name for m in d.members if not m.constructor]
            row |= {"parent_classes": _bases(src, d), "skeleton": _skeleton(src, d, doc, lines), "method_names": methods, "method_count": len(methods), "has_constructor": _constructs(src, d, methods)}
        if measure:
            depth, nodes, kinds = tree_features(code, language)
            row |= {"ast_depth": depth, "ast_num_nodes": nodes, "ast_node_types": kinds, "ast": json.dumps(syntax_tree(code, language), ensure_ascii=False) if include_ast else None} | compute_metrics(code, language)
        out.append(row)
    return out


def definition_counts(text: str, language: str) -> tuple[int, int]:
    """Functions and classes of a file."""
    if language == "JavaScript" and minified(text):
        return 0, 0
    kinds = [d.kind for d in find_definitions(text, language)[1]]
    return kinds.count("function"), kinds.count("class")
