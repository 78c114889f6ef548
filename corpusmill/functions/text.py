"""Column expressions over source text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]"
TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*|[^ \t\n\x0B\f\r\p{L}\p{N}_]"
_DOUBLE, _SINGLE = r'"[^"\\]*(?:\\[^\n][^"\\]*)*"', r"'[^'\\]*(?:\\[^\n][^'\\]*)*'"
_COMMENTS = (r"//[^\n]*", r"/\*[\s\S]*?\*/", r"#[^\n]*")
#: Plain forms, for engines of any kind.
LITERALS = (r'"""[\s\S]*?"""', r"'''[\s\S]*?'''", _DOUBLE, _SINGLE)
COMMENT_OR_STRING = "|".join([*LITERALS, *_COMMENTS])
#: The same with possessive loops: what they pass never ends a literal, and Java then loops where it would call itself for each escape.
_LOOPED = tuple(p.replace(")*", ")*+") for p in LITERALS)
_LOOPED_COMMENT_OR_STRING = "|".join([*_LOOPED, *_COMMENTS])


def code_tokens(text: Column) -> Column:
    """Identifiers and single signs; string literals become STR; digits and non-ASCII letters give none."""
    t = F.regexp_replace(text, SPACE + "+", " ")
    for pattern in _LOOPED:
        t = F.regexp_replace(t, pattern, "STR")
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def blank(line: Column) -> Column:
    return ~line.rlike(r"[^ \t\n\x0B\f\r]")


def minified(text: Column, longest: int = 1000, mean: int = 300) -> Column:
    """A line over longest signs, or lines over mean signs on average."""
    sizes = F.transform(lines(text), F.length)
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    return (F.array_max(sizes) > longest) | (total > mean * F.size(sizes))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once: Spark works out again for each element what a lambda takes from outside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_indentation(snippet: Column) -> Column:
    """Cut all lines but the first by the least body indent less four, if that indent is over four."""

    def cut_of(rows: Column) -> Column:
        body = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: ~blank(x))
        indent = F.array_min(F.transform(body, lambda x: F.length(F.regexp_extract(x, r"^[ \t\x0B\f\r]*", 0))))
        return F.coalesce(F.when(indent > 4, indent - 4), F.lit(0))

    def joined(rows: Column, cut: Column) -> Column:
        return F.concat_ws("\n", F.transform(rows, lambda x, i: F.when((i == 0) | (F.length(x) < cut), x).otherwise(F.substr(x, cut + 1))))

    return _bound(lines(snippet), lambda rows: _bound(cut_of(rows), lambda cut: joined(rows, cut)))


def strip_comments_and_strings(text: Column) -> Column:
    return F.regexp_replace(text, _LOOPED_COMMENT_OR_STRING, " ")


def clean_block_comment(raw: Column) -> Column:
    """Delimiters and leading stars off; empty is null."""
    t = F.regexp_replace(F.regexp_replace(raw, r"^/\*+|\*+/$", ""), r"(?m)^[ \t]*\*+ ?", "")
    t = F.regexp_replace(t, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return F.when(t != "", t)


def strip_python_literal(raw: Column) -> Column:
    """The inside of a Python string literal with any prefix and quote style."""
    t = F.regexp_replace(raw, r"^[rRbBfFuU]{0,2}(?=['\"])", "")
    inner = F.regexp_extract(t, r"^(?s)(?:\"\"\"(.*)\"\"\"|'''(.*)'''|\"(.*)\"|'(.*)')$", 0)
    out = F.when(inner.rlike(r"^(\"\"\"|''')"), F.substr(t, F.lit(4), F.length(t) - 6)).when(inner != "", F.substr(t, F.lit(2), F.length(t) - 2))
    return F.coalesce(out, t)


def strip_fences(text: Column) -> Column:
    """The longest fenced body, the first of equals; else the trimmed text."""
    trim = lambda c: F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    first = lambda bodies, most: F.element_at(F.filter(bodies, lambda b: F.length(b) == most), 1)
    longest = lambda bodies: F.when(F.size(bodies) > 0, _bound(F.array_max(F.transform(bodies, F.length)), lambda most: first(bodies, most)))
    bodies = F.regexp_extract_all(text, F.lit(r"```[a-zA-Z+#]*\n([\s\S]*?)```"), F.lit(1))
    return trim(F.coalesce(_bound(bodies, longest), text))


def slug(name: Column) -> Column:
    """Last path part, lower case, other signs as single dashes, none at the end."""
    last = F.element_at(F.split(name, "/"), -1)
    return F.regexp_replace(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "-"), "-$", "")


def used_imports(imports: Column, code: Column) -> Column:
    """Statements of array<struct<stmt,names>> whose name occurs in stripped code as a word not after a dot; wildcards always."""

    def used(stripped: Column) -> Column:
        hit = lambda n: (n == "*") | F.rlike(stripped, F.concat(F.lit(r"(?<![\w.])\Q"), n, F.lit(r"\E(?!\w)")))
        return F.array_distinct(F.transform(F.filter(imports, lambda i: F.exists(i["names"], hit)), lambda i: i["stmt"]))

    # An array of one, so that the code is stripped once, not for each name.
    return F.get(F.transform(F.array(strip_comments_and_strings(code)), used), F.lit(0))


def redact(message: Column, secret: Column) -> Column:
    return F.when(F.length(secret) > 0, F.replace(message, secret, F.lit("***"))).otherwise(message)


def duration_text(seconds: Column) -> Column:
    """45s, 2m 05s, 1h 02m 05s; rounded up with a slack of 1e-9."""
    s = F.greatest(F.lit(0), F.ceil(seconds - 1e-9)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m "), two(r), F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(r), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))
