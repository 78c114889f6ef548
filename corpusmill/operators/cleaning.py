"""Generated code cut down to the first wanted definition."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.definitions import find_definitions

#: Leading lines that are dropped at most while looking for code.
LEADING, LEADING_PYTHON = 19, 49


def longest_fence(text: str) -> str:
    """The longest fenced body, else the text; both without outer space."""
    bodies = re.findall(r"```[a-zA-Z+#]*\n(.*?)```", text, re.S)
    return max(bodies, key=len).strip() if bodies else text.strip()


def _parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _wanted(granularity: str) -> tuple:
    return (ast.ClassDef,) if granularity == "class" else (ast.FunctionDef, ast.AsyncFunctionDef)


def first_python_node(text: str, granularity: str, prefixes: bool = False) -> str | None:
    """The first top-level definition with its decorators; else what parses once leading lines are gone (or the longest leading lines that parse)."""
    rows = text.splitlines()
    tree = _parsed(text)
    if tree is not None:
        for node in tree.body:
            if isinstance(node, _wanted(granularity)):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                return "\n".join(rows[first - 1 : node.end_lineno])
        if not prefixes:
            return None
    if prefixes:
        return next((part for k in range(len(rows), 0, -1) if (part := "\n".join(rows[:k])).strip() and _parsed(part) is not None), None)
    for k in range(1, min(LEADING_PYTHON, len(rows) - 1) + 1):
        part = "\n".join(rows[k:])
        if part.strip() and _parsed(part) is not None:
            return first_python_node(part, granularity) or part
    return None


def first_brace_node(text: str, language: str, granularity: str) -> str | None:
    """The first definition of the kind; else the text without leading lines, once it has one."""
    rows = text.splitlines()
    for k in range(min(LEADING, max(len(rows) - 1, 0)) + 1):
        src, found = find_definitions("\n".join(rows[k:]), language)
        for d in found:
            if d.kind == granularity:
                return src.slice(d.source_first, d.source_last if d.source_last >= 0 else d.last)
    return None


def clean_snippet(raw: str | None, language: str, granularity: str) -> str | None:
    """Null where nothing of the kind is found."""
    if raw is None or not raw.strip():
        return None
    text = longest_fence(raw)
    out = first_python_node(text, granularity, prefixes=True) if language == "Python" else first_brace_node(text, language, granularity)
    return out if out and out.strip() else None


def cleaned(raw: Column, language: str, granularity: str) -> Column:
    """clean_snippet over a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([clean_snippet(t, language, granularity) for t in texts], dtype="object")

    return run(raw)


def without_imports(raw: Column, granularity: str) -> Column:
    """Python code cut to its first definition; null where there is none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([first_python_node(t, granularity) if t and t.strip() else None for t in texts], dtype="object")

    return run(raw)


# Fixed value: what asks a generator for code.
PROMPT = "Implement the following {language} {granularity}. Reply with code only.\n\n{skeleton}"


def prompts(language: Column, granularity: Column, skeleton: Column, template: str = PROMPT) -> Column:
    out = F.lit(template)
    for name, value in (("language", language), ("granularity", granularity), ("skeleton", skeleton)):
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def generated(rows, skeleton: str, generate, into: str = "generated_code"):
    """rows with a column of what generate (list of texts to list of texts or None) returns; a failed batch gives nulls."""
    schema = rows.withColumn(into, F.lit(None).cast("string")).schema

    def run(batches):
        for batch in batches:
            texts: Sequence[str] = batch[skeleton].tolist()
            try:
                found = list(generate(texts))
            except Exception:  # the generator is foreign code; its failure costs this batch
                found = [None] * len(texts)
            yield batch.assign(**{into: pd.Series(found, index=batch.index, dtype="object")})

    return rows.mapInPandas(run, schema)
