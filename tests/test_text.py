"""Text expressions on very long literals, and each pattern against its plain form."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text


@pytest.mark.parametrize("quote", ['"', "'"])
def test_many_escapes_in_one_literal(spark, quote):
    code = "x = " + quote + "\\n" * 100_000 + quote + "; y = " + quote + '\\"' * 1000
    df = spark.createDataFrame([(1, code)], "k int, code string")
    r = df.select(text.code_tokens(F.col("code")).alias("t"), text.strip_comments_and_strings(F.col("code")).alias("s")).first()
    assert r["t"][:6] == ["x", "=", "STR", ";", "y", "="]
    assert r["s"].startswith("x =  ; y = ")


def test_looped_patterns_equal_the_plain_ones(spark):
    rng = random.Random(3)
    signs = ['"', "'", "\\", "\n", "a", " ", "#", "/", "*", '"""', "'''", "\\\\"]
    codes = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(codes)), "k int, code string").coalesce(2)
    got = {r["k"]: r["s"] for r in df.select("k", text.strip_comments_and_strings(F.col("code")).alias("s")).collect()}
    assert got == {k: re.sub(text.COMMENT_OR_STRING, " ", c) for k, c in enumerate(codes)}


def test_used_imports(spark):
    rows = F.array(*[F.struct(F.lit(s).alias("stmt"), F.array(*[F.lit(n) for n in names]).alias("names")) for s, names in (("import os", ["os"]), ("from a import *", ["*"]), ("import re", ["re"]))])
    df = spark.createDataFrame([(1, "os.path # re"), (2, "x.os 're'"), (3, None)], "k int, code string")
    got = {r["k"]: r["u"] for r in df.select("k", text.used_imports(rows, F.col("code")).alias("u")).collect()}
    assert got[1] == ["import os", "from a import *"] and got[2] == ["from a import *"] and got[3] in (["from a import *"], None)


def test_long_texts_take_time_in_proportion_to_their_lines(spark):
    """What holds for all lines or bodies is worked out once, not for each of them."""
    rows = 20_000
    code = "def f():" + "\n      a" * rows
    fenced = "```\nx\n```\n" * rows + "```py\nlonger\n```"
    df = spark.createDataFrame([(code, fenced)], "code string, fenced string")
    began = time.time()
    r = df.select(text.clean_indentation(F.col("code")).alias("c"), text.strip_fences(F.col("fenced")).alias("f")).first()
    assert r["c"] == "def f():" + "\n    a" * rows and r["f"] == "longer"
    assert time.time() - began < 30


def test_odd_snippets(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\n  \n"), (4, "a\n      b\n     \n c"), (5, "```\n```"), (6, "```\nab\n``` ```\ncd\n```")], "k int, t string").coalesce(1)
    got = {r["k"]: (r["c"], r["f"]) for r in df.select("k", text.clean_indentation(F.col("t")).alias("c"), text.strip_fences(F.col("t")).alias("f")).collect()}
    assert got == {1: ("", None), 2: ("", ""), 3: ("a\n\n  \n", "a"), 4: ("a\n      b\n     \n c", "a\n      b\n     \n c"), 5: ("```\n```", ""), 6: ("```\nab\n``` ```\ncd\n```", "ab")}
