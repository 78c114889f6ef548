"""Queries over the tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill import config, sinks
from corpusmill.functions import metrics, text
from corpusmill.operators import allocation, cleaning, dedup, discovery, evaluation, extraction, manifests, quality, scoring, testsuite
from corpusmill.plans import build, datasets
from corpusmill.sources import files, remote
from corpusmill.streaming import paging

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_Reader = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of a table reader under name, with its SQL."""

    def keep(build: Callable[[_Reader], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return keep


# ---------------------------------------------------------------- allocation

_CAPS = """
g AS (SELECT source AS repo, count(*) AS cnt FROM documents GROUP BY 1),
w AS (SELECT repo, cnt, sum(cnt) OVER () AS total, sum(CASE WHEN cnt > 0 THEN 1 ELSE 0 END) OVER () AS live FROM g),
e AS (SELECT *, least({cap}, total) AS eff, total - live AS spare FROM w),
x AS (SELECT *, CASE WHEN spare > 0 THEN ((eff - live) * (cnt - 1)) // spare ELSE 0 END AS fl, CASE WHEN spare > 0 THEN ((eff - live) * (cnt - 1)) % spare ELSE 0 END AS rest FROM e),
r AS (SELECT *, sum(1 + fl) OVER () AS given, row_number() OVER (ORDER BY rest DESC, cnt DESC, repo) AS rr, row_number() OVER (ORDER BY cnt DESC, repo) AS sr FROM x),
caps AS (SELECT repo, cnt, CAST(CASE WHEN eff < live THEN CASE WHEN sr <= eff THEN 1 ELSE 0 END ELSE 1 + fl + CASE WHEN rr <= eff - given THEN 1 ELSE 0 END END AS BIGINT) AS cap_rows FROM r)
"""
CAP = 50


def _documents(t: _Reader) -> DataFrame:
    return t("documents").withColumnRenamed("source", "repo")


def _caps(t: _Reader, cap: int = CAP) -> DataFrame:
    return allocation.stratified_caps(_documents(t).groupBy("repo").agg(F.count("*").alias("cnt")), cap)


@query("strat_caps", f"WITH {_CAPS.format(cap=CAP)} SELECT repo, cnt, cap_rows FROM caps")
def strat_caps(t: _Reader) -> DataFrame:
    return _caps(t)


@query("strat_caps_few", f"WITH {_CAPS.format(cap=7)} SELECT repo, cnt, cap_rows FROM caps")
def strat_caps_few(t: _Reader) -> DataFrame:
    return _caps(t, 7)


_FIRST = f"WITH {_CAPS.format(cap=CAP)}, p AS (SELECT d.source AS repo, doc_id, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS pos FROM documents d), f AS (SELECT p.*, cap_rows FROM p JOIN caps USING (repo))"


@query("first_n_per_repo", f"{_FIRST} SELECT repo, doc_id, pos FROM f WHERE pos <= cap_rows")
def first_n_per_repo(t: _Reader) -> DataFrame:
    return allocation.first_n(_documents(t).select("repo", "doc_id"), _caps(t), "repo", ["doc_id"]).filter("pos <= cap_rows").select("repo", "doc_id", "pos")


@query("buffered_caps_surplus", f"{_FIRST} SELECT repo, doc_id, pos, pos > cap_rows AS surplus FROM f WHERE pos <= least(cap_rows * 2, cap_rows + 50)")
def buffered_caps_surplus(t: _Reader) -> DataFrame:
    rows = allocation.first_n(_documents(t).select("repo", "doc_id"), _caps(t), "repo", ["doc_id"])
    return rows.filter(F.col("pos") <= allocation.buffered_cap(F.col("cap_rows"))).select("repo", "doc_id", "pos", (F.col("pos") > F.col("cap_rows")).alias("surplus"))


@query(
    "refill_shortfall",
    f"{_FIRST}, kept AS (SELECT * FROM f WHERE pos <= cap_rows AND repo <> 'src0'), spare AS (SELECT repo, doc_id, pos FROM f WHERE pos > cap_rows AND repo <> 'src0' AND doc_id NOT IN (SELECT doc_id FROM kept)) SELECT repo, doc_id, pos FROM spare ORDER BY repo, pos LIMIT 10",
)
def refill_shortfall(t: _Reader) -> DataFrame:
    """One repository fails; the ten rows it leaves short come from the others' surplus in order."""
    rows = allocation.first_n(_documents(t).select("repo", "doc_id"), _caps(t), "repo", ["doc_id"]).filter(F.col("repo") != "src0")
    return allocation.refill(rows.filter("pos > cap_rows").select("repo", "doc_id", "pos"), rows.filter("pos <= cap_rows"), 10, ["doc_id"], [F.asc("repo"), F.asc("pos")])


@query(
    "proportional_sample",
    """WITH g AS (SELECT source, count(*) AS cnt FROM documents GROUP BY 1), q AS (SELECT *, sum(cnt) OVER () AS total FROM g),
    z AS (SELECT source, (least(100, total) * cnt) // total AS quota, (least(100, total) * cnt) % total AS rest, least(100, total) AS cap FROM q),
    k AS (SELECT source, quota + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= cap - sum(quota) OVER () THEN 1 ELSE 0 END AS take FROM z)
    SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s|' || doc_id), doc_id) AS rn FROM documents) JOIN k USING (source) WHERE rn <= take""",
)
def proportional_sample(t: _Reader) -> DataFrame:
    return allocation.proportional_sample(t("documents").select("doc_id", "source"), 100, "source", "doc_id", "s")


@query(
    "two_level_cap",
    "WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('c|' || doc_id), doc_id) AS rn FROM documents) SELECT doc_id, source FROM k WHERE rn <= 8 ORDER BY md5('ct|' || doc_id), doc_id LIMIT 60",
)
def two_level_cap(t: _Reader) -> DataFrame:
    return allocation.two_level_cap(t("documents").select("doc_id", "source"), "source", 8, 60, "doc_id", "c")


@query(
    "strat_split_80_10_10",
    "WITH r AS (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY md5('42|' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY lang, quality) AS n FROM documents JOIN labels USING (doc_id)) SELECT doc_id, lang, quality, CASE WHEN rn * 10 <= n * 8 THEN 'train' WHEN rn * 10 <= n * 9 THEN 'val' ELSE 'test' END AS split FROM r",
)
def strat_split(t: _Reader) -> DataFrame:
    rows = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id")
    return allocation.stratified_split(rows, ["lang", "quality"], "doc_id", "42")


@query("seeded_sample", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber LIMIT 500")
def seeded_sample(t: _Reader) -> DataFrame:
    return allocation.seeded_sample(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 500, ["l_orderkey", "l_linenumber"], "42")


# ---------------------------------------------------------------- discovery

_START, _END = date(1995, 1, 1), date(1996, 12, 31)


def _repos(t: _Reader) -> DataFrame:
    return t("orders").select(F.concat(F.lit("repo/"), F.col("o_orderkey").cast("string")).alias("full_name"), F.col("o_totalprice").alias("stars"), F.col("o_orderdate").alias("created"), F.col("o_custkey").alias("owner"))


_REPOS = "repos AS (SELECT 'repo/' || o_orderkey AS full_name, o_totalprice AS stars, o_orderdate AS created, o_custkey AS owner FROM orders)"
_WHERE = "created >= TIMESTAMP '1995-01-01' AND created < TIMESTAMP '1997-01-01' AND stars >= 100000"


@query("discovery_filter", f"WITH {_REPOS} SELECT full_name, stars, owner FROM repos WHERE {_WHERE}")
def discovery_filter(t: _Reader) -> DataFrame:
    return discovery.qualify(_repos(t), _START, _END, 100000).select("full_name", "stars", "owner")


_LOGINS = "logins AS (SELECT user_id, user_id % 50 AS owner, CASE WHEN user_id % 11 = 0 THEN 'ci-' || user_id || '[BOT]' ELSE 'u' || user_id END AS login, CASE WHEN user_id % 13 = 0 THEN 'Bot' ELSE 'User' END AS kind FROM (SELECT DISTINCT user_id FROM events))"


def _contributors(t: _Reader) -> DataFrame:
    u = F.col("user_id")
    people = t("events").select("user_id").distinct()
    people = people.select((u % 50).alias("owner"), F.when(u % 11 == 0, F.concat(F.lit("ci-"), u.cast("string"), F.lit("[BOT]"))).otherwise(F.concat(F.lit("u"), u.cast("string"))).alias("login"), F.when(u % 13 == 0, "Bot").otherwise("User").alias("kind"))
    return people.groupBy("owner").agg(F.count_if(~discovery.is_bot(F.col("login"), F.col("kind"))).alias("contributors"), F.count("*").alias("accounts"))


_CONTRIB = f"{_LOGINS}, contrib AS (SELECT owner, count(*) FILTER (WHERE NOT (lower(login) LIKE '%[bot]' OR kind = 'Bot')) AS contributors, count(*) AS accounts FROM logins GROUP BY 1)"


@query("contributor_counts", f"WITH {_CONTRIB} SELECT owner, contributors, accounts FROM contrib")
def contributor_counts(t: _Reader) -> DataFrame:
    return _contributors(t)


@query("discovery_topk", f"WITH {_REPOS}, {_CONTRIB} SELECT full_name, stars FROM (SELECT full_name, stars, contributors FROM (SELECT * FROM repos WHERE {_WHERE} ORDER BY stars DESC, full_name LIMIT 1000) p LEFT JOIN contrib ON contrib.owner = p.owner) WHERE contributors IS NULL OR contributors >= 2 ORDER BY stars DESC, full_name LIMIT 40")
def discovery_topk(t: _Reader) -> DataFrame:
    page = discovery.qualify(_repos(t), _START, _END, 100000).orderBy(F.desc("stars"), "full_name").limit(discovery.LIMIT)
    rows = page.join(F.broadcast(_contributors(t)), "owner", "left")  # a row for each of 50 owners
    return discovery.top(rows, 40, least_contributors=2, scanned=None).select("full_name", "stars")


@query(
    "discovery_windows",
    """WITH RECURSIVE days AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1),
    w AS (SELECT DATE '1995-01-01' AS s, DATE '1996-12-31' AS e
      UNION ALL
      SELECT CASE WHEN h = 0 THEN s ELSE s + CAST((e - s) // 2 AS INTEGER) + 1 END, CASE WHEN h = 0 THEN s + CAST((e - s) // 2 AS INTEGER) ELSE e END
      FROM w, (SELECT 0 AS h UNION ALL SELECT 1) WHERE s < e AND (SELECT coalesce(sum(n), 0) FROM days WHERE d BETWEEN s AND e) > 100)
    SELECT s AS window_start, e AS window_end, CAST(n AS BIGINT) AS n_rows, n > 100 AS truncated FROM (SELECT s, e, (SELECT coalesce(sum(n), 0) FROM days WHERE d BETWEEN s AND e) AS n FROM w) WHERE n > 0 AND (n <= 100 OR s = e)""",
)
def discovery_windows(t: _Reader) -> DataFrame:
    return discovery.windows(_repos(t), _START, _END, 100)


@query("count_probe", f"WITH {_REPOS} SELECT count(*) AS total, count(*) > 1000 AS incomplete FROM repos WHERE {_WHERE}")
def count_probe(t: _Reader) -> DataFrame:
    return discovery.qualify(_repos(t), _START, _END, 100000).agg(F.count("*").alias("total"), (F.count("*") > discovery.LIMIT).alias("incomplete"))


@query(
    "repo_metadata",
    "SELECT 'repo/' || o_orderkey AS full_name, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'pushed' END, 'unknown') AS last_commit, nullif(o_orderstatus, 'P') AS license_spdx, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) // 2 AS BIGINT) AS half_days FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'",
)
def repo_metadata(t: _Reader) -> DataFrame:
    k = F.col("o_orderkey")
    commit = F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    pushed = F.when(k % 9 != 0, F.lit("pushed"))
    rows = t("orders").filter(F.col("o_orderdate") >= F.lit(_START))
    return rows.select(F.concat(F.lit("repo/"), k.cast("string")).alias("full_name"), F.coalesce(commit, pushed, F.lit("unknown")).alias("last_commit"), F.nullif("o_orderstatus", F.lit("P")).alias("license_spdx"), F.floor(F.datediff("o_orderdate", F.lit(_START)) / 2).cast("long").alias("half_days"))


@query("default_end_date", "SELECT o_orderkey, DATE '1998-08-31' - 30 AS end_date, CAST(o_orderdate AS DATE) <= DATE '1998-08-31' - 30 AS covered FROM orders")
def default_end_date(t: _Reader) -> DataFrame:
    end = F.lit(config.default_end(date(1998, 8, 31)))
    return t("orders").select("o_orderkey", end.alias("end_date"), (F.to_date("o_orderdate") <= end).alias("covered"))


@query("api_plan", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, greatest(1, CAST(ceil(n * 40 / 100.0) AS BIGINT)) AS pages, greatest(1, CAST(ceil(n * 40 / 100.0) AS BIGINT)) + 1 AS calls, (n * 40) // 5 AS repos FROM c")
def api_plan(t: _Reader) -> DataFrame:
    @F.pandas_udf("struct<pages: long, calls: long, repos: long>")
    def planned(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"pages": n.map(remote.contributor_pages), "calls": n.map(remote.calls_for_repo), "repos": n.map(remote.estimate_repos)})

    return t("orders").groupBy("o_custkey").agg((F.count("*") * 40).alias("n")).select("o_custkey", planned("n").alias("p")).select("o_custkey", "p.pages", "p.calls", "p.repos")


# ---------------------------------------------------------------- engineered filter

_METRICS = """
m AS (SELECT c_custkey AS full_name, any_value(c_mktsegment) AS license_spdx, count(DISTINCT o_orderpriority) AS contributor_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS release_count,
  count(DISTINCT o_orderkey) AS pull_request_count, greatest(count(l_linenumber) - count(DISTINCT o_orderkey), 0) AS issue_count, coalesce(CAST(sum(l_quantity) AS BIGINT), 0) AS loc, count(*) FILTER (WHERE l_returnflag = 'R') AS comment_lines
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
q AS (SELECT *, CASE WHEN loc + comment_lines = 0 THEN 0.0 ELSE CAST(loc AS DOUBLE) / (loc + comment_lines) END AS code_ratio FROM m)
"""


def _quality_metrics(t: _Reader) -> DataFrame:
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    orders = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = orders.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("contributor_count"), F.sum(F.when(F.col("o_orderstatus") == "F", n).otherwise(0)).alias("release_count"), F.count("*").alias("pull_request_count"), F.sum(F.coalesce("n", F.lit(0))).alias("_lines"), F.sum("q").cast("long").alias("loc"), F.sum(F.coalesce("r", F.lit(0))).alias("comment_lines"))
    out = t("customer").select(F.col("c_custkey").alias("full_name"), F.col("c_mktsegment").alias("license_spdx")).join(per, F.col("full_name") == F.col("o_custkey"), "left").na.fill(0)
    out = out.withColumn("issue_count", F.greatest(F.col("_lines") - F.col("pull_request_count"), F.lit(0)))
    return out.select("full_name", "license_spdx", "contributor_count", "release_count", "pull_request_count", "issue_count", "loc", "comment_lines", quality.code_ratio(F.col("loc"), F.col("comment_lines")).alias("code_ratio"))


@query("quality_metrics", f"WITH {_METRICS} SELECT * FROM q")
def quality_metrics(t: _Reader) -> DataFrame:
    return _quality_metrics(t)


_BAD_LICENCES = ("MACHINERY", "NOASSERTION")


@query(
    "engineered_filter",
    f"""WITH {_METRICS}, s AS (SELECT *, license_spdx IS NOT NULL AND license_spdx NOT IN ('MACHINERY', 'NOASSERTION') AS s1, contributor_count >= 2 AND release_count > 0 AS s2 FROM q),
    l AS (SELECT quantile_cont(pull_request_count, 0.25) AS pr, quantile_cont(issue_count, 0.25) AS iss, quantile_cont(loc, 0.25) AS lc, avg(CASE WHEN code_ratio > 0 THEN code_ratio END) AS m, stddev_pop(CASE WHEN code_ratio > 0 THEN code_ratio END) AS d, count(CASE WHEN code_ratio > 0 THEN 1 END) AS n FROM s WHERE s1 AND s2)
    SELECT full_name, s1 AS passes_stage1, s2 AS passes_stage2, coalesce(s1 AND s2 AND NOT (pull_request_count < pr OR issue_count < iss OR loc < lc) AND (code_ratio <= 0 OR code_ratio BETWEEN CASE WHEN n >= 2 THEN m - 2.17 * d ELSE 0 END AND CASE WHEN n >= 2 THEN m + 2.17 * d ELSE 1 END), false) AS passes_all FROM s, l""",
)
def engineered_filter(t: _Reader) -> DataFrame:
    return quality.apply_filters(_quality_metrics(t), _BAD_LICENCES).select("full_name", "passes_stage1", "passes_stage2", "passes_all")


# ---------------------------------------------------------------- text



def _quoted(pattern: str) -> str:
    """A SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _tokens_sql() -> str:
    out = f"regexp_replace(text, {_quoted(text.SPACE + '+')}, ' ', 'g')"
    for pattern in text.LITERALS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, 'STR', 'g')"
    return f"regexp_extract_all({out}, {_quoted(text.TOKEN)})"


_TOKENS = _tokens_sql()


@query("tokenize_code", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def tokenize_code(t: _Reader) -> DataFrame:
    rows = t("documents").select("doc_id", text.code_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query("token_counts", f"SELECT lang, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(sum(len(list_distinct(t))) AS BIGINT) AS distinct_per_doc FROM (SELECT lang, {_TOKENS} AS t FROM documents) GROUP BY 1")
def token_counts(t: _Reader) -> DataFrame:
    rows = t("documents").select("lang", text.code_tokens(F.col("text")).alias("t"))
    return rows.groupBy("lang").agg(F.sum(F.size("t")).cast("long").alias("tokens"), F.sum(F.size(F.array_distinct("t"))).cast("long").alias("distinct_per_doc"))


@query(
    "raw_lines",
    r"SELECT doc_id, CAST(len(l) AS BIGINT) AS loc, CAST(len(list_filter(l, lambda x: NOT regexp_matches(x, '[^ \t\n\x0B\f\r]'))) AS BIGINT) AS blank, CAST(list_max(list_transform(l, lambda x: length(x))) AS BIGINT) AS longest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
)
def raw_lines(t: _Reader) -> DataFrame:
    rows = t("documents").select("doc_id", text.lines(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("loc"), F.size(F.filter("l", text.blank)).cast("long").alias("blank"), F.array_max(F.transform("l", F.length)).cast("long").alias("longest"))


@query("minified_flag", "SELECT doc_id, list_max(s) > 1000 OR list_sum(s) > 300 * len(s) AS minified FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS s FROM documents)")
def minified_flag(t: _Reader) -> DataFrame:
    return t("documents").select("doc_id", text.minified(F.col("text")).alias("minified"))


@query(
    "clean_indent",
    r"""WITH s AS (SELECT doc_id, string_split('def f():' || chr(10) || regexp_replace(text, '\n', chr(10) || repeat(' ', 6 + CAST(doc_id % 3 AS INTEGER)), 'g'), chr(10)) AS l FROM documents),
    i AS (SELECT doc_id, l, list_min(list_transform(list_filter(l[2:], lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')), lambda x: length(regexp_extract(x, '^[ \t\x0B\f\r]*')))) AS ind FROM s)
    SELECT doc_id, md5(array_to_string(list_transform(l, lambda x, k: CASE WHEN k = 1 OR length(x) < greatest(coalesce(ind, 0) - 4, 0) THEN x ELSE substring(x, CAST(greatest(coalesce(ind, 0) - 4, 0) + 1 AS BIGINT)) END), chr(10))) AS cleaned_md5 FROM i""",
)
def clean_indent(t: _Reader) -> DataFrame:
    pad = F.concat(F.lit("\n"), F.repeat(F.lit(" "), (6 + F.col("doc_id") % 3).cast("int")))
    snippet = F.concat(F.lit("def f():\n"), F.replace(F.col("text"), F.lit("\n"), pad))
    return t("documents").select("doc_id", F.md5(text.clean_indentation(snippet).cast("binary")).alias("cleaned_md5"))


@query(
    "fence_strip",
    r"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'Here:' || chr(10) || '```python' || chr(10) || left(text, 40) || chr(10) || '```' || chr(10) || 'or' || chr(10) || '```' || chr(10) || text || chr(10) || '```' ELSE text END AS raw FROM conversations),
    b AS (SELECT *, regexp_extract_all(raw, '```[a-zA-Z+#]*\n([\s\S]*?)```', 1) AS bodies FROM r)
    SELECT conv_id, turn, md5(regexp_replace(CASE WHEN len(bodies) > 0 THEN list_filter(bodies, lambda x: length(x) = list_max(list_transform(bodies, lambda y: length(y))))[1] ELSE raw END, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')) AS code_md5 FROM b""",
)
def fence_strip(t: _Reader) -> DataFrame:
    x = F.col("text")
    raw = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Here:\n```python\n"), F.left(x, F.lit(40)), F.lit("\n```\nor\n```\n"), x, F.lit("\n```"))).otherwise(x)
    return t("conversations").select("conv_id", "turn", F.md5(text.strip_fences(raw).cast("binary")).alias("code_md5"))


@query(
    "comment_clean",
    r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace('/** ' || regexp_replace(text, '\n', chr(10) || ' * ', 'g') || ' */', '^/\*+|\*+/$', '', 'g'), '(?m)^[ \t]*\*+ ?', '', 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')) AS comment_md5 FROM documents",
)
def comment_clean(t: _Reader) -> DataFrame:
    raw = F.concat(F.lit("/** "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n * ")), F.lit(" */"))
    return t("documents").select("doc_id", F.md5(F.coalesce(text.clean_block_comment(raw), F.lit("")).cast("binary")).alias("comment_md5"))


@query("literal_strip", "SELECT doc_id, md5(text) AS inner_md5 FROM documents")
def literal_strip(t: _Reader) -> DataFrame:
    quote = F.when(F.col("doc_id") % 2 == 0, '"""').otherwise("'''")
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, "rb").when(F.col("doc_id") % 3 == 1, "f").otherwise(""), quote, F.col("text"), quote)
    return t("documents").select("doc_id", F.md5(text.strip_python_literal(raw).cast("binary")).alias("inner_md5"))


_IMPORTS = (("import the", ["the"]), ("import of", ["of"]), ("from a import b", ["la", "der"]), ("import all", ["*"]))


@query(
    "used_imports",
    f"""WITH s AS (SELECT doc_id, regexp_replace(text, {_quoted(text.COMMENT_OR_STRING)}, ' ', 'g') AS c FROM documents),
    u AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(c, '(^|[^A-Za-z0-9_.])the($|[^A-Za-z0-9_])') THEN 'import the' END, CASE WHEN regexp_matches(c, '(^|[^A-Za-z0-9_.])of($|[^A-Za-z0-9_])') THEN 'import of' END, CASE WHEN regexp_matches(c, '(^|[^A-Za-z0-9_.])(la|der)($|[^A-Za-z0-9_])') THEN 'from a import b' END, 'import all'], lambda x: x IS NOT NULL) AS used FROM s)
    SELECT doc_id, array_to_string(used, ';') AS used FROM u""",
)
def used_imports(t: _Reader) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("stmt"), F.array(*[F.lit(n) for n in names]).alias("names")) for s, names in _IMPORTS])
    return t("documents").select("doc_id", F.array_join(text.used_imports(rows, F.col("text")), ";").alias("used"))


@query("permalink", "SELECT doc_id, 'https://host/' || source || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '/blob/' || md5(CAST(doc_id AS VARCHAR)) || '/f' || doc_id || '.py#L1-L' || n_chars END AS url FROM documents")
def permalink(t: _Reader) -> DataFrame:
    k = F.col("doc_id").cast("string")
    place = F.concat(F.lit("/blob/"), F.md5(k.cast("binary")), F.lit("/f"), k, F.lit(".py#L1-L"), F.col("n_chars").cast("string"))
    return t("documents").select("doc_id", F.concat(F.lit("https://host/"), F.col("source"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(place)).alias("url"))


@query("slug", "SELECT page_id, regexp_replace(regexp_replace(lower(string_split(url, '/')[-1]), '[^a-z0-9]+', '-', 'g'), '-$', '') AS slug FROM pages")
def slug(t: _Reader) -> DataFrame:
    return t("pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("short_name_default", "SELECT p_partkey, string_split(p_name, ' ')[-1] AS short_name, coalesce(CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS VARCHAR) END, 'latest') AS version FROM part")
def short_name_default(t: _Reader) -> DataFrame:
    size = F.col("p_size")
    return t("part").select("p_partkey", F.element_at(F.split("p_name", " "), -1).alias("short_name"), F.coalesce(F.when(size % 5 != 0, size.cast("string")), F.lit("latest")).alias("version"))


@query("duration_text", "WITH s AS (SELECT event_id, CAST(ceil(abs(value) * 97 - 1e-9) AS BIGINT) AS n FROM events) SELECT event_id, CASE WHEN n >= 3600 THEN (n // 3600) || 'h ' || lpad(CAST((n % 3600) // 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || 's' WHEN n >= 60 THEN (n // 60) || 'm ' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || 's' ELSE n || 's' END AS took FROM s")
def duration_text(t: _Reader) -> DataFrame:
    return t("events").select("event_id", text.duration_text(F.abs("value") * 97).alias("took"))


@query("prompts", "SELECT conv_id, turn, 'Implement the following ' || role || ' ' || CASE WHEN turn % 2 = 0 THEN 'function' ELSE 'class' END || '. Reply with code only.' || chr(10) || chr(10) || text AS prompt FROM conversations")
def prompts(t: _Reader) -> DataFrame:
    kind = F.when(F.col("turn") % 2 == 0, "function").otherwise("class")
    return t("conversations").select("conv_id", "turn", cleaning.prompts(F.col("role"), kind, F.col("text")).alias("prompt"))


@query("redact", "SELECT conv_id, turn, md5(replace(text, substr(text, 1, 3), '***')) AS shown FROM conversations")
def redact(t: _Reader) -> DataFrame:
    return t("conversations").select("conv_id", "turn", F.md5(text.redact(F.col("text"), F.substr("text", F.lit(1), F.lit(3))).cast("binary")).alias("shown"))


@query("line_sets", "SELECT doc_id, len(list_filter(list_distinct(l), lambda x: NOT list_contains(s, x))) AS only_lines, len(list_distinct(list_concat(l, s))) AS all_lines FROM (SELECT doc_id, string_split(text, chr(10)) AS l, string_split(text, '. ') AS s FROM documents)")
def line_sets(t: _Reader) -> DataFrame:
    rows = t("documents").select("doc_id", text.lines(F.col("text")).alias("l"), F.split("text", r"\. ", -1).alias("s"))
    return rows.select("doc_id", F.size(F.array_except("l", "s")).cast("long").alias("only_lines"), F.size(F.array_union("l", "s")).cast("long").alias("all_lines"))


# ---------------------------------------------------------------- metrics

_BASE = f"b AS (SELECT doc_id, CAST(len(list_distinct(list_filter(t, lambda x: NOT regexp_matches(x, '^[a-zA-Z_]')))) AS DOUBLE) AS h1, CAST(len(list_distinct(list_filter(t, lambda x: regexp_matches(x, '^[a-zA-Z_]')))) AS DOUBLE) AS h2, CAST(len(list_filter(t, lambda x: NOT regexp_matches(x, '^[a-zA-Z_]'))) AS DOUBLE) AS n1, CAST(len(list_filter(t, lambda x: regexp_matches(x, '^[a-zA-Z_]'))) AS DOUBLE) AS n2 FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))"


def _base(t: _Reader) -> DataFrame:
    word = lambda x: x.rlike("^[a-zA-Z_]")
    rows = t("documents").select("doc_id", "text", text.code_tokens(F.col("text")).alias("t")).withColumn("o", F.filter("t", lambda x: ~word(x))).withColumn("w", F.filter("t", word))
    size = lambda c: F.size(c).cast("double")
    return rows.select("doc_id", "text", size(F.array_distinct("o")).alias("h1"), size(F.array_distinct("w")).alias("h2"), size("o").alias("n1"), size("w").alias("n2"))


@query("halstead_base", f"WITH {_BASE} SELECT doc_id, h1, h2, n1, n2 FROM b")
def halstead_base(t: _Reader) -> DataFrame:
    return _base(t).drop("text")


@query("halstead_formulas", f"WITH {_BASE} SELECT doc_id, h1 + h2 AS vocabulary, n1 + n2 AS halstead_length, round(CASE WHEN h1 + h2 > 0 THEN (n1 + n2) * log2(h1 + h2) ELSE 0 END, 2) AS volume, round(CASE WHEN h2 > 0 THEN h1 / 2 * n2 / h2 ELSE 0 END, 2) AS difficulty FROM b")
def halstead_formulas(t: _Reader) -> DataFrame:
    h = metrics.halstead(*(F.col(c) for c in ("h1", "h2", "n1", "n2")))
    return _base(t).select("doc_id", h["vocabulary"].alias("vocabulary"), h["halstead_length"].alias("halstead_length"), F.round(h["volume"], 2).alias("volume"), F.round(h["difficulty"], 2).alias("difficulty"))


@query("maintainability", f"WITH {_BASE}, v AS (SELECT b.doc_id, CASE WHEN h1 + h2 > 0 THEN (n1 + n2) * log2(h1 + h2) ELSE 0 END AS volume, len(string_split(text, chr(10))) AS sloc FROM b JOIN documents d ON d.doc_id = b.doc_id) SELECT doc_id, round(CASE WHEN volume <= 0 THEN 100 ELSE greatest(0, (171 - 5.2 * ln(volume) - 0.23 * 3 - 16.2 * ln(sloc) + 50 * sin(sqrt(2.4 * 0.25))) * 100 / 171) END, 2) AS mi FROM v")
def maintainability(t: _Reader) -> DataFrame:
    h = metrics.halstead(*(F.col(c) for c in ("h1", "h2", "n1", "n2")))
    rows = _base(t).select("doc_id", h["volume"].alias("volume"), F.size(text.lines(F.col("text"))).alias("sloc"))
    return rows.select("doc_id", F.round(metrics.maintainability(F.col("volume"), F.lit(3), F.col("sloc"), F.lit(0.25)), 2).alias("mi"))


# ---------------------------------------------------------------- de-duplication

_GREEDY = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, CASE WHEN regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') THEN list_distinct({_TOKENS}) END AS t FROM documents),
l AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM s WHERE t IS NOT NULL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM l a JOIN l b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k) UNION SELECT x.doc_id, y.doc_id FROM s x JOIN s y ON len(x.t) = 0 AND len(y.t) = 0 AND x.doc_id < y.doc_id),
o AS MATERIALIZED (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS i FROM e GROUP BY b),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT o.i, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, b) ELSE gone END FROM g JOIN o ON o.i = g.i + 1)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM g ORDER BY i DESC LIMIT 1))"""


@query("dedup_exact", _GREEDY)
def dedup_exact(t: _Reader) -> DataFrame:
    return dedup.deduplicate(t("documents").select("doc_id", "text"), "doc_id", "text", 80).select("doc_id")


@query("dedup_lsh")
def dedup_lsh(t: _Reader) -> DataFrame:
    return dedup.deduplicate(t("documents").select("doc_id", "text"), "doc_id", "text", 80, "lsh").select("doc_id")


@query("minhash_sig")
def minhash_sig(t: _Reader) -> DataFrame:
    return dedup.minhash(dedup.token_sets(t("documents"), "doc_id", "text"), "doc_id").select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query("jaccard_pairs", f"WITH s AS (SELECT item_id, list_distinct({_TOKENS}) AS t FROM benchmark), l AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM s), p AS (SELECT a.item_id AS a, b.item_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM l a JOIN l b ON a.w = b.w AND a.item_id < b.item_id GROUP BY 1, 2) SELECT a, b FROM p WHERE 100 * k >= 20 * (na + nb - k)")
def jaccard_pairs(t: _Reader) -> DataFrame:
    return dedup.exact_pairs(dedup.token_sets(t("benchmark"), "item_id", "text"), "item_id", 20)


@query("dedup_by_key", "WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, url FROM pages) SELECT host, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM h GROUP BY 1")
def dedup_by_key(t: _Reader) -> DataFrame:
    rows = t("pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), "page_id", "url")
    return discovery.last_wins(rows.withColumn("o", F.col("page_id")), "host", "o").select("host", "page_id", "url")


# ---------------------------------------------------------------- joins and lookups


@query("contamination_semi", "SELECT d.doc_id FROM documents d WHERE d.text IN (SELECT text FROM benchmark WHERE text IS NOT NULL) OR d.source IN (SELECT 'src' || (item_id % 3) FROM benchmark)")
def contamination_semi(t: _Reader) -> DataFrame:
    marks = t("benchmark").select(F.sha2("text", 256).alias("k")).distinct()
    sources = t("benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 3).cast("string")).alias("source")).distinct()
    docs = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("k"))
    return docs.join(marks, "k", "left_semi").select("doc_id").unionByName(docs.join(sources, "source", "left_semi").select("doc_id")).distinct()


@query("lookup_first", "SELECT l.doc_id, f.first_id FROM labels l JOIN documents d USING (doc_id) JOIN (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY 1) f ON f.text = d.text")
def lookup_first(t: _Reader) -> DataFrame:
    docs = t("documents").select("doc_id", F.sha2("text", 256).alias("sig"))
    return t("labels").select("doc_id").join(docs, "doc_id").join(docs.groupBy("sig").agg(F.min("doc_id").alias("first_id")), "sig").select("doc_id", "first_id")


@query("caps_lookup", f"WITH {_CAPS.format(cap=CAP)} SELECT d.doc_id, CASE WHEN d.source = 'src1' THEN NULL ELSE cap_rows END AS cap_rows FROM documents d LEFT JOIN caps ON caps.repo = d.source")
def caps_lookup(t: _Reader) -> DataFrame:
    return _documents(t).select("doc_id", "repo").join(F.broadcast(_caps(t).filter(F.col("repo") != "src1")), "repo", "left").select("doc_id", "cap_rows")


@query("quality_lookup", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def quality_lookup(t: _Reader) -> DataFrame:
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")


@query("response_join", "SELECT a.conv_id, a.turn, 'req-' || a.turn AS custom_id, length(b.text) AS response_chars FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'")
def response_join(t: _Reader) -> DataFrame:
    c = t("conversations")
    asked = c.filter(F.col("role") == "user").select("conv_id", "turn", F.concat(F.lit("req-"), F.col("turn").cast("string")).alias("custom_id"))
    answered = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("response_chars"))
    return asked.join(answered, ["conv_id", "turn"], "left")


@query("scored_zip", "SELECT d.doc_id, round(1 / (1 + exp(-((n_chars % 97) - 48) / 10.0)), 4) AS score, l.quality FROM documents d JOIN labels l USING (doc_id)")
def scored_zip(t: _Reader) -> DataFrame:
    logit = (F.col("n_chars") % 97 - 48) / 10.0
    return t("documents").select("doc_id", F.round(metrics.sigmoid(logit), 4).alias("score")).join(t("labels").select("doc_id", "quality"), "doc_id")


@query("union_rows", "SELECT 'document' AS kind, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark")
def union_rows(t: _Reader) -> DataFrame:
    rows = lambda d, kind, key: d.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.length("text").cast("long").alias("n"))
    return rows(t("documents"), "document", "doc_id").unionByName(rows(t("benchmark"), "benchmark", "item_id"))


@query("anti_rows", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src7') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def anti_rows(t: _Reader) -> DataFrame:
    return t("documents").filter(~F.col("source").isin("src0", "src7")).select("doc_id", "source").join(t("labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


# ---------------------------------------------------------------- aggregations


@query("repo_stats", "SELECT d.source AS repo, count(*) AS functions, count(l.doc_id) AS classes, coalesce(max(CASE WHEN d.source <> 'src2' THEN d.lang END), 'Unknown') AS license, false AS test_suite_present, 'none' AS confidence FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.source IS NOT NULL GROUP BY 1")
def repo_stats(t: _Reader) -> DataFrame:
    rows = _documents(t).select("doc_id", "repo", "lang")
    places = rows.filter("repo IS NOT NULL").groupBy(F.col("repo").alias("full_name")).agg(F.max(F.when(F.col("repo") != "src2", F.col("lang"))).alias("license_spdx")).withColumns({c: F.lit(0) for c in ("place", "stars", "contributors")})
    marked = rows.join(t("labels").select("doc_id").distinct(), "doc_id", "left_semi")
    tests = testsuite.detect(_tree(t, "'README'", "''"), "Python")
    return build.repo_stats(places, rows, marked, tests).select("repo", "functions", "classes", "license", "test_suite_present", "confidence")


@query("top_repos", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def top_repos(t: _Reader) -> DataFrame:
    return t("documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(t: _Reader) -> DataFrame:
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("group_sizes", "SELECT lang, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def group_sizes(t: _Reader) -> DataFrame:
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@query("pivot_counts", "SELECT lang, count(*) FILTER (WHERE quality = 0) AS q0, count(*) FILTER (WHERE quality = 1) AS q1 FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def pivot_counts(t: _Reader) -> DataFrame:
    rows = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("lang").pivot("quality", [0, 1]).count().na.fill(0).select("lang", F.col("0").alias("q0"), F.col("1").alias("q1"))


@query("type_pivot", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'es') AS es FROM documents GROUP BY 1")
def type_pivot(t: _Reader) -> DataFrame:
    return t("documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().na.fill(0)


_EVAL = "s AS (SELECT {by}quality AS y, ((n_chars * 7 + doc_id) % 100) / 100.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id)), h AS (SELECT {by}p, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y <> 1) AS b FROM s GROUP BY ALL), u AS (SELECT {by}sum(a * (below + b / 2.0)) AS u FROM (SELECT {by}a, b, coalesce(sum(b) OVER ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h) {group}), c AS (SELECT {by}count(*) AS n, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y <> 1 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 1) AS pos, avg(CASE WHEN y = 1 THEN -ln(greatest(1e-12, least(p, 1 - 1e-12))) ELSE -ln(1 - greatest(1e-12, least(p, 1 - 1e-12))) END) AS loss FROM s {group})"
_EVAL_OUT = "n, (n - fp - fn)::DOUBLE / n AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(u::DOUBLE / nullif(pos * (n - pos), 0), 0) AS auroc, round(loss, 9) AS loss"


def _scored(t: _Reader) -> DataFrame:
    p = ((F.col("n_chars") * 7 + F.col("doc_id")) % 100) / F.lit(100.0)
    return t("documents").select("doc_id", "lang", p.alias("p")).join(t("labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


@query("eval_metrics", f"WITH {_EVAL.format(by='', part='', group='')} SELECT {_EVAL_OUT} FROM c, u")
def eval_metrics(t: _Reader) -> DataFrame:
    return evaluation.evaluate(_scored(t), "y", "p").withColumn("loss", F.round("loss", 9))


@query("eval_by_language", f"WITH {_EVAL.format(by='lang, ', part='PARTITION BY lang ', group='GROUP BY lang')} SELECT lang, {_EVAL_OUT} FROM c JOIN u USING (lang)")
def eval_by_language(t: _Reader) -> DataFrame:
    return evaluation.evaluate(_scored(t), "y", "p", ["lang"]).withColumn("loss", F.round("loss", 9)).orderBy("lang")


@query("class_balance", "SELECT count(*) FILTER (WHERE quality = 0) AS n_human, count(*) FILTER (WHERE quality = 1) AS n_ai, (count(*) FILTER (WHERE quality = 0))::DOUBLE / nullif(count(*) FILTER (WHERE quality = 1), 0) AS pos_weight FROM labels")
def class_balance(t: _Reader) -> DataFrame:
    return evaluation.class_balance(t("labels"), "quality")


@query("qa_counts", r"WITH p AS (SELECT text, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS bare FROM documents) SELECT count(*) FILTER (WHERE text IS NULL) AS missing, count(*) FILTER (WHERE bare = '') AS blank, count(*) FILTER (WHERE bare <> '' AND length(bare) < 10) AS short FROM p")
def qa_counts(t: _Reader) -> DataFrame:
    return datasets.qa_counts(t("documents"), "text")


@query("kind_counts", "SELECT source, count(*) FILTER (WHERE doc_id % 3 = 1) AS functions, count(*) FILTER (WHERE doc_id % 3 = 0) AS classes FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING functions > 0 AND classes > 0")
def kind_counts(t: _Reader) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "class").when(F.col("doc_id") % 3 == 1, "function")
    rows = t("documents").select("source", kind.alias("kind"))
    functions, classes = (part(rows).groupBy("source").agg(F.count("*").alias(name)) for part, name in ((extraction.functions, "functions"), (extraction.classes, "classes")))
    return functions.join(classes, "source")


@query("scored_counts", "SELECT count(*) AS n, count(quality) AS scored, count(*) FILTER (WHERE toxic = 1) AS truncated FROM labels")
def scored_counts(t: _Reader) -> DataFrame:
    return sinks.score_totals(t("labels").select(F.col("quality").alias("llm_score"), (F.col("toxic") == 1).alias("llm_score_truncated")))


@query("manifest_totals", "SELECT count(DISTINCT source) AS repos, count(*) AS functions, count(DISTINCT lang) AS languages, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def manifest_totals(t: _Reader) -> DataFrame:
    return t("documents").agg(F.count_distinct("source").alias("repos"), F.count("*").alias("functions"), F.count_distinct("lang").alias("languages"), F.sum("n_chars").alias("chars"))


@query("throughput", "SELECT event_type, count(*) * 60.0::DOUBLE / greatest(1, date_diff('second', min(ts), max(ts))) AS per_minute FROM events GROUP BY 1")
def throughput(t: _Reader) -> DataFrame:
    seconds = F.floor(F.unix_timestamp(F.max("ts"))) - F.floor(F.unix_timestamp(F.min("ts")))
    return t("events").groupBy("event_type").agg((F.count("*") * 60.0 / F.greatest(F.lit(1), seconds)).alias("per_minute"))


_SIGNALS = "SELECT user_id, bool_or(event_type = 'click') AS has_dir, bool_or(event_type = 'view') AS has_files, bool_or(value > 50) AS has_config, bool_or(event_type = 'purchase') AS has_ci, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS dirs FROM events GROUP BY 1"


@query("signal_confidence", f"WITH s AS ({_SIGNALS}), n AS (SELECT *, has_dir::INT + has_files::INT + has_config::INT + has_ci::INT AS k FROM s) SELECT user_id, dirs, CAST(k AS BIGINT) AS signals, CASE WHEN k >= 3 THEN 'high' WHEN k = 2 THEN 'medium' WHEN k = 1 THEN 'low' ELSE 'none' END AS confidence, k >= 2 AS present FROM n")
def signal_confidence(t: _Reader) -> DataFrame:
    kind = F.col("event_type")
    rows = t("events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("dirs"), *[F.bool_or(c).cast("long").alias(f"s{i}") for i, c in enumerate((kind == "click", kind == "view", F.col("value") > 50, kind == "purchase"))])
    k = F.col("s0") + F.col("s1") + F.col("s2") + F.col("s3")
    return rows.select("user_id", "dirs", k.alias("signals"), testsuite.confidence(k).alias("confidence"), (k >= 2).alias("present"))


# ---------------------------------------------------------------- predicates, paths, JSON, renames

_PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


@query(
    "path_rules",
    f"WITH p AS (SELECT page_id, {_PATH} AS path, string_split({_PATH}, '/') AS parts FROM pages) SELECT page_id, regexp_extract(parts[-1], '(\\.[^.]+)$', 1) AS extension, len(list_filter(parts[1:-2], lambda x: x IN ('en', 'node_modules', 'vendor'))) > 0 AS skipped, regexp_matches(parts[-1], '^(test_|Test)|(_test|\\.test|\\.spec)\\.[a-z]+$') AS is_test, lower(path) LIKE '%.min.js' OR lower(path) LIKE '%node_modules%' AS vendored FROM p",
)
def path_rules(t: _Reader) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    rows = t("pages").select("page_id", path.alias("path"), F.split(path, "/", -1).alias("parts"))
    name = F.element_at("parts", -1)
    inside = F.slice("parts", F.lit(1), F.size("parts") - 1)
    return rows.select("page_id", F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("extension"), F.arrays_overlap(inside, F.array(*[F.lit(x) for x in ("en", "node_modules", "vendor")])).alias("skipped"), name.rlike(r"^(test_|Test)|(_test|\.test|\.spec)\.[a-z]+$").alias("is_test"), (F.lower("path").endswith(".min.js") | F.contains(F.lower("path"), F.lit("node_modules"))).alias("vendored"))


@query("file_order", f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), k AS (SELECT page_id, path, len(string_split(path, '/')) AS n, string_split(path, '/') AS parts FROM p) SELECT page_id, row_number() OVER (ORDER BY list_transform(parts, lambda x, i: {{'d': i < n, 'x': x}}), page_id) AS pos FROM k")
def file_order(t: _Reader) -> DataFrame:
    """Files of a directory before its subdirectories: places in ranges of the order, and how many pages the ranges before hold."""
    rows = t("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))
    # The upper bits number the range, the lower 33 the row in it; kept, so that both uses see the same ranges.
    placed = rows.select("page_id", files.order_key(F.col("path")).alias("k")).orderBy("k", "page_id").select("page_id", F.monotonically_increasing_id().alias("at")).persist(StorageLevel.DISK_ONLY)
    placed = placed.select("page_id", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    return placed.join(F.broadcast(ranges), "range").select("page_id", (F.col("before") + F.col("i") + 1).alias("pos"))


@query("skip_counts", f"SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) FILTER (WHERE list_contains(string_split({_PATH}, '/')[1:-2], 'en')) AS skipped, count(*) AS files FROM pages GROUP BY 1")
def skip_counts(t: _Reader) -> DataFrame:
    parts = F.split(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), "/", -1)
    inside = F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), "en")
    return t("pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), inside.alias("s")).groupBy("host").agg(F.count_if("s").alias("skipped"), F.count("*").alias("files"))


@query("garbage_filter", "WITH r AS (SELECT p_partkey, p_brand, p_name, CASE WHEN p_size % 7 = 0 THEN ' main ' WHEN p_size % 11 = 0 THEN 'unknown' ELSE p_brand END AS name FROM part) SELECT p_partkey FROM r WHERE p_brand <> 'Brand#11' AND trim(name) NOT IN ('unknown', 'main') AND length(p_name) >= 10")
def garbage_filter(t: _Reader) -> DataFrame:
    name = F.when(F.col("p_size") % 7 == 0, " main ").when(F.col("p_size") % 11 == 0, "unknown").otherwise(F.col("p_brand"))
    rows = t("part").select("p_partkey", F.col("p_brand").alias("repo"), name.alias("name"), "p_name")
    return datasets.without_garbage(rows, "name", "p_name", ["Brand#11"]).select("p_partkey")


@query("blank_filter", r"SELECT doc_id FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^ \t\n\x0B\f\r]')")
def blank_filter(t: _Reader) -> DataFrame:
    return t("documents").filter(F.col("text").isNotNull() & ~text.blank(F.col("text"))).select("doc_id")


@query("renamed_rows", "SELECT source AS repository_name, 'f' || doc_id AS func_path_in_repository, lang AS func_name, md5(text) AS complete_extracted_code, length(text) AS func_signature FROM documents")
def renamed_rows(t: _Reader) -> DataFrame:
    rows = t("documents").select(F.col("source").alias("repo"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), F.col("lang").alias("func_name"), F.md5(F.col("text").cast("binary")).alias("source_code"), F.length("text").cast("long").alias("signature"))
    return datasets.converted(rows, datasets.FUNCTION_COLUMNS)


@query("training_rows", r"SELECT md5(text) AS code_md5, 0 AS label, lang AS language, 'function' AS granularity, 'human' AS model, source AS repository FROM documents WHERE regexp_matches(text, '[^ \t\n\x0B\f\r]') UNION ALL SELECT md5(text), 1, 'en', 'class', role, NULL FROM conversations WHERE role = 'assistant' AND regexp_matches(text, '[^ \t\n\x0B\f\r]')")
def training_rows(t: _Reader) -> DataFrame:
    human = datasets.training_rows(t("documents"), "text", 0, F.col("lang"), "function", "human", "source")
    made = datasets.training_rows(t("conversations").filter("role = 'assistant'"), "text", 1, "en", "class", F.col("role"))
    return human.unionByName(made).withColumn("code_md5", F.md5(F.col("code").cast("binary"))).drop("code")


@query("array_fields", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS method_count, list_contains(t, 'the') AS has_constructor, array_to_string(t, ',') AS names FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def array_fields(t: _Reader) -> DataFrame:
    rows = t("documents").select("doc_id", text.code_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("method_count"), F.exists("t", lambda x: x == "the").alias("has_constructor"), F.array_join("t", ",").alias("names"))


@query("json_arrays", f"SELECT doc_id, CAST(to_json(list_filter(t, lambda x: regexp_matches(x, '^[a-zA-Z]'))) AS VARCHAR) AS names_json FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def json_arrays(t: _Reader) -> DataFrame:
    words = F.filter(text.code_tokens(F.col("text")), lambda x: x.rlike("^[a-zA-Z]"))
    return sinks.json_lists(t("documents").select("doc_id", words.alias("names_json")))


@query("epoch_and_retry_after", "SELECT event_id, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS reset_at, CASE WHEN event_id % 4 = 0 THEN NULL ELSE greatest(0.0, round(value, 2) - 20) END AS retry_after FROM events")
def epoch_and_retry_after(t: _Reader) -> DataFrame:
    @F.pandas_udf("struct<reset: long, after: double>")
    def read(reset: pd.Series, after: pd.Series) -> pd.DataFrame:
        headers = [{"X-RateLimit-Reset": r, "Retry-After": a} for r, a in zip(reset, after)]
        at = [remote.reset_time(h) for h in headers]
        return pd.DataFrame({"reset": [int(x.timestamp()) if x else None for x in at], "after": [remote.retry_after(h) for h in headers]})

    after = F.when(F.col("event_id") % 4 == 0, "soon").otherwise((F.round("value", 2) - 20).cast("string"))
    rows = t("events").select("event_id", read(F.unix_timestamp("ts").cast("string"), after).alias("r"))
    return rows.select("event_id", F.timestamp_seconds("r.reset").alias("reset_at"), F.col("r.after").alias("retry_after"))


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n_keys FROM events")
def json_props(t: _Reader) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


# ---------------------------------------------------------------- source trees


def _tree(t: _Reader, path: str, body: str) -> DataFrame:
    """A source file for each document; path and body are SQL over doc_id and source."""
    return t("documents").filter("source IS NOT NULL").select(F.col("source").alias("repo"), F.expr(path).alias("path"), F.expr(body).cast("binary").alias("content"))


_FOLDER = "CASE doc_id % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'vendor/' ELSE 'src/pkg/' END"
_SOURCES = {
    "Python": ("py", r"concat('import os\n\n@cache\ndef f', doc_id, '(a, b=1):\n    if a and b:\n        return os.path\n    return [x for x in a]\n\nclass C', doc_id, '(Base):\n    def m(self): pass\n')", ("import os", "a,b=1", "Base", 4)),
    "Java": ("java", r"concat('import java.util.List;\nclass C', doc_id, ' extends Base {\n    List f', doc_id, '(int a, int b) { for (int i = 0; i < a; i++) { if (a > i && b > i) { } } return null; }\n    void m() { }\n}\n')", ("import java.util.List;", "a,b", "Base", 4)),
    "JavaScript": ("js", r"concat('import os from \"os\";\nconst f', doc_id, ' = (a, b) => { while (a) { a = b ? os.x : 1; } };\nclass C', doc_id, ' extends Base {\n  m() { }\n}\n')", ("import os from \"os\";", "a,b", "Base", 3)),
    "C++": ("cpp", r"concat('#include <os>\nint f', doc_id, '(int a, int b) { switch (a) { case 1: case 2: return os; default: return a || b; } }\nclass C', doc_id, ' : public Base { public: void m() { } };\n')", ("#include <os>\n", "a,b", "Base", 4)),
}


def _definition_query(language: str, name: str) -> None:
    ending, body, (stmt, params, base, complexity) = _SOURCES[language]
    path = f"concat({_FOLDER}, 'n', doc_id, '.{ending}')"
    sql = f"""WITH d AS (SELECT source AS repo, {path} AS file_path, doc_id FROM documents WHERE source IS NOT NULL AND doc_id % 5 > 1)
    SELECT repo, file_path, 'function' AS kind, 'f' || doc_id AS name, '{params}' AS parts, {_quoted(stmt)} AS imports, {complexity} AS complexity FROM d
    UNION ALL SELECT repo, file_path, 'class', 'C' || doc_id, '{base}', {_quoted(stmt) if language == "Java" else "''"}, {complexity if language == "Java" else 1} FROM d
    UNION ALL SELECT repo, file_path, 'function', 'm', '{'self' if language == "Python" else ''}', '', 1 FROM d"""

    @query(name, sql)
    def walk(t: _Reader) -> DataFrame:
        rows = extraction.definitions(_tree(t, path, body), language)
        parts = F.array_join(F.when(F.col("kind") == "function", F.col("parameters")).otherwise(F.col("parent_classes")), ",")
        return rows.select("repo", "file_path", "kind", "name", parts.alias("parts"), F.array_join("used_imports", ";").alias("imports"), F.col("cyclomatic_complexity").alias("complexity"))


for _language, _name in (("Python", "definitions_python"), ("Java", "definitions_java"), ("JavaScript", "definitions_javascript"), ("C++", "definitions_cpp")):
    _definition_query(_language, _name)


@query("content_counts", "SELECT source AS repo, 2 * count(*) FILTER (WHERE doc_id % 5 > 1) AS functions, count(*) FILTER (WHERE doc_id % 5 > 1) AS classes FROM documents WHERE source IS NOT NULL GROUP BY 1")
def content_counts(t: _Reader) -> DataFrame:
    ending, body, _ = _SOURCES["Python"]
    return extraction.content_counts(_tree(t, f"concat({_FOLDER}, 'n', doc_id, '.{ending}')", body), "Python")


@query("skipped_files", "SELECT source AS repo, count(*) FILTER (WHERE doc_id % 5 = 1) AS skipped_files FROM documents WHERE source IS NOT NULL GROUP BY 1")
def skipped_files(t: _Reader) -> DataFrame:
    return files.skipped_counts(_tree(t, f"concat({_FOLDER}, 'n', doc_id, '.py')", "''"), "Python")


_FILE_NAMES = "CASE doc_id % 9 WHEN 0 THEN 'test_a.js' WHEN 1 THEN 'TestB.js' WHEN 2 THEN 'c.min.js' WHEN 3 THEN 'd.spec.js' WHEN 4 THEN 'e.jsx' WHEN 5 THEN 'f.ts' WHEN 6 THEN 'dist/g.js' WHEN 7 THEN 'Dist/h.js' ELSE 'i.js' END"


@query("eligible_files", f"SELECT doc_id, {_FILE_NAMES} AS path FROM documents WHERE doc_id % 9 IN (4, 7, 8)")
def eligible_files(t: _Reader) -> DataFrame:
    return t("documents").select("doc_id", F.expr(_FILE_NAMES).alias("path")).filter(files.eligible(F.col("path"), "JavaScript"))


_MANIFESTS = {
    "Python": ("requirements.txt", r"concat('# c\nlib', doc_id, '[x]>=', doc_id % 7, '.0 # why\n-r b\nplain\n')", "('lib' || doc_id, '>=' || doc_id % 7 || '.0', 'main'), ('plain', NULL, 'main')"),
    "JavaScript": ("package.json", r"""concat('{"dependencies": {"lib', doc_id, '": "^', doc_id % 7, '"}, "devDependencies": {"plain": "*"}}')""", "('lib' || doc_id, '^' || doc_id % 7, 'main'), ('plain', '*', 'dev')"),
    "Java": ("pom.xml", r"concat('<dependency><groupId>g</groupId><artifactId>lib', doc_id, '</artifactId><version>', doc_id % 7, '</version></dependency><dependency><groupId>p</groupId><artifactId>q</artifactId><scope>test</scope></dependency>')", "('g:lib' || doc_id, CAST(doc_id % 7 AS VARCHAR), 'main'), ('p:q', NULL, 'dev')"),
    "C++": ("conanfile.txt", r"concat('[requires]\nlib', doc_id, '/', doc_id % 7, '\n[options]\nno/1\n')", "('lib' || doc_id, CAST(doc_id % 7 AS VARCHAR), 'main')"),
}


def _manifest_query(language: str, name: str) -> None:
    path, body, values = _MANIFESTS[language]

    @query(name, f"SELECT 'r' || d.doc_id AS repo, v.name, v.version, v.kind FROM documents d, LATERAL (VALUES {values}) v(name, version, kind)")
    def depend(t: _Reader) -> DataFrame:
        tree = t("documents").select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("repo"), F.lit(path).alias("path"), F.expr(body).cast("binary").alias("content"))
        return manifests.dependencies(tree, language).select("repo", "name", "version", "kind")


for _language, _name in (("Python", "dependencies_python"), ("JavaScript", "dependencies_javascript"), ("Java", "dependencies_java"), ("C++", "dependencies_cpp")):
    _manifest_query(_language, _name)


@query(
    "test_suite",
    """SELECT 'r' || doc_id AS repo, doc_id % 2 + (doc_id % 2) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END >= 2 AS test_suite_present,
    CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 'high' WHEN doc_id % 2 = 1 THEN 'medium' WHEN doc_id % 3 = 0 THEN 'low' ELSE 'none' END AS confidence, CAST(doc_id % 2 AS INTEGER) AS test_file_count FROM documents""",
)
def test_suite(t: _Reader) -> DataFrame:
    repo = F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("repo")
    tests = t("documents").select(repo, F.expr("CASE WHEN doc_id % 2 = 1 THEN 'pkg/tests/test_a.py' ELSE 'tests/data.py' END").alias("path"), F.lit("").cast("binary").alias("content"))
    ci = t("documents").select(repo, F.lit(".github/workflows/ci.yml").alias("path"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'run: PyTest' ELSE 'run: make' END").cast("binary").alias("content"))
    return testsuite.detect(tests.unionByName(ci), "Python").select("repo", "test_suite_present", "confidence", "test_file_count")


@query("clean_generated", "SELECT doc_id, 'def f' || doc_id || '():' || chr(10) || '    return 1' AS code FROM documents")
def clean_generated(t: _Reader) -> DataFrame:
    raw = F.expr(r"concat('Sure:\n```python\nimport os\n\ndef f', doc_id, '():\n    return 1\n\nprint(1)\n```')")
    return t("documents").select("doc_id", cleaning.cleaned(raw, "Python", "function").alias("code"))


@query("batch_scores", "SELECT doc_id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '[^ \t\n\x0B\f\r]') THEN NULL ELSE least(length(text) + 2, 512) / 1000.0 END AS llm_score, CASE WHEN NOT regexp_matches(coalesce(text, ''), '[^ \t\n\x0B\f\r]') THEN NULL ELSE length(text) + 2 > 512 END AS llm_score_truncated FROM documents")
def batch_scores(t: _Reader) -> DataFrame:
    """A stand-in scorer: the share of 1000 ids that a text of one id a sign fills."""
    make = lambda: (lambda text: [0, *text, 2], lambda batch: [len(ids) / 1000 for ids in batch])
    return scoring.score_rows(t("documents").select("doc_id", "text"), "text", make).select("doc_id", "llm_score", "llm_score_truncated")


@query("event_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(t: _Reader) -> DataFrame:
    return paging.arrivals(t("events"))
