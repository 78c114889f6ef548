"""URL verdicts by host and path rules, and by a character language-model ratio.

URLs that a rule accepts or rejects train two variable-order Markov models of
characters. Each order keeps the exact count of every gram, in a table that grows
with the labelled URLs; each order's estimate is smoothed with that of the order
below. The log-likelihood difference over a URL, divided by its length, decides
those that no rule fits. Its threshold lies between the tails of both classes on
labelled URLs kept out of the counts. A character's difference depends on its
longest gram alone, so it is worked out once for each gram met and joined to the
URLs' grams; differences are whole multiples of 1 / UNIT, so that a sum does not
depend on its order.

Defined results: null or ``://``-less URLs have empty host and path, no rule, and
the model's verdict; null and empty URLs are allowed; without URLs of both
classes everything undecided is allowed; repeated rows get equal results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ORDER = 3
SMOOTHING = 4.0
ALPHABET = 96
UNIT = 1 << 32
#: A gram that is one of so many grams met, or more, is joined by broadcast.
OFTEN = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruling of every row; the longest rule that fits wins, the first of equals."""
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, ruling = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(ruling)
    return out.select("*", rule.alias("rule"), ruling.alias("ruling"))


def _padded(url: Column) -> Column:
    return F.concat(F.lit("\u0002" * ORDER), url, F.lit("\u0003"))


def _grams(u: Column, orders: range) -> Column:
    """The grams of k + 1 characters that end at each character of a padded URL, for each order k."""

    def of_order(k: int) -> Column:
        return F.transform(F.sequence(F.lit(ORDER + 1), F.length(u)), lambda i: F.substr(u, i - k, F.lit(k + 1)))

    return F.flatten(F.array(*[of_order(k) for k in orders]))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """gram, allow, block: how often each gram of each order ends a prefix of the URLs of a ruling."""
    rows = labelled.select("ruling", _padded(F.col("url")).alias("u")).select("ruling", F.explode(_grams(F.col("u"), range(ORDER + 1))).alias("gram"))
    return rows.groupBy("gram").agg(F.count_if(F.col("ruling") == "allow").alias("allow"), F.count_if(F.col("ruling") == "block").alias("block"))


def gram_ratios(wanted: DataFrame, counts: DataFrame, totals: dict[str, float]) -> DataFrame:
    """gram, n, ratio of the longest grams in wanted (gram, n): the log-likelihood difference of the last character, in units of 1 / UNIT."""
    g = F.col("gram")
    # Grams of one to ORDER + 1 characters that end the gram, then the contexts of all but the first.
    parts = [F.substr(g, F.lit(ORDER + 1 - k), F.lit(k + 1)) for k in range(ORDER + 1)] + [F.substr(g, F.lit(ORDER + 1 - k), F.lit(k)) for k in range(1, ORDER + 1)]
    looked = wanted.select(g.alias("whole"), "n", F.posexplode(F.array(*parts)).alias("slot", "gram")).join(counts, "gram", "left")
    at = lambda c, slot: F.coalesce(F.max(F.when(F.col("slot") == slot, F.col(c))), F.lit(0)).cast("double")
    seen = looked.groupBy("whole").agg(F.max("n").alias("n"), *[at(c, slot).alias(f"{c}{slot}") for c in ("allow", "block") for slot in range(len(parts))])

    def likelihood(c: str) -> Column:
        p = F.lit(1.0 / ALPHABET)
        for k in range(ORDER + 1):
            n = F.col(f"{c}{k}")
            before = F.col(f"{c}{ORDER + k}") if k else F.lit(totals[c])
            # A context at a URL's start has no count of its own as a gram; it is at least as frequent as what follows it.
            p = (n + SMOOTHING * p) / (F.greatest(before, n) + SMOOTHING)
        return F.log(p)

    return seen.select(F.col("whole").alias("gram"), "n", F.round((likelihood("allow") - likelihood("block")) * UNIT).cast("long").alias("ratio"))


def ratios(urls: DataFrame, counts: DataFrame, totals: dict[str, float]) -> DataFrame:
    """row, score of urls (row, url), none of them empty: the length-normalised log-likelihood difference of accepted and rejected."""
    grams = urls.select("row", F.explode(_grams(_padded(F.col("url")), range(ORDER, ORDER + 1))).alias("gram"))
    known = materialise(gram_ratios(grams.groupBy("gram").agg(F.count("*").alias("n")), counts, totals), "url-ratios")
    total = known.agg(F.sum("n").alias("n")).first()["n"] or 0
    # At most OFTEN grams can each be one of OFTEN grams met; without them no key of the join holds many rows.
    often = F.col("n") * OFTEN >= total
    met = [grams.join(F.broadcast(known.filter(often)), "gram"), grams.join(known.filter(~often), "gram")]
    return met[0].unionByName(met[1]).groupBy("row").agg((F.sum("ratio") / F.count("*") / UNIT).alias("score"))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    rows = ruled(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), rules)
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    part = F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(5))
    ruling = F.col("ruling")
    counts = materialise(gram_counts(rows.filter(ruling.isNotNull() & (part != 0))), "url-grams")
    sums = counts.filter(F.length("gram") == 1).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    totals = {c: float(sums[c] or 0) for c in ("allow", "block")}
    if not all(totals.values()):
        return rows.select("page_id", "host", "path", "rule", F.coalesce(ruling, F.lit("allow")).alias("verdict"))
    known = F.coalesce(F.length("url"), F.lit(0)) > 0
    scored = materialise(ratios(rows.filter(known & (ruling.isNull() | (part == 0))).select("row", "url"), counts, totals), "url-scores")
    rows = rows.join(scored, "row", "left")
    kept_out = rows.filter(ruling.isNotNull() & F.col("score").isNotNull())
    tails = {r["ruling"]: r for r in kept_out.groupBy("ruling").agg(F.percentile_approx("score", 0.05).alias("low"), F.percentile_approx("score", 0.95).alias("high")).collect()}
    least = (tails["allow"]["low"] + tails["block"]["high"]) / 2 if len(tails) == 2 else 0.0
    verdict = F.coalesce(ruling, F.when(F.col("score") < least, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
