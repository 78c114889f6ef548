"""The URL model against exact counts in plain Python, with more distinct grams than any small table holds."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import urlfilter

URLS = "page_id long, url string"


def addresses():
    rng = np.random.default_rng(4)
    signs = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789-_ABCDEFGH"))
    odds = np.arange(1, len(signs) + 1) ** 0.3
    out = []
    for i in range(1500):
        p = odds if i % 2 else odds[::-1]
        tail = "".join(rng.choice(signs, 40, p=p / p.sum()))
        out.append(["https://x.net/de/", "https://x.org/es/", "https://x.fr/q/"][i % 3] + tail)
    return out + out[:30] * 2


def brute_verdicts(spark, urls):
    rows = urlfilter.ruled(spark.createDataFrame(list(enumerate(urls)), URLS)).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(5))).collect()
    counts = {c: [Counter() for _ in range(4)] for c in ("allow", "block")}
    pad = lambda u: "\2\2\2" + u + "\3"
    for r in rows:
        if r["ruling"] and r["part"]:
            u = pad(r["url"])
            for i in range(3, len(u)):
                for k in range(4):
                    counts[r["ruling"]][k][u[i - k : i + 1]] += 1

    def score(url):
        u, s = pad(url), 0.0
        for i in range(3, len(u)):
            for c, sign in (("allow", 1), ("block", -1)):
                p = 1 / 96
                for k in range(4):
                    n = counts[c][k][u[i - k : i + 1]]
                    p = (n + 4 * p) / (max(counts[c][k - 1][u[i - k : i]] if k else sum(counts[c][0].values()), n) + 4)
                s += sign * math.log(p)
        return s / (len(u) - 3)

    held = {c: sorted(score(r["url"]) for r in rows if r["ruling"] == c and r["part"] == 0) for c in ("allow", "block")}
    at = lambda v, q: v[max(0, math.ceil(q * len(v)) - 1)]
    least = (at(held["allow"], 0.05) + at(held["block"], 0.95)) / 2
    assert sum(len(set().union(*(counts[c][k] for c in counts))) for k in range(4)) > 16384
    return {r["page_id"]: r["ruling"] or ("block" if score(r["url"]) < least else "allow") for r in rows}


def test_verdicts_follow_exact_counts(spark):
    urls = addresses()
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), URLS)).collect()}
    assert got == brute_verdicts(spark, urls)
    assert {"allow", "block"} == {got[i] for i in range(2, 1500, 3)}
