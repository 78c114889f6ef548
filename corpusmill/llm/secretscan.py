"""Secrets in whole texts: fixed patterns and a randomness test battery.

All of it is column expressions: positions come from the pieces between matches,
and a text without matches costs only its pattern scans. Candidate strings that
no pattern covers are long runs of encoding characters. For each, the narrowest
alphabet that holds it is inferred and three tests are made: chi-squared
uniformity over the alphabet, runs of character classes, and lag-one serial
correlation. The first two say how unlikely a string of that length and encoding
is to be text-like; the last, and uniformity itself, must not rule out
randomness. Combined evidence is compared with a threshold for each encoding and
length band that keeps the expected share of false discoveries among all
candidates under ``fdr`` (Benjamini and Hochberg on a grid of evidence, counted
over the whole table in a bounded histogram).

What is text-like: letters as frequent as in English have a sum of squared shares
of 0.0655, of 0.041 where a quarter are capitals, as in joined short words;
decimal digits of 0.1. Over an alphabet of k signs that lifts chi-squared by k
times that sum, less one, for each character. Joined words of about five
letters change class at 0.40 of characters, strings of one case more seldom; joined
words of two and three letters change as often as random strings and can be taken for them.

Work grows with a text's length times the square root of its number of matches;
``redact`` puts a text together from parts of PART code points.

Defined results: null text counts as empty and has no spans; an empty table
gives no rows; repeated rows get equal results; spans count code points and end
before ``end``; extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
FDR = 0.01
MARK = "[SECRET]"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_ENGLISH, _MIXED, _DECIMAL = 0.0655, 0.041, 0.1
#: Name, pattern, alphabet, sum of squared shares of text-like strings, their class changes a character; the first that fits holds.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", _DECIMAL, 0.15),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567", _ENGLISH, 0.10),
    ("base32lower", r"^[a-z2-7]+=*$", _LOWER + "234567", _ENGLISH, 0.10),
    ("base36", r"^[0-9a-z]+$", _DIGITS + _LOWER, _ENGLISH, 0.10),
    ("base36upper", r"^[0-9A-Z]+$", _DIGITS + _UPPER, _ENGLISH, 0.10),
    ("base58", r"^[1-9A-HJ-NP-Za-km-z]+$", "".join(c for c in _DIGITS + _UPPER + _LOWER if c not in "0OIl"), _MIXED, 0.40),
    ("base62", r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER, _MIXED, 0.40),
    ("base64url", r"^[A-Za-z0-9_-]*[_-][A-Za-z0-9_-]*=*$", _UPPER + _LOWER + _DIGITS + "-_", _MIXED, 0.40),
    ("base64", r"", _UPPER + _LOWER + _DIGITS + "+/", _MIXED, 0.40),
)
#: Upper ends of length bands.
BANDS = (24, 32, 48, 64, 128)
#: Evidence is -log10 of the combined p-value; steps of a quarter.
STEPS, STEP = 60, 0.25
#: Code points of the parts that a redacted text is put together from.
PART = 4096
#: Largest |z| at which a test still allows that the string is random.
ALLOW = 4.0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """The sum of the lengths before each; over groups of about the square root of their number, so that none sums over all."""

    def grouped(v: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(v["n"]) - 1) / v["k"]).cast("int")), lambda g: _total(F.slice(v["n"], g * v["k"] + 1, v["k"])))

        def placed(w: Column) -> Column:
            group = lambda i: F.floor(i / w["k"]).cast("int")
            return F.transform(w["n"], lambda x, i: F.element_at(w["heads"], group(i) + 1) + _total(F.slice(w["n"], group(i) * w["k"] + 1, i - group(i) * w["k"])))

        heads = let(sums, lambda s: F.transform(s, lambda x, g: _total(F.slice(s, F.lit(1), g))))
        return let(F.struct(v["n"].alias("n"), v["k"].alias("k"), heads.alias("heads")), placed)

    return let(F.struct(lengths.alias("n"), F.ceil(F.sqrt(F.greatest(F.lit(1), F.size(lengths)))).cast("int").alias("k")), grouped)


_NONE = "CAST(array() AS array<struct<start:int,kind:int,end:int,match:string>>)"


def _found(text: Column, pattern: str, kind: int, least_group: int = 0) -> Column:
    """array of (start, kind, end, match) of the leftmost non-overlapping matches."""

    def located(s: Column) -> Column:
        def at(v: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.element_at(v["before"], i + 1) + F.length(F.element_at(v["between"], i + 1))
                return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), m.alias("match"))

            every = F.transform(v["match"], one)
            if least_group:
                every = F.filter(every, lambda x, i: F.length(F.element_at(v["group"], i + 1)) >= least_group)
            return every

        steps = F.transform(s["match"], lambda m, i: F.length(m) + F.length(F.element_at(s["between"], i + 1)))
        return let(F.struct(_before(steps).alias("before"), *[s[c].alias(c) for c in (("between", "match", "group") if least_group else ("between", "match"))]), at)

    parts = [F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")]
    if least_group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("group"))
    return F.when(text.rlike(pattern), let(F.struct(*parts), located)).otherwise(F.expr(_NONE))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds."""
    return F.concat(_found(text, ASSIGN, 0, 8), F.when(F.contains(text, F.lit("AKIA")), _found(text, ACCESS, 1)).otherwise(F.expr(_NONE)), _found(text, HEX, 2))


def _battery(s: Column) -> Column:
    """(start, end, stratum, evidence) of one candidate; evidence is 0 where a test rules randomness out."""
    t = F.regexp_replace(s["match"], "=+$", "")
    code = F.lit(len(ENCODINGS) - 1)
    for i in reversed(range(len(ENCODINGS) - 1)):
        code = F.when(s["match"].rlike(ENCODINGS[i][1]), i).otherwise(code)

    def pick(values: list) -> Callable[[Column], Column]:
        return lambda c: F.element_at(F.array(*[F.lit(v) for v in values]), c + 1)

    def tests(v: Column) -> Column:
        n, k = v["n"].cast("double"), v["k"].cast("double")
        squares = F.aggregate(F.split(v["alphabet"], "(?!^)"), F.lit(0.0), lambda a, c: a + F.pow((v["n"] - F.length(F.replace(v["t"], c, F.lit("")))).cast("double"), F.lit(2.0)))
        chi = squares * k / n - n
        mean = (k - 1) / 2
        spread = F.aggregate(v["at"], F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        lagged = F.aggregate(F.zip_with(F.slice(v["at"], F.lit(1), v["n"] - 1), F.slice(v["at"], F.lit(2), v["n"] - 1), lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda a, x: a + x)
        kinds = F.transform(v["chars"], lambda c: F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 1).when(c.between("a", "z"), 2).otherwise(3))
        changes = F.size(F.filter(F.zip_with(F.slice(kinds, F.lit(1), v["n"] - 1), F.slice(kinds, F.lit(2), v["n"] - 1), lambda x, y: x != y), lambda x: x)).cast("double")
        excess, change = pick([len(e[2]) * e[3] - 1 for e in ENCODINGS])(v["code"]), pick([e[4] for e in ENCODINGS])(v["code"])
        uniform = ((k - 1) + n * excess - chi) / F.sqrt(2 * (k - 1) + 4 * n * excess)
        runs = (changes - 0.5 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
        serial = F.coalesce(F.try_divide(lagged, spread), F.lit(1.0)) * F.sqrt(n)
        random = (F.abs(serial) <= ALLOW) & ((chi - (k - 1)) / F.sqrt(2 * (k - 1)) <= ALLOW)
        z = (uniform + runs) / math.sqrt(2)
        x = F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z)
        evidence = F.when(random, F.log1p(F.exp(F.greatest(F.lit(-700.0), x))) / math.log(10)).otherwise(0.0)
        band = F.size(F.filter(F.array(*[F.lit(b) for b in BANDS]), lambda b: b < v["n"]))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), (v["code"] * (len(BANDS) + 1) + band).alias("stratum"), evidence.alias("evidence"))

    def indexed(v: Column) -> Column:
        alphabet = pick([e[2] for e in ENCODINGS])(v["code"])
        fold = F.when(v["code"] == 0, F.lower(v["t"])).otherwise(v["t"])
        chars = F.filter(F.split(fold, ""), lambda c: c != "")
        return let(
            F.struct(v["code"].alias("code"), fold.alias("t"), chars.alias("chars"), alphabet.alias("alphabet")),
            lambda w: let(F.struct(*[w[c].alias(c) for c in ("code", "t", "chars", "alphabet")], F.size(w["chars"]).alias("n"), F.length(w["alphabet"]).alias("k"), F.transform(w["chars"], lambda c: (F.greatest(F.lit(1), F.instr(w["alphabet"], c)) - 1).cast("double")).alias("at")), tests),
        )

    return let(F.struct(t.alias("t"), code.alias("code")), indexed)


def _candidates(text: Column, base: Column) -> Column:
    """The battery's results for the candidates that no base span touches.

    A hex or access match that touches a candidate lies within it, as its signs
    are candidates' own. Neither assign spans nor candidates overlap their like:
    in their common order, a candidate's place less its number among candidates
    is how many assign spans start before it, of which the last one reaches farthest.
    """

    def free(v: Column) -> Column:
        bare = lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), i.alias("i"))
        both = F.array_sort(F.concat(F.transform(v["assign"], bare), F.transform(v["found"], bare)))

        def touches(x: Column, place: Column) -> Column:
            before = place - x["i"]
            last, following = F.get(v["assign"], before - 1), F.get(v["assign"], before)
            return F.coalesce(last["end"] > x["start"], F.lit(False)) | F.coalesce(following["start"] < x["end"], F.lit(False))

        kept = F.filter(both, lambda x, place: (x["kind"] == 3) & ~touches(x, place))
        kept = F.transform(kept, lambda x: F.element_at(v["found"], x["i"] + 1))
        return F.transform(F.filter(kept, lambda s: (F.length(F.regexp_replace(s["match"], "=+$", "")) >= 20) & ~s["match"].rlike(HEX) & ~s["match"].rlike(ACCESS)), _battery)

    every = let(F.struct(F.filter(base, lambda b: b["kind"] == 0).alias("assign"), _found(text, CANDIDATE, 3).alias("found")), free)
    return F.when(text.rlike(CANDIDATE), every).otherwise(F.expr("CAST(array() AS array<struct<start:int,end:int,stratum:int,evidence:double>>)"))  # without candidates base spans are not looked for here


def _measured(docs: DataFrame, text: str, base: str, candidates: str) -> DataFrame:
    """docs with columns of these names: the text, never null, its base spans and the battery's results."""
    return docs.withColumn(text, F.coalesce("text", F.lit(""))).withColumn(base, base_spans(F.col(text))).withColumn(candidates, _candidates(F.col(text), F.col(base)))


def thresholds(docs: DataFrame, fdr: float = FDR) -> list[float]:
    """For each encoding and length band, the least evidence at which expected false discoveries stay under fdr of all discoveries."""
    strata = len(ENCODINGS) * (len(BANDS) + 1)
    step = F.least(F.lit(STEPS), F.floor(F.col("c.evidence") / STEP)).cast("int")
    # At most strata x STEPS rows, whatever the table's size.
    rows = _measured(docs.select("text"), "t", "b", "found").select(F.explode("found").alias("c")).groupBy(F.col("c.stratum").alias("stratum"), step.alias("step")).count().collect()
    out = []
    for s in range(strata):
        at = [0] * (STEPS + 1)
        for r in rows:
            if r["stratum"] == s:
                at[r["step"]] += r["count"]
        least, above, total = math.inf, 0, sum(at)
        for b in range(STEPS, 0, -1):
            above += at[b]
            if above and total * 10 ** (-b * STEP) <= fdr * above:
                least = b * STEP
        out.append(least)
    return out


def _spans(docs: DataFrame, fdr: float, text: str, base: str, every: str) -> DataFrame:
    """docs with columns of these names: the text, and arrays of (start, kind, end) of base spans and of all."""
    least = F.array(*[F.lit(float(x)) for x in thresholds(docs, fdr)])
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    random = F.transform(F.filter(every, lambda c: c["evidence"] >= F.element_at(least, c["stratum"] + 1)), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return _measured(docs, text, base, every).withColumn(base, F.array_sort(F.transform(base, bare))).withColumn(every, F.array_sort(F.concat(base, random)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, counts of the fixed kinds, the digest of their spans, and all spans, for every row."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    found = _spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fdr, "whole", "base", "every")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans replaced by one mark, part by part."""

    def part(p: Column) -> Column:
        begin, end = p * PART, (p + 1) * PART
        own = F.substr(text, begin + 1, F.lit(PART))

        def of(v: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                more = F.concat(a["out"], F.substr(v["own"], a["at"] - begin + 1, s["start"] - a["at"]), F.lit(mark))
                marked = F.struct(s["end"].alias("at"), more.alias("out"))
                # A span from the part before is marked there.
                return F.when(s["start"] >= a["at"], marked).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

            return F.aggregate(v["spans"], F.struct(begin.alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.when(a["at"] < end, F.substr(v["own"], a["at"] - begin + 1)).otherwise("")))

        return let(F.struct(own.alias("own"), F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > begin)).alias("spans")), of)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PART).cast("int")), part), "")


def redact(docs: DataFrame, fdr: float = FDR, mark: str = MARK) -> DataFrame:
    """docs with every span of its text replaced by mark; n_chars, where there is one, follows."""
    whole, base, every = fresh(docs.columns, "whole", "base", "every")
    found = _spans(docs, fdr, whole, base, every)
    some = F.size(every) > 0
    found = found.withColumn("text", F.when(some, _masked(F.col(whole), F.col(every), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)
