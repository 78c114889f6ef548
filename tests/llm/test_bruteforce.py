"""Whole queries against plain versions written on their own; repeated rows, null ids, ties, very long texts, clashing columns."""

import hashlib
import itertools
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from corpusmill.llm import digest, langid, mixing, packing, quality, urlfilter

CLASH = ", lang_pred string, score double, mix_times int, _row int, row int, text_ string, whole string, kept_row int, label int, h long, k long, r int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long" + CLASH
MINE = ("mine", 0.125, 7, 8, 9, "t", "w", 10, 11, 12, 13, 14)
LANGS = {"en": "the house of the old man stands near river and forest with many small birds singing", "de": "das haus des alten mannes steht nahe am fluss und wald mit vielen kleinen vögeln", "es": "la casa del viejo hombre está cerca del río y bosque con muchos pájaros pequeños"}


def frame(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), *MINE) for i, t, g, s in rows], DOCS)


def prose(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))


def sample(seed=1, n=90):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice(sorted(LANGS)), rng.randrange(3, 40)), None, rng.choice(["a", "b", None])) for i in range(n)]
    rows = [(i, t, next(g for g, w in LANGS.items() if t.split()[0] in w.split()), s) for i, t, _, s in rows]
    odd = [None, "", " \n", "½ ² ⅷ ① 12", "1234 !!", prose(rng, "en", 170_000), "z" * 300_000, "漢字 かな", "\U00010330\U00010331" * 60]
    rows += [(1000 + k, t, "en" if t and "the" in t else None, "a") for k, t in enumerate(odd)]
    return rows + rows[3:6] + [(None, rows[2][1], "en", "b"), (None, rows[2][1], "en", "b"), (None, None, None, None)]


def is_letter(c):
    return unicodedata.category(c).startswith("L")


def letter_runs(text):
    """Words, long ones in parts, by categories."""
    runs = ["".join(g) for on, g in itertools.groupby(text.lower(), is_letter) if on]
    return [w[i : i + langid.WORD] for w in runs for i in range(0, len(w), langid.WORD)]


def plain_fit(counts, known):
    """Expectation maximisation by listing every segmentation of every word."""

    def segmentations(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if k == 1 or s[:k] in known:
                for rest in segmentations(s[k:]):
                    yield (s[:k], *rest)

    ways = {w: list(segmentations("▁" + w)) for w in counts}
    pieces = {p for every in ways.values() for way in every for p in way}
    p = dict.fromkeys(pieces, 1 / len(known))
    for _ in range(langid.ROUNDS):
        seen = Counter()
        for w, n in counts.items():
            weights = [math.prod(p[x] for x in way) for way in ways[w]]
            for way, v in zip(ways[w], weights):
                for x in way:
                    seen[x] += n * v / sum(weights)
        total = sum(seen.values())
        p = {x: max(seen[x] / total, 1e-9) for x in pieces}
    floor = 0.5 / (1 + sum(counts.values())) / 10
    return {x: max(v, floor) for x, v in p.items()}, floor


def test_language_prediction_equals_a_plain_version(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, g, 4), g, "s") for i, g in enumerate(sorted(LANGS) * 8)]
    rows += [(100 + i, t, None, "s") for i, t in enumerate(["the wald", "río", "zzzz qqqq", "xy" * 40, "The HOUSE, des Mannes.", "x² ½"])] + rows[:2] + [(None, "old man", None, "s")]
    got = langid.identify(frame(spark, rows).repartition(3)).collect()
    known, models, floors = set(langid.vocabulary_pieces()), {}, []
    for g in sorted(LANGS):
        learned = [t for i, t, lang, _ in rows if lang == g and zlib.crc32(str(i).encode()) % 4 != 2]
        models[g], floor = plain_fit(Counter(w for t in learned for w in letter_runs(t)), known)
        floors.append(floor)
    floor = min(floors)
    table = set().union(*models.values())
    longest = max(map(len, table))

    def log_probability(word, g):
        s, alpha = "▁" + word, [1.0]
        for i in range(1, len(s) + 1):
            edges = [(j, models[g].get(s[j:i], floor)) for j in range(max(0, i - longest), i) if i - j == 1 or s[j:i] in table]
            alpha.append(sum(alpha[j] * p * 1e4 ** (i - j) for j, p in edges))
        return math.log(alpha[-1]) - len(s) * math.log(1e4)

    want = {}
    for i, t, _, _ in rows:
        words = letter_runs(t)
        logs = {g: sum(log_probability(w, g) for w in words) for g in models}
        top = max(logs.values())
        best = min(g for g in logs if logs[g] == top)
        scale = min(1.0, langid.EVIDENCE / max(1, len(words)))
        want[i, t] = (best, 1 / sum(math.exp((v - top) * scale) for v in logs.values())) if words else ("und", 0.0)
    texts = defaultdict(list)
    for i, t, _, _ in rows:
        texts[i].append(want[i, t])
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
        assert any(r["lang_pred"] == g and r["score"] == pytest.approx(p, rel=1e-9) for g, p in texts[r["doc_id"]]), (r, texts[r["doc_id"]])


def test_letters_are_category_l():
    text = "".join(map(chr, range(0x3000))) + "\U00010330x\U0001d7d8y⅓z"
    assert langid.words(text) == letter_runs(text)


def test_long_unknown_words_keep_their_evidence():
    model = langid.Model(["x", "y"], {"▁": [0.1, 0.1]}, [1e-9, 1e-8], 1)
    logs = model.scorer().log_forward(["q" * langid.WORD])
    assert np.allclose(logs, [[math.log(0.1) + langid.WORD * math.log(p) for p in (1e-9, 1e-8)]])


def test_language_of_odd_rows(spark):
    rows = sample()
    got = defaultdict(list)
    for r in langid.identify(frame(spark, rows).repartition(4)).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert sum(map(len, got.values())) == len(rows)
    for k in (0, 1, 2, 3, 4):
        assert got[1000 + k] == [("und", 0.0)]
    assert got[1005][0][0] == "en" and all(0 <= p <= 1 for v in got.values() for _, p in v)
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    kept = langid.keep_identified(frame(spark, rows)).collect()
    assert all(tuple(r)[5:] == MINE for r in kept)  # the caller's columns survive
    assert sum(r["doc_id"] is None for r in kept) == 2


def plain_digest(text):
    """Buckets counted triplet by triplet."""
    data, counts = text.encode(), [0] * 128
    for at in range(len(data)):
        for (i, j, k), salt in (((0, 1, 2), 0x9E3779B1), ((0, 1, 3), 0x85EBCA77), ((0, 2, 3), 0xC2B2AE3D)):
            if at + k < len(data):
                v = (data[at + i] << 16 | data[at + j] << 8 | data[at + k]) * salt & 0xFFFFFFFF
                v ^= v >> 15
                counts[(v * 0x2C1B3C6D & 0xFFFFFFFF) >> 25] += 1
    ranked = sorted(counts)
    q1, q2, q3 = ranked[31], ranked[63], ranked[95]
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    body = "".join(f"{codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3]:02x}" for i in range(0, 128, 4))
    return f"{min(255, round(8 * math.log2(1 + len(data)))):02x}{15 * q1 // q3 if q3 else 0:x}{15 * q2 // q3 if q3 else 0:x}{body}", codes


def plain_likeness(a, b):
    (x, p), (y, q) = plain_digest(a), plain_digest(b)
    apart = sum(abs(u - v) * (2 if abs(u - v) == 3 else 1) for u, v in zip(p, q))
    return 1 - (apart + min(64, abs(int(x[:2], 16) - int(y[:2], 16))) + abs(int(x[2], 16) - int(y[2], 16)) + abs(int(x[3], 16) - int(y[3], 16))) / (6 * 128 + 64 + 30)


@pytest.mark.parametrize("partitions", [1, 7])
def test_fingerprints_equal_a_plain_version(spark, partitions):
    rows = [r for r in sample(2, 40) if len(r[1] or "") < 20_000]
    rows += [(5000, "hot id %d" % (k % 9), None, "a") for k in range(60)] + [(None, f"null id {k}", None, None) for k in range(60)]
    got = digest.neighbours(frame(spark, rows).repartition(partitions)).collect()
    assert len(got) == len(rows)
    # Equal ids may come in any order of their texts' hashes, so the chain is followed from what was edited.
    order = sorted({r[0] for r in rows if r[0] is not None}, reverse=True) + [None]
    by_id = defaultdict(list)
    for i, t, _, _ in rows:
        by_id[i].append(t or "")
    following = {i: by_id[i] + by_id[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
    prints = {t: plain_digest(t)[0] for v in by_id.values() for t in v}
    used = defaultdict(Counter)
    for r in got:
        own = [t for t in by_id[r["doc_id"]] if prints[t] == r["fingerprint"] and len(t) == r["n_chars"]]
        hits = [(t, f) for t in own for f in following[r["doc_id"]] if hashlib.sha256((t[: len(t) - len(t) // 3] + f[: len(t) // 3]).encode()).hexdigest() == r["edited_sha256"]]
        assert hits, r
        edited = {t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in hits}
        assert any(plain_digest(e)[0] == r["edited_fingerprint"] and plain_likeness(t, e) == pytest.approx(r["near_edited"]) for e in edited for t, _ in hits)
        assert any(plain_likeness(t, f) == pytest.approx(r["near_next"]) for t, f in hits)
        used[r["doc_id"]][r["fingerprint"]] += 1
    assert {i: Counter(prints[t] for t in v) for i, v in by_id.items()} == used
    # Ids of one row each: the next document is fixed.
    alone = {i: v[0] for i, v in by_id.items() if len(v) == 1}
    for r in got:
        k = order.index(r["doc_id"])
        if r["doc_id"] in alone and (n := order[(k + 1) % len(order)]) in alone:
            t, f = alone[r["doc_id"]], alone[n]
            assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 3] + f[: len(t) // 3]).encode()).hexdigest()


def test_fingerprints_of_very_long_texts(spark):
    rows = [(1, "a calm line\n" * 90_000, None, None), (2, "zé" * 700_000, None, None), (3, "", None, None)]
    got = {r["doc_id"]: r for r in digest.neighbours(frame(spark, rows)).collect()}
    for i, t, following in ((1, rows[0][1], rows[2][1]), (2, rows[1][1], rows[0][1]), (3, "", rows[1][1])):
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 3] + following[: len(t) // 3]).encode()).hexdigest()
    whole, parts = digest.triplet_counts(rows[1][1].encode()), np.zeros(128, np.int64)
    data = rows[1][1].encode()
    for at in range(0, len(data), 1000):
        parts += digest.triplet_counts(data[at : at + 1003])
        parts -= digest.triplet_counts(data[at + 1000 : at + 1003])
    assert (whole == parts).all()


def test_votes_equal_a_plain_version():
    rng = np.random.default_rng(3)
    labelled = np.repeat(rng.standard_normal((40, 6)), 5, axis=0).astype(np.float32)  # every vector five times: ties
    labelled /= np.linalg.norm(labelled, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 200).astype(float)
    space = quality.Space(np.eye(6, dtype=np.float32), labelled, labels)
    points = rng.standard_normal((700, 6)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[5] = 0
    points[100:110] = points[99]
    got = space.vote(points, 23)
    for p, score in zip(points, got):
        sims = [round(float(np.dot(p.astype(float), v.astype(float))), 9) for v in labelled]
        near = sorted(range(200), key=lambda i: (-sims[i], i))[:23]
        weights = [max(sims[i], 0) ** 4 for i in near]
        want = sum(w * labels[i] for w, i in zip(weights, near)) / sum(weights) if sum(weights) and p.any() else labels.mean()
        assert score == pytest.approx(want, abs=1e-7)
    assert len(set(got[99:110])) == 1
    assert (space.vote(points[99:100], 23) == got[99]).all()  # alone as in a block
    assert quality.nearest(np.array([[1.0, 2, 2, 2, 0], [5, 5, 5, 5, 5]]), 3).tolist() == [[1, 2, 3], [0, 1, 2]]


def test_quality_of_odd_rows(spark):
    rows = sample(5)
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(80)] + [(3, 0, 0, "x"), (None, 1, 0, "x"), (4, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    df = frame(spark, rows).repartition(4)
    got = defaultdict(list)
    for r in quality.quality_scores(df, labels).collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        got[r["doc_id"]].append(r["score"])
    assert sum(map(len, got.values())) == len(rows)
    assert got[3][0] == got[3][1] and got[2][0] in got[None]  # equal texts, equal scores
    assert got[1000] == got[1001] == got[1002]


def test_url_verdicts_equal_a_plain_model(spark):
    rng = random.Random(8)

    def url(good):
        host = rng.choice(["shop", "news", "wiki", "blog"]) + rng.choice([".net", ".com", ".org", ".fr", ".io"])
        path = rng.choice(["/de/", "/en/", "/es/"]) + "".join(rng.choice("abcdef" if good else "uvwxyz") for _ in range(8))
        return f"https://{host}{path}"

    urls = [url(rng.random() < 0.5) for _ in range(260)] + [None, "", "no scheme here", "http://x.io/é\U0001f600"]
    urls += urls[:4]
    pages = spark.createDataFrame([(i, u, "v", "g", 1, 2) for i, u in enumerate(urls)] + [(None, urls[9], "v", "g", 1, 2)], "page_id long, url string, verdict string, gram string, row int, n int").repartition(3)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages).collect()}
    part = {r["page_id"]: r["p"] for r in pages.selectExpr("page_id", "pmod(xxhash64(3, url), 5) AS p").collect()}

    def rule_of(u):
        if not u or "://" not in u:
            return None
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(v, h, p) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda r: len(r[1] + r[2]), default=None)

    rules = {i: rule_of(u) for i, u in enumerate(urls)}
    rules[None] = rules[9]
    every = {**dict(enumerate(urls)), None: urls[9]}
    counts = {"allow": Counter(), "block": Counter()}
    for i, u in every.items():
        if rules[i] and part[i]:
            s = "\2" * 3 + u + "\3"
            for end in range(3, len(s)):
                for k in range(4):
                    counts[rules[i][0]][s[end - k : end + 1]] += 1

    def log_likelihood(c, s, end):
        p = 1 / urlfilter.ALPHABET
        for k in range(4):
            n = counts[c][s[end - k : end + 1]]
            before = counts[c][s[end - k : end]] if k else sum(v for g, v in counts[c].items() if len(g) == 1)
            p = (n + urlfilter.SMOOTHING * p) / (max(before, n) + urlfilter.SMOOTHING)
        return math.log(p)

    def score(u):
        s = "\2" * 3 + u + "\3"
        return sum(log_likelihood("allow", s, e) - log_likelihood("block", s, e) for e in range(3, len(s))) / (len(s) - 3)

    kept_out = {c: sorted(score(u) for i, u in every.items() if rules[i] and rules[i][0] == c and part[i] == 0) for c in counts}
    at = lambda v, q: v[max(0, math.ceil(q * len(v)) - 1)]
    least = (at(kept_out["allow"], 0.05) + at(kept_out["block"], 0.95)) / 2
    verdicts = Counter()
    for i, u in every.items():
        if rules[i]:
            want = rules[i][0]
        else:
            want = "block" if u and score(u) < least else "allow"
            verdicts[want] += bool(u)
            if u and abs(score(u) - least) < 1e-6:
                continue  # on the border the last digit decides
        assert got[i] == (rules[i][1] + rules[i][2] if rules[i] else None, want), (i, u)
    assert min(verdicts["allow"], verdicts["block"]) > 5


def test_mix_equals_a_plain_version(spark):
    rows = sample(7)
    df = frame(spark, rows).repartition(4)
    planned = mixing.plan(df).collect()
    assert len(planned) == len(rows)
    sizes = Counter((i, len((t or "").split()), s) for i, t, _, s in rows)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in planned) == sizes
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n * c for (_, n, x), c in sizes.items() if x == s) for s in names}
    weights, budget, target, open_ = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(total.values()), {}, {s for s in names if total[s]}
    while open_:
        share = {s: budget * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        for s in over or open_:
            target[s] = 2 * total[s] if over else share[s]
        budget -= sum(2 * total[s] for s in over)
        open_ = open_ - over if over else set()
    for s in names:
        mine = [r for r in planned if r["source"] == s]
        assert all(r["target"] == pytest.approx(target.get(s, 0.0)) and r["source_size"] == total[s] for r in mine)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
        # The nearest sum of whole documents, by a set of every sum that can be reached.
        want = round(target.get(s, 0.0))
        whole = want // total[s] if total[s] else 0
        reached = {0}
        for r in mine:
            if r["size"] < 100_000:
                reached |= {x + r["size"] for x in reached if x + r["size"] <= 2 * want}
        large = [r["size"] for r in mine if r["size"] >= 100_000]
        sums = {x + sum(c) for x in reached for k in range(len(large) + 1) for c in itertools.combinations(large, k)} if large else reached
        best = min(abs(want - whole * total[s] - x) for x in sums)
        assert abs(sum(r["taken"] for r in mine) - want) == best, s
    assert Counter(map(tuple, planned)) == Counter(map(tuple, mixing.plan(df.repartition(2)).collect()))
    mixed = mixing.apply_mix(df, mixing.plan(df)).collect()
    assert all(tuple(r)[5:] == MINE for r in mixed)
    assert any(r["doc_id"] is None for r in mixed)


def best_of_two(lengths, capacity):
    """Bins that first-fit decreasing makes, one document at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        for b in bins:
            if sum(b) + n <= capacity:
                b.append(n)
                break
        else:
            bins.append([n])
    return bins


def test_packing_is_no_worse_than_first_fit():
    rng = np.random.default_rng(3)
    for most in (40, 70, 100):
        lengths = rng.integers(1, most, 400)
        bins = packing.best_two_fit(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(400))
        assert all(lengths[b].sum() <= 100 for b in bins)
        assert len(bins) <= len(best_of_two(lengths.tolist(), 100))
    # Small cases against the least number of bins, by trying every partition.
    for _ in range(40):
        lengths = rng.integers(1, 10, 7)

        def least(rest, bins):
            if not rest:
                return len(bins)
            out = len(bins) + len(rest)
            for k in range(len(bins)):
                if bins[k] + rest[0] <= 10:
                    out = min(out, least(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]]))
            return min(out, least(rest[1:], [*bins, rest[0]]))

        assert len(packing.best_two_fit(lengths, 10)) <= least(lengths.tolist(), []) + 1


def test_stages_keep_clashing_columns_null_ids_and_repeats(spark, tmp_path):
    rows = sample(9, 40)
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(tuple(r)[5:] == MINE for r in got), name
        if name == "secret scan":
            assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in rows)
        if name != "mixing":
            assert sum(r["doc_id"] is None for r in got) == {"language ID": 2, "near-dedup": 1, "secret scan": 3}[name]
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in placed} == {i for i, *_ in rows}
