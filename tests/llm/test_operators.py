"""Small fixtures: nulls, empty texts, ties, repeated rows, empty tables, extra columns; brute-force versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from corpusmill.llm import ann, digest, langid, mixing, neardup, packing, quality, secretscan, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int"
BASE = "the quick brown fox jumps over the lazy dog while seven old owls watch from a tall dark tree near the river bank today "
TEXTS = [None, "", "   \n", BASE * 3, BASE * 3, BASE * 3 + "indeed", "el perro come la comida de la casa", "der hund und die katze", "12 34 !!", "x" * 5000, "Ünïcode 漢字 ﬁ <|endoftext|> Σς", "word " * 6000]


def docs(spark, texts=TEXTS):
    langs = {6: "es", 7: "de"}
    return spark.createDataFrame([(i, t, langs.get(i, "en"), [None, "a", "b"][i % 3], len(t or ""), 0.0, 1) for i, t in enumerate(texts)], DOCS).coalesce(2)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language_id(spark):
    df = docs(spark)
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert set(got) == set(range(len(TEXTS)))
    for i in (0, 1, 2, 8):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == "en"
    assert langid.identify(empty(spark)).collect() == []
    assert langid.keep_identified(df).columns == df.columns


def test_forward_sums_all_segmentations():
    table = {"▁": [0.1], "a": [0.2], "b": [0.3], "▁a": [0.05], "ab": [0.07], "▁ab": [0.01]}
    got = langid.forward("ab", {k: np.array(v) for k, v in table.items()}, np.array([1e-9]), 3)[0]
    assert got == pytest.approx(0.1 * 0.2 * 0.3 + 0.05 * 0.3 + 0.1 * 0.07 + 0.01)
    rng = np.random.default_rng(3)
    two = {k: [v[0], float(rng.random())] for k, v in table.items()}
    scorer = langid.Scorer(langid.Model(["x", "y"], two, [1e-6, 1e-3], 3))
    words = ["ab", "b", "abab", "ca", "bbbbbbbbabc", "ü"]
    want = [langid.forward(w, {k: np.array(v) for k, v in two.items()}, np.array([1e-6, 1e-3]), 3) for w in words]
    assert np.allclose(scorer.forward(words), want, rtol=1e-12)
    assert scorer.many(["ab ca", None, "ab", "1"])[1::2] == [("und", 0.0)] * 2


def test_secrets(spark):
    key = "kJ8s0dPq3VxZ7mLw2RtYb5NcHf9GaE1u"
    texts = [None, "", "password = hunter2hunter2 end", "Token:abc", "é\U0001f600 AKIAABCDEFGHIJKL12 " + "0123456789abcdef" * 2, "password: token: abcdefgh1", f"value {key} end", "an_extraordinarily_long_identifier_name_here", "api_key='AKIAABCDEFGHIJKL12'"]
    df = docs(spark, texts)
    assign = re.compile(secretscan.ASSIGN.replace(r"\x20", " "))
    got = {r["doc_id"]: r for r in secretscan.scan(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
    assert got[6]["spans"] == f"random:6:{6 + len(key)}"
    assert got[7]["spans"] == ""
    masked = secretscan.redact(df)
    assert masked.columns == df.columns
    rows = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert rows[0] is None and rows[2] == "[SECRET] end" and rows[6] == "value [SECRET] end" and rows[8] == "[SECRET]'"
    assert secretscan.scan(empty(spark)).collect() == []


def test_packing(spark):
    df = docs(spark).unionByName(docs(spark).filter("doc_id in (3, 11)"))
    rows = packing.pack_documents(df).collect()
    assert sum(r["doc_id"] == 3 for r in rows) == 2
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert packing.pack_documents(empty(spark)).collect() == []


def test_best_two_fit_beats_one_document():
    # Greedy takes 6 and 3 of capacity 10; 3 makes way for 2 and 2, which fill the gap.
    assert sorted(map(sorted, ([[6, 2, 2], [3]]))) == sorted(sorted(np.array([6, 3, 2, 2])[b].tolist()) for b in packing.best_two_fit(np.array([6, 3, 2, 2]), 10))
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 2000)
    bins = packing.best_two_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(2000))
    assert len(bins) <= 1.02 * lengths.sum() / 100  # over half of these lengths cannot share a bin with their like


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return [len(s) for s in sets], up


@pytest.mark.parametrize("block", [neardup.BLOCK, 16])
def test_near_duplicates_equal_brute_force(spark, block, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    base = [words[i] for i in rng.integers(0, 300, 120)]
    texts = list(TEXTS[:8])
    for _ in range(40):  # a chain and a cloud of near copies, around the threshold
        t = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 5))):
            t[k] = words[int(rng.integers(0, 300))]
        texts.append(" ".join(t))
    texts += texts[10:14]
    monkeypatch.setattr(neardup, "BLOCK", block)
    sizes, want = brute_components(texts, 4, 80)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, texts), 4, 80).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert neardup.near_duplicates(empty(spark)).collect() == []


def test_odd_sketch_estimates():
    rng = np.random.default_rng(4)
    common, a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 50, dtype=np.uint64), rng.integers(0, 2**63, 50, dtype=np.uint64)
    sketches = [np.frombuffer(neardup.odd_sketch(neardup.signature(np.concatenate([common, x]))), np.uint64) for x in (a, b)]
    assert abs(neardup.estimate(np.bitwise_count(sketches[0] ^ sketches[1]).sum()[None])[0] - 0.9) < 0.1


def test_leaders_keep_every_link_of_a_bucket():
    rng = np.random.default_rng(12)
    sets, current = [], rng.integers(0, 2**63, 400, dtype=np.uint64)
    for i in range(300):  # a walk through near copies, with copies on the way
        if i % 3:
            current = current.copy()
            current[rng.integers(0, 400, int(rng.integers(1, 30)))] = rng.integers(0, 2**63, 1, dtype=np.uint64)
        sets.append(np.unique(current))
    order = rng.permutation(300)
    sketches = np.stack([np.frombuffer(neardup.odd_sketch(neardup.signature(sets[i])), np.uint64) for i in order])
    leaders, forest, n = neardup.Leaders(), neardup.Forest(300), 0
    for lo in range(0, 300, 77):
        for a, b in leaders.add(order[lo : lo + 77], sketches[lo : lo + 77]):
            forest.join(int(a), int(b))
            n += 1
    roots = forest.roots()
    for i in range(300):
        for j in range(i):
            if neardup._similar(sets[i], sets[j], 80):
                assert roots[i] == roots[j]
    assert len(leaders.ids) < 250 and n <= 300 + len(leaders.ids)


def test_urls(spark):
    urls = [None, "", "no scheme", "https://A.Example.COM/en/7?x#y", "https://com/en/1", "https://x.net/de/8", "https://m.example.net/de/80", "ftp://u.org/es/", "https://x.fr/en/"]
    pages = spark.createDataFrame([(i, u, "allow") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = [tuple(r)[1:] for r in urlfilter.judge(pages).orderBy("page_id").collect()]
    assert got[0] == ("", "", None, "allow") == got[1]
    assert got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert [g[2:] for g in got[4:8]] == [("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    assert got[8][2] is None
    assert urlfilter.judge(pages.limit(0)).collect() == []


def test_quality(spark):
    good, bad = ["A calm line of prose number %d follows here today." % i for i in range(40)], ["BUY!! NOW!! %d!! BUY!! NOW!!" % i for i in range(40)]
    df = docs(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(df, labels).collect()}
    held = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(80))
    assert all(got[i]["predicted"] == int(i < 40) for i in held)
    assert 0 <= got[80]["score"] == got[81]["score"] <= 1
    assert quality.quality_scores(empty(spark), labels.limit(0)).collect() == []


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    e = rng.standard_normal((400, 16))
    e[40:70] = e[40]  # equal vectors
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(e)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [1.0, None] * 8, 0), (1080, [1.0], 0)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        s = e @ e[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -np.round(s, 9)))[:20]
        assert [v for _, v, _ in sorted(found)] == want.tolist()
        assert np.allclose([x for _, _, x in sorted(found)], s[want])
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(ann.hilbert(grid, 3))
    assert len(set(ann.hilbert(grid, 3).tolist())) == 512
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_digests(spark):
    got = {r["doc_id"]: r for r in digest.neighbours(docs(spark)).collect()}
    n = len(TEXTS)
    for i, t in enumerate(TEXTS):
        t, following = t or "", TEXTS[(i - 1) % n] or ""
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == digest.digest(t) and got[i]["edited_fingerprint"] == digest.digest(edited)
        assert got[i]["near_next"] == pytest.approx(digest.likeness(digest.digest(t), digest.digest(following)))
    assert got[0]["fingerprint"] == got[1]["fingerprint"]
    assert digest.neighbours(empty(spark)).collect() == []


def test_mixing(spark):
    df = docs(spark)
    rows = mixing.plan(df).collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by.setdefault(r["source"], []).append(r)
    assert sum(r[0]["target"] for r in by.values()) == pytest.approx(1.5 * sum(x["size"] for x in rows))
    again = {(r["doc_id"]): r["taken"] for r in mixing.plan(df).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    assert mixing.plan(empty(spark)).collect() == []
    assert mixing.apply_mix(df, mixing.plan(df)).columns == df.columns


def test_budget_is_met_as_nearly_as_any_subset():
    import itertools

    rng = np.random.default_rng(9)
    for _ in range(600):
        lengths = sorted(set(rng.integers(1, 30, 4).tolist()))
        counts = rng.integers(0, 4, len(lengths)).tolist()
        total = sum(n * c for n, c in zip(lengths, counts))
        budget = int(rng.integers(0, total + 1))
        taken = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        best = min(abs(budget - sum(n * k for n, k in zip(lengths, ks))) for ks in itertools.product(*[range(c + 1) for c in counts]))
        assert abs(budget - sum(n * k for n, k in zip(lengths, taken))) == best


def test_shares_above_the_cap_are_dealt_again():
    assert mixing.shared_targets([10, 100, 100], [3, 1, 2], 315, 2) == pytest.approx([20, (315 - 20) / 3, 2 * (315 - 20) / 3])
