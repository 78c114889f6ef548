"""The pipeline's stages and its whole run against brute force."""

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from corpusmill.llm import mixing, secretscan
from corpusmill.llm.tokens import WordCache
from tests.llm.test_operators import BASE, DOCS, brute_components


def texts():
    rng = np.random.default_rng(5)
    words = BASE.split()
    out = [None, "", "123 456 !!", BASE * 2, BASE * 2, BASE * 2 + "indeed", "password: hunter2hunter2 " + BASE]
    out += [" ".join(rng.choice(words, 60)) for _ in range(20)]
    out += [out[10] + " tail", "key AKIAABCDEFGHIJKL12 and " + " ".join(rng.choice(words, 40)), " ".join(rng.choice(words, 6000))]
    return out


def test_stages_and_run(spark, tmp_path):
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t or ""), 0.0, 1) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = Counter(r["doc_id"] for r in docs.collect())
        kept[name] = after
        if name == "language ID":
            assert set(before) - set(after) == {0, 1, 2}
        elif name == "near-dedup":
            ids = sorted(before)
            _, roots = brute_components([before[i]["text"] for i in ids], 5, 80)
            assert set(after) == {i for k, i in enumerate(ids) if roots[k] == k}
        elif name == "secret scan":
            assert set(after) == set(before)
            assign = re.compile(secretscan.ASSIGN.replace(r"\x20", " "))
            for r in docs.collect():
                want = re.sub("AKIA[A-Z0-9]{12,}", "[SECRET]", assign.sub("[SECRET]", before[r["doc_id"]]["text"]))
                assert r["text"] == want and r["n_chars"] == len(want)
        else:
            plan = {r["doc_id"]: r for r in mixing.plan(spark.read.parquet(str(tmp_path / "secret scan"))).collect()}
            assert all(after[i] == (p["taken"] // p["size"] if p["size"] else 0) for i, p in plan.items())
    cache, end, want = WordCache(), np.array([1], "<u4").tobytes(), Counter()
    for r in docs.collect():
        ids = cache.encode(r["text"]) + end
        for k in range(0, len(ids), 4 * 4096):
            want[r["doc_id"], k // (4 * 4096), len(ids[k : k + 4 * 4096]) // 4, zlib.crc32(ids[k : k + 4 * 4096])] += 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed) == want
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(places, places[1:])) and places[0][0] == 0 and sum(n for _, n in places) <= 4096


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
