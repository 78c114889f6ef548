"""Near-dedup and mixing of tables whose ids repeat or are null, by row counts."""

from collections import Counter

import numpy as np

import corpus_pipeline
from corpusmill.llm import neardup
from tests.llm.test_operators import BASE, DOCS


def rows():
    rng = np.random.default_rng(8)
    words = BASE.split()
    t = [" ".join(rng.choice(words, 60)) for _ in range(6)]
    pairs = [(7, t[0]), (7, t[0]), (7, t[0]), (3, t[0] + " tail"), (8, t[1]), (8, t[2]), (8, t[2]), (None, t[3]), (None, t[3]), (None, t[4]), (None, t[1]), (9, t[5])]
    return t, [(i, x, "en", "a", len(x), 0.0, 1) for i, x in pairs]


def test_one_row_of_each_group_stays(spark):
    t, table = rows()
    df = spark.createDataFrame(table, DOCS).repartition(3)
    out = neardup.drop_near_duplicates(df)
    assert out.columns == df.columns
    want = [(3, t[0] + " tail"), (8, t[1]), (8, t[2]), (None, t[3]), (None, t[4]), (9, t[5])]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(want)


def test_each_row_is_mixed_by_itself(spark, tmp_path):
    t, table = rows()
    table = [r for r in table if r[0] is None or r[0] == 8]
    df = spark.createDataFrame(table, DOCS).coalesce(1)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, df, str(tmp_path)).collect())
    # One source: its target is all its words or a share of them, met by whole rows of 60 words.
    plan = corpus_pipeline.mixing.plan(df.withColumn("k", corpus_pipeline.F.monotonically_increasing_id()), key="k").collect()
    assert sum(got.values()) == sum(p["taken"] // p["size"] for p in plan) and len({p["k"] for p in plan}) == len(table)
    assert any(i is None for i, _ in got)
