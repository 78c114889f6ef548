"""Scores of code rows: any batch scorer, and one that Spark ML trains."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import code_tokens

#: Ids that a scorer reads of a text, the two closing ones included; texts per batch; texts tokenized at once.
MOST_IDS, BATCH, CHUNK = 512, 64, 1024
Scorer = Callable[[Sequence[str]], Sequence[float]]
Tokenizer = Callable[[str], list]


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"[^ \t\n\x0B\f\r]")


def length_order(lengths: Sequence[int]) -> list[int]:
    """Indexes by falling length; equal ones keep their order."""
    return sorted(range(len(lengths)), key=lambda i: -lengths[i])


def cut(ids: list, close: object, most: int = MOST_IDS) -> tuple[list, bool]:
    """ids with their closing id last; longer ones lose their end and are marked."""
    return (ids, False) if len(ids) <= most else ([*ids[: most - 1], close], True)


def score_rows(rows: DataFrame, text: str, make_scorer: Callable[[], tuple[Tokenizer, Callable[[list[list]], Sequence[float]]]], close: object = 2) -> DataFrame:
    """rows with llm_score and llm_score_truncated; blank texts get nulls.

    make_scorer runs once in each task and gives a tokenizer of whole texts (with
    opening and closing ids) and a scorer of batches of equal-ish length.
    """
    schema = rows.drop("llm_score", "llm_score_truncated").withColumns({"llm_score": F.lit(0.0), "llm_score_truncated": F.lit(False)}).schema
    for f in schema:
        f.nullable = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize, score = make_scorer()
        for batch in batches:
            texts = batch[text].tolist()
            live = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            encoded = [cut(tokenize(texts[i]), close) for i in live]
            scores: list = [None] * len(texts)
            marks: list = [None] * len(texts)
            order = length_order([len(ids) for ids, _ in encoded])
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                for k, value in zip(part, score([encoded[k][0] for k in part])):
                    scores[live[k]], marks[live[k]] = round(float(value), 4), encoded[k][1]
            yield batch.drop(columns=["llm_score", "llm_score_truncated"], errors="ignore").assign(llm_score=pd.Series(scores, dtype="float64", index=batch.index), llm_score_truncated=pd.Series(marks, dtype="object", index=batch.index))

    return rows.mapInPandas(run, schema)


def _features(rows: DataFrame, text: str) -> DataFrame:
    """rows with tokens, of the first MOST_IDS - 2 at most."""
    return rows.withColumn("_tokens", F.slice(code_tokens(F.coalesce(F.col(text), F.lit(""))), 1, MOST_IDS - 2))


def train_scorer(rows: DataFrame, text: str, label: str, features: int = 1 << 14, rounds: int = 50) -> PipelineModel:
    """Logistic regression on hashed token weights; classes weigh alike."""
    live = rows.filter(~blank(F.col(text)) & F.col(label).isNotNull()).select(text, F.col(label).cast("double").alias("_label"))
    balance = live.agg(F.count_if(F.col("_label") == 0).alias("n"), F.count_if(F.col("_label") == 1).alias("p")).first()
    weight = balance["n"] / balance["p"] if balance["p"] else 1.0
    data = _features(live, text).withColumn("_weight", F.when(F.col("_label") == 1, weight).otherwise(1.0))
    stages = [HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_weight", maxIter=rounds, regParam=0.01, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction")]
    return Pipeline(stages=stages).fit(data)


def apply_scorer(model: PipelineModel, rows: DataFrame, text: str) -> DataFrame:
    """rows with llm_score (four decimals) and llm_score_truncated; blank texts get nulls."""
    long = F.size(code_tokens(F.coalesce(F.col(text), F.lit("")))) + 2 > MOST_IDS
    scored = model.transform(_features(rows.drop("llm_score", "llm_score_truncated"), text)).withColumn("_p", vector_to_array("_probability"))
    out = scored.withColumn("llm_score", F.when(~blank(F.col(text)), F.round(F.get("_p", F.lit(1)), 4))).withColumn("llm_score_truncated", F.when(~blank(F.col(text)), long))
    return out.drop("_tokens", "_tf", "_x", "_raw", "_probability", "_prediction", "_p")
