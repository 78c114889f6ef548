"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Hashed word, word-shape and repetition counts of at most about ``sample``
labelled documents give a TF-IDF matrix, whose leading singular vectors span the
latent space. The labelled vectors (sample x RANK floats, a fixed bound) are
broadcast; every document is projected, its exact cosines to all of them are
made in blocks, and the nearest ones vote with their similarity as weight.

Defined results: an empty or null text has no features and gets the share of
label 1 in the sample; no labelled rows gives score 0.5; a document labelled
twice counts with its greatest label; equal similarities go to the smaller
doc_id; repeated rows get equal scores; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import id_crc

SAMPLE = 2048
RANK = 64
NEIGHBOURS = 25
THRESHOLD = 0.3
WORDS, SHAPES, EXTRA = 4096, 2048, 64
FEATURES = WORDS + SHAPES + EXTRA
_CACHE = 400_000
#: Word counts weigh less than shapes and repetition, which tell more of quality in few documents.
_WEIGHT = np.concatenate([np.full(WORDS, 0.3, np.float32), np.full(SHAPES, 1.0, np.float32), np.full(EXTRA, 1.5, np.float32)])


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass"))


class _Kinds(dict):
    """Code point to the sign of its kind, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        return kind


_KINDS = _Kinds()
_RUNS = re.compile(r"([Aa0])\1+")


def shape(word: str) -> str:
    """Case, digits and marks of a whole word, runs of one kind cut to one sign."""
    return _RUNS.sub(r"\1", word.translate(_KINDS))


class Counter:
    """Feature counts of texts; words' features are cached in the worker."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 2), np.int64)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        try:
            at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.rows) > _CACHE:
                self.rows = {}
            new = set(words).difference(self.rows)
            while len(self.rows) + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for w in new:
                k = self.rows[w] = len(self.rows)
                self.table[k] = _hash(w.lower().strip(".,;:!?")) % WORDS, WORDS + _hash(shape(w)) % SHAPES
            at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        n = len(at)
        counts = np.bincount(self.table[at].ravel(), minlength=FEATURES)
        base = WORDS + SHAPES
        repeated = float((at[1:] == at[:-1]).mean()) if n > 1 else 0.0
        distinct = len(np.unique(at)) / n
        mean = len(text) / n
        for k, v in ((0, 10 * repeated), (10 if n >= 30 else 20, 10 * distinct), (30, min(9.0, mean)), (40, min(9.0, np.log2(n)))):
            counts[base + k + int(min(9, v))] += max(1, n // 4)
        used = np.flatnonzero(counts)
        return used, np.log1p(counts[used] * (100.0 / n)).astype(np.float32)


def nearest(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k greatest; of equals the first. In the order of the columns."""
    if k == sims.shape[1]:
        return np.tile(np.arange(k), (len(sims), 1))
    least = np.partition(sims, -k, axis=1)[:, -k, None]
    over, level = sims > least, sims == least
    for row in np.flatnonzero((over | level).sum(1) > k):
        level[row, np.flatnonzero(level[row])[k - int(over[row].sum()) :]] = False
    return np.nonzero(over | level)[1].reshape(-1, k)


class Space:
    """The latent space and the labelled vectors in it."""

    def __init__(self, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.basis, self.vectors, self.labels = basis, vectors, labels
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def project(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(found), self.basis.shape[1]), np.float32)
        for i, (at, v) in enumerate(found):
            if len(at):
                out[i] = v @ self.basis[at]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-12)

    def vote(self, points: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 512) -> np.ndarray:
        """Exact cosines to all labelled vectors, a block of documents at a time; rounded, so that they do not depend on the block."""
        scores = np.full(len(points), self.prior)
        points, labelled = points.astype(np.float64), self.vectors.T.astype(np.float64)
        k = min(neighbours, len(self.labels))
        for at in range(0, len(points) if k else 0, block):
            sims = np.round(points[at : at + block] @ labelled, 9)
            near = nearest(sims, k)
            weight = np.maximum(np.take_along_axis(sims, near, 1), 0) ** 4
            total = weight.sum(1)
            some = (total > 0) & points[at : at + block].any(1)
            mean = (weight * self.labels[near]).sum(1)
            scores[at : at + block][some] = mean[some] / total[some]
        return np.clip(scores, 0.0, 1.0)


def fit(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK) -> Space:
    """Truncated singular vectors of the weighted TF-IDF matrix."""
    n = len(found)
    x = np.zeros((n, FEATURES), np.float32)
    for i, (at, v) in enumerate(found):
        x[i, at] = v
    idf = np.log((1 + n) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
    scale = idf * _WEIGHT
    x *= scale
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(norm > 0, norm, 1)
    values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    order = np.argsort(values)[::-1][: min(rank, n)]
    order = order[values[order] > 1e-9]
    right = x.T @ (left[:, order] / np.sqrt(values[order])).astype(np.float32)
    space = Space(np.ascontiguousarray(scale[:, None] * right), np.zeros((0, len(order)), np.float32), labels)
    space.vectors = space.project(found)
    return space


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", sample: int = SAMPLE) -> Space:
    """Fit on at most about sample labelled rows where usable holds, chosen by hash of doc_id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(usable & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    total = marked.count()
    chance = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000))
    chosen = marked.filter(chance < int(1_000_000 * min(1.0, sample / max(1, total)))).groupBy("doc_id").agg(F.max("label").alias("label"))
    count = Counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = count()
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0].tolist() for f in found], pa.list_(pa.int64())), pa.array([f[1].tolist() for f in found], pa.list_(pa.float32()))], names=["doc_id", "label", "at", "v"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = texts.mapInArrow(run, "doc_id long, label int, at array<long>, v array<float>").toPandas().sort_values("doc_id")  # bounded by sample
    if not len(rows):
        return Space(np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    return fit([(np.asarray(a, np.int64), np.asarray(v, np.float32)) for a, v in zip(rows["at"], rows["v"])], rows["label"].to_numpy(np.float64))


def score(docs: DataFrame, space: Space, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id and score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, s = Counter(), shared.value
        for batch in batches:
            points = np.concatenate([s.project([features(t.as_py()) for t in batch.column(1)[i : i + 256]]) for i in range(0, batch.num_rows, 256)]) if batch.num_rows else np.zeros((0, s.basis.shape[1]), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.vote(points, neighbours))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from labels of rows that are not held out."""
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(modulus)) == held
    space = train(docs, labels, ~held_out)
    return score(docs, space).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
