"""Nearest neighbours by inner product over several shifted Hilbert orderings.

Vectors are placed by their direction, or are augmented so that the largest inner
product becomes the smallest distance; then they are projected at random for each
curve, shifted, and put in Hilbert order. Key quantiles of a bounded sample cut each order in cells of about equal
counts. A query meets the vectors of the cells around its own, on each curve;
the curves' best are merged and reranked by exact inner products in double
precision. Vectors with one key are met all or none.

How many curves and how wide a window are needed depends on the vectors, not on
their number: about PROBES queries are answered exactly, and the cheapest choice
of placement, curves and window that would have found TARGET of their neighbours
is taken. Clustered vectors need
narrow windows. For isotropic vectors of high dimension no ordering gathers
neighbours; where windows would take over WORTH of the products of a full search,
a single window over the whole of one curve, which is that full search in blocks
and exact, is cheaper and is taken instead.

Candidates travel once a curve, queries (the smaller side) to each segment of the
order that their windows touch; a segment holds at most about HELD queries and
streams its candidates.

Defined results: vectors that are null, empty, zero, of another than the most
frequent dimension (the smaller of equals), or hold null or non-finite components
take no part, nor rows without an id; of equal vectors only the ``neighbours + 1``
with the smallest ids can be among the nearest, so only they are indexed, all are
queries; an id that repeats is one candidate and one query, with its best scores;
ties go to the smaller id; with fewer candidates than ``neighbours`` all within
reach are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.llm.common import materialise

NEIGHBOURS = 20
#: Curves of each placement at most.
CURVES = 4
DIMENSIONS, BITS = 8, 16
SEED = 29
#: Vectors that quantiles are taken from, and queries that are answered exactly to choose windows: about so many, by hash.
SAMPLE, PROBES = 65_536, 128
#: Share of the probes' neighbours that the windows must find; share of a full search's products above which windows are not worth it.
TARGET, WORTH = 0.97, 0.5
#: Vectors in a cell, about, and cells of a curve at most (beyond that cells are larger).
CELL, CELLS = 64, 4096
#: Vectors in a segment and queries held in one, about; segments of a curve at least.
SEGMENT, HELD, SEGMENTS = 200_000, 20_000, 8
#: Rows of the result in each of its partitions at most, about.
OUT_ROWS = 500_000
_NO_ID = np.iinfo(np.int64).max


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n x dimensions, each under 2**bits), as bytes that sort like it."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    signs = np.stack([(x[i] >> b & 1).astype(np.uint8) for b in range(bits - 1, -1, -1) for i in range(n)], 1)
    packed = np.packbits(signs, axis=1)
    return np.ascontiguousarray(packed).view(f"S{packed.shape[1]}").ravel()


def curve_keys(vectors: np.ndarray, curve: int, norm_most: float, query: bool = False, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of vectors on one randomly rotated and shifted curve; even ones place candidates by direction."""
    d = vectors.shape[1]
    rng = np.random.default_rng(SEED + curve)
    turn = np.linalg.qr(rng.standard_normal((d + 1, min(dimensions, d + 1))))[0]
    shift = rng.uniform(0, 1, turn.shape[1])
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    if query or curve % 2 == 0:
        unit = np.hstack([vectors / norms, np.zeros_like(norms)])
    else:
        unit = np.hstack([vectors / norm_most, np.sqrt(np.maximum(0.0, 1 - (norms / norm_most) ** 2))])
    z = unit @ turn * math.sqrt(d + 1)
    # The shift moves the grid by up to a quarter of its width.
    cells = ((np.clip((z + 3) / 6, 0, 1) + shift / 4) / 1.25 * (2**bits - 1)).astype(np.int64)
    return hilbert(cells, bits)


class Best:
    """The best partners so far of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, norm_most: float):
        self.ids, self.vectors, self.low, self.high, self.k = ids, vectors, low, high, k
        self.slack = 1e-9 * norm_most * np.linalg.norm(vectors, axis=1)  # far above the rounding of a product in blocks
        self.score = np.full((len(ids), k), -np.inf)
        self.partner = np.tile(_NO_ID - np.arange(k), (len(ids), 1))

    def meet(self, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Meet candidates whose cells, low to high, lie within the queries' low to high."""
        for at in range(0, len(self.ids), 256):
            s = slice(at, at + 256)
            sims = self.vectors[s] @ vectors.T
            sims[(high[None] < self.low[s, None]) | (low[None] > self.high[s, None]) | (self.ids[s, None] == ids[None])] = -np.inf
            least = self.score[s, -1]
            if sims.shape[1] > self.k:
                least = np.maximum(least, np.partition(sims, -self.k, axis=1)[:, -self.k])
            rows, columns = np.nonzero((sims >= (least - self.slack[s])[:, None]) & (sims > -np.inf))
            if rows.size:  # sums of one order for all, so that equal vectors tie
                exact = np.concatenate([(self.vectors[s][rows[i : i + 65536]] * vectors[columns[i : i + 65536]]).sum(1) for i in range(0, len(rows), 65536)])
                self._merge(at, rows, exact, ids[columns])

    def _merge(self, at: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(some, self.k)])
        scores = np.concatenate([scores, self.score[at + some].ravel()])
        ids = np.concatenate([ids, self.partner[at + some].ravel()])
        order = np.lexsort((-scores, ids, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        once = np.r_[True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])]
        rows, scores, ids = rows[once], scores[once], ids[once]
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = rank < self.k
        self.score[at + some], self.partner[at + some] = scores[kept].reshape(-1, self.k), ids[kept].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = np.isfinite(self.score)
        return np.broadcast_to(self.ids[:, None], some.shape)[some], self.partner[some], self.score[some]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part; float and double components as they are, others as double."""
    kind = embeddings.schema["embedding"].dataType.elementType
    stored = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(stored).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("embedding") == (common["d"] if common else 0))


def _some(rows: DataFrame, n: int, most: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of about most of the n rows, chosen by hash of the id; all, where there are no more."""
    chance = F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(1 << 31))
    table = rows.filter(chance < math.ceil((1 << 31) * min(1.0, most / n))).toArrow().combine_chunks()
    ids, vectors = (c.combine_chunks() for c in table.columns)
    return ids.to_numpy(), matrix(vectors) if len(ids) else np.zeros((0, 1))


class Index:
    """Cell bounds of the curves, and the choice of curves and window."""

    def __init__(self, bounds: list[np.ndarray], cells: int, norm_most: float):
        self.bounds, self.cells, self.norm_most = bounds, cells, norm_most
        self.curves, self.width = [0], cells

    def spans(self, vectors: np.ndarray, curve: int, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell that each vector's key spans."""
        keys = curve_keys(vectors, curve, self.norm_most, query)
        return np.searchsorted(self.bounds[curve], keys, "left"), np.searchsorted(self.bounds[curve], keys, "right")

    def choose(self, apart: np.ndarray, target: float, worth: float) -> None:
        """apart: cells between each probe and each of its neighbours (pair x curve)."""
        best, every = worth, list(range(apart.shape[1]))
        for curves in [every[kind::2][:k] for kind in (0, 1) for k in range(1, len(every[kind::2]) + 1)] if len(apart) else []:
            width = int(np.quantile(apart[:, curves].min(1), target, method="higher"))
            share = len(curves) * (2 * width + 1) / self.cells
            if share <= best:
                best, self.curves, self.width = share, curves, width


def fit(indexed: DataFrame, queries: DataFrame, n: int, n_queries: int, norm_most: float, neighbours: int, curves: int = CURVES, target: float = TARGET, worth: float = WORTH) -> Index:
    """Cut the curves in cells and choose the windows from exactly answered probes."""
    vectors = _some(indexed, n, SAMPLE, 3)[1]
    cells = max(1, min(CELLS, n // CELL, len(vectors)))
    at = len(vectors) * np.arange(1, cells) // cells
    curves *= 2  # of both placements
    index = Index([np.sort(curve_keys(vectors, c, norm_most))[at] for c in range(curves)], cells, norm_most)
    ids, probes = _some(queries, n_queries, PROBES, 7)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("apart", pa.list_(pa.int32()))])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [index.spans(probes, c, True) for c in range(curves)]
        for batch in batches:
            if not batch.num_rows:
                continue
            names, some = batch.column(0).to_numpy(), matrix(batch.column(1))
            every = np.zeros(len(ids), np.int64)
            best = Best(ids, probes, every, every, neighbours, norm_most)
            for k in range(0, len(names), 2048):
                part = np.zeros(len(names[k : k + 2048]), np.int64)
                best.meet(names[k : k + 2048], some[k : k + 2048], part, part)
            query, partner, score = best.found()
            order = np.argsort(names, kind="stable")
            row = order[np.searchsorted(names[order], partner)]
            probe = {q: i for i, q in enumerate(ids.tolist())}
            mine = np.array([probe[q] for q in query.tolist()], np.int64)
            apart = []
            for c in range(curves):
                low, high = index.spans(some[row], c, False) if len(row) else (np.zeros(0, np.int64),) * 2
                apart.append(np.maximum(0, np.maximum(low - own[c][1][mine], own[c][0][mine] - high)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(apart, 1).ravel().astype(np.int32)), curves).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(partner), pa.array(score), lists], schema=schema)

    if len(ids):
        pairs = indexed.mapInArrow(near, "query_id long, vec_id long, score double, apart array<int>")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        rows = pairs.withColumn("rank", rank).filter(F.col("rank") <= neighbours).select("apart").collect()  # about PROBES x neighbours
        index.choose(np.array([r["apart"] for r in rows], np.int64).reshape(len(rows), curves), target, worth)
    return index


def search(embeddings: DataFrame, every: int = 20, neighbours: int = NEIGHBOURS, curves: int = CURVES, target: float = TARGET, worth: float = WORTH) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of every row but the query's own, for rows whose id is divisible by every."""
    rows = usable_vectors(embeddings)
    same = Window.partitionBy(F.xxhash64("embedding"), F.hash("embedding")).orderBy("vec_id")
    # A limit of the rank reaches the scan's side of the shuffle, so a very common vector brings few rows from each task.
    indexed = materialise(rows.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= neighbours + 1).select("vec_id", "embedding"), "ann-indexed")
    queries = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts, n_queries = indexed.agg(F.count("*").alias("n"), F.max(square).alias("m")).first(), queries.count()
    n, norm_most = facts["n"], math.sqrt(facts["m"] or 1.0)
    pair = "query_id long, vec_id long, score double"
    if not n or not n_queries:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(indexed, queries, n, n_queries, norm_most, neighbours, curves, target, worth)
    used, width, cells = len(index.curves), index.width, index.cells
    length = max(1, min(-(-cells // SEGMENTS), cells * SEGMENT // n))  # cells of a segment
    segments = -(-cells // length)
    # A segment's queries are those of its cells and of a window to either side; more than HELD are cut in blocks.
    blocks = max(1, math.ceil(n_queries * min(1.0, (length + 2 * width) / cells) / HELD))

    def placed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, lists = batch.column(0).to_numpy(), batch.column(1)
                vectors, mixed = matrix(lists), ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                for c, curve in enumerate(index.curves):
                    low, high = index.spans(vectors, curve, query)
                    if query:
                        low, high = np.maximum(low - width, 0), np.minimum(high + width, cells - 1)
                        first, last = low // length, high // length
                        n = last - first + 1
                        row = np.repeat(np.arange(len(ids)), n)
                        segment = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                        block = mixed[row].astype(np.int64) % blocks
                    else:  # a key's vectors are spread over the cells that it spans; queries of a key reach all of them
                        spread = low + mixed.astype(np.int64) % (high - low + 1)
                        low = high = spread
                        row = np.repeat(np.arange(len(ids)), blocks)
                        segment, block = spread[row] // length, np.tile(np.arange(blocks), len(ids))
                    tile = (c * segments + segment) * blocks + block
                    for k in range(0, len(row), 10_000):
                        part = row[k : k + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array(tile[k : k + 10_000].astype(np.int32)), pa.array(np.full(len(part), query)), pa.array(ids[part]), pa.array(low[part].astype(np.int32)), pa.array(high[part].astype(np.int32)), lists.take(pa.array(part))], names=["tile", "query", "vec_id", "low", "high", "embedding"])

        return run

    kind = dict(indexed.dtypes)["embedding"]
    schema = f"tile int, query boolean, vec_id long, low int, high int, embedding {kind}"
    points = indexed.mapInArrow(placed(False), schema).unionByName(queries.mapInArrow(placed(True), schema))
    points = points.repartitionById(used * segments * blocks, "tile").sortWithinPartitions("tile", F.desc("query"))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, best = None, [], None
        for batch in batches:
            tile, query, ids, low, high = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            vectors = matrix(batch.column(5))
            cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True]) if len(tile) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if tile[lo] != at:
                    if best is not None:
                        yield pa.record_batch([pa.array(x) for x in best.found()], schema=out)
                    at, held, best = tile[lo], [], None
                q = lo + int(query[lo:hi].astype(bool).sum())
                if q > lo:
                    held.append((ids[lo:q], vectors[lo:q], low[lo:q], high[lo:q]))
                if q < hi and held:
                    if best is None:
                        best = Best(*(np.concatenate(x) for x in zip(*held)), neighbours, norm_most)
                    for k in range(q, hi, 2048):
                        e = min(k + 2048, hi)
                        best.meet(ids[k:e], vectors[k:e], low[k:e], high[k:e])
        if best is not None:
            yield pa.record_batch([pa.array(x) for x in best.found()], schema=out)

    pairs = points.mapInArrow(answer, pair).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= neighbours).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").coalesce(max(SEGMENTS, n_queries * neighbours // OUT_ROWS))
