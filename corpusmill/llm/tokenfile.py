"""Token-id files coded by adaptive context mixing and a range coder.

Format: a segment holds whole documents, in ascending doc_id order: a header,
the order-0 frequencies of its ids, document ids and lengths, then blocks of
BLOCK ids. Each block starts from an empty adaptive model, has its own checksum,
and can be decoded alone. For each id, the order-2 context (hashed), else the
order-1 context names a candidate. How likely it is, is mixed from three
predictions in the logistic domain: how often candidates of the order-2 entry's
confidence were right, the same for the order-1 entry's confidence and whether it
agrees, and the candidate's order-0 frequency; the weights adapt after each id.
An id that is not the candidate is coded by the order-0 frequencies. All drive one
carry-propagating range coder a block. The model is in whole numbers, so that it
is the same on every machine.

Blocks are independent, so numpy runs them in step, one lane a block.

Segments are rows of Parquet files in the shared folder: Spark's writer commits
them, on any store, and a task that runs again leaves no half file.

Defined results: null text counts as empty, which is the end id alone; documents
with equal ids stay apart, ordered by text hash; null ids come first; an id over
65,535 is refused with ValueError; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import shared_dir
from corpusmill.llm.tokens import END_ID, VOCABULARY, word_cache

BLOCK = 2048
#: Ids after which a segment ends, at a document's end.
SEGMENT = 12_000_000
#: Bytes of text that are tokenized together, words that a worker holds.
TOKENIZED, WORDS = 12 << 20, 1_000_000
MAGIC = b"CMX2"
_HEAD = "<IQIII"
_HASH = 10  # bits of a context table's address
_SCALE = 16  # bits of the order-0 frequencies' sum
_RANGE = 48  # bits of the coder's interval; words of 16 bits leave it
_ONE = 1 << 12  # probabilities of the mixer
#: ln(p / (1 - p)) in steps of 1 / 256, and back; a hit is never held for impossible or certain.
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((2 * i + 1) / (2 * _ONE - 2 * i - 1))))) for i in range(_ONE)], np.int32)
_SQUASH = np.array([min(_ONE - 16, max(16, round(_ONE / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)], np.int32)
_MOST_WEIGHT = 1 << 18


class Prior:
    """Order-0 frequencies of a segment's ids; they sum to 65,536 and each id has one at least."""

    def __init__(self, symbols: np.ndarray, widths: np.ndarray):
        self.symbols, self.widths = symbols, widths
        ends = np.cumsum(widths)
        self.place = np.zeros(1 << 16, np.int64)  # where the id's interval starts, then 17 bits of its width
        self.place[symbols] = (ends - widths) << 17 | widths
        self.slot = np.repeat(symbols, widths).astype(np.int32)
        self.stretch = _STRETCH[np.minimum((self.place & 0x1FFFF) >> 4, _ONE - 1)]

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        counts = np.bincount(ids, minlength=1)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        widths = 1 + counts * ((1 << _SCALE) - len(symbols)) // max(1, int(counts.sum()))
        if len(widths):
            widths[np.argmax(widths)] += (1 << _SCALE) - int(widths.sum())
        return cls(symbols, widths)


class _Writer:
    """Range coders, one a lane: ``low`` and its carry into words that are out."""

    def __init__(self, lanes: int, steps: int):
        self.room = 2 * steps + 8  # two words a step at most, three at the end
        self.out = np.zeros(lanes * self.room, np.uint16)
        self.low = np.zeros(lanes, np.int64)
        self.n = np.arange(lanes, dtype=np.int64) * self.room

    def add(self, active: int, more: np.ndarray) -> None:
        low = self.low[:active]
        low += more
        over = np.flatnonzero(low >> _RANGE)
        if over.size:
            low[over] &= (1 << _RANGE) - 1
            at = self.n[over] - 1
            while at.size:
                word = self.out[at] + np.uint16(1)
                self.out[at] = word
                at = at[word == 0] - 1

    def shift(self, lanes: np.ndarray) -> None:
        at, low = self.n[lanes], self.low[lanes]
        self.out[at] = low >> 32
        self.low[lanes] = (low & 0xFFFFFFFF) << 16
        self.n[lanes] = at + 1

    def close(self) -> list[np.ndarray]:
        every = np.arange(len(self.low))
        for _ in range(3):
            self.shift(every)
        return [self.out[k * self.room : end] for k, end in enumerate(self.n.tolist())]


class _Reader:
    """Range decoders, one a lane: ``code`` is the offset within the interval."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.at = words.astype(np.int64), starts.copy()
        self.code = np.zeros(len(starts), np.int64)
        for _ in range(3):
            self.shift(np.arange(len(starts)))

    def shift(self, lanes: np.ndarray) -> None:
        at = self.at[lanes]
        self.code[lanes] = self.code[lanes] << 16 | self.words[np.minimum(at, len(self.words) - 1)]  # damaged words may lead beyond the end
        self.at[lanes] = at + 1


def _run(lengths: np.ndarray, prior: Prior, coder: _Writer | _Reader, ids: np.ndarray | None = None) -> np.ndarray:
    """Code blocks in step; lengths fall; ids is (step x lane), or None to decode it."""
    lanes, steps, take = len(lengths), int(lengths[0]), np.take
    reading = ids is None
    if reading:
        ids = np.zeros((steps, lanes), np.uint16)
    width = np.full(lanes, 1 << _RANGE, np.int64)
    one, two = np.zeros(lanes << _HASH, np.int32), np.zeros(lanes << _HASH, np.int32)  # id, then confidence: 0 is none yet
    right2, right1 = np.full(lanes * 4, 1 << 13, np.int32), np.full(lanes * 8, 1 << 13, np.int32)  # of 65,536
    weights = np.full((3, lanes), 1 << 14, np.int32)
    lane = np.arange(lanes, dtype=np.int64)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    active = lanes
    for t in range(steps):
        while lengths[active - 1] <= t:
            active -= 1
        if active < len(last):
            lane, last, before, width, weights = lane[:active], last[:active], before[:active], width[:active], weights[:, :active]
        h1 = (last * 0x9E3779B1 >> 8 & (1 << _HASH) - 1) + (lane << _HASH)
        h2 = (last * 0x9E3779B1 + before * 0x85EBCA77 >> 10 & (1 << _HASH) - 1) + (lane << _HASH)
        e1, e2 = take(one, h1, mode="clip"), take(two, h2, mode="clip")
        id1, id2, c1, c2 = e1 & 0xFFFF, e2 & 0xFFFF, e1 >> 16, e2 >> 16
        guess = np.where(c2 > 0, id2, id1)
        k2, k1 = (lane << 2) + c2, (lane << 3) + c1 + ((id1 == guess) << 2)
        p2, p1 = take(right2, k2, mode="clip"), take(right1, k1, mode="clip")
        s2, s1, s0 = take(_STRETCH, p2 >> 4, mode="clip"), take(_STRETCH, p1 >> 4, mode="clip"), take(prior.stretch, guess, mode="clip")
        mixed = weights[2] * s2 + weights[1] * s1 + weights[0] * s0 >> 16
        p = take(_SQUASH, mixed + 2048, mode="clip")

        bound = (width >> 12) * p  # the candidate's part of the interval; order-0 intervals lie beyond
        if reading:
            hit = coder.code[:active] < bound
        else:
            now = ids[t, :active].astype(np.int32)
            hit = now == guess
        miss = ~hit
        part = np.where(hit, bound, width - bound)
        step = part >> _SCALE
        start = bound * miss
        if reading:
            code = coder.code[:active]
            code -= start
            slot = (code / step).astype(np.int64)  # exact: both are under 2 ** 53
            found = take(prior.slot, slot, mode="clip")
            now = np.where(hit, guess, found)
            place = take(prior.place, found, mode="clip")
            code -= step * (place >> 17) * miss
        else:
            place = take(prior.place, now, mode="clip")
            coder.add(active, start + step * (place >> 17) * miss)
        width = np.where(hit, part, step * (place & 0x1FFFF))
        while (small := np.flatnonzero(width < 1 << 32)).size:
            width[small] <<= 16
            coder.shift(small)
        if reading:
            ids[t, :active] = now

        y = hit.astype(np.int32)
        error = ((y << 12) - p) * 6
        for k, s in enumerate((s0, s1, s2)):
            weights[k] += s * error + 0x8000 >> 16
        if not t & 15:  # a step moves a weight by under 800, so that products stay within 32 bits
            np.clip(weights, -_MOST_WEIGHT, _MOST_WEIGHT, out=weights)
        y <<= 16
        right2[k2], right1[k1] = p2 + (y - p2 >> 5), p1 + (y - p1 >> 5)
        one[h1] = np.where(id1 == now, e1 + ((c1 < 3) << 16), now | 1 << 16)
        two[h2] = np.where(id2 == now, e2 + ((c2 < 3) << 16), now | 1 << 16)
        before, last = last, now.astype(np.int64)
    return ids


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """doc_ids and lengths of documents, and their ids, one document after the other; an id over 65,535 raises ValueError."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError(f"id {int(ids.max())} is over 65,535")
    ids = np.ascontiguousarray(ids, "<u4")
    sizes = np.array([min(block, len(ids) - k) for k in range(0, len(ids), block)], np.int64)
    coded: list[np.ndarray] = []
    prior = Prior.of(ids)
    if len(sizes):
        padded = np.zeros(len(sizes) * block, np.uint16)
        padded[: len(ids)] = ids
        coder = _Writer(len(sizes), int(sizes[0]))
        _run(sizes, prior, coder, np.ascontiguousarray(padded.reshape(len(sizes), block).T))  # only the last may be shorter
        coded = coder.close()
    checks = [zlib.crc32(ids[k : k + block]) for k in range(0, len(ids), block)]
    head = MAGIC + struct.pack(_HEAD, len(doc_ids), len(ids), block, len(sizes), len(prior.symbols))
    present = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [prior.symbols.astype("<u2"), (prior.widths - 1).astype("<u2"), present, names, np.asarray(lengths, "<u4"), np.array([len(w) for w in coded], "<u4"), np.array(checks, "<u4"), *(w.astype("<u2") for w in coded)]
    return b"".join([head, *(p.tobytes() for p in parts)])


class Segment:
    """A segment's header and its blocks, any of which can be decoded alone."""

    def __init__(self, data: bytes | pa.Buffer):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a token-id segment")
        n_docs, self.n_ids, self.block, self.n_blocks, n_symbols = struct.unpack_from(_HEAD, data, 4)
        at = 4 + struct.calcsize(_HEAD)

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.prior = Prior(part("<u2", n_symbols).astype(np.int64), part("<u2", n_symbols).astype(np.int64) + 1)
        present, names, self.lengths = part("u1", n_docs), part("<i8", n_docs), part("<u4", n_docs).astype(np.int64)
        self.doc_ids = [int(n) if p else None for n, p in zip(names, present)]
        n_words, self.checks = part("<u4", self.n_blocks).astype(np.int64), part("<u4", self.n_blocks)
        self.words = part("<u2", int(n_words.sum()))
        self.starts = np.cumsum(n_words) - n_words

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The ids of blocks first to end; a block that fails its checksum raises ValueError."""
        end = self.n_blocks if end is None else end
        if first >= end:
            return np.zeros(0, "<u4")
        sizes = np.full(end - first, self.block, np.int64)
        if end == self.n_blocks:
            sizes[-1] = self.n_ids - self.block * (self.n_blocks - 1)
        out = _run(sizes, self.prior, _Reader(self.words, self.starts[first:end])).T.ravel()[: int(sizes.sum())].astype("<u4")
        for k, check in enumerate(self.checks[first:end].tolist()):
            if zlib.crc32(out[self.block * k : self.block * (k + 1)]) != check:
                raise ValueError(f"block {first + k} fails its checksum")
        return out


def write_ids(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, segment: int = SEGMENT) -> None:
    """Tokenize whole documents and write their ids, an end id after each, in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shard, k = word_cache(vocabulary, WORDS), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            data = encode_segment(names, np.concatenate(lengths), np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["shard", "segment", "n_ids", "payload"])

        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for ids, cuts in cache.encode_all(batch.column(1), END_ID, TOKENIZED):
                names += doc_ids[at : at + len(cuts) - 1]
                at += len(cuts) - 1
                lengths.append(np.diff(cuts))
                held.append(ids.astype(np.uint16) if not len(ids) or ids.max() <= 0xFFFF else ids)
                n += len(ids)
                if n >= segment:
                    yield flush()
                    names, lengths, held, n, k = [], [], [], 0, k + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(1, rows.rdd.getNumPartitions())
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(run, "shard int, segment int, n_ids long, payload binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    segments = spark.read.parquet(path)
    # A row for each segment of millions of ids, summed in its shard; one row a shard is summed over all.
    order = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.select("shard", "segment", "n_ids")
    within = sizes.withColumn("within", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = shards.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = within.join(ahead, "shard").select("shard", "segment", (F.col("ahead") + F.col("within")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, k, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                segment = Segment(payload.as_buffer())
                ids = segment.ids()
                ends = np.cumsum(segment.lengths)
                starts = ends - segment.lengths
                checks = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                same = [pa.array(np.full(len(ends), v, np.int32)) for v in (shard, k)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(segment.doc_ids, pa.int64()), pa.array(starts), pa.array(segment.lengths), pa.array(checks, pa.int64())], names=["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = segments.select("shard", "segment", "payload").mapInArrow(run, "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["shard", "segment"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write docs' ids to the shared folder and read them back."""
    path = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, vocabulary)
    return read_ids(docs.sparkSession, path)
