"""Candidate pairs of similar token sets, with little more on disk than the sets themselves.

By prefix filtering: in any common order of tokens, two similar sets share one of
their first; rare tokens come first. All tests are exact bounds, and pairs are
tested where they meet: what fails is never written. The sets' first tokens are
dealt over tasks in packets, in which a set's size and sketch stand once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of the token order (log2); tokens of the sets for each task; tokens prepared, pairs met and words compared at once.
BITS, TASK, SLICE, CHUNK, WORDS = 22, 1_200_000, 500_000, 1_000_000, 4_000_000


def token_order(sets: DataFrame) -> np.ndarray:
    """A byte for each slot of token hashes: 0 where at most one set has a token of it, else greater the more do.

    Tokens that share a slot stand later than they might, which costs time only.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            at = batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
            slots, n = np.unique(at.astype(np.int64), return_counts=True)
            total[slots] += n
        slots = np.flatnonzero(total)
        for at in range(0, len(slots), 100_000):
            some = slots[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "n"])

    every = sets.select("tokens").mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1")
    found = every.select("slot", F.least(F.lit(255), F.round(10 * F.log2("n"))).cast("short").alias("r")).toArrow()
    out = np.zeros(1 << BITS, np.uint8)
    out[found["slot"].to_numpy()] = found["r"].to_numpy()
    return out


def _widths(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of a sketch: a power of 2, about a bit a token."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(sizes / 100, 1))).astype(np.int64), 4, 128)


def _sketches(doc: np.ndarray, tokens: np.ndarray, docs: int, words: int) -> np.ndarray:
    """For each set, whether an odd number of its tokens falls on each bit: sketches differ in no more bits than sets in tokens."""
    bits = np.bincount(doc * (64 * words) + (tokens.view(np.uint64) % np.uint64(64 * words)).astype(np.int64), minlength=docs * 64 * words) & 1
    return np.packbits(bits.astype(np.uint8).reshape(docs, -1), axis=1)


def _packets(ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, order: np.ndarray, percent: int, parts: int) -> Iterator[tuple[int, bytes]]:
    """A part's number and its packet: sets, rows; the sets' id, size and sketch; the rows' token, set and place."""
    doc = np.repeat(np.arange(len(ids)), sizes)
    rank = order[(tokens.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.int64)
    at = np.argsort(doc << 8 | rank, kind="stable")  # equal ranks stay in the order of the hashes
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = at[(place < (sizes - -(-sizes * percent // 100) + 1)[doc]) & (rank[at] > 0)]
    seat = np.empty(len(doc), np.int64)
    seat[at] = place
    width = _widths(sizes)
    sketches = {}
    for w in np.unique(width).tolist():
        inside = (width == w)[doc]
        sketches[w] = _sketches((np.cumsum(width == w) - 1)[doc[inside]], tokens[inside], int((width == w).sum()), w)
    seats = np.zeros(len(ids), np.int64)  # of a set among those of its width
    for w in sketches:
        seats[width == w] = np.arange(len(sketches[w]))
    part = ((tokens[first].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
    first = first[by := np.argsort(part, kind="stable")]
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        rows = first[cuts[p] : cuts[p + 1]]
        mine, local = np.unique(doc[rows], return_inverse=True)
        head = np.array([len(mine), len(rows)], np.int64)
        drawn = [sketches[w][seats[mine[width[mine] == w]]] for w in sketches]
        yield p, b"".join(x.tobytes() for x in (head, ids[mine], sizes[mine], tokens[rows], local.astype(np.int32), seat[rows].astype(np.int32), *drawn))


def _opened(packets: list[bytes]) -> tuple:
    """ids and sizes of all sets; token, set and place of all rows; of each set its place in the sketches; sketches by words, wide ones folded in with the narrower."""
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]
    drawn: dict[int, list[np.ndarray]] = {}
    owner: dict[int, list[np.ndarray]] = {}
    base = 0
    for packet in packets:
        docs, rows = np.frombuffer(packet, np.int64, 2).tolist()
        at = 16
        for k, (kind, n) in enumerate(((np.int64, docs), (np.int64, docs), (np.int64, rows), (np.int32, rows), (np.int32, rows))):
            x = np.frombuffer(packet, kind, n, at)
            at += x.nbytes
            columns[k].append(x.astype(np.int64) + base if k == 3 else x)
        width = _widths(columns[1][-1])
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            drawn.setdefault(w, []).append(np.frombuffer(packet, np.uint64, len(mine) * w, at).reshape(-1, w))
            owner.setdefault(w, []).append(mine + base)
            at += len(mine) * w * 8
        base += docs
    ids, sizes, token, doc, place = (np.concatenate(c) for c in columns)
    seat, sketch, seen, w = np.zeros(base, np.int64), {}, 0, max(drawn)
    while w >= min(drawn):
        wide = sketch.get(2 * w)
        parts = [wide[:, :w] ^ wide[:, w:]] if wide is not None else []
        if w in drawn:
            who = np.concatenate(owner[w])
            seat[who] = seen + np.arange(len(who))
            seen += len(who)
            parts += drawn[w]
        sketch[w] = np.concatenate(parts)
        w //= 2
    return ids, sizes, token, doc, place.astype(np.int64), seat, sketch


def _close(a: np.ndarray, b: np.ndarray, most: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Where sketches a and b differ in no more bits than most."""
    out = np.zeros(len(a), bool)
    step, half = max(1, WORDS // sketch.shape[1]), sketch.shape[1] // 2
    for lo in range(0, len(a), step):
        at = np.arange(lo, min(lo + step, len(a)))
        apart = np.zeros(len(at), np.int64)
        for words in (slice(0, half), slice(half, None)):
            apart += np.bitwise_count(sketch[a[at], words] ^ sketch[b[at], words]).sum(1, dtype=np.int64)
            near = apart <= most[at]
            at, apart = at[near], apart[near]
        out[at] = True
    return out


def _met(packets: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (smaller id, larger id) that pass the bounds at one of their common tokens; a pair may come for each of them."""
    ids, sizes, token, doc, place, seat, sketch = _opened(packets)
    width = _widths(sizes)
    at = np.lexsort((sizes[doc], token))
    token, doc, place = token[at], doc[at], place[at]
    n = sizes[doc]
    group = np.cumsum(np.r_[False, token[1:] != token[:-1]])
    wide = int(n.max()) + 1
    # Of two sets with a common token the smaller meets those that are not too large for it.
    end = np.searchsorted(group * wide + n, group * wide + np.minimum(n * 100 // percent, wide - 1), "right")
    partners = np.where(place <= n - -(-n * 2 * percent // (100 + percent)), end - np.arange(len(n)) - 1, 0)
    sums = np.cumsum(partners)
    lo = 0
    while lo < len(n):
        done = sums[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sums, done + CHUNK, "right")))
        count = partners[lo:hi]
        x = np.repeat(np.arange(lo, hi), count)
        y = x + 1 + np.arange(len(x)) - np.repeat(sums[lo:hi] - count - done, count)
        lo = hi
        if not len(x):
            continue
        # The first token that both share: from there on, the smaller rest is all that they can share.
        fits = np.minimum(n[x] - place[x], n[y] - place[y]) * (100 + percent) >= (n[x] + n[y]) * percent
        x, y = x[fits], y[fits]
        a, b = doc[x], doc[y]
        most = (n[x] + n[y]) * (100 - percent) // (100 + percent)  # tokens that only one of them may have
        near = np.zeros(len(a), bool)
        for w in np.unique(width[a]).tolist():  # a is the smaller set
            mine = np.flatnonzero(width[a] == w)
            near[mine] = _close(seat[a[mine]], seat[b[mine]], most[mine], sketch[w])
        a, b = a[near], b[near]
        if len(a):
            pairs = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]), axis=1)
            yield pairs[0], pairs[1]


def candidates(sets: DataFrame, key: str, percent: int) -> DataFrame:
    """a, b (a < b, long): all pairs of different keys whose sets reach the similarity, and few others; sets has key (long) and tokens, sorted hashes."""
    spark = sets.sparkSession
    sets = sets.filter("tokens IS NOT NULL").select(F.col(key).cast("long").alias("id"), "tokens")
    total = sets.agg(F.sum(F.size("tokens")).alias("n")).first()["n"] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, total // TASK + 1)
    order = spark.sparkContext.broadcast(token_order(sets))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            tokens = lists.values.to_numpy()
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE, "right")) - 1)
                found = list(_packets(ids[lo:hi], np.diff(ends[lo : hi + 1]), tokens[ends[lo] : ends[hi]], order.value, percent, parts))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["part", "packet"])
                lo = hi

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _met([x for batch in batches for x in batch.column("packet").to_pylist()], percent):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return sets.mapInArrow(dealt, "part int, packet binary").groupBy("part").applyInArrow(met, "a long, b long").distinct()
