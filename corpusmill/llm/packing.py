"""Best-two-fit packing of tokenized documents into fixed-length sequences.

Tokenizing is a map over the scan. Only (doc_id, piece, start, length, checksum)
rows are shuffled, by a hash of the row, so no key can be hot; each task then
packs its own pieces in chunks of bounded size. Sequence ids carry the task's
partition number and need no coordination.

Defined results: a null or empty text is the single end id; a longer document
is cut into full pieces and a rest; equal rows are packed as often as they
occur; a null doc_id is carried; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokens import END_ID, VOCABULARY, word_cache

CAPACITY = 4096
#: Pieces that one packing run holds in memory; packing tasks for each core of the cluster at most.
CHUNK = 200_000
TASKS_PER_CORE = 4
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([*PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes into lengths (each 1 to capacity).

    A bin takes the longest unpacked document that fits until none does. Then,
    as long as that fills it better, its smallest document makes way for the two
    unpacked ones that best fill the gap it leaves.
    """
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    mask = 0  # bit n: an unpacked document of length n
    for n in stacks:
        mask |= 1 << n

    def take(n: int) -> int:
        nonlocal mask
        i = stacks[n].pop()
        if not stacks[n]:
            mask &= ~(1 << n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal mask
        stacks[n].append(i)
        mask |= 1 << n

    def longest(most: int) -> int:
        return (mask & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def best_pair(room: int, above: int) -> tuple[int, int] | None:
        best, found, a = above, None, longest(room - 1)
        while a > 0 and 2 * a > best:
            b = longest(min(a, room - a))
            if b == a and len(stacks[a]) < 2:
                b = longest(min(a - 1, room - a))
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    break
            a = longest(a - 1)
        return found

    bins = []
    while mask:
        held: list[tuple[int, int]] = []
        gap = capacity
        while (n := longest(gap)) > 0:
            held.append((n, take(n)))
            gap -= n
        while gap and mask and len(held) > 1:
            n, i = held[-1]  # taken in falling order, so the last is the smallest
            if not (pair := best_pair(gap + n, n)):
                break
            held.pop()
            held += [(m, take(m)) for m in pair]
            held.sort(reverse=True)
            give(n, i)
            gap += n - sum(pair)
        bins.append([i for _, i in held])
    return bins


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document's ids, the end id included."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(vocabulary)
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for ids, cuts in cache.encode_all(batch.column(1), END_ID):
                whole = np.diff(cuts)
                n = -(-whole // capacity)
                owner = np.repeat(np.arange(len(whole)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, whole[owner] - start)
                first = cuts[owner] + start
                ids = np.ascontiguousarray(ids, "<u4")
                checks = [zlib.crc32(ids[i : i + k]) for i, k in zip(first.tolist(), length.tolist())]
                columns = [doc_ids.take(pa.array(at + owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(checks, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=PIECE)
                at += len(whole)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """Place pieces (columns of ``pieces``) in sequences of at most capacity ids."""

    def placed(held: list[pa.RecordBatch], base: int) -> tuple[pa.RecordBatch, int]:
        table = pa.Table.from_batches(held).combine_chunks()
        lengths = table["length"].to_numpy()
        sequence, offset, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), base
        for bin_ in best_two_fit(lengths, capacity):
            sequence[bin_] = at
            offset[bin_] = np.cumsum([0, *lengths[bin_][:-1]])
            at += 1
        return pa.record_batch([*(table[n].combine_chunks() for n in PIECE.names), pa.array(sequence), pa.array(offset)], schema=PLACED), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            held.append(batch.cast(PIECE) if batch.schema != PIECE else batch)
            n += batch.num_rows
            if n >= chunk:
                out, at = placed(held, at)
                held, n = [], 0
                yield out
        if n:
            yield placed(held, at)[0]

    key = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    dealt = parts.repartition(key).sortWithinPartitions("doc_id", "piece", "ids_crc32")  # sorted: a task that runs again gives the same places
    dealt = dealt.coalesce(TASKS_PER_CORE * parts.sparkSession.sparkContext.defaultParallelism)  # large pools leave few sequences half full
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize whole documents and pack them; see the module for defined results."""
    return pack(pieces(docs, vocabulary, capacity), capacity)
