"""Quartile bucket digests of whole texts and their bounded difference score.

A digest counts hashed byte triplets of the UTF-8 text in 128 buckets and keeps
two bits for each bucket, its place among the quartiles of the counts, with a
logarithmic length and the ratios of the quartiles. The difference of two
digests is a bounded sum over buckets, length and ratios; likeness is one minus
its share of the greatest possible difference.

``neighbours`` pairs every document with the next one in falling doc_id order
without a global window: rows are dealt to key ranges, and the first row of each
range also goes to the range above it. Ranges hold about equal counts: an id of
very many rows, or the null one, spans several, parted by text hash.

Defined results: null text counts as empty; all empty texts share one digest;
equal ids are ordered by text hash, null ids come last; the last document's next
is the first, so a single document is its own next; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 128
_LENGTH_MOST, _RATIO_MOST = 64, 15
#: The greatest difference: six for each bucket, the length's cap, both ratios.
DIFFERENCE_MOST = 6 * BUCKETS + _LENGTH_MOST + 2 * _RATIO_MOST
_PARTS = ((0, 1, 2, 0x9E3779B1), (0, 1, 3, 0x85EBCA77), (0, 2, 3, 0xC2B2AE3D))


def triplet_counts(data: bytes) -> np.ndarray:
    """How often each bucket gets a triplet of the bytes; three triplets start at each byte."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), 1 << 20):  # blocks overlap by a triplet's reach
        b = np.frombuffer(data, np.uint8, count=min((1 << 20) + 3, len(data) - at), offset=at).astype(np.uint32)
        for i, j, k, salt in _PARTS:
            n = min(len(b) - k, 1 << 20)
            if n > 0:
                v = (b[i : i + n] << 16 | b[j : j + n] << 8 | b[k : k + n]) * np.uint32(salt)
                v ^= v >> 15
                v *= np.uint32(0x2C1B3C6D)
                total += np.bincount(v >> 25, minlength=BUCKETS)
    return total


def digest(text: str) -> str:
    """72 hexadecimal digits: length, two quartile ratios, two bits for each bucket."""
    data = text.encode("utf-8", "surrogatepass")
    counts = triplet_counts(data)
    q1, q2, q3 = np.partition(counts, (31, 63, 95))[[31, 63, 95]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    length = min(255, round(8 * math.log2(1 + len(data))))
    ratios = (int(15 * q1 / q3), int(15 * q2 / q3)) if q3 else (0, 0)
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{packed.astype(np.uint8).tobytes().hex()}"


def _codes(value: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(value[4:]), np.uint8)
    return np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], 1).ravel().astype(np.int8)


def difference(a: str, b: str) -> int:
    """0 to DIFFERENCE_MOST; opposite quartiles weigh double."""
    if a == b:
        return 0
    apart = np.abs(_codes(a) - _codes(b))
    body = int(apart.sum()) + 3 * int((apart == 3).sum())
    length = min(_LENGTH_MOST, abs(int(a[:2], 16) - int(b[:2], 16)))
    return body + length + sum(abs(int(a[k], 16) - int(b[k], 16)) for k in (2, 3))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for the greatest difference."""
    return 1.0 - difference(a, b) / DIFFERENCE_MOST


def edited_text(text: str, following: str) -> str:
    """The last third of the code points makes way for as many of the next text's first."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _range_of(keys: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each key among those that it spans; smaller hashes come first, so in the upper ones."""
    low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
    return high - np.minimum((share * (high - low + 1)).astype(np.int64), high - low)


def neighbours(docs: DataFrame) -> DataFrame:
    """Digest rows of every document, its edited text and the next document."""
    n = max(2, 2 * docs.rdd.getNumPartitions())
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("h"))
    bounds = np.array(rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or [], np.int64)

    @F.pandas_udf("int")
    def range_of(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_range_of(k.to_numpy(), h.to_numpy(), bounds))

    # A row for each range: its first row's key and hash.
    firsts = rows.groupBy(range_of("k", "h").alias("r")).agg(F.max(F.struct("k", F.bitwise_not("h").alias("h"))).alias("first")).collect()
    first = {r["r"]: (r["first"]["k"], ~r["first"]["h"]) for r in firsts}
    used = sorted(first)
    above = {r: used[(i + 1) % len(used)] for i, r in enumerate(used)}

    @F.pandas_udf("array<int>")
    def places(k: pd.Series, h: pd.Series) -> pd.Series:
        """Twice the row's own range; for a range's first row also twice the range above, and one."""
        k, h = k.to_numpy(), h.to_numpy()
        own = _range_of(k, h, bounds)
        return pd.Series([[2 * r, 2 * above[r] + 1] if first[r] == key else [2 * r] for r, key in zip(own.tolist(), zip(k.tolist(), h.tolist()))])

    rows = rows.withColumn("p", F.explode(places("k", "h"))).select("doc_id", "text", "k", "h", F.shiftright("p", 1).alias("r"), (F.col("p") % 2 == 1).alias("tail"))
    rows = rows.repartitionById(n, "r").sortWithinPartitions("r", "tail", F.desc("k"), "h")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, at = None, None  # the row that waits for its next; the range

        def emit(row: tuple, following: str, following_digest: str) -> None:
            doc_id, text, own_digest = row
            edited = edited_text(text, following)
            e = digest(edited)
            out.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_digest, e, likeness(own_digest, e), likeness(own_digest, following_digest)))

        for batch in batches:
            ids, ranges, tails = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                if tails[i] and (held is None or at != ranges[i]):
                    continue  # a further row of the same greatest key
                text = batch.column(1)[i].as_py()
                d = digest(text)
                if held is not None:
                    emit(held, text, d)
                held, at = (None if tails[i] else (ids[i], text, d)), ranges[i]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, schema.types)], schema=schema)
            out.clear()

    return rows.select("doc_id", "text", "r", "tail").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
