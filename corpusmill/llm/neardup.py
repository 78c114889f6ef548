"""MinHash near-duplicates with odd sketches, confirmed on full shingle sets.

1. Every text's distinct word shingles give MinHash bands and an odd sketch: the
   MinHash samples folded into a parity bitmap. Equal sets form a class; one of
   each goes on.
2. Band keys alone travel first; sketches join those of buckets with several
   members. Members are compared by the population count of the XOR of their
   sketches, which estimates the similarity; a bucket gives a spanning forest of
   the pairs that may reach the threshold. Buckets stream; only members that no
   leader covers are held. A bucket of over PART members is met in parts, then
   the parts' leaders meet.
3. Connected components of these links are families, a superset of the true
   components. Within a family the texts' full sets confirm links; pairs already
   joined are skipped, so copies cost one comparison each. A family over BLOCK
   members or SHINGLES shingles is cut in blocks; what its blocks leave apart is
   met in block pairs. Families whose every pair is near but not near enough
   need all of their pairs.

Missing a link at similarity 0.8 needs all BANDS bands to differ (about 5e-8 for
32 bands of 4) or a sketch estimate under LEAST, far from 0.8.

Defined results: null or wordless text has an empty set and is linked with
nothing; with fewer words than a shingle, the whole sequence is the one shingle;
equal rows form one class; rows with a null doc_id take part, and their
component_id is null where no row with an id is in reach (the rows of one of its
texts are then kept); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, materialise
from corpusmill.operators.graph import components

BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: Estimates from which pairs may be near, members are covered by a leader, leaders of a bucket's parts by another.
LEAST, COVER, COVER_LEADER = 0.6, 0.95, 0.99
#: Members of a band bucket that are met in one task.
PART = 1024
#: Members of a block, and shingles of its members together, at most about.
BLOCK, SHINGLES = 2048, 8_000_000
#: Stand-ins for null ids are above this, so that any usual id comes before them.
NULLS = 1 << 62
_CACHE = 200_000
_rng = np.random.default_rng(41)
_MULT = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ v >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ v >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return v ^ v >> np.uint64(31)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z lower-cased, words parted by space and U+0009 to U+000D."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, as asked
    if not words:
        return np.zeros(0, np.uint64)
    try:
        h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_words) > _CACHE:
            _words.clear()
        for w in set(words).difference(_words):
            _words[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    v = np.full(n, k, np.uint64)
    for i in range(k):
        v = _mix(v * _MIX + h[i : i + n])
    return np.unique(v)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_MULT), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        v = x[at : at + 1024, None] * _MULT
        v += _ADD
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(low, v.min(0), out=low)
    return low


def odd_sketch(sig: np.ndarray) -> bytes:
    """Parity bitmap: each sample, with its position, flips one bit."""
    at = _mix(sig.astype(np.uint64) << np.uint64(8) | np.arange(len(sig), dtype=np.uint64)) >> np.uint64(64 - (SKETCH_BITS - 1).bit_length())
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def estimate(flipped: np.ndarray) -> np.ndarray:
    """Similarity from XOR population counts: 2k(1 - J) samples differ, each flipping one of the bits."""
    share = np.minimum(2 * flipped / SKETCH_BITS, 0.999)
    return 1 + np.log(1 - share) * SKETCH_BITS / (4 * len(_MULT))


def band_keys(sig: np.ndarray) -> np.ndarray:
    v = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        v = _mix(v * _MIX + sig[i::ROWS].astype(np.uint64))
    return v.view(np.int64)


class Forest:
    """Union-find; roots are the least members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        up = np.array(self.up)
        while (up[up] != up).any():
            up = up[up]
        return up


class Leaders:
    """The members of a bucket that later ones must meet.

    A member that a leader covers (estimate of at least COVER) is linked and goes:
    whatever is similar to it is, by the triangle inequality of the Jaccard
    distance, similar enough to its leader (0.95 + 0.8 - 1 is over LEAST). So a
    bucket of copies holds a few rows however many pass. Links only join what is
    still apart, so they are at most the members and leaders.
    """

    def __init__(self, cover: float = COVER) -> None:
        self.cover = cover
        self.ids: list[int] = []
        self.sketches = np.zeros((16, SKETCH_BITS // 64), np.uint64)
        self.forest = Forest(0)

    def add(self, ids: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
        return [x for at in range(0, len(ids), 128) for x in self._add(ids[at : at + 128].tolist(), sketches[at : at + 128])]

    def _add(self, ids: list[int], sketches: np.ndarray) -> list[tuple[int, int]]:
        links, covered = [], np.zeros(len(ids), bool)
        near: list[list[int]] = [[] for _ in ids]  # leaders that each member may be similar to
        for at in range(0, len(self.ids), 1024):
            likely = estimate(np.bitwise_count(sketches[:, None] ^ self.sketches[None, at : min(at + 1024, len(self.ids))]).sum(2))
            for i, k in zip(*(x.tolist() for x in np.nonzero(likely >= LEAST))):
                near[i].append(at + k)
            covered |= (likely >= self.cover).any(1)
        for i, name in enumerate(ids):
            if near[i]:
                links.append((self.ids[near[i][0]], name))
                links += [(self.ids[k], name) for k in near[i][1:] if self.forest.join(near[i][0], k)]
            if covered[i]:
                continue
            k = len(self.ids)
            self.ids.append(name)
            self.forest.up.append(k)
            if near[i]:
                self.forest.join(near[i][0], k)
            if k == len(self.sketches):
                self.sketches = np.concatenate([self.sketches, np.zeros_like(self.sketches)])
            self.sketches[k] = sketches[i]
            rest = i + 1 + np.flatnonzero(~covered[i + 1 :])
            if len(rest):
                likely = estimate(np.bitwise_count(sketches[rest] ^ sketches[i]).sum(1))
                for j in rest[likely >= LEAST].tolist():
                    near[j].append(k)
                covered[rest[likely >= self.cover]] = True
        return links


def _arrow_rows(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


def sign(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands, sketch; the last two null for empty sets."""
    names, types = ["doc_id", "n_shingles", "set_key", "bands", "sketch"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = shingles(text.as_py(), size)
                if len(h):
                    sig = signature(h)
                    rows.append((doc_id, len(h), xxhash.xxh3_128_digest(h.tobytes()), band_keys(sig).tolist(), odd_sketch(sig)))
                else:
                    rows.append((doc_id, 0, b"e%d" % doc_id, None, None))  # a key of its own, so that wordless rows do not meet in one task
            yield _arrow_rows(names, types, rows)
            pa.default_memory_pool().release_unused()  # the worker lives on beside those of other stages

    return docs.select(named(docs), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def named(docs: DataFrame) -> Column:
    """doc_id; for null ids a stand-in from the text's hash, alike for equal texts."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULLS) + F.xxhash64(F.lit(19), "text").bitwiseAND(F.lit(NULLS - 1))).alias("doc_id")


def shared_bands(banded: DataFrame) -> DataFrame:
    """band, id and part of the rows of buckets with more than one row, PART rows a part; most texts share none, so that few sketches travel on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, given, n = None, False, 0  # the row before this batch, whether it was given out, and its place in its bucket
        for batch in batches:
            band, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(band):
                continue
            as_before = np.r_[last is not None and band[0] == last[0], band[1:] == band[:-1]]
            keep = as_before.copy()
            keep[:-1] |= as_before[1:]
            late = [last] if as_before[0] and not given else []
            at = np.arange(len(band))
            begins = np.maximum.accumulate(np.where(as_before, -1, at))
            place = np.where(begins < 0, n + 1 + at, at - begins)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array([x[k] for x in late], np.int64), v[keep]])) for k, v in enumerate((band, ids, place // PART))], names=["band", "id", "part"])
            last, given, n = (band[-1], ids[-1], int(place[-1]) // PART), bool(keep[-1]), int(place[-1])

    return banded.repartition("band").sortWithinPartitions("band", "id").mapInArrow(run, "band long, id long, part long")


def bucket_links(banded: DataFrame) -> DataFrame:
    """a, b: sketch-level links within band buckets; banded has band, id, part, sketch."""
    names, types = ["a", "b", "band", "sketch"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def meet(cover: float, parts: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, leaders, n = None, Leaders(cover), 0

            def led() -> list[tuple]:
                """A row for each leader of a part that may not be all of its bucket."""
                if at is None or not parts or (at[1] == 0 and n < PART):
                    return []
                return [(i, i, at[0], s.tobytes()) for i, s in zip(leaders.ids, leaders.sketches)]

            for batch in batches:
                rows, band, ids, part = [], *(batch.column(k).to_numpy() for k in range(3))
                sketches = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                cuts = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (part[1:] != part[:-1]), True]) if len(band) else np.zeros(0, np.int64)
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if (band[lo], part[lo]) != at:
                        rows += led()
                        at, leaders, n = (band[lo], part[lo]), Leaders(cover), 0
                    rows += [(a, b, None, None) for a, b in leaders.add(ids[lo:hi], sketches[lo:hi])]
                    n += hi - lo
                yield _arrow_rows(names, types, rows)
            if rest := led():
                yield _arrow_rows(names, types, rest)

        return run

    schema = "a long, b long, band long, sketch binary"
    dealt = banded.select("band", "id", "part", "sketch").repartition("band", "part").sortWithinPartitions("band", "part", "id")
    first = materialise(dealt.mapInArrow(meet(COVER, True), schema), "dup-links")
    leaders = first.filter("band IS NOT NULL").select("band", F.col("a").alias("id"), F.lit(0).cast("long").alias("part"), "sketch")
    second = leaders.repartition("band").sortWithinPartitions("band", "id").mapInArrow(meet(COVER_LEADER, False), schema)
    return first.filter("band IS NULL").unionByName(second).select("a", "b").distinct()


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed_groups(sets: list[np.ndarray], percent: int, forest: Forest | None = None, cut: int = 0) -> Forest:
    """Join the members whose full sets reach the similarity; cut: only pairs of one member before and one from there on are met."""
    forest = forest or Forest(len(sets))
    sizes = np.array([len(s) for s in sets])
    order = range(len(sets))
    for i in order:
        for j in range(cut if cut and i < cut else i + 1, len(sets) if not cut or i < cut else i):
            if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]) and forest.root(i) != forest.root(j) and _similar(sets[i], sets[j], percent):
                forest.join(i, j)
    return forest


def _sets(rows: pa.Table, order: np.ndarray, size: int) -> list[np.ndarray]:
    return [shingles(rows["text"][int(i)].as_py(), size) for i in order]


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    signed = materialise(sign(docs, size), "dup-signed")
    live = signed.filter("n_shingles > 0")
    # Written, so that Spark can split the join back to a class of very many copies.
    classes = materialise(live.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n")), "dup-classes")
    # Equal sets have equal bands and sketches; of an id with several texts, the least sketch stands for it.
    members = live.groupBy("set_key")
    banded = members.agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")).select(F.explode("bands").alias("band"), "id")
    sketches = members.agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")).groupBy("id").agg(F.min("sketch").alias("sketch"))
    banded = shared_bands(banded).join(sketches, "id").select("band", "id", "part", "sketch")
    families = materialise(components(bucket_links(banded)), "dup-families")

    def confirm(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
        ids = rows["doc_id"].to_numpy()[order]
        roots = confirmed_groups(_sets(rows, order, size), percent).roots()
        return pa.table({"family": pa.array(np.full(len(ids), rows["family"][0].as_py())), "id": pa.array(ids), "root": pa.array(ids[roots])})

    member = families.withColumnRenamed("node", "id").withColumnRenamed("root", "family")
    texts = docs.select(named(docs), "text")
    # A doc_id that occurs twice with different texts is met with each of them.
    counted = member.join(classes.groupBy(F.col("first").alias("id")).agg(F.sum("n").alias("n")), "id").groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    blocks = materialise(counted, "dup-blocks")
    # Written, so that its size is known and texts are shuffled only where it is too large to broadcast.
    dealt = materialise(member.join(blocks, "family").select("id", "family", F.pmod(F.hash("id"), F.col("blocks")).alias("block")), "dup-dealt")
    own = texts.join(dealt, F.col("doc_id") == F.col("id")).select("family", "block", "doc_id", "text")
    local = materialise(own.groupBy("family", "block").applyInArrow(confirm, "family long, id long, root long"), "dup-local")
    links = local.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if large := bool(blocks.filter("blocks > 1").limit(1).collect()):
        links = links.unionByName(_across(texts, local, blocks, size, percent))
    joined = components(links.filter("a <> b").distinct()) if large else local.filter("id <> root").select(F.col("id").alias("node"), "root")
    keyed = signed.join(classes.select("set_key", "first"), "set_key", "left").withColumn("first", F.coalesce("first", "doc_id"))
    out = keyed.join(joined.filter("node <> root").groupBy("node").agg(F.min("root").alias("root")), F.col("first") == F.col("node"), "left").withColumn("component_id", F.coalesce("root", "first"))
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nulls = docs.filter(F.col("doc_id").isNull()).select(named(docs)).distinct()
    if nulls.isEmpty():
        return out
    for column in ("component_id", "doc_id"):  # the stand-ins are null again
        out = out.join(nulls.select(F.col("doc_id").alias(column), F.lit(True).alias(f"no_{column}")), column, "left")
    return out.select(*[F.when(F.col(f"no_{c}").isNull(), F.col(c)).alias(c) for c in ("doc_id",)], "n_shingles", F.when(F.col("no_component_id").isNull(), F.col("component_id")).alias("component_id"), "kept")


def _across(texts: DataFrame, local: DataFrame, blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the block groups of families of several blocks.

    The least members of a family's groups are met first, in blocks, which joins
    most that belongs together; only members of groups still apart from the
    family's largest group then meet all others, in pairs of blocks.
    """
    many = local.join(blocks.filter("blocks > 1"), "family")
    groups = many.groupBy("family", "root").agg(F.count("*").alias("n"))
    head_blocks = groups.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("head_blocks"))
    heads = groups.join(head_blocks, "family").withColumn("block", F.pmod(F.hash("root"), F.col("head_blocks")))

    def meet_heads(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["root"].to_numpy(), kind="stable")
        ids, n = rows["root"].to_numpy()[order], rows["n"].to_numpy()[order]
        roots = confirmed_groups(_sets(rows, order, size), percent).roots()
        return pa.table({"family": pa.array(np.full(len(ids), rows["family"][0].as_py())), "root": pa.array(ids), "head": pa.array(ids[roots]), "n": pa.array(n)})

    met = materialise(heads.join(texts, F.col("root") == F.col("doc_id")).select("family", "block", "root", "n", "text").groupBy("family", "block").applyInArrow(meet_heads, "family long, root long, head long, n long"), "dup-heads")
    found = met.select(F.col("root").alias("a"), F.col("head").alias("b"))
    largest = met.groupBy("family", "head").agg(F.sum("n").alias("n")).groupBy("family").agg(F.max(F.struct("n", (-F.col("head")).alias("h"))).alias("top")).select("family", (-F.col("top.h")).alias("largest"))
    sided = many.join(met.select("root", "head").distinct(), "root").join(largest, "family").select("family", "id", "head", (F.col("head") == F.col("largest")).alias("main"), "blocks", F.pmod(F.hash("id"), F.col("blocks")).alias("block"))
    strays = sided.filter(~F.col("main"))
    stray_blocks = strays.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("stray_blocks"))
    sided = sided.join(stray_blocks, "family")
    to_left = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.pmod(F.hash("id"), F.col("stray_blocks")).alias("x"), b.alias("y"), F.lit(True).alias("stray")))
    to_right = F.transform(F.sequence(F.lit(0), F.col("stray_blocks") - 1), lambda b: F.struct(b.alias("x"), F.col("block").alias("y"), F.lit(False).alias("stray")))
    spread = sided.withColumn("p", F.explode(F.when(F.col("main"), to_right).otherwise(F.concat(to_left, to_right)))).select("family", "id", "head", "p.x", "p.y", "p.stray")

    def meet(rows: pa.Table) -> pa.Table:
        side = rows["stray"].to_numpy(zero_copy_only=False).astype(bool)
        order = np.r_[np.flatnonzero(side), np.flatnonzero(~side)]
        ids, heads_ = rows["id"].to_numpy()[order], rows["head"].to_numpy()[order]
        forest, first = Forest(len(ids)), {}
        for i, h in enumerate(heads_.tolist()):
            forest.join(first.setdefault(h, i), i)
        roots = confirmed_groups(_sets(rows, order, size), percent, forest, int(side.sum())).roots()
        return pa.table({"a": pa.array(ids), "b": pa.array(ids[roots])})

    crossed = spread.join(texts, F.col("id") == F.col("doc_id")).select("family", "id", "head", "x", "y", "stray", "text").groupBy("family", "x", "y").applyInArrow(meet, "a long, b long")
    return found.unionByName(crossed)


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: the one with the smallest id, once, a null id after all others; wordless ones all stay.

    Rows are told apart by a key of their own, so ids may repeat or be null.
    """
    row, kept_row, doc_id = fresh(docs.columns, "row", "kept_row", "id")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "dup-rows")
    marks = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), size, percent)
    ids = rows.select(F.col(row).alias(kept_row), F.col("doc_id").alias(doc_id))
    grouped = marks.join(ids, F.col("doc_id") == F.col(kept_row)).groupBy("component_id")
    kept = grouped.agg(F.min(F.struct(F.col(doc_id).isNull(), doc_id, kept_row))[kept_row].alias(kept_row))
    return rows.join(kept, F.col(row) == F.col(kept_row), "left_semi").select(*docs.columns)
