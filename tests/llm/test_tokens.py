"""Token ids against the library; segments and files against exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import packing, tokenfile, tokens

TEXTS = [None, "", "  \n x", "a calm line. A Calm LINE!", "İstanbul ΣΑΣ. ΟΔΟΣ, ẞß ŉ ǅ", "don't'5 it's 'tis we'll.'s a's,b 's", "<|endoftext|> a<|startoftext|>b <|endoftext|>. x<|", "e\u0301a. n\u0303 각 Å", "½ ² ⅷ ① x² y½.", "a\xa0b\x85c d \x1cx\x1fy", "漢字 かな。ﬁ.ﬂ abc…!! é…?", "a__b c--d. #tag @me $5.00 100% \\n `x`", "µm ºC ªb ÆŒœ.", "\U0001f600 \U0001f600. x\U0001f600y!", "12345.67,89 1st 2nd.", "x" * 5000, "wörter und Wörter. " * 9000]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    return lambda t: found.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("limit", "run"), [(300_000, 16 << 20), (3, 40)])
def test_ids_equal_the_library(library, limit, run, monkeypatch):
    monkeypatch.setattr(tokens, "RUN", run)
    monkeypatch.setattr(tokens, "GATHER", run // 3)
    rng = random.Random(2)
    signs = [*"abcXYZéßÑ0'.,!-<|>#_ \t\n\u00a0\u0301Σσ漢½²", "'s", "the ", "tion"]
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)]
    cache = tokens.WordCache(limit=limit)
    for _ in range(2):
        got = [ids[a:b].tolist() for ids, cuts in cache.encode_all(pa.array(texts, pa.string())) for a, b in zip(cuts[:-1], cuts[1:])]
        assert got == [library(t) for t in texts]
    got = [ids[a:b].tolist() for ids, cuts in cache.encode_all(pa.array(texts, pa.large_string()), 7) for a, b in zip(cuts[:-1], cuts[1:])]
    assert got == [[*library(t), 7] for t in texts]
    assert list(cache.encode_all(pa.array([], pa.string()))) == []
    assert cache.encode("a line") == np.array(library("a line"), "<u4").tobytes()


def segment_ids():
    rng = np.random.default_rng(8)
    parts = [rng.integers(0, 49408, n) for n in (0, 1, 700, 5)] + [np.full(900, 65535), rng.geometric(0.01, 2000) % 65536, np.tile(rng.integers(0, 9, 7), 300)]
    return [None, 1, 2, 2, -5, 9, 9], np.array([len(p) for p in parts]), np.concatenate(parts).astype(np.uint32)


def test_segments_round_trip():
    names, lengths, ids = segment_ids()
    data = tokenfile.encode_segment(names, lengths, ids, block=256)
    segment = tokenfile.Segment(data)
    assert (segment.doc_ids, segment.lengths.tolist()) == (names, lengths.tolist())
    assert (segment.ids() == ids).all()
    for k in range(segment.n_blocks):  # each block alone
        assert (segment.ids(k, k + 1) == ids[256 * k : 256 * (k + 1)]).all()
    empty = tokenfile.Segment(tokenfile.encode_segment([4], np.array([0]), np.zeros(0, np.uint32)))
    assert (empty.doc_ids, empty.ids().tolist()) == ([4], [])


def test_mixing_codes_what_repeats_in_few_bits():
    rng = np.random.default_rng(5)
    phrase = rng.integers(0, 40000, 50)
    data = tokenfile.encode_segment([1], np.array([20000]), np.tile(phrase, 400).astype(np.uint32))
    assert 8 * len(data) < 20000  # order 0 alone takes 5.6 bits an id
    noise = rng.integers(0, 40000, 20000).astype(np.uint32)
    assert len(tokenfile.encode_segment([1], np.array([20000]), noise)) < 1.05 * 20000 * 15.3 / 8 + 4 * len(np.unique(noise))


def test_damage_is_found_in_its_block_only():
    names, lengths, ids = segment_ids()
    data = bytearray(tokenfile.encode_segment(names, lengths, ids, block=256))
    data[-40] ^= 255
    segment = tokenfile.Segment(bytes(data))
    last = segment.n_blocks
    with pytest.raises(ValueError, match="checksum"):
        segment.ids()
    assert (segment.ids(0, last - 2) == ids[: 256 * (last - 2)]).all()
    with pytest.raises(ValueError):
        tokenfile.Segment(b"CMX0" + bytes(data[4:]))


def test_large_ids_are_refused():
    with pytest.raises(ValueError, match="70000"):
        tokenfile.encode_segment([1], np.array([1]), np.array([70000], np.uint32))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "z", 2) for i, t in rows], "doc_id long, text string, start int, payload string, n_tokens int")


def test_token_files(spark, library):
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id"), (-7, "before all")]
    got = tokenfile.round_trip(frame(spark, texts).repartition(5)).collect()
    want, at = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*library(t), 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenfile.round_trip(frame(spark, [])).collect() == []


def test_small_segments_are_one_file(spark, library, tmp_path):
    rows = [(i, f"word{i} again") for i in range(40)]
    tokenfile.write_ids(frame(spark, rows), str(tmp_path / "ids"), segment=1)
    got = sorted(map(tuple, tokenfile.read_ids(spark, str(tmp_path / "ids")).collect()))
    sizes = [len(library(t)) + 1 for _, t in rows]
    assert [r[:3] for r in got] == [(i, sum(sizes[:i]), sizes[i]) for i in range(40)]


def test_pieces_equal_the_library(spark, library):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id " * 3000)]
    want = []
    for i, t in rows:
        ids = np.array([*library(t), 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    placed = packing.pack_documents(frame(spark, rows)).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert order([tuple(r)[:5] for r in placed]) == order(want)
    by = {}
    for r in placed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *(n for _, n in sorted(places)[:-1])]).tolist()
        assert sum(n for _, n in places) <= 4096
