"""Token ids of whole texts, worked out once for each distinct word of a run of texts.

The vocabulary never joins what white space parts, so a text's ids are those of
its pieces between ASCII white space, in order. Arrow kernels split a run of
texts and number its distinct pieces; a piece of letters and a tail of ASCII
marks and digits has the ids of both parts. Parts that a worker has not met go
through the tokenizers library, the others come from its cache, and the texts'
ids are gathered by number. They equal those of ``Tokenizer.encode(text,
add_special_tokens=False)``. Null and empty texts have none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: ASCII but for letters and white space: what may follow the letters of a piece.
TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
#: Bytes of text that are encoded together, words that are gathered together.
RUN, GATHER = 4 << 20, 1 << 19


def _byte_symbols() -> dict[int, str]:
    """Latin-1 code points (bytes) to the visible symbols of byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordCache:
    """Encodes texts; holds the ids of about ``limit`` words, of ``room`` bytes together."""

    def __init__(self, vocabulary: str = VOCABULARY, limit: int = 300_000, room: int = 32 << 20):
        from tokenizers import Tokenizer

        if "/" not in vocabulary:
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.symbols = _byte_symbols()
        self.limit, self.room = limit, room
        self._reset()

    def _reset(self) -> None:
        self.known = pa.array([], pa.string())
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, word: str) -> list[int]:
        if not word.isascii():
            try:
                word.encode("latin-1")  # beyond Latin-1 the library's normal form and lower case may differ from Python's
                plain = word.isalpha()
            except UnicodeEncodeError:
                plain = False
            if plain:
                return [t.id for t in self.model.tokenize(word.lower().encode().decode("latin-1").translate(self.symbols))]
        elif word.isalpha():
            return [t.id for t in self.model.tokenize(word.lower())]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _rows_of(self, words: pa.StringArray) -> np.ndarray:
        """The row of each word; new ones are learned."""
        rows = pc.index_in(words, value_set=self.known)
        if rows.null_count:
            new = words.filter(pc.is_null(rows))
            found = [self._ids(w) for w in new.to_pylist()]
            first, sizes = len(self.known), np.fromiter(map(len, found), np.int64, len(found))
            rows = pc.fill_null(rows, -1).to_numpy(zero_copy_only=False).copy()
            rows[rows < 0] = first + np.arange(len(found))
            self.known = pa.concat_arrays([self.known, new])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter((i for f in found for i in f), np.uint32, int(sizes.sum()))])
            return rows
        return rows.to_numpy()

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of each piece's ids, and the ids."""
        cores = pc.utf8_rtrim(pieces, characters=TAIL)
        at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        size = pc.binary_length(cores).to_numpy().astype(np.int64)
        rest = np.diff(at) - size
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[_spread(at[:-1] + size, rest)]
        ends = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
        tails = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(ends), pa.py_buffer(data.tobytes())).dictionary_encode()
        cores = cores.dictionary_encode()
        # Marks within a core: the piece is not two parts.
        split = pc.or_(pc.utf8_is_alpha(cores.dictionary), pc.equal(pc.binary_length(cores.dictionary), 0)).to_numpy(zero_copy_only=False)
        core, tail = cores.indices.to_numpy().astype(np.int64), tails.indices.to_numpy() + len(cores.dictionary)
        mixed = np.flatnonzero(~split[core])
        none = len(cores.dictionary) + len(tails.dictionary)
        core[mixed], tail[mixed] = none + 1 + np.arange(len(mixed)), none
        used = np.concatenate([split, np.ones(len(tails.dictionary) + 1 + len(mixed), bool)])
        words = pa.concat_arrays([cores.dictionary, tails.dictionary, pa.array([""]), pieces.take(pa.array(mixed, pa.int64()))])
        rows = np.zeros(len(words), np.int64)
        rows[used] = self._rows_of(words.filter(pa.array(used)))
        both = rows[np.stack([core, tail], 1).ravel()]
        sizes = self.size[both]
        ids = self.flat[_spread(self.start[both], sizes)]
        sizes = sizes.reshape(-1, 2).sum(1)
        return np.cumsum(sizes) - sizes, sizes, ids

    def _run(self, texts: pa.StringArray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.limit or self.known.nbytes > self.room:
            self._reset()
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        start, size, ids = self._pieces(coded.dictionary)
        words, cuts = coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        if end is not None:  # one piece more after each text
            words = np.insert(words, cuts[1:], len(start))
            cuts = cuts + np.arange(len(cuts))
            start, size, ids = np.append(start, len(ids)), np.append(size, 1), np.append(ids, np.uint32(end))
        sizes = size[words]
        out = [ids[_spread(start[words[k : k + GATHER]], sizes[k : k + GATHER])] for k in range(0, len(words), GATHER)]
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(sizes)])[cuts]

    def encode_all(self, texts: pa.Array, end: int | None = None, run: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of the texts in order: their ids (unsigned 32-bit), and where each text's begin and the last one's end.

        end: an id that follows each text's; run: bytes that are encoded together, where not RUN.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        cuts = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(cuts, (cuts[at - 1] if at else 0) + (run or RUN), side="right")))
            yield self._run(texts.slice(at, to - at), end)
            at = to
        pa.default_memory_pool().release_unused()  # workers live on beside those of other stages

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, without an end id."""
        return b"".join(ids.astype("<u4").tobytes() for ids, _ in self.encode_all(pa.array([text], pa.string())))


@functools.cache
def word_cache(vocabulary: str = VOCABULARY, limit: int = 300_000) -> WordCache:
    """The worker's own cache; it lives as long as the worker, over tasks."""
    return WordCache(vocabulary, limit)
