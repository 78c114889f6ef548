"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a
probability for every piece, fitted by expectation maximisation; a word's
probability is the sum over all its segmentations, by the forward algorithm.
A text's evidence is the sum of its words' log probabilities.

Training reads whole texts of at most about ``docs_per_lang`` labelled documents
a language, chosen by hash, so the model has a fixed bound; scoring is a map over
the scan. Words longer than WORD code points are scored in parts of that length.

Defined results: null text or text without letters gives ``und`` with score 0;
no training rows gives ``und`` for all; ties go to the language first by code
point; repeated rows get equal results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import fresh, id_crc

VOCABULARY = "piece_bpe_32k.model"
DOCS_PER_LANG = 500
ROUNDS = 2
WORD = 48
#: Words of evidence after which a text's posterior grows no sharper.
EVIDENCE = 10
UNKNOWN = "und"
_RUNS = re.compile(r"[^\W\d_]+")
_CACHE = 200_000
#: Numbers that a forward pass holds at most; code points of texts that are scored together.
_CELLS, RUN = 1 << 21, 1_000_000


def vocabulary_pieces(vocabulary: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces, lower-cased ones only, without control and byte pieces."""
    import sentencepiece

    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in found if p == p.lower()})


def words(text: str) -> list[str]:
    """Lower-cased runs of letters (Unicode's category L), long ones in parts."""
    found = _RUNS.findall(text.lower())
    if not text.isascii() and not all(map(str.isalpha, found)):  # some hold numerals that are no decimal digits
        found = ["".join(run) for w in found for letters, run in itertools.groupby(w, str.isalpha) if letters]
    if found and max(map(len, found)) > WORD:
        found = [w[i : i + WORD] for w in found for i in range(0, len(w), WORD)]
    return found


def forward(word: str, table: dict[str, np.ndarray], unknown: np.ndarray, longest: int) -> np.ndarray:
    """Per language, the probability of the word summed over all segmentations."""
    s = "▁" + word
    alpha = [np.ones(len(unknown))]
    for i in range(1, len(s) + 1):
        total = alpha[i - 1] * table.get(s[i - 1], unknown)
        for j in range(max(0, i - longest), i - 1):
            if (p := table.get(s[j:i])) is not None:
                total = total + alpha[j] * p
        alpha.append(total)
    return alpha[-1]


def fit(histogram: dict[str, int], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], list[float], float]:
    """Piece probabilities of one language by expectation maximisation over its words; and the rest's probability."""
    known, longest = set(pieces), max(map(len, pieces), default=1)
    lattice = []
    for w, n in histogram.items():
        s = "▁" + w
        lattice.append((len(s), n, [(j, i, s[j:i]) for i in range(1, len(s) + 1) for j in range(max(0, i - longest), i) if j == i - 1 or s[j:i] in known]))
    p = dict.fromkeys({e[2] for _, _, edges in lattice for e in edges}, 1 / max(1, len(pieces)))
    floor = 1e-9
    for _ in range(rounds):
        seen: dict[str, float] = dict.fromkeys(p, 0.0)
        for length, n, edges in lattice:
            a, b = [1.0] + [0.0] * length, [0.0] * length + [1.0]
            for j, i, piece in edges:
                a[i] += a[j] * p[piece]
            for j, i, piece in reversed(edges):
                b[j] += b[i] * p[piece]
            if (z := a[length]) > 0:
                for j, i, piece in edges:
                    seen[piece] += n * a[j] * p[piece] * b[i] / z
        total = sum(seen.values()) or 1.0
        p = {k: max(v / total, floor) for k, v in seen.items()}
    floor = 0.5 / (1 + sum(histogram.values())) / 10
    return list(p), [max(v, floor) for v in p.values()], floor


class Model:
    """Piece tables of all languages; small and of fixed bound, so it is broadcast."""

    def __init__(self, langs: list[str], table: dict[str, list[float]], floors: list[float], longest: int):
        self.langs, self.table, self.floors, self.longest = langs, table, floors, longest

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A worker's scorer with its word cache; words that are new in a run of texts go through the forward algorithm together."""

    def __init__(self, model: Model):
        self.model = model
        nodes, self.piece = {"": 0}, [-1]  # a tree of the pieces; a node's piece, or -1
        edges: dict[int, int] = {}
        for row, p in enumerate(model.table):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    edges[nodes[p[: k - 1]] << 21 | ord(p[k - 1])] = nodes[p[:k]] = len(nodes)
                    self.piece.append(-1)
            self.piece[nodes[p]] = row
        self.piece = np.array(self.piece)
        self.edges = np.array(sorted(edges), np.int64)
        self.targets = np.array([edges[e] for e in self.edges.tolist()], np.int64)
        odds = np.array([*model.table.values(), model.floors], np.float64).reshape(len(model.table) + 1, len(model.floors))
        # Each sign lifts a probability by the root of the rarest's inverse, so that long words of rare signs do not underflow.
        self.lift = -0.5 * math.log(max(min(model.floors, default=1.0), 1e-12))
        self.odds = odds * np.exp(self.lift * np.array([*map(len, model.table), 1]))[:, None]
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((1 << 12, len(self.model.floors)))

    def forward(self, found: list[str]) -> np.ndarray:
        """Per word and language, the probability summed over all segmentations; 0 where too small for a float."""
        return np.exp(self.log_forward(found))

    def log_forward(self, found: list[str]) -> np.ndarray:
        """Per word and language, the log of the probability summed over all segmentations: position by position, all words at once."""
        rest, longest = len(self.odds) - 1, min(self.model.longest, WORD + 1)
        lengths = np.array([len(w) + 1 for w in found])
        signs = np.frombuffer("".join(["▁" + w for w in found]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(found)), lengths)
        at = np.arange(len(signs)) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # place within the word
        left = lengths[word] - at
        live, node = np.arange(len(signs)), np.zeros(len(signs), np.int64)
        owner, codes, pieces = [], [], []
        for d in range(1, longest + 1):  # substrings of d signs, as long as they begin a piece
            more = left[live] >= d
            live, node = live[more], node[more]
            key = node << 21 | signs[live + d - 1]
            k = np.minimum(np.searchsorted(self.edges, key), max(len(self.edges) - 1, 0))
            hit = self.edges[k] == key if len(self.edges) else np.zeros(len(key), bool)
            if d == 1:  # a sign that is no piece has the rest's probability
                p = np.where(hit, self.piece[self.targets[k]] if len(self.edges) else -1, -1)
                owner.append(word)
                codes.append((at + 1) * (longest + 1) + 1)
                pieces.append(np.where(p < 0, rest, p))
                live, node = live[hit], self.targets[k[hit]]
                continue
            live, node = live[hit], self.targets[k[hit]]
            p = self.piece[node]
            whole = p >= 0
            owner.append(word[live[whole]])
            codes.append((at[live[whole]] + d) * (longest + 1) + d)
            pieces.append(p[whole])
            if not len(live):
                break
        at, code, piece = np.concatenate(owner), np.concatenate(codes), np.concatenate(pieces)
        order = np.argsort(code.astype(np.int16), kind="stable")  # at most (WORD + 1) x (WORD + 2)
        at, code, piece = at[order], code[order], piece[order]
        alpha = np.zeros((int(lengths.max()) + 1, len(found), self.odds.shape[1]))
        alpha[0] = 1
        cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # a word has one edge of a length that ends at a position
            i, d = divmod(int(code[lo]), longest + 1)
            alpha[i, at[lo:hi]] += alpha[i - d, at[lo:hi]] * self.odds[piece[lo:hi]]
        return np.log(np.maximum(alpha[lengths, np.arange(len(found))], 1e-300)) - self.lift * lengths[:, None]

    def _learn(self, new: set[str]) -> None:
        if len(self.rows) > _CACHE:
            self._reset()
        while len(self.rows) + len(new) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        order, most = list(new), max(64, _CELLS // ((WORD + 2) * self.odds.shape[1]))
        for k in range(0, len(order), most):
            part = order[k : k + most]
            self.logs[len(self.rows) : len(self.rows) + len(part)] = self.log_forward(part)
            self.rows.update(zip(part, range(len(self.rows), len(self.rows) + len(part))))

    def _score(self, found: list[str]) -> tuple[str, float]:
        if not found:
            return UNKNOWN, 0.0
        logs = self.logs[np.fromiter(map(self.rows.__getitem__, found), np.int64, len(found))].sum(0)
        best = int(np.argmax(logs))
        tempered = np.exp((logs - logs[best]) * min(1.0, EVIDENCE / len(found)))
        return self.model.langs[best], float(1.0 / tempered.sum())

    def many(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """Prediction and score of each text, in runs of about RUN code points."""
        out: list[tuple[str, float]] = []
        held: list[list[str]] = []
        size = 0

        def done() -> None:
            new = set().union(*held).difference(self.rows)
            if len(self.rows) > _CACHE:
                new = set().union(*held)
            if new:
                self._learn(new)
            out.extend(map(self._score, held))
            held.clear()

        for t in texts:
            held.append(words(t) if t and self.model.langs else [])
            size += len(t or "")
            if size >= RUN:
                done()
                size = 0
        if held:
            done()
        return out

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.many([text])[0]


def train(docs: DataFrame, usable: Column, vocabulary: str = VOCABULARY, docs_per_lang: int = DOCS_PER_LANG, rounds: int = ROUNDS) -> Model:
    """Fit on rows where usable holds and lang is not null: at most about docs_per_lang whole documents a language, by hash."""
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return Model([], {}, [], 1)
    chance = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("string")), F.lit(1_000_000))
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = keep | ((F.col("lang") == lang) & (chance < math.ceil(1_000_000 * min(1.0, docs_per_lang / n))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, Counter()).update(words(text))
            rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        p, v, floor = fit(dict(zip(rows["word"], rows["n"])), vocabulary_pieces(vocabulary), rounds)
        return pd.DataFrame({"lang": key[0], "piece": [*p, ""], "p": [*v, floor]})

    histogram = known.filter(keep).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = histogram.groupBy("lang").applyInPandas(fitted, "lang string, piece string, p double").toPandas()  # at most the pieces of the bounded sample
    langs = sorted(set(rows["lang"]), key=str.encode)
    at = {x: i for i, x in enumerate(langs)}
    floors = [0.0] * len(langs)
    for lang, piece, p in rows[rows["piece"] == ""].itertuples(index=False):
        floors[at[lang]] = p
    floors = [min(floors)] * len(langs)  # alike for all, so that little training text is no advantage
    table: dict[str, list[float]] = {}
    for lang, piece, p in rows[rows["piece"] != ""].itertuples(index=False):
        table.setdefault(piece, list(floors))[at[lang]] = p
    return Model(langs, table, floors, max(map(len, table), default=1))


_scorers: dict[int, Scorer] = {}


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns and two more: the predicted language and its posterior. No column of docs may have their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if id(m) not in _scorers:
            _scorers.clear()
            _scorers[id(m)] = m.scorer()
        score = _scorers[id(m)]
        for batch in batches:
            found = score.many(t.as_py() for t in batch.column("text"))
            out = dict(zip(batch.schema.names, batch.columns))
            out[names[0]] = pa.array([x[0] for x in found], pa.string())
            out[names[1]] = pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_pydict(out)
            pa.default_memory_pool().release_unused()  # the worker lives on beside those of other stages

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only from rows that are not held out."""
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(modulus)) == held
    model = train(docs, ~held_out)
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those of no recognised language: no letters, or a posterior under least. Null ids and repeated rows stay."""
    lang, score = fresh(docs.columns, "lang_pred", "score")
    found = predict(docs, train(docs, F.lit(True)), (lang, score))
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
