r"""Language identification: unigram models over pieces, summed over all segmentations.

The pieces are a public tokenizer's fixed vocabulary; only their probabilities are learnt, one
distribution for each language. A text is lower-cased and cut at white space into units, each
with the mark U+2581 in front, which no piece has after another character. The probability of a
unit is the sum over all its segmentations of the product of piece probabilities, by the forward
algorithm: with ``a(0) = 1``, ``a(i) = sum of a(j) p(unit[j:i])`` over the pieces that end at i,
which an Aho-Corasick automaton finds, for all languages at once and in logarithms. A character
that is no piece is spelt with the byte pieces. A text scores the sum of its units and the
language's share of the training documents; the score of the prediction is its posterior
probability.

Training: expectation-maximisation. About ``PER_LANG`` documents of each language outside the
held-out fold, chosen by the hash of their id, are counted into units by Spark; in each
of ``ROUNDS`` rounds the tasks sum the expected piece counts of their units by the forward-backward
algorithm, as whole numbers of ``1 / GRAIN``, so that the model does not depend on partitions. Only
these sums, a number for each piece and language, come to the driver. Each language is smoothed
with all of them together. The model is pieces times languages floats and goes to the tasks as a broadcast.

Scale: the id and language columns are read for the sample, then one pass over the texts without a shuffle.
A worker remembers at most ``MEMO_UNITS`` units of up to ``MEMO_CHARS`` characters (fewer with many
languages); longer ones are summed anew, in stretches of ``STRETCH`` characters, so a text without
spaces needs no more memory than its characters.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is all if nothing
was learnt; a null language or id is not learnt from, '' is a language like others; rows with the
same id and language are learnt together; ties go to the smaller language name; texts are read whole; repeated
rows get equal results; an empty table gives an empty result. Only id, text and language are read, so
other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voucherlens.llm.common import fold_of, schema_with, ship, table
from voucherlens.staging import Stage

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BREAK = "\n"  # between units; no unit and no piece has it
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
PER_LANG = 2000
ROUNDS = 3
GRAIN = 1 << 20
SMOOTHING = 100.0   # expected pieces that the background is worth
SALTS = 16
MEMO_UNITS, MEMO_CELLS, MEMO_CHARS = 400_000, 1 << 21, 32
STRETCH = 1024
CHUNK_CHARS = 100_000
SLICE_CHARS = 1 << 20


class Pieces:
    """The vocabulary: ordinary pieces, byte pieces, and the automaton over the ordinary ones."""

    def __init__(self, ordinary: dict[str, int], byte_ids: list[int], size: int):
        self.byte_ids, self.size = byte_ids, size
        ordinary = {p: i for p, i in ordinary.items() if BREAK not in p}
        self.longest = max(map(len, ordinary), default=1)
        self.length = np.ones(size, np.int64)
        self.length[list(ordinary.values())] = [len(p) for p in ordinary]
        self.single = np.array(sorted(ord(p) for p in ordinary if len(p) == 1), np.uint32)
        self.automaton = ahocorasick.Automaton()
        for piece, i in ordinary.items():
            self.automaton.add_word(piece, i)
        if ordinary:
            self.automaton.make_automaton()
        self.empty = not ordinary

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of pieces: the place of the last character, and the id."""
        if self.empty:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64)
        return flat[0::2], flat[1::2]

    def spelt(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]


def read_vocabulary(path: str = MODEL_PATH) -> bytes:
    """The vocabulary file, read by the driver; the tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def pieces_of(proto: bytes) -> Pieces:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=proto)
    n = p.get_piece_size()
    ids = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
    ordinary = {p.id_to_piece(i): i for i in range(n)
                if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}
    return Pieces(ordinary, [ids[b] for b in range(256)], n)


def units_of(text: str) -> Counter:
    """How often each unit occurs in a text."""
    return Counter(text.lower().split())


class Lattice:
    """All pieces in some prepared texts, as edges from position to position.

    Text ``t`` has the positions ``base[t] .. base[t] + len(text)``: the places of its characters
    in one string of all texts, with a ``BREAK`` behind each. ``piece`` is an id, or the
    size of the vocabulary plus a place in ``chars`` for a character in bytes. The edges come in
    the order of their distance from the start, then of their text.
    """

    def __init__(self, pieces: Pieces, texts: list[str]):
        self.pieces = pieces
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.cumsum(self.length + 1) - (self.length + 1)
        self.places = int((self.length + 1).sum())
        whole = "".join(t + BREAK for t in texts)
        last, piece = pieces.found(whole)
        size = pieces.length[piece]
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        odd = np.flatnonzero(~np.isin(code, pieces.single) & (code != ord(BREAK)))
        chars, which = np.unique(code[odd], return_inverse=True)
        self.chars = [chr(c) for c in chars]
        end = np.concatenate([last, odd]) + 1
        start = end - np.concatenate([size, np.ones(len(odd), np.int64)])
        piece = np.concatenate([piece, pieces.size + which])
        text = np.searchsorted(self.base, start, "right") - 1
        order = np.lexsort((text, end - self.base[text]))
        self.text, self.piece, self.start, self.end = text[order], piece[order], start[order], end[order]
        self.first = self.start - self.base[self.text]
        self.steps = np.searchsorted(self.end - self.base[self.text],
                                     np.arange(int(self.length.max(initial=0)) + 2))

    def weights(self, logp: np.ndarray) -> np.ndarray:
        """``logp`` (pieces x languages) with a row for each character in bytes."""
        extra = [logp[self.pieces.spelt(c)].sum(axis=0) for c in self.chars]
        return np.vstack([logp, *extra]) if extra else logp

    def forward(self, weight: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Log of the summed probability of everything before each position (rows).

        ``weight`` is that of each edge. ``known`` gives the first positions of a single text.
        """
        alpha = np.full((self.places, weight.shape[1]), -np.inf)
        alpha[self.base] = 0.0
        done = 1
        if known is not None:
            done = len(known)
            alpha[:done] = known
        for step in range(done, len(self.steps) - 1):
            a, b = self.steps[step], self.steps[step + 1]
            if a == b:
                continue
            heads = np.flatnonzero(np.diff(self.end[a:b], prepend=-1))
            alpha[self.end[a:b][heads]] = np.logaddexp.reduceat(
                alpha[self.start[a:b]] + weight[a:b], heads)
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """Log of the summed probability of everything after each position (one language)."""
        beta = np.full(self.places, -np.inf)
        beta[self.base + self.length] = 0.0
        order = np.lexsort((self.text, -self.first))
        first = self.first[order]
        cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            e = order[a:b]
            heads = np.flatnonzero(np.diff(self.start[e], prepend=-1))
            beta[self.start[e][heads]] = np.logaddexp.reduceat(beta[self.end[e]] + weight[e], heads)
        return beta


def unit_scores(pieces: Pieces, logp: np.ndarray, units: list[str]) -> np.ndarray:
    """Log probability of each unit in each language."""
    lattice = Lattice(pieces, [MARK + u for u in units])
    alpha = lattice.forward(lattice.weights(logp)[lattice.piece])
    return alpha[lattice.base + lattice.length]


def long_unit_score(pieces: Pieces, logp: np.ndarray, unit: str, stretch: int = STRETCH) -> np.ndarray:
    """As :func:`unit_scores` for one unit, keeping only the last positions between stretches."""
    text, back = MARK + unit, pieces.longest
    known = np.zeros((1, logp.shape[1]))
    at = 0  # ``known`` are the positions up to and with ``at``
    while at < len(text):
        start = at - len(known) + 1
        lattice = Lattice(pieces, [text[start:at + stretch]])
        # edges that end at a known position are not used again
        alpha = lattice.forward(lattice.weights(logp)[lattice.piece], known)
        at = min(len(text), at + stretch)
        known = alpha[-min(back, len(alpha)):]
    return known[-1]


class Model(NamedTuple):
    proto: bytes
    langs: list[str]
    prior: np.ndarray  # log share of the training documents
    logp: np.ndarray   # pieces x languages


class Scorer:
    """Scores texts; remembers a bounded number of units."""

    def __init__(self, model: Model):
        self.pieces, self.logp, self.prior = pieces_of(model.proto), model.logp, model.prior
        n = len(model.langs)
        self.most = min(MEMO_UNITS, MEMO_CELLS // max(1, n))
        self.row: dict[str, int] = {}
        self.value = np.zeros((0, n))

    def _learn(self, units: list[str]) -> np.ndarray:
        """Scores of some units, a bounded number of characters at a time."""
        out, held, chars = [self.value[:0]], [], 0
        for u in units:
            if len(u) > MEMO_CHARS:
                out.append(long_unit_score(self.pieces, self.logp, u)[None])
                continue
            held.append(u)
            chars += len(u) + 1
            if chars > CHUNK_CHARS or len(held) == len(units):
                out.append(unit_scores(self.pieces, self.logp, held))
                held, chars = [], 0
        if held:
            out.append(unit_scores(self.pieces, self.logp, held))
        return np.vstack(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text and each language."""
        counted = [units_of(t) for t in texts]
        new = set().union(*counted).difference(self.row)
        if len(self.row) + len(new) > self.most:
            self.row, self.value = {}, self.value[:0]
            new = set().union(*counted)
        short = [u for u in new if len(u) <= MEMO_CHARS]
        long = [u for u in new if len(u) > MEMO_CHARS]
        for some in (short, long):
            self.row.update(zip(some, range(len(self.row), len(self.row) + len(some))))
            self.value = np.vstack([self.value, self._learn(some)])
        out = np.tile(self.prior, (len(texts), 1))
        for k, counts in enumerate(counted):
            n = np.fromiter(counts.values(), float, len(counts))
            at = np.fromiter(map(self.row.__getitem__, counts), np.int64, len(counts))
            out[k] += (n[:, None] * self.value[at]).sum(axis=0)
        for u in long:  # the last rows
            del self.row[u]
        self.value = self.value[:len(self.row)]
        return out


_last: list = []


def scorer_of(model: Model) -> Scorer:
    """The scorer of a worker, with what it remembers from its tasks before."""
    if not _last or _last[0] is not model:
        _last[:] = [model, Scorer(model)]
    return _last[1]


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """About ``per_lang`` ids of each language outside the held-out fold: ``doc_id, lang``.

    Those with the smallest hashes in each of ``SALTS`` parts of a language, so that no task ranks
    a whole language: at most ``per_lang`` rounded up to a multiple of ``SALTS``.
    """
    ids = (docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
                      & (fold_of(folds=FOLDS) != HELD_OUT))
           .select("doc_id", "lang", F.xxhash64("doc_id").alias("_h")))
    salted = Window.partitionBy("lang", F.pmod(F.col("_h"), F.lit(SALTS))).orderBy("_h", "doc_id")
    few = ids.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= -(-per_lang // SALTS))
    return few.select("doc_id", "lang").distinct()


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for unit, n in units_of(text).items():
                for at in range(0, len(unit), MEMO_CHARS):  # long units are learnt in stretches
                    counts[lang, unit[at:at + MEMO_CHARS]] += n
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([k[0] for k in counts], pa.string()),
            "unit": pa.array([k[1] for k in counts], pa.string()),
            "n": pa.array(counts.values(), pa.int64())})


def expected(pieces: Pieces, logp: np.ndarray, lang: np.ndarray, units: list[str], n: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected piece counts of units of known language: language, piece, count in grains."""
    lattice = Lattice(pieces, [MARK + u for u in units])
    weight = lattice.weights(logp)[lattice.piece, lang[lattice.text]]
    alpha = lattice.forward(weight[:, None])[:, 0]
    beta = lattice.backward(weight)
    whole = alpha[(lattice.base + lattice.length)[lattice.text]]
    share = np.exp(alpha[lattice.start] + weight + beta[lattice.end] - whole)
    grains = np.rint(share * GRAIN).astype(np.int64) * n[lattice.text]
    in_bytes = lattice.piece >= pieces.size
    piece, by = [lattice.piece[~in_bytes]], [np.flatnonzero(~in_bytes)]
    for k, c in enumerate(lattice.chars):
        own = np.flatnonzero(lattice.piece == pieces.size + k)
        for b in pieces.spelt(c):
            piece.append(np.full(len(own), b))
            by.append(own)
    edge = np.concatenate(by)
    return lang[lattice.text[edge]], np.concatenate(piece), grains[edge]


def _expectations(units: DataFrame, proto: bytes, langs: list[str], logp: np.ndarray) -> np.ndarray:
    """Sums of :func:`expected` over all units, by the tasks: pieces x languages."""
    shared = units.sparkSession.sparkContext.broadcast((proto, langs, logp))
    size, n_langs = logp.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, weights = shared.value
        pieces, place = pieces_of(own), {x: i for i, x in enumerate(names)}
        total = np.zeros(size * n_langs, np.int64)
        for batch in batches:
            text = batch.column("unit").to_pylist()
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            n = batch.column("n").to_numpy()
            for at in range(0, len(text), 4096):
                to = at + 4096
                which, piece, grains = expected(pieces, weights, lang[at:to], text[at:to], n[at:to])
                np.add.at(total, piece * n_langs + which, grains)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "grains": pa.array(total[cell])})

    sums = (units.mapInArrow(run, "cell bigint, grains bigint").groupBy("cell")
            .agg(F.sum(F.col("grains").cast("decimal(38,0)")).cast("double").alias("grains")).toArrow())
    out = np.zeros(size * n_langs)
    out[sums["cell"].to_numpy()] = sums["grains"].to_numpy()
    shared.destroy()
    return (out / GRAIN).reshape(size, n_langs)


def train(docs: DataFrame, stage: Stage, vocabulary: str = MODEL_PATH, per_lang: int = PER_LANG,
          rounds: int = ROUNDS) -> Model:
    """Learns from ``doc_id``, ``text`` and ``lang``; see the top of the module."""
    proto = read_vocabulary(vocabulary)
    pieces = pieces_of(proto)
    chosen = stage(sample(docs, per_lang), "sample")
    shares = sorted(chosen.groupBy("lang").count().collect())  # a row a language
    if not shares:
        return Model(proto, [], np.zeros(0), np.zeros((pieces.size, 0)))
    learnt = (docs.where(fold_of(folds=FOLDS) != HELD_OUT).join(chosen, ["doc_id", "lang"])
              .select("lang", F.coalesce("text", F.lit("")).alias("text")))
    units = stage(learnt.mapInArrow(_count_units, "lang string, unit string, n bigint")
                  .groupBy("lang", "unit").agg(F.sum("n").alias("n")), "units")
    langs = [r[0] for r in shares]
    logp = np.full((pieces.size, len(langs)), -np.log(pieces.size))
    for _ in range(rounds):
        counts = _expectations(units, proto, langs, logp)
        background = counts.sum(axis=1) + 0.01
        background /= background.sum()
        logp = np.log(counts + SMOOTHING * background[:, None]) - np.log(counts.sum(axis=0) + SMOOTHING)
    n = np.array([r[1] for r in shares], float)
    return Model(proto, langs, np.log(n / n.sum()), logp)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.when(text.rlike(r"\p{L}"), text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = scorer_of(own)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not own.langs:
                texts = [None] * len(texts)
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for part in _parts(texts):
                z = scorer.scores([texts[i] for i in part])
                z = np.exp(z - z.max(axis=1, keepdims=True))
                best = z.argmax(axis=1)  # languages are sorted: the first of equals
                sure = z[np.arange(len(part)), best] / z.sum(axis=1)
                for i, b, s in zip(part, best.tolist(), sure.tolist()):
                    pred[i], score[i] = own.langs[b], s
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pred,
                                              "score": pa.array(score, pa.float64())})

    out = rows.mapInArrow(run, schema_with(rows, "lang_pred string", "score double"))
    return out.select("doc_id", (fold_of(folds=FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def _parts(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of the texts that are there, about ``SLICE_CHARS`` characters at a time."""
    held, chars = [], 0
    for i, t in enumerate(texts):
        if t is not None:
            held.append(i)
            chars += len(t)
            if chars > SLICE_CHARS:
                yield held
                held, chars = [], 0
    if held:
        yield held


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Id, text and language under fixed names, to learn from."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.col(f"`{lang_col}`").cast("string").alias("lang"))


def op12_language_id(spark, sf_dir: str, stage: Stage | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(labelled(docs), stage or Stage(spark)))
