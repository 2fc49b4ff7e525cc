"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Features of a text: its words hashed into ``BUCKETS`` places, each weighted by its share under
a square root (unit length in total), and the structure statistics of :func:`structure`, which
include what stands in for metadata: the length of the text and its lines. Ids, sources,
languages and labels are no features.

The score is ``sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2])``,
the pairwise interactions of all features in time linear in their number.

Training: the labelled rows outside the held-out fold, at most ``SAMPLE_PER_CLASS`` of each
label, those with the smallest hash of their id. Only their features come to the driver, where
the machine is fitted by AdaGrad on the logistic loss with fixed seeds: the same table gives
the same model. The weights are a fixed number of floats and go to the tasks as a broadcast.
Conflicting labels of one document count as 0; null labels or ids are left out.

Edge cases: null and empty texts are scored as a text without words; without any training row
every score is 0.5; whole texts are read; rows are scored one by one, so repeated rows get equal
results; a null id is in the held-out fold (crc32 of the empty text is 0); an empty table gives
an empty result. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import fold_of, id_and_text, kept, schema_with, sent, table

BUCKETS = 1 << 13
RANK = 8
SAMPLE_PER_CLASS = 2000
EPOCHS = 30
THRESHOLD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]\\^~_=+@/")] = True
_STOP_MARK = np.zeros(256, bool)
_STOP_MARK[list(b".,;:?")] = True
N_STATS = 14


def structure(raw: bytes, words: list[bytes]) -> list[float]:
    """Statistics between about 0 and 1; the first is the constant 1."""
    n = max(1, len(raw))
    b = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(b, minlength=256)
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    lines = raw.split(b"\n")
    filled = [x for x in lines if x.strip()]
    k = max(1, len(words))
    distinct = len(set(words))
    return [
        1.0,
        min(1.0, np.log1p(len(words)) / 10),
        min(1.0, np.log1p(len(filled)) / 6),
        float(counts[_UPPER].sum()) / letters,
        min(1.0, 5 * float(counts[_SYMBOL].sum()) / n),
        min(1.0, 20 * float(counts[_DIGIT].sum()) / n),
        min(1.0, 10 * float(counts[_STOP_MARK].sum()) / n),
        min(1.0, 10 * float(counts[ord("!")]) / n),
        min(1.0, 10 * float(counts[ord("|")]) / n),
        distinct / k,
        min(1.0, sum(map(len, words)) / k / 20),
        1 - len(set(filled)) / max(1, len(filled)),
        min(1.0, n / max(1, len(filled)) / 1000),
        1.0 if len(words) < 10 else 0.0,
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the non-zero features; statistics come first."""
    raw = text.encode()
    words = raw.split()
    stats = np.array(structure(raw, words))
    if not words:
        return np.arange(N_STATS), stats
    places = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % BUCKETS
    index, counts = np.unique(places, return_counts=True)
    value = np.sqrt(counts / counts.sum())
    return np.concatenate([np.arange(N_STATS), index + N_STATS]), np.concatenate([stats, value])


class FactorisationMachine(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # features x rank

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index] * value[:, None]
        s = v.sum(axis=0)
        z = self.bias + self.linear[index] @ value + 0.5 * float(s @ s - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS,
        rank: int = RANK, rate: float = 0.1, penalty: float = 1e-4,
        seed: int = 5) -> FactorisationMachine:
    """Stochastic gradient descent with AdaGrad steps, over the rows in shuffled order."""
    rng = np.random.default_rng(seed)
    size = N_STATS + BUCKETS
    linear, factors = np.zeros(size), rng.normal(0, 0.05, (size, rank))
    if len(rows) == 0:
        return FactorisationMachine(0.0, linear, np.zeros((size, rank)))
    bias = 0.0
    g_bias, g_lin, g_fac = 1.0, np.ones(size), np.ones((size, rank))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            index, x = rows[i]
            f = factors[index]
            v = f * x[:, None]
            s = v.sum(axis=0)
            z = bias + linear[index] @ x + 0.5 * (s @ s - (v * v).sum())
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            d_lin = err * x + penalty * linear[index]
            d_fac = err * (x[:, None] * s - f * (x * x)[:, None]) + penalty * f
            g_bias += err * err
            g_lin[index] += d_lin * d_lin
            g_fac[index] += d_fac * d_fac
            bias -= rate * err / np.sqrt(g_bias)
            linear[index] -= rate * d_lin / np.sqrt(g_lin[index])
            factors[index] -= rate * d_fac / np.sqrt(g_fac[index])
    return FactorisationMachine(float(bias), linear, factors)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept("quality").clear()
    for batch in batches:
        made = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "label": batch.column("label"),
            "index": pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())),
            "value": pa.array([v for _, v in made], pa.list_(pa.float64()))})


def train(texts: DataFrame, labels: DataFrame, label_col: str = "quality",
          label_id: str = "doc_id", held_out: int = 0,
          per_class: int = SAMPLE_PER_CLASS) -> FactorisationMachine:
    """Fits the machine on the labelled rows of ``texts`` outside fold ``held_out``."""
    known = (labels.select(F.col(label_id).alias("_id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("_id").isNotNull() & F.col("label").isNotNull()
                    & (fold_of("_id") != held_out))
             .groupBy("_id").agg(F.min("label").alias("label")))
    order = [F.xxhash64("_id"), F.col("_id")]
    sample = (known.where("label = 0").orderBy(*order).limit(per_class)
              .unionByName(known.where("label <> 0").orderBy(*order).limit(per_class)))
    rows = (texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # 2 x per_class rows
            .select("doc_id", "label", "text")
            .mapInArrow(_featurise, schema_with(
                texts, "label int", "index array<int>", "value array<double>"))
            .collect())
    rows.sort(key=lambda r: (str(r.doc_id), r.label, r["index"], r["value"]))
    data = [(np.array(r["index"]), np.array(r["value"])) for r in rows]
    return fit(data, np.array([min(1, r.label) for r in rows], dtype=float))


def classify(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id",
             text_col: str = "text", threshold: float = THRESHOLD,
             whole: bool = False) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` in 0 to 1, ``predicted`` 0 or 1; with ``whole`` also
    the complete input row as ``row``."""
    texts = id_and_text(docs, id_col, text_col, whole)
    shared = texts.sparkSession.sparkContext.broadcast(model)
    keep = ("doc_id", "row") if whole else ("doc_id",)
    texts, text_of = sent(texts, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("quality").clear()
        machine = shared.value
        for batch in batches:
            scores = [machine.score(*features(t.as_py())) for t in text_of(batch)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep}
                                             | {"score": pa.array(scores, pa.float64())})

    scored = texts.mapInArrow(run, schema_with(texts, "score double", keep=keep))
    return scored.select(
        "doc_id", (fold_of() == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), *keep[1:])


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(id_and_text(docs), table(spark, sf_dir, "labels"))
    return classify(docs, model)
