r"""Secret scan: fixed patterns, and two character Markov models compared by likelihood ratio.

Fixed patterns find what is named or shaped like a secret. The models find what merely looks
random. Each character of a run of the key alphabet gets the log-likelihood ratio of a Markov model
of random strings against one of ordinary identifiers, less a threshold. A segment whose sum is
``MIN_EXCESS`` or more becomes a span of kind ``markov``, alone or inside a path, a dotted name or
beside a fixed match: it begins where the sum last left zero, ends at its highest sum before falling
by ``MIN_EXCESS``, and is widened to the ends of the letters and digits around it. It has to have
16 characters then. One pass finds all such segments, as the part after a highest sum holds none.
Fixed matches belong to no such span, nor do UUIDs, which name things and are not reported.

Training: the labelled sample are the runs of a bounded sample of documents (those whose id
hashes below a limit set so that about ``sample_docs`` are expected). Values matched by a fixed
pattern are labelled random, other runs of four or more characters ordinary. Spark counts the
character pairs of both labels; the driver sees the two tables of counts, 67 by 67 numbers
however large the corpus is. After a character that was seen rarely, a model backs off to its
frequencies of single characters, of which a little (``MIX``) is mixed in everywhere; a hundredth
goes to all characters alike, so that a separator that neither label has speaks for none of them. Without
anything to learn from a model is uniform.

Edge cases: null and empty texts have no spans; whole texts are scanned; positions are code
points, the end exclusive; rows are scanned one by one, so repeated rows get equal results; a
null id is treated as the empty text when sampling; an empty table gives an empty result. Only
id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import id_and_text, schema_with, table

# The base patterns. The letters of the names are spelt out in both cases,
# because ignoring case would also accept the Kelvin sign for k and the long s for s.
_NAMES = ("password", "passwd", "secret", "token")


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" for c in name)


ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, _NAMES)) + "|" + _either_case("api") + "_?"
    + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more; runs are matched whole
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])")
WORD_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{4,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
START = len(ALPHABET)  # the state before the first character
SAMPLE_DOCS = 4000
MIN_PER_CHAR = 0.5
MIN_EXCESS = 10.0   # of the ratio over MIN_PER_CHAR, summed over a segment
MIN_LENGTH = 16
BACK_OFF = 5.0
UNSEEN, MIX = 0.01, 0.005   # shares of any character, and of a character whatever stands before it

_CODES = np.zeros(256, dtype=np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping in a kind."""
    out = []
    low = text.lower()  # at least the texts with a name contain it in lower case
    if any(n in low for n in _NAMES) or "key" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def pairs(run: str) -> np.ndarray:
    """Indices of the character pairs of a run into a flattened table of counts."""
    codes = _CODES[np.frombuffer(run.encode("ascii"), dtype=np.uint8)]
    before = np.empty_like(codes)
    before[0], before[1:] = START, codes[:-1]
    return before * len(ALPHABET) + codes


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


class RandomnessModel:
    """Log-likelihood ratios per character pair, from counts of both labels."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        shape = (len(ALPHABET) + 1, len(ALPHABET))

        def logs(counts: np.ndarray) -> np.ndarray:
            pair = counts.reshape(shape)
            # The same floor in both models: what neither has seen tells nothing.
            single = pair.sum(axis=0)
            single = (1 - UNSEEN) * single / max(1.0, single.sum()) + UNSEEN / len(ALPHABET)
            single /= single.sum()
            c = pair + BACK_OFF * single  # rare contexts go by the characters alone
            return np.log((1 - MIX) * c / c.sum(axis=1, keepdims=True) + MIX * single)

        self.ratio = (logs(random) - logs(ordinary)).ravel()

    def segments(self, run: str) -> list[tuple[int, int]]:
        """The parts of a run that look random, widened to whole words of letters and digits;
        parts that meet in a word are one."""
        excess = self.ratio[pairs(run)] - MIN_PER_CHAR
        total = np.concatenate([[0.0], np.cumsum(excess)])
        if len(run) < MIN_LENGTH or (total - np.minimum.accumulate(total)).max() < MIN_EXCESS:
            return []
        out: list[tuple[int, int]] = []

        def add(start: int, end: int) -> None:
            past = out[-1][1] if out else 0
            if end <= past:
                return
            if start < past:  # it begins in the word that the last one was widened to
                start = out.pop()[0]
            while start > 0 and run[start].isalnum() and run[start - 1].isalnum():
                start -= 1
            while end < len(run) and run[end].isalnum() and run[end - 1].isalnum():
                end += 1
            if end - start >= MIN_LENGTH:
                out.append((start, end))

        start, top, end, s = 0, 0.0, 0, 0.0
        for at, x in enumerate(excess.tolist(), 1):
            s += x
            if s > top:
                top, end = s, at
            elif s <= 0 or s <= top - MIN_EXCESS:
                if top >= MIN_EXCESS:
                    add(start, end)
                start, top, end, s = at, 0.0, at, 0.0
        if top >= MIN_EXCESS:
            add(start, end)
        return out

    def is_secret(self, run: str) -> bool:
        return bool(self.segments(run))

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """What looks random beside the fixed matches and UUIDs, in order of its start."""
        out: list[tuple[int, int, int]] = []
        taken: list[tuple[int, int]] | None = None
        next_taken = 0
        for m in RUN.finditer(text):
            if taken is None:
                taken = sorted([(s, e) for s, _, e in base] + [u.span() for u in UUID.finditer(text)])
            at = m.start()
            while next_taken < len(taken) and taken[next_taken][0] < m.end():
                s, e = taken[next_taken]
                if s > at:
                    out += [(at + a, 3, at + b) for a, b in self.segments(text[at:s])]
                at = max(at, e)
                if e > m.end():
                    break  # it may reach into the next run
                next_taken += 1
            if at < m.end():
                out += [(at + a, 3, at + b) for a, b in self.segments(text[at:m.end()])]
        return out


_SIZE = (len(ALPHABET) + 1) * len(ALPHABET)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, _SIZE), dtype=np.int64)
    for batch in batches:
        for text in batch.column("text"):
            text = text.as_py()
            secret = base_spans(text)
            rest, at = [], 0
            for s, k, e in secret:
                value = ASSIGN.match(text, s).group(2) if k == 0 else text[s:e]
                np.add.at(counts[1], pairs(value), 1)
                if s >= at:
                    rest.append(text[at:s])
                at = max(at, e)
            rest.append(text[at:])
            runs = WORD_RUN.findall(" ".join(rest))
            if runs:
                np.add.at(counts[0], np.concatenate([pairs(r) for r in runs]), 1)
    label, pair = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict({
        "label": pa.array(label.astype(np.int32)), "pair": pa.array(pair.astype(np.int32)),
        "n": pa.array(counts[label, pair])})


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> RandomnessModel:
    """The two models, learnt from about ``sample_docs`` documents of ``doc_id``, ``text``."""
    buckets = 1 << 30
    total = max(1, docs.count())
    bound = buckets if total <= sample_docs else max(1, buckets * sample_docs // total)
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)) < bound)
    rows = (picked.select("text")
            .mapInArrow(_count_pairs, "label int, pair int, n bigint")
            .groupBy("label", "pair").agg(F.sum("n").alias("n")).collect())  # 2 x 67 x 66 at most
    counts = np.zeros((2, _SIZE))
    for r in rows:
        counts[r.label, r.pair] = r.n
    return RandomnessModel(counts[1], counts[0])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 model: RandomnessModel | None = None) -> DataFrame:
    """Per row: the fixed spans (``base``) and all spans (``spans``), each ``kind:start:end``
    by start, then kind, joined by commas, and the counts per kind."""
    texts = id_and_text(docs, id_col, text_col)
    model = model or train(texts)
    fields = [f"n_{k} bigint" for k in KINDS]
    schema = schema_with(texts, *fields, "base string", "spans string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base_out, all_out = [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                base = base_spans(text)
                spans = sorted(base + model.spans(text, base))
                kinds = [k for _, k, _ in spans]
                counts.append([kinds.count(k) for k in range(len(KINDS))])
                base_out.append(joined(base))
                all_out.append(joined(spans))
            columns = {"doc_id": batch.column("doc_id")}
            for i, k in enumerate(KINDS):
                columns[f"n_{k}"] = pa.array([c[i] for c in counts], pa.int64())
            columns["base"] = pa.array(base_out, pa.string())
            columns["spans"] = pa.array(all_out, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return texts.mapInArrow(scan, schema)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
                        "spans", "n_markov")
