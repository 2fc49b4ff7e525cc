r"""LM scoring with a smoothed bigram model in Elias-Fano tries.

Tokens are the words ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased, then one end token;
the end token is also the context of the first word. With ``c`` the counts in the training
documents, ``N`` all training tokens and ``V`` the distinct ones,

    P(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))                     the base
    P(w | u) = c(u, w) / (c(u) + MU) + MU / (c(u) + MU) * P(w)      the model

so both sum to one over the vocabulary and one unknown word, and a context never seen leaves
the base. The first term is what a trie holds, quantised downwards in steps of 0.04 in log10.

How it runs. The documents are read once and written as *chunks*: the distinct word hashes of a
few thousand documents, and the texts as numbers into them. Then two rounds of packed requests,
each one shuffle of one row per chunk and shard:

1. Words. A shard holds a range of word hashes, sums the chunks' training counts and answers
   with the total counts. Its summary gives ``N``, ``V`` and the words with more than
   ``SHARD_TOKENS`` occurrences.
2. Word pairs. A shard holds a range of contexts. It sums the pairs, builds its trie and looks the
   chunks' pairs up in it, context by context. A context that is more frequent than
   ``SHARD_TOKENS`` is split by ranges of its successors over several shards, so that no shard
   grows with the frequency of a word; there are at most tokens / SHARD_TOKENS such words.

The chunks then meet their answers and add up the scores of their documents. Every step works on
all documents; what is sent grows with the input, what a task holds does not: a chunk or a shard.
The driver sees a row of totals and the list of frequent words. All steps in between are staged
in shared storage, where a lost executor's tasks read them again. The tries are among them, as
rows of the second round's answers. The query does not map them: a shard's trie is asked in the
task that builds it, from the bytes in memory. ``NgramTrie.open`` is for a trie saved as a file.

The model ends at order 2; longer contexts are not in the score of any document.

Words are identified by 64-bit hashes, successors in a trie by 40 bits of them.

Edge cases: null and empty texts are one end token; without training documents all counts are 0
and both scores follow the formulas; whole texts count, however long (one is never cut between
chunks); repeated rows count and are scored each; a null id counts as the empty text for the
fold (remainder 0: training); an empty table gives an empty result. Only id and text are read,
so other columns cannot clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voucherlens.llm.common import id_and_text, table
from voucherlens.llm.elias_fano import (
    CONTEXT_BITS,
    SUCCESSOR_BITS,
    NgramTrie,
    probability,
)
from voucherlens.llm.hashing import SPACE_WORDS, U64, constants, slices
from voucherlens.staging import Stage

FOLDS, HELD_OUT = 5, 1
MU = 2000.0
CHUNK_BYTES = 8 << 20
SHARD_TOKENS = 2_000_000
END = constants(99, 1)[0]  # the hash of the end token
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Integers as zstd-compressed byte planes, small numbers cost little."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    head = np.array([len(values), values.dtype.itemsize], dtype=np.int64).tobytes()
    return head + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def unpack(data: bytes, dtype) -> np.ndarray:
    n, size = (int(x) for x in np.frombuffer(data[:16], np.int64))
    if n == 0:
        return np.zeros(0, dtype)
    raw = np.frombuffer(_ZSTD.decompress(data[16:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(dtype)


def is_held_out(doc_id) -> bool:
    text = "" if doc_id is None else str(doc_id)
    return zlib.crc32(text.encode()) % FOLDS == HELD_OUT


# -- chunks ---------------------------------------------------------------------------------

def _chunk(ids: pa.Array, hashes: list[np.ndarray], lengths: np.ndarray) -> dict:
    """Row of a chunk: documents of ``lengths`` tokens (end included) with token ``hashes``."""
    words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
    held = np.array([is_held_out(i) for i in ids.to_pylist()], dtype=bool)
    learn = np.repeat(~held, lengths)
    counts = np.bincount(tokens[learn], minlength=len(words)).astype(np.int32)
    return {"chunk": uuid.uuid4().hex, "ids": ids, "held": held, "lengths": lengths,
            "end": int(np.searchsorted(words, END)), "tokens": pack(tokens.astype(np.int32)),
            "words": words.tobytes(), "counts": pack(counts)}


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        column, ids = batch.column("text"), batch.column("doc_id")
        first, hashes, lengths, size = 0, [], [], 0
        for a, b, texts in slices(column):
            starts, ends, before = texts.words(SPACE_WORDS)
            h = texts.span_hash(texts.prefix(lower=True), starts, ends)
            # One end token behind the words of each document.
            hashes.append(np.insert(h, before[1:], END))
            lengths.append(np.diff(before) + 1)
            size += len(texts.buf)
            if size >= CHUNK_BYTES or b == len(column):
                yield _chunk(ids.slice(first, b - first), hashes, np.concatenate(lengths))
                first, hashes, lengths, size = b, [], [], 0


def chunks(docs: DataFrame, stage: Stage) -> DataFrame:
    """The staged chunks of ``doc_id``, ``text``. A chunk's name is fixed by the staging."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("chunk", T.StringType()), T.StructField("ids", T.ArrayType(id_type)),
        *T.StructType.fromDDL("held array<boolean>, lengths array<int>, end int, tokens binary, "
                              "words binary, counts binary, n_tokens bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks_of(batches):
            yield pa.RecordBatch.from_pydict({
                "chunk": [c["chunk"]],
                "ids": pa.ListArray.from_arrays(pa.array([0, len(c["ids"])], pa.int32()),
                                                c["ids"]),
                "held": pa.array([c["held"]], pa.list_(pa.bool_())),
                "lengths": pa.array([c["lengths"].astype(np.int32)], pa.list_(pa.int32())),
                "end": pa.array([c["end"]], pa.int32()), "tokens": [c["tokens"]],
                "words": [c["words"]], "counts": [c["counts"]],
                "n_tokens": pa.array([int(c["lengths"].sum())], pa.int64())})

    return stage(docs.mapInArrow(run, schema), "chunks")


# -- round 1: words -------------------------------------------------------------------------

def shard_starts(words: np.ndarray, shards: int) -> np.ndarray:
    """Cuts sorted hashes at the borders of ``shards`` equal ranges: shards + 1 places."""
    borders = [(k << 64) // shards for k in range(1, shards)]
    inner = np.searchsorted(words, np.array(borders, dtype=U64))
    return np.concatenate([[0], inner, [len(words)]]).astype(np.int64)


def _word_requests(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(c) for c in ("chunk", "words", "counts")),
                                            strict=True):
                words = np.frombuffer(words.as_py(), U64)
                counts = unpack(counts.as_py(), np.int32)
                cut = shard_starts(words, shards)
                own = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(own.astype(np.int32)),
                    "chunk": [chunk.as_py()] * len(own),
                    "words": [words[cut[k]:cut[k + 1]].tobytes() for k in own],
                    "counts": [pack(counts[cut[k]:cut[k + 1]]) for k in own]})
    return run


_ANSWER = "chunk string, round int, shard int, part int, data binary, n bigint, v bigint"


def _answer(chunk: list, rnd: int, shard: list, part: list, data: list, n: list, v: list) -> pa.Table:
    return pa.Table.from_pydict({
        "chunk": pa.array(chunk, pa.string()), "round": pa.array([rnd] * len(chunk), pa.int32()),
        "shard": pa.array(shard, pa.int32()), "part": pa.array(part, pa.int32()),
        "data": pa.array(data, pa.binary()), "n": pa.array(n, pa.int64()),
        "v": pa.array(v, pa.int64())})


def _count_words(frequent: int):
    def run(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(w.as_py(), U64) for w in group.column("words")]
        counts = [unpack(c.as_py(), np.int32) for c in group.column("counts")]
        words, where = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts])[:-1]
        answers = [pack(total[w]) for w in np.split(where, ends)]
        shard = group.column("shard")[0].as_py()
        many = total > frequent
        often = np.concatenate([words[many].view(np.int64), total[many]])
        n = len(answers)
        return _answer(
            [*group.column("chunk").to_pylist(), None], 1, [shard] * (n + 1), [0] * (n + 1),
            [*answers, often.tobytes()], [None] * n + [int(total.sum())],
            [None] * n + [int((total > 0).sum())])
    return run


class Totals(NamedTuple):
    """``n`` training tokens, ``v`` distinct ones, and the frequent words with their counts."""

    n: int
    v: int
    often: np.ndarray
    often_counts: np.ndarray


# -- round 2: pairs -------------------------------------------------------------------------

def context_key(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U64(64 - CONTEXT_BITS)


def successor_key(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U64(64 - SUCCESSOR_BITS)


def _previous(tokens: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    prev = np.empty_like(tokens)
    prev[1:] = tokens[:-1]
    prev[np.cumsum(lengths) - lengths] = end
    return prev


def _split(often_counts: np.ndarray, frequent: int) -> np.ndarray:
    """Into how many shards each frequent context goes."""
    return -(-often_counts // max(1, frequent))


def _pair_requests(shards: int, frequent: int, shared):
    """Requests of a chunk: per shard its contexts, the number of their successors, those
    successors and their training counts. Frequent contexts have shards behind the others."""
    def pieces(words, tokens, lengths, held, end, totals: Totals):
        size = len(words)
        pair = _previous(tokens, lengths, end).astype(np.int64) * size + tokens
        learn = np.repeat(~held, lengths)
        keys = np.unique(pair)
        learnt, n = np.unique(pair[learn], return_counts=True)
        counts = np.zeros(len(keys), dtype=np.int32)
        counts[np.searchsorted(keys, learnt)] = n
        first, second = keys // size, keys % size
        often = np.isin(words, totals.often)
        hot = often[first]
        plain = first[~hot], second[~hot], counts[~hot]
        for k, (a, b) in enumerate(_ranges(plain[0], shard_starts(words, shards))):
            if b > a:
                yield k, *(x[a:b] for x in plain)
        base = shards + np.concatenate([[0], np.cumsum(_split(totals.often_counts, frequent))])
        for i in np.flatnonzero(often):
            k = int(np.searchsorted(totals.often, words[i]))
            fan = int(base[k + 1] - base[k])
            own = slice(*np.searchsorted(first, [i, i + 1]))  # pairs are in order of context
            for j, (a, b) in enumerate(_ranges(second[own], shard_starts(words, fan))):
                if b > a:
                    yield int(base[k]) + j, *(x[own][a:b] for x in (first, second, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals(*shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                get = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                words = np.frombuffer(get["words"], U64)
                out = {c: [] for c in ("shard", "contexts", "lengths", "successors", "counts")}
                for k, i, j, n in pieces(
                        words, unpack(get["tokens"], np.int32), np.array(get["lengths"]),
                        np.array(get["held"], dtype=bool), get["end"], totals):
                    which, lengths = np.unique(i, return_counts=True)
                    out["shard"].append(k)
                    out["contexts"].append(context_key(words[which]).tobytes())
                    out["lengths"].append(pack(lengths.astype(np.int32)))
                    keys = successor_key(words[j])
                    five = keys.view(np.uint8).reshape(-1, 8)[:, :5]
                    out["successors"].append(five.tobytes())
                    out["counts"].append(pack(n))
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array(out.pop("shard"), pa.int32()),
                     "chunk": pa.array([get["chunk"]] * len(out["counts"]), pa.string())}
                    | {k: pa.array(v, pa.binary()) for k, v in out.items()})
    return run


def _ranges(sorted_values: np.ndarray, borders: np.ndarray) -> list[tuple[int, int]]:
    at = np.searchsorted(sorted_values, borders)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _successors(data: bytes) -> np.ndarray:
    five = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), dtype=np.uint8)
    out[:, :5] = five
    return out.reshape(-1).view(U64)


def _answer_pairs(shards: int, frequent: int, mu: float, shared):
    def run(group: pa.Table) -> pa.Table:
        totals = Totals(*shared.value)
        shard = group.column("shard")[0].as_py()
        asked = [(np.frombuffer(c.as_py(), U64), unpack(n.as_py(), np.int32), _successors(s.as_py()),
                  unpack(k.as_py(), np.int32))
                 for c, n, s, k in zip(*(group.column(x) for x in (
                     "contexts", "lengths", "successors", "counts")), strict=True)]
        context = np.concatenate([np.repeat(c, n) for c, n, _, _ in asked])
        successor = np.concatenate([s for _, _, s, _ in asked])
        count = np.concatenate([k for _, _, _, k in asked])
        seen = np.flatnonzero(count)
        seen = seen[np.lexsort((successor[seen], context[seen]))]
        context, successor, count = context[seen], successor[seen], count[seen].astype(np.int64)
        new = np.ones(len(seen), dtype=bool)
        new[1:] = (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])
        first = np.flatnonzero(new)
        count = np.add.reduceat(count, first) if len(first) else count
        context, successor = context[first], successor[first]
        if shard < shards:  # the whole context is here: its count is the sum over successors
            _, which = np.unique(context, return_inverse=True)
            total = np.bincount(which, weights=count)[which] if len(which) else count
        else:
            base = np.cumsum(_split(totals.often_counts, frequent)) + shards
            total = float(totals.often_counts[np.searchsorted(base, shard, side="right")])
        data = NgramTrie.build(context, successor, np.log10(count / (total + mu)))
        trie = NgramTrie.from_bytes(data)
        codes = [pack(trie.find(c, n, s)) for c, n, s, _ in asked]
        n = len(codes)
        return _answer([*group.column("chunk").to_pylist(), None], 2, [shard] * (n + 1),
                       [0] * (n + 1), [*codes, data], [None] * (n + 1), [None] * (n + 1))
    return run


# -- scores ---------------------------------------------------------------------------------

def _score(mu: float, shards: int, frequent: int, shared):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        totals = Totals(*shared.value)
        get = {c: chunk.column(c)[0].as_py() for c in ("lengths", "end", "tokens", "held")}
        ids = pa.concat_arrays(chunk.column("ids").chunks).flatten()
        lengths, tokens = np.array(get["lengths"]), unpack(get["tokens"], np.int32)
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("round", "shard", "data")),
                          strict=True), key=lambda r: r[:2])
        c = np.concatenate([unpack(d, np.int64) for r, _, d in rows if r == 1])
        plain = [unpack(d, np.uint8) for r, k, d in rows if r == 2 and k < shards]
        often = [unpack(d, np.uint8) for r, k, d in rows if r == 2 and k >= shards]
        prev = _previous(tokens, lengths, get["end"])
        keys, which = np.unique(prev.astype(np.int64) * len(c) + tokens, return_inverse=True)
        hot = c[keys // len(c)] > frequent
        codes = np.zeros(len(keys), dtype=np.uint8)
        # Shards are ranges of hashes and so are the chunk's numbers: answers come in order.
        codes[~hot] = np.concatenate([*plain, np.zeros(0, np.uint8)])
        codes[hot] = np.concatenate([*often, np.zeros(0, np.uint8)])
        base = (c + 0.5) / (totals.n + 0.5 * (totals.v + 1))
        context = c[prev].astype(float)
        p = probability(codes)[which] + mu / (context + mu) * base[tokens]
        starts = np.cumsum(lengths) - lengths
        return pa.Table.from_pydict({
            "doc_id": ids, "held_out": pa.array(get["held"], pa.bool_()),
            "n_tokens": pa.array(lengths.astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((c[tokens] > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(lengths), totals.n, dtype=np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10(base)[tokens], starts)),
            "score": pa.array(np.add.reduceat(np.log10(p), starts))})
    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU,
              shard_tokens: int = SHARD_TOKENS, stage: Stage | None = None) -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``. The staged table ``pair_answers`` holds the tries (rows
    without a chunk)."""
    spark = docs.sparkSession
    stage = stage or Stage(spark)
    texts = id_and_text(docs, id_col, text_col)
    made = chunks(texts, stage)
    tokens = made.agg(F.sum("n_tokens")).first()[0] or 0
    shards = int(tokens // shard_tokens) + 1
    words = stage(
        made.select("chunk", "words", "counts")
        .mapInArrow(_word_requests(shards), "shard int, chunk string, words binary, counts binary")
        .groupBy("shard").applyInArrow(_count_words(shard_tokens), _ANSWER), "word_answers")
    summary = words.where("chunk is null").select("n", "v", "data").collect()  # one row a shard
    often = [np.frombuffer(r.data, np.int64).reshape(2, -1) for r in summary]
    often = np.concatenate([np.zeros((2, 0), np.int64), *often], axis=1)
    order = np.argsort(often[0].view(U64))
    totals = Totals(sum(r.n for r in summary), sum(r.v for r in summary),
                    often[0].view(U64)[order], often[1][order])
    shared = spark.sparkContext.broadcast(tuple(totals))  # at most tokens / shard_tokens words
    pairs = stage(
        made.select("chunk", "words", "tokens", "lengths", "held", "end")
        .mapInArrow(_pair_requests(shards, shard_tokens, shared),
                    "shard int, chunk string, contexts binary, lengths binary, "
                    "successors binary, counts binary")
        .groupBy("shard").applyInArrow(_answer_pairs(shards, shard_tokens, mu, shared), _ANSWER), "pair_answers")
    answers = (words.unionByName(pairs).where("chunk is not null")
               .select("chunk", "round", "shard", "data"))
    schema = T.StructType([
        T.StructField("doc_id", texts.schema["doc_id"].dataType),
        *T.StructType.fromDDL("held_out boolean, n_tokens bigint, n_known bigint, "
                              "train_tokens bigint, base_score double, score double").fields])
    return (made.select("chunk", "ids", "held", "lengths", "end", "tokens").groupBy("chunk")
            .cogroup(answers.groupBy("chunk"))
            .applyInArrow(_score(mu, shards, shard_tokens, shared), schema))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
