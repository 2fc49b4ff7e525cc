r"""Suffix-array dedup: removes every byte of a 200-byte string that also starts somewhere else.

Only few of all suffixes need sorting. In every 200-byte string the 32-byte piece with the least
hash (the leftmost of equals) is its *anchor*; equal strings have the same anchor at the same
place. So positions that are the anchor of some string, about one byte in 85, are enough: two
equal strings show as two anchors with equal pieces whose texts agree to the left and right over
200 bytes in all. The *context* of an anchor are the 168 bytes before and the 200 from it on, as
far as the document goes.

1. Anchors are counted by piece; pieces that occur once are done.
2. Anchors with repeated pieces are counted by context. Equal contexts are repeated as a whole.
3. One context of each kind, where a piece has several kinds, goes to the sort: buckets of pieces,
   in each of which right and reversed left contexts are put in order by deep-shallow sorting
   (:mod:`deep_shallow`), which is the suffix order at the anchors with its common prefix lengths.
   For i = 0..168 the string that starts i bytes before an anchor is repeated if another
   anchor of the piece is in the same run of the right order at length 200 - i and in the same run
   of the left order at length i. The least and the largest such i bound what is removed.
4. A piece with more than ``HOT_CONTEXTS`` kinds of context (a passage put into very many
   documents, say) is not given to one task: its strings are hashed one by one (128 bits) and
   counted, with a combine before the shuffle. The result is the same.
5. Removed ranges go back to the distinct texts, are merged and cut out.

Scale: texts cross the network as distinct compressed texts, only those with a repeated
piece go on; anchors cross as a few numbers. Counts combine before the shuffle, joins are such that
AQE can split, no task holds a piece, context or text group. Distinct texts are known by 80 bits
of hash, contexts by 128 (64 of the piece, 64 of the context).

Edge cases: a null text is empty; texts under 200 bytes lose nothing as nothing fits in them;
texts are bytes throughout, a cut may fall inside a character; matches never cross documents;
overlapping repeats inside one document count; rows with equal text are copies of each other
whatever their ids, null ids included; an empty table gives an empty result. Only id and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import id_and_text, table
from voucherlens.llm.deep_shallow import deep_shallow_sort
from voucherlens.llm.hashing import U64, Texts, concat_ranges, mix, slices
from voucherlens.staging import Stage

LENGTH = 200
PIECE = 32
HOT_CONTEXTS = 20_000
BUCKET_CONTEXTS = 40_000

_ZSTD = pa.Codec("zstd", compression_level=1)
_KEY = ["t1", "t2"]


# -- anchors --------------------------------------------------------------------------------

def _least_in_window(h: np.ndarray, window: int) -> np.ndarray:
    """For each start the place of the least of the next ``window`` hashes, leftmost first.

    Doubling: windows of 1, 2, 4, ... and in the end two overlapping ones.
    """
    at = np.arange(len(h))
    best, size = h, 1

    def join(best, at, step):
        n = len(best) - step
        right = best[step:step + n] < best[:n]
        return (np.where(right, best[step:step + n], best[:n]),
                np.where(right, at[step:step + n], at[:n]))

    while 2 * size <= window:
        best, at = join(best, at, size)
        size *= 2
    if size < window:
        best, at = join(best, at, window - size)
    return at


class Anchors:
    """Anchors of the documents of a slice: document, place in it, piece and context hashes."""

    def __init__(self, texts: Texts, length: int = LENGTH, piece: int = PIECE):
        n, offs = len(texts.buf), texts.offs
        self.doc = self.at = np.zeros(0, dtype=np.int64)
        self.piece = self.context = np.zeros(0, dtype=U64)
        strings = np.diff(offs) - length + 1  # strings that start in each document
        if n < length or not (strings > 0).any():
            return
        prefix = texts.prefix()
        start = np.arange(n - piece + 1)
        h = texts.span_hash(prefix, start, start + piece)
        least = _least_in_window(h, length - piece + 1)
        inside = concat_ranges(offs[:-1], np.maximum(strings, 0))
        found = np.zeros(n, dtype=bool)
        found[least[inside]] = True
        at = np.flatnonzero(found)
        self.doc = np.searchsorted(offs, at, side="right") - 1
        left = np.maximum(offs[self.doc], at - (length - piece))
        right = np.minimum(offs[self.doc + 1], at + length)
        with np.errstate(over="ignore"):
            self.context = mix(texts.span_hash(prefix, left, at) * U64(0x9E3779B97F4A7C15)
                               + texts.span_hash(prefix, at, right))
        self.piece = h[at]
        self.at = at - offs[self.doc]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _pieces(length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column("text")):
                yield pa.RecordBatch.from_pydict({"piece": _long(Anchors(texts, length, piece).piece)})
    return run


def _occurrences(length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY)
            for a, _, texts in slices(batch.column("text")):
                x = Anchors(texts, length, piece)
                yield pa.RecordBatch.from_pydict({
                    "piece": _long(x.piece), "context": _long(x.context),
                    "t1": pa.array(t1[a + x.doc]), "t2": pa.array(t2[a + x.doc]),
                    "at": pa.array(x.at.astype(np.int32))})
    return run


# -- contexts -------------------------------------------------------------------------------

def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({
            "t1": batch.column("t1"), "t2": batch.column("t2"),
            "body": pa.array([_squeeze(t.as_py()) for t in batch.column("text")], pa.binary())})


def _squeeze(text: str) -> bytes:
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def _unsqueeze(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return _ZSTD.decompress(data[8:], n, asbytes=True) if n else b""


def _cut_contexts(length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("piece", "context", "copies", "hot", "left", "right")}
            for body, asked in zip(batch.column("body"), batch.column("asked"), strict=True):
                raw = _unsqueeze(body.as_py())
                for x in asked.as_py():
                    at = x["at"]
                    for c in ("piece", "context", "copies", "hot"):
                        out[c].append(x[c])
                    out["left"].append(raw[max(0, at - (length - piece)):at])
                    out["right"].append(raw[at:at + length])
            yield pa.RecordBatch.from_pydict({
                "piece": pa.array(out["piece"], pa.int64()),
                "context": pa.array(out["context"], pa.int64()),
                "copies": pa.array(out["copies"], pa.int64()),
                "hot": pa.array(out["hot"], pa.bool_()),
                "left": pa.array(out["left"], pa.binary()),
                "right": pa.array(out["right"], pa.binary())})
    return run


def repeated_starts(left: list[bytes], right: list[bytes], groups: np.ndarray,
                    length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """For each context the least and the largest i such that the string starting i bytes before
    the anchor also occurs at another context of its group; (1, 0) if there is none."""
    n = len(left)
    reach = length - piece
    r_order, r_lcp = deep_shallow_sort(right, groups, length)
    l_order, l_lcp = deep_shallow_sort([s[::-1] for s in left], groups, reach)
    least, largest = np.ones(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    found = np.zeros(n, dtype=bool)
    r_run, l_run = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i in range(reach + 1):
        # Runs of equal prefixes: a new one begins where the common prefix is too short.
        r_run[r_order] = np.cumsum(r_lcp < length - i)
        l_run[l_order] = np.cumsum(l_lcp < i)
        key = r_run * (n + 1) + l_run
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.zeros(n + 1, dtype=bool)
        same[1:-1] = k[1:] == k[:-1]
        hit = order[same[1:] | same[:-1]]
        least[hit] = np.where(found[hit], least[hit], i)
        largest[hit] = i
        found[hit] = True
    return least, largest


def _sort_bucket(length: int, piece: int):
    def run(group: pa.Table) -> pa.Table:
        pieces = group.column("piece").to_numpy()
        _, groups = np.unique(pieces, return_inverse=True)
        least, largest = repeated_starts(group.column("left").to_pylist(),
                                         group.column("right").to_pylist(), groups, length, piece)
        return pa.Table.from_pydict({
            "piece": group.column("piece"), "context": group.column("context"),
            "least": pa.array(least), "largest": pa.array(largest)})
    return run


def _hash_strings(length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                some = batch.slice(row, 256)
                out = {c: [] for c in ("piece", "context", "i", "h1", "h2")}
                for p, c, left, right in zip(*(some.column(x).to_pylist() for x in (
                        "piece", "context", "left", "right")), strict=True):
                    whole = left + right
                    # Piece and place belong to the key: a string lies in the contexts of several
                    # anchors of its own text, which must not count as occurrences.
                    seed = hashlib.blake2b(p.to_bytes(8, "little", signed=True), digest_size=16)
                    for i in range(max(0, length - len(right)), min(len(left), length - piece) + 1):
                        state = seed.copy()
                        state.update(i.to_bytes(4, "little"))
                        state.update(whole[len(left) - i:len(left) - i + length])
                        d = state.digest()
                        out["piece"].append(p)
                        out["context"].append(c)
                        out["i"].append(i)
                        out["h1"].append(int.from_bytes(d[:8], "little", signed=True))
                        out["h2"].append(int.from_bytes(d[8:], "little", signed=True))
                yield pa.RecordBatch.from_pydict({
                    k: pa.array(v, pa.int32() if k == "i" else pa.int64()) for k, v in out.items()})
    return run


# -- removal --------------------------------------------------------------------------------

def merge_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of non-empty ranges; ranges that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return starts[first], ends[np.concatenate([first[1:], [len(starts)]])[:len(first)] - 1]


def _remove(length: int, piece: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("removed", "spans", "sha", "kept")}
            for body, found in zip(batch.column("body"), batch.column("found"), strict=True):
                raw = _unsqueeze(body.as_py())
                rows = found.as_py()
                at = np.array([x["at"] for x in rows], dtype=np.int64)
                least = np.array([x["least"] for x in rows], dtype=np.int64)
                largest = np.array([x["largest"] for x in rows], dtype=np.int64)
                # The whole context, of which more than the string must be there.
                largest = np.minimum(largest, np.minimum(at, length - piece))
                least = np.maximum(least, length - np.minimum(length, len(raw) - at))
                ok = least <= largest
                a, b = merge_ranges((at - largest)[ok], (at + length - least)[ok])
                kept, last = [], 0
                for s, e in zip(a.tolist(), b.tolist(), strict=True):
                    kept.append(raw[last:s])
                    last = e
                kept = b"".join([*kept, raw[last:]])
                out["removed"].append(len(raw) - len(kept))
                out["spans"].append(np.stack([a, b], axis=1).ravel())
                out["sha"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if keep else None)
            yield pa.RecordBatch.from_pydict({
                "t1": batch.column("t1"), "t2": batch.column("t2"),
                "removed": pa.array(out["removed"], pa.int64()),
                "spans": pa.array(out["spans"], pa.list_(pa.int64())),
                "sha": pa.array(out["sha"], pa.string()),
                "kept": pa.array(out["kept"], pa.binary())})
    return run


def _text_key() -> list[Column]:
    second = F.xxhash64(F.lit(1), F.col("text"))
    return [F.xxhash64("text").alias("t1"), F.shiftright(second, 48).cast("smallint").alias("t2")]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 length: int = LENGTH, piece: int = PIECE, hot_contexts: int = HOT_CONTEXTS,
                 keep_bytes: bool = False, stage: Stage | None = None) -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (starts and ends in
    turn), ``kept_sha256``, and with ``keep_bytes`` the remaining bytes as ``kept``."""
    stage = stage or Stage(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col).select("doc_id", "text", *_text_key())
    reach = length - piece

    # 1. repeated pieces
    pieces = texts.select("text").mapInArrow(_pieces(length, piece), "piece bigint")
    repeated = stage(pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
                     .where("n > 1").select("piece"), "repeated_pieces")
    anchors = stage(
        texts.select("text", *_KEY)
        .mapInArrow(_occurrences(length, piece),
                    "piece bigint, context bigint, t1 bigint, t2 smallint, at int")
        .join(repeated, "piece", "left_semi"), "anchors")

    # 2. kinds of context
    kinds = stage(anchors.groupBy("piece", "context").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*_KEY, "at")).alias("of")), "contexts")
    mixed = (kinds.groupBy("piece").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
             .select("piece", (F.col("kinds") > hot_contexts).alias("hot")))
    asked = stage(kinds.join(mixed, "piece").select(
        "of.*", "piece", "context", "copies", "hot"), "asked")

    # distinct texts with a repeated piece
    bodies = (texts.select("text", *_KEY)
              .mapInArrow(_compress, "t1 bigint, t2 smallint, body binary")
              .groupBy(*_KEY).agg(F.first("body").alias("body")))
    bodies = stage(bodies.join(anchors.select(*_KEY).distinct(), _KEY, "left_semi"), "bodies")

    # 3. and 4. what of each kind is repeated
    wanted = asked.groupBy(*_KEY).agg(F.collect_list(
        F.struct("at", "piece", "context", "copies", "hot")).alias("asked"))  # anchors of a text
    cut = stage(bodies.join(wanted, _KEY).mapInArrow(
        _cut_contexts(length, piece), "piece bigint, context bigint, copies bigint, hot boolean, "
        "left binary, right binary"), "cut_contexts")
    buckets = int(cut.where("not hot").count() // BUCKET_CONTEXTS) + 1
    sorted_ = (cut.where("not hot").select("piece", "context", "left", "right")
               .groupBy(F.pmod(F.xxhash64("piece"), F.lit(buckets)).alias("bucket"))
               .applyInArrow(_sort_bucket(length, piece),
                             "piece bigint, context bigint, least int, largest int"))
    strings = cut.where("hot").select("piece", "context", "left", "right").mapInArrow(
        _hash_strings(length, piece), "piece bigint, context bigint, i int, h1 bigint, h2 bigint")
    several = (strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
               .select("h1", "h2"))
    counted = (strings.join(several, ["h1", "h2"], "left_semi").groupBy("piece", "context")
               .agg(F.min("i").alias("least"), F.max("i").alias("largest")))
    single = stage(sorted_.unionByName(counted).where("least <= largest"), "repeated_parts")

    # 5. back to the texts: kinds with copies are repeated as a whole
    whole = kinds.where("copies > 1").select(
        "piece", "context", F.lit(0).alias("least"), F.lit(reach).alias("largest"))
    parts = stage(whole.unionByName(single.join(
        kinds.where("copies > 1").select("piece", "context"), ["piece", "context"], "left_anti")),
        "repeated")
    found = (anchors.join(parts, ["piece", "context"]).groupBy(*_KEY)
             .agg(F.collect_list(F.struct("at", "least", "largest")).alias("found")))
    done = stage(bodies.join(found, _KEY).mapInArrow(
        _remove(length, piece, keep_bytes),
        "t1 bigint, t2 smallint, removed bigint, spans array<bigint>, sha string, kept binary"),
        "removed")
    rows = texts.select(
        "doc_id", *_KEY, F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("own_sha"),
        *([F.col("text").cast("binary").alias("own")] if keep_bytes else []))
    joined = rows.join(done, _KEY, "left")
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"),
        (F.coalesce(F.size("spans"), F.lit(0)) / 2).cast("long").alias("n_spans"),
        F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"),
        F.coalesce("sha", "own_sha").alias("kept_sha256"),
        *([F.coalesce("kept", "own").alias("kept")] if keep_bytes else []))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")
