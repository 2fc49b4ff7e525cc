r"""Benchmark decontamination by Wu-Manber search over words.

Texts and benchmark items are lower-cased (A-Z) and cut into words, the runs of
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``. A window is ten consecutive words of an item; an item of
fewer words is one window. The windows are the patterns, words the symbols, two words a block:

* the shift table holds for each block how far the search may jump when the block ends at the
  current word; a block in no pattern allows the whole ``length - 1`` words;
* where the shift is 0, the bucket of the patterns that end with this block is looked up;
* its candidates are compared word by word, so hashes decide nothing.

Patterns of one length share a table; an item shorter than ten words has a table of its length.

Scale: documents are scanned where they lie, without a shuffle. The items are collected only in
blocks of at most ``block_bytes`` of text: their sizes are summed by Spark first, and a larger
benchmark is searched block after block, with the hits of each document merged in the end.

Edge cases: a null text has no words and is not contaminated; a null or wordless item has no
window; equal items all count as occurring; a null item id counts as an empty id; repeated
document rows are searched one by one; an empty benchmark or an empty table gives zero hits or
no rows. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import id_and_text, kept, schema_with, sent, table
from voucherlens.staging import Stage

WINDOW = 10
BLOCK_BYTES = 32 << 20

# The bytes that separate words; upper-case letters become lower-case ones.
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b
              for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text as UTF-8 bytes; separators become spaces, so split() finds them."""
    return text.encode().translate(_FOLD).split()


class WuManber:
    """Patterns of one length, each a tuple of words with the items it belongs to."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.buckets[pattern[length - self.block:]].append((list(pattern), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(place of the first word, items) for every occurrence of a pattern."""
        n, m, shift, default = len(words), self.length, self.shift.get, self.default
        at = m - 1
        if self.block == 1:
            for at, w in enumerate(words):
                for _, items in self.buckets.get((w,), ()):
                    yield at, items
            return
        while at < n:
            block = (words[at - 1], words[at])
            jump = shift(block, default)
            if jump:
                at += jump
                continue
            for pattern, items in self.buckets[block]:
                if words[at - m + 1:at + 1] == pattern:
                    yield at - m + 1, items
            at += 1


def compile_items(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    """One searcher per pattern length, from (item id, text) pairs."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = words_of(text)
        length = min(window, len(words))
        if length:
            for i in range(len(words) - length + 1):
                by_length[length][tuple(words[i:i + length])].add(item_id)
    return [WuManber(k, dict(v)) for k, v in sorted(by_length.items())]


def hits(words: list[bytes], searchers: list[WuManber]) -> tuple[list[list[int]], set[str]]:
    """Merged ranges [from, to) of hit words, and the items that occur."""
    found, ids = [], set()
    for s in searchers:
        for at, items in s.search(words):
            found.append((at, at + s.length))
            ids |= items
    return merge(found), ids


def merge(ranges) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, ranges)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _finish(columns: dict, rows: list[tuple[int, list[list[int]], set[str]]]) -> pa.RecordBatch:
    lists = [sorted(ids) for _, _, ids in rows]
    return pa.RecordBatch.from_pydict(columns | {
        "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
        "n_hit": pa.array([sum(b - a for a, b in r) for _, r, _ in rows], pa.int64()),
        "ranges": pa.array([[x for ab in r for x in ab] for _, r, _ in rows],
                           pa.list_(pa.int64())),
        "items": pa.array(lists, pa.list_(pa.string()))})


_RESULT = ("n_words bigint", "n_hit bigint", "ranges array<bigint>", "items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                  stage: Stage | None = None, whole: bool = False) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, the hit word ``ranges`` and the ``items`` found;
    with ``whole`` also the complete input row as ``row``."""
    texts = id_and_text(docs, id_col, text_col, whole)
    keep = ("doc_id", "row") if whole else ("doc_id",)
    items = id_and_text(benchmark, item_col, item_text).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    if blocks == 1:
        return _search(texts, text_col, items, window, keep)
    # More than one pass: rows get a number that ties the passes together.
    stage = stage or Stage(docs.sparkSession)
    numbered = stage(texts.withColumn("number", F.monotonically_increasing_id()), "numbered")
    found = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        one = _search(numbered.drop("row"), text_col, part, window, ("number",))
        found = one if found is None else found.unionByName(one)
    grouped = found.groupBy("number").agg(
        F.max("n_words").alias("n_words"),
        F.collect_list("ranges").alias("ranges"),  # one entry per block
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, ranges, ids in zip(b.column("n_words").to_pylist(),
                                      b.column("ranges").to_pylist(),
                                      b.column("items").to_pylist(), strict=True):
                flat = [(r[i], r[i + 1]) for r in ranges for i in range(0, len(r), 2)]
                rows.append((n, merge(flat), set(ids)))
            yield _finish({"number": b.column("number")}, rows)

    merged = grouped.mapInArrow(together, schema_with(grouped, *_RESULT, keep=("number",)))
    return numbered.select("number", *keep).join(merged, "number").drop("number")


def _search(texts: DataFrame, text_col: str, items: DataFrame, window: int,
            keep: tuple[str, ...]) -> DataFrame:
    rows = [(r.item, r.text) for r in items.collect()]  # a block: bounded by block_bytes
    shared = texts.sparkSession.sparkContext.broadcast(rows)
    compiled: list[list[WuManber]] = []
    texts, text_of = sent(texts, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("decontamination").clear()
        if not compiled:
            compiled.append(compile_items(shared.value, window))
        for batch in batches:
            done = []
            for text in text_of(batch):
                words = words_of(text.as_py())
                done.append((len(words), *hits(words, compiled[0])))
            yield _finish({c: batch.column(c) for c in keep}, done)

    return texts.mapInArrow(scan, schema_with(texts, *_RESULT, keep=keep))


def sha256_hex(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
