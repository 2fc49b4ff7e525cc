r"""Source divergence audit: how far the words of a source are from those of the others.

Per language the kept terms are those in at least ``MIN_DOCS`` of its documents. A group is a
(language, source) that occurs; it and the language as a whole give each kept term the smoothed
share ``p = 1 + floor(SCALE * (count + 1) / (N + V))``. The divergence of two shares is
``f(p, q) = floor((p - q)^2 / q)``. Part ``pair`` sums f over all kept terms for every two sources
of a language, part ``term`` lists the terms a group uses more than its language, by f.

*Single-pass in-memory indexing.* A task counts the terms of its documents into a block of postings
until ``POSTINGS`` of them are in memory, then spills it: a run, sorted by term, cut by term hash
into shards and rows of ``BLOCK`` terms. Per shard the rows come in the order of their first term,
and a heap merges them: a row is opened when the merge reaches its first term, so what is in memory
are the rows around the current term, not the shard. The merged frequencies of kept terms are
staged, one row a term.

*Pair corrections.* Most terms are missing from most sources, where they all have the same share
p0. The sum over all terms is V f(p0, q0); plus, for the terms that one of the two has, what that
changes, which follows from the histogram of the counts of that source alone; plus, for terms that both have,
``f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)``. Only the last needs the terms: they are streamed
once, shard by shard behind the totals of their language, and corrections are added up in tables
that are handed on when they have ``CELLS`` entries.

Scale: one shuffle of combined counts (a term crosses once a run, whatever its frequency) and one
of kept terms; shards are hashes of terms, so no language, source or word makes one task large.
Sums are whole numbers throughout (counts beyond 9 * 10^9 in Python's own). The result has a row for each two sources
of a language, as its definition wants. Set ``spark.sql.shuffle.partitions`` to the size of the input:
it is the number of shards.

Edge cases: null text, language and source count as ''; groups without terms have N = 0 and take
part; with V = 0 the pairs have value 0 and there are no terms; repeated rows are documents of
their own; texts are read whole; ties in value go by the UTF-8 bytes of the item; an empty table
gives an empty result. Only the three columns are read, so others cannot clash.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voucherlens.llm.common import ship, table
from voucherlens.llm.hashing import concat_ranges
from voucherlens.staging import Stage

# Fixed values of the definition.
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200

POSTINGS = 600_000
BLOCK = 4096
PAIRS = 1 << 20
CELLS = 1 << 20
SALTS = 16

# Terms are runs of letters and of anything beyond ASCII; only A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))

_RUN = ("shard int, lang string, first binary, terms array<binary>, docs array<bigint>, "
        "sizes array<int>, names array<string>, source array<int>, count array<bigint>")
_KEPT = "shard int, lang string, term string, source array<string>, count array<bigint>"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Block:
    """Postings in memory: per language the documents of a term, per source its occurrences."""

    def __init__(self) -> None:
        self.size = 0
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.count: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def add(self, lang: str, source: str, text: str) -> None:
        terms = terms_of(text)
        if terms:
            counts = self.count[lang][source]
            self.size -= len(counts)
            counts.update(terms)
            self.size += len(counts)
            self.docs[lang].update(set(terms))

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The block as rows: sorted by term within a shard and language."""
        for lang, by_source in self.count.items():
            docs = self.docs[lang]
            ordered = sorted(docs)
            shard = np.fromiter(map(zlib.crc32, ordered), np.int64, len(ordered)) % shards
            by_shard = np.argsort(shard, kind="stable")
            shard = shard[by_shard]
            terms = [ordered[i] for i in by_shard.tolist()]
            place = dict(zip(terms, range(len(terms))))
            n_docs = np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms))
            term = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c))
                                   for c in by_source.values()])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c))
                                    for c in by_source.values()])
            source = np.repeat(np.arange(len(by_source)), [len(c) for c in by_source.values()])
            by_term = np.argsort(term, kind="stable")
            yield from _rows(lang, shard, terms, n_docs, list(by_source), term[by_term],
                             source[by_term], count[by_term])


def _rows(lang: str, shard: np.ndarray, terms: list[bytes], docs: np.ndarray, names: list[str],
          term: np.ndarray, source: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Terms in the order of (shard, term), with their postings, as rows of at most ``BLOCK`` terms
    and with the names of the sources that occur in them."""
    edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(terms)]
    cuts = sorted({c for a, b in zip(edges, edges[1:]) for c in range(a, b, BLOCK)} | {len(terms)})
    sizes = np.bincount(term, minlength=len(terms))
    upto = np.searchsorted(term, cuts)
    used, places = [], []
    for a, b in zip(upto, upto[1:]):
        own, at = np.unique(source[a:b], return_inverse=True)
        used.append([names[i] for i in own])
        places.append(at)

    def lists(values: pa.Array, offsets: object) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    n = len(cuts) - 1
    yield pa.RecordBatch.from_arrays([
        pa.array(shard[cuts[:-1]], pa.int32()), pa.array([lang] * n, pa.string()),
        pa.array([terms[c] for c in cuts[:-1]], pa.binary()), lists(pa.array(terms, pa.binary()), cuts),
        lists(pa.array(docs), cuts), lists(pa.array(sizes, pa.int32()), cuts), pa.array(used, pa.list_(pa.string())),
        lists(pa.array(np.concatenate(places), pa.int32()), upto), lists(pa.array(count), upto)],
        schema=_RUN_ARROW)


def _batches(rows: Iterator[dict], schema: pa.Schema, per_batch: int) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == per_batch:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


_RUN_ARROW = pa.schema([
    ("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()),
    ("terms", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
    ("names", pa.list_(pa.string())), ("source", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))])
_KEPT_ARROW = pa.schema([
    ("shard", pa.int32()), ("lang", pa.string()), ("term", pa.string()),
    ("source", pa.list_(pa.string())), ("count", pa.list_(pa.int64()))])


def runs(texts: DataFrame, shards: int, postings: int = POSTINGS) -> DataFrame:
    """Columns ``lang, source, text`` (no nulls) as sorted runs."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                block.add(lang.as_py(), source.as_py(), text.as_py())
                if block.size >= postings:
                    yield from block.run(shards)
                    block = Block()
        yield from block.run(shards)

    return texts.select("lang", "source", "text").mapInArrow(index, _RUN)


def merge(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int, dict[str, int]]]:
    """Heap-merges run rows (as :func:`_opened` gives them) in the order of (shard, lang, first
    term).

    Gives ((shard, lang, term), documents, {source: count}) in that order.
    """
    heap: list[tuple] = []
    last, docs, counts = None, 0, {}

    def cursor(key: tuple, terms: list, n_docs: list, sizes: list, postings: Iterator) -> Iterator[tuple]:
        for term, n, size in zip(terms, n_docs, sizes):
            yield (*key, term), n, list(islice(postings, size))

    def smallest(below: tuple | None) -> Iterator[tuple]:
        while heap and (below is None or heap[0][0] < below):
            _, number, found, rest = heap[0]
            yield found
            following = next(rest, None)
            if following is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (following[0], number, following, rest))

    def entries() -> Iterator[tuple]:
        for number, (key, terms, *columns) in enumerate(rows):
            yield from smallest((*key, terms[0]))
            rest = cursor(key, terms, *columns)
            head = next(rest)
            heapq.heappush(heap, (head[0], number, head, rest))
        yield from smallest(None)

    for key, n, postings in entries():
        if key != last:
            if last is not None:
                yield last, docs, counts
            last, docs, counts = key, n, dict(postings)
        else:
            docs += n
            for name, count in postings:
                counts[name] = counts.get(name, 0) + count
    if last is not None:
        yield last, docs, counts


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Run rows as ((shard, lang), terms, documents, sizes, postings (source, count))."""
    for b in batches:
        shard, lang, _, terms, docs, sizes, names, source, count = b.columns
        for i in range(b.num_rows):
            own = names[i].as_py()
            each = map(own.__getitem__, source[i].values.to_numpy().tolist())
            yield ((shard[i].as_py(), lang[i].as_py()), terms[i].as_py(),
                   docs[i].values.to_numpy().tolist(), sizes[i].values.to_numpy().tolist(),
                   zip(each, count[i].values.to_numpy().tolist()))


def frequencies(spilled: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """The merged runs: a row for each term in at least ``min_docs`` documents of its language."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((*key, counts) for key, docs, counts in merge(_opened(batches)) if docs >= min_docs)
        while part := list(islice(found, BLOCK)):
            offsets = pa.array(np.cumsum([0, *(len(p[3]) for p in part)]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([p[0] for p in part], pa.int32()), pa.array([p[1] for p in part], pa.string()),
                pa.array([p[2] for p in part], pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array([x for p in part for x in p[3]], pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array([x for p in part for x in p[3].values()], pa.int64()))],
                schema=_KEPT_ARROW)

    dealt = spilled.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "lang", "first")
    return dealt.mapInArrow(kept, _KEPT)


def share(count: Column, total: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / total)``, exact for any count; null for total 0."""
    scaled = (count + F.lit(1)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + _div(scaled, F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def group_totals(groups: DataFrame, kept: DataFrame, histogram: DataFrame) -> DataFrame:
    """Per group ``n`` (occurrences of kept terms), ``v`` (kept terms of its language), the share
    ``p0`` of a term it does not have, and ``n_lang``."""
    n = histogram.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("n"))
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    n_lang = n.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    zero = {"n": 0, "v": 0, "n_lang": 0}
    full = (groups.join(n, ["lang", "source"], "left").join(v, "lang", "left")
            .join(n_lang, "lang", "left").fillna(zero))
    return full.withColumn("p0", share(F.lit(0).cast("long"), F.col("n") + F.col("v")))


def one_sided(histogram: DataFrame, totals: DataFrame) -> DataFrame:
    """What the terms of one source alone change, for every two sources: ``lang, source, item,
    value``.

    The histogram meets each distinct p0 of the other sources, not each source. The languages are
    salted: one of them may hold most rows.
    """
    stats = totals.select("lang", "source", "n", "v", "p0")
    h = (histogram.join(stats, ["lang", "source"])
         .withColumn("p", share(F.col("count"), F.col("n") + F.col("v")))
         .withColumn("salt", F.pmod(F.xxhash64("source", "count"), F.lit(SALTS))))
    others = (totals.select("lang", F.col("p0").alias("q0")).distinct()
              .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))))
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    terms = F.col("terms").cast("decimal(19,0)")
    sums = (h.join(others, ["lang", "salt"]).groupBy("lang", "source", "q0").agg(
        F.sum((divergence(p, q0) - divergence(p0, q0)) * terms).alias("as_first"),
        F.sum((divergence(q0, p) - divergence(q0, p0)) * terms).alias("as_second")))
    # q0 is the other side's share of what it lacks
    mine = sums.select("lang", F.col("source").alias("_s"), "q0", "as_first", "as_second")
    other = totals.select("lang", F.col("source").alias("_o"), F.col("p0").alias("q0"))
    met = mine.join(other, ["lang", "q0"]).where(F.col("_s") != F.col("_o"))
    return met.select("lang", F.inline(F.array(
        F.struct(F.col("_s").alias("source"), F.col("_o").alias("item"), F.col("as_first").alias("value")),
        F.struct(F.col("_o").alias("source"), F.col("_s").alias("item"), F.col("as_second").alias("value")))))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As :func:`share`, in a task."""
    if len(count) and int(count.max()) >= 9 * SCALE:
        big = SCALE * (count.astype(object) + 1) // total
        return 1 + big.astype(np.int64)
    return 1 + SCALE * (count + 1) // total


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Corrections:
    """Sums of the two-sided corrections of one language, handed on when they grow."""

    def __init__(self, lang: str, names: list[str], n: list[int], v: int):
        self.lang, self.names = lang, names
        self.at = {s: i for i, s in enumerate(names)}
        self.total = np.array(n, dtype=np.int64) + v
        self.p0 = shares(np.zeros(len(n), np.int64), self.total) if v else None
        self.source: list[int] = []
        self.count: list[int] = []
        self.sizes: list[int] = []
        self.pairs = 0
        self.cells, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, sources: list[str], counts: list[int]) -> Iterator[dict]:
        k = len(sources)
        if k > 1:
            self.source += [self.at[s] for s in sources]
            self.count += counts
            self.sizes.append(k)
            self.pairs += k * k
            if self.pairs >= PAIRS:
                self.settle()
                if len(self.cells) >= CELLS:
                    yield from self.rows()

    def settle(self) -> None:
        """Turns the postings held into sums per pair, a stretch of postings at a time."""
        if not self.sizes:
            return
        s = np.array(self.source, np.int64)
        p = shares(np.array(self.count, np.int64), self.total[s])
        size = np.array(self.sizes, np.int64)
        start = np.repeat(np.cumsum(size) - size, size)  # of the term of each posting
        width = np.repeat(size, size)
        upto, at = np.cumsum(width), 0
        while at < len(s):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            i = np.repeat(np.arange(at, to), width[at:to])
            j = concat_ranges(start[at:to], width[at:to])
            i, j = i[i != j], j[i != j]
            a, b = s[i], s[j]
            both = (_f(p[i], p[j]) - _f(p[i], self.p0[b]) - _f(self.p0[a], p[j])
                    + _f(self.p0[a], self.p0[b]))
            self._sum(a * len(self.names) + b, both)
            at = to
        self.source, self.count, self.sizes, self.pairs = [], [], [], 0

    def _sum(self, cells: np.ndarray, values: np.ndarray) -> None:
        cells = np.concatenate([self.cells, cells])
        values = np.concatenate([self.sums, values])
        self.cells, place = np.unique(cells, return_inverse=True)
        self.sums = np.zeros(len(self.cells), np.int64)
        np.add.at(self.sums, place, values)

    def rows(self) -> Iterator[dict]:
        self.settle()
        for cell, value in zip(self.cells.tolist(), self.sums.tolist()):
            a, b = divmod(cell, len(self.names))
            yield {"lang": self.lang, "source": self.names[a], "item": self.names[b], "value": value}
        self.cells, self.sums = self.cells[:0], self.sums[:0]


_PAIR_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()),
                         ("value", pa.int64())])


def two_sided(kept: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """Corrections of the terms that two sources share: ``lang, source, item, value``."""
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    head = totals.select(shard, "lang", F.lit(None).cast("string").alias("term"),
                         F.array("source").alias("source"), F.array("n", "v").alias("count"))
    stream = (head.unionByName(kept.where(F.size("source") > 1))
              .repartitionById(shards, F.col("shard"))
              .sortWithinPartitions("shard", "lang", F.col("term").isNotNull()))

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            at, names, n, v, sums = None, [], [], 0, None
            for b in batches:
                for r in b.to_pylist():
                    if (r["shard"], r["lang"]) != at:
                        if sums:
                            yield from sums.rows()
                        at, names, n, sums = (r["shard"], r["lang"]), [], [], None
                    if r["term"] is None:  # the totals of a language come before its terms
                        names += r["source"]
                        n.append(r["count"][0])
                        v = r["count"][1]
                        continue
                    if sums is None:
                        sums = Corrections(r["lang"], names, n, v)
                    yield from sums.add(r["source"], r["count"])
            if sums:
                yield from sums.rows()

        yield from _batches(found(), _PAIR_ARROW, 10_000)

    return stream.mapInArrow(correct, "lang string, source string, item string, value bigint")


def pair_part(kept: DataFrame, histogram: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language."""
    a = totals.select("lang", "source", "v", "p0")
    b = totals.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    wide = "decimal(38,0)"
    base = (a.join(b, "lang").where(F.col("source") != F.col("item"))
            .select("lang", "source", "item",
                    F.coalesce(F.col("v").cast("decimal(18,0)") * divergence(F.col("p0"), F.col("q0")),
                               F.lit(0)).cast(wide).alias("value")))
    parts = [one_sided(histogram, totals), two_sided(kept, totals, shards)]
    for p in parts:
        base = base.unionByName(p.withColumn("value", F.col("value").cast(wide)))
    return base.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def term_part(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the terms a group uses more than its language."""
    each = (kept.withColumn("n_all", F.aggregate("count", F.lit(0).cast("long"), lambda a, x: a + x))
            .select("lang", "term", "n_all",
                    F.inline(F.arrays_zip(F.col("source").alias("source"), F.col("count").alias("count")))))
    p = share(F.col("count"), F.col("n") + F.col("v"))
    q = share(F.col("n_all"), F.col("n_lang") + F.col("v"))
    return (each.join(totals.drop("p0"), ["lang", "source"])
            .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
            .where(F.col("p") > F.col("q"))
            .select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value")))


def source_divergence(docs: DataFrame, stage: Stage, lang_col: str = "lang", source_col: str = "source",
                      text_col: str = "text", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
                      postings: int = POSTINGS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of both parts."""
    spark = docs.sparkSession
    ship(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def text(c: str, name: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)

    own = docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text"))
    groups = stage(own.select("lang", "source").distinct(), "groups")
    kept = stage(frequencies(runs(own, shards, postings), shards, min_docs), "frequencies")
    histogram = stage(
        kept.select("lang", F.inline(F.arrays_zip("source", "count")))
        .groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("terms")), "histogram")
    totals = stage(group_totals(groups, kept, histogram), "totals")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_part(kept, histogram, totals, shards).withColumn("rank", rank)
    terms = term_part(kept, totals).withColumn("rank", rank).where(F.col("rank") <= top_terms)
    return (pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
            .select("lang", "source", "part", "item", "value", "rank"))


def op11_source_divergence(spark, sf_dir: str, stage: Stage | None = None) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), stage or Stage(spark))


OP11_SQL = rf"""
WITH own AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
words AS (
  SELECT row, lang, source,
         unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM own),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {MIN_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM own),
vocabulary AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
found AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
totals AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total
  FROM groups g LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source GROUP BY g.lang, g.source),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(f.n, 0) AS n,
         1 + ({SCALE}::HUGEINT * (coalesce(f.n, 0) + 1)) // (t.total + v.v) AS p
  FROM totals t JOIN vocabulary v USING (lang) JOIN kept k USING (lang)
  LEFT JOIN found f ON f.lang = t.lang AND f.source = t.source AND f.term = k.term),
lang_shares AS (
  SELECT f.lang, f.term,
         1 + ({SCALE}::HUGEINT * (sum(f.n)::HUGEINT + 1))
             // (any_value(t.total) + any_value(v.v)) AS q
  FROM found f JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM totals GROUP BY lang) t USING (lang)
  JOIN vocabulary v USING (lang) GROUP BY f.lang, f.term),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
terms AS (
  SELECT a.lang, a.source, a.term AS item, ((a.p - q) * (a.p - q) // q)::BIGINT AS value
  FROM shares a JOIN lang_shares USING (lang, term) WHERE a.n > 0 AND a.p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT * FROM (
  SELECT lang, source, part, item, value,
         row_number() OVER (PARTITION BY lang, source, part
                            ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM ranked)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
