r"""Hard-negative mining: bounds along spanning trees of anchors.

Anchors are some of the rows. An anchor's positives are the other rows of its label with the highest scores;
for each of them the negatives are the rows of other labels with the highest scores in a window
relative to the positive's, ``low * positive <= 100 * negative <= high * positive``. A score is
the inner product of the whole-number vectors. Ties go to the smaller id.

*Spanning-tree bounds.* Anchors are put in groups of at most ``GROUP`` near each other (by label, then
along a fixed direction), and each group gets its minimum spanning tree. At the root all
candidates x of a block are scored. Along an edge of length d from parent p to child c,

    s(p, x) - d |x| <= s(c, x) <= s(p, x) + d |x|,

where an interval stands for s(p, x) if x was not scored at p. At the child only the candidates whose interval
overlaps the window (from the lowest score that can still enter a list to the highest that a
window allows) are scored again. The lists fill up block by block, which raises the lower end.

Scale: rows and anchor groups are packed into blocks once and staged. The anchors are a query set
that meets all rows in blocks: the rows are dealt to parts, the groups to buckets of about
``BUCKET`` groups, and a task takes one part and one bucket: it holds the bucket's groups and
streams the part's blocks past them. So a row is copied once for every ``GROUP * BUCKET`` anchors, an anchor
once for every part, and no task holds more than a bucket and a block; labels of any size and groups of
equal vectors change nothing in that. A task hands on a few rows for each positive, which are
ranked by anchor. Both passes (positives, then negatives) go this way.

Scores are exact: in floating point where the norms prove that no sum can pass 2^53, else in 64-bit
integers; a score that might not fit into a long is an error.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component take no
part; shorter vectors count as ending in zeros; "other" means another id; rows that repeat an id
count each, equal anchor rows once; positives with a score below 0 have an empty window; an empty
table gives an empty result. Only the three columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voucherlens.llm.common import ship, table
from voucherlens.staging import Stage

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90          # percent of the positive's score
GROUP, BUCKET = 512, 32     # anchors of a tree, groups of a bucket
ROWS, PART_BLOCKS = 4096, 256

_BLOCK = ("ids array<bigint>, labels array<bigint>, dim int, width int, vectors binary, "
          "parent array<int>, distance array<double>")
_BLOCK_ARROW = pa.schema([
    ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("dim", pa.int32()),
    ("width", pa.int32()), ("vectors", pa.binary()), ("parent", pa.list_(pa.int32())),
    ("distance", pa.list_(pa.float64()))])


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                  label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """``id, label, vector`` of the rows that take part; components are ``floor(scale * x)``."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                     F.col(f"`{label_col}`").cast("long").alias("label"),
                     F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    ok = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
          & F.forall("vector", finite))
    return rows.where(ok).withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(scale) * x)))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of whole numbers; short rows end in zeros."""
    sizes = np.array(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    dim = int(sizes.max(initial=0))
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _pack(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, parent: np.ndarray | None = None,
          distance: np.ndarray | None = None) -> dict:
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return {"ids": ids, "labels": labels, "dim": x.shape[1], "width": width,
            "vectors": x.astype(f"<i{width}").tobytes(),
            "parent": parent, "distance": distance}


def _unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array(r["ids"], np.int64)
    x = np.frombuffer(r["vectors"], dtype=f"<i{r['width']}").reshape(len(ids), r["dim"])
    return ids, np.array(r["labels"], np.int64), x


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield pa.RecordBatch.from_pylist([_pack(
                part.column("id").to_numpy(), part.column("label").to_numpy(),
                _matrix(part.column("vector")))], schema=_BLOCK_ARROW)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree of some points: their order (parents first), the parent of
    each in that order (-1 for the root) and the length of the edge to it."""
    n = len(x)
    order, parent, length = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    place, near, link = np.full(n, -1), np.full(n, np.inf), np.zeros(n, np.int64)
    at = 0
    for step in range(n):
        order[step], place[at] = at, step
        if step:
            parent[step], length[step] = place[link[at]], near[at]
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = (d < near) & (place < 0)
        near[closer], link[closer] = d[closer], at
        near[at] = np.inf
        at = int(np.argmin(np.where(place < 0, near, np.inf)))
    return order, parent, length


def _pack_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows).combine_chunks()
    ids, labels = t["id"].to_numpy(), t["label"].to_numpy()
    x = _matrix(t["vector"].combine_chunks())
    direction = np.random.default_rng(1).normal(size=x.shape[1])
    near = np.lexsort((ids, x @ direction, labels))
    for own in np.array_split(near, -(-len(near) // GROUP)):
        order, parent, length = spanning_tree(x[own].astype(float))
        own = own[order]
        yield pa.RecordBatch.from_pylist(
            [_pack(ids[own], labels[own], x[own], parent, length)], schema=_BLOCK_ARROW)


def _wide(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices of whole numbers as a type in which their inner products are exact."""
    dim = max(a.shape[1], b.shape[1])
    a, b = _wide(a, dim), _wide(b, dim)
    most = _norms(a).max(initial=0) * _norms(b).max(initial=0)  # no partial sum is larger
    if most >= 2.0 ** 62:
        raise ValueError("a score might not fit into a long")
    kind = np.float64 if most < 2.0 ** 52 else np.int64
    return a.astype(kind), b.astype(kind)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(axis=1))


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score, then by id."""
    if len(score) > 4 * k:  # leave out what cannot be among them
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


class PositiveLists:
    """The best rows of the own label for each anchor of a group."""

    def __init__(self, group: dict):
        self.key, (self.ids, self.labels, self.x) = group["group"], _unpack(group)
        self.score = [np.zeros(0, np.int64)] * len(self.ids)
        self.found = [np.zeros(0, np.int64)] * len(self.ids)

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        for label in np.unique(self.labels):
            rows, own = np.flatnonzero(labels == label), np.flatnonzero(self.labels == label)
            if len(rows) == 0:
                continue
            a, b = comparable(self.x[own], x[rows])
            scores = (a @ b.T).astype(np.int64)
            for i, s in zip(own, scores):
                other = np.flatnonzero(ids[rows] != self.ids[i])
                if len(self.score[i]) == POSITIVES:
                    other = other[s[other] >= self.score[i][-1]]
                if len(other):
                    s = np.concatenate([self.score[i], s[other]])
                    found = np.concatenate([self.found[i], ids[rows][other]])
                    best = _first(s, found, POSITIVES)
                    self.score[i], self.found[i] = s[best], found[best]

    def rows(self) -> Iterator[dict]:
        for i, (s, found) in enumerate(zip(self.score, self.found)):
            for score, other in zip(s.tolist(), found.tolist()):
                yield {"group": self.key, "node": i, "positive_id": other, "positive_score": score}


class NegativeLists:
    """For each positive of each anchor of a group, the first rows of other labels in its window."""

    def __init__(self, group: dict):
        self.key, (self.ids, self.labels, self.x) = group["group"], _unpack(group)
        self.parent, self.distance = np.array(group["parent"]), np.array(group["distance"])
        self.children = np.bincount(self.parent[self.parent >= 0], minlength=len(self.ids))
        self.rescored = self.met = 0
        self.windows: list[list[dict]] = [[] for _ in self.ids]
        for p in group["positives"] or ():
            low, high = -(-LOW * p["positive_score"] // 100), HIGH * p["positive_score"] // 100
            if low <= high:
                self.windows[p["node"]].append({
                    **p, "low": low, "high": high,
                    "score": np.zeros(0, np.int64), "found": np.zeros(0, np.int64)})

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        anchors, rows = comparable(self.x, x)
        norms = _norms(x)
        slack = 1 + 1e-9 * norms * _norms(self.x).max(initial=0)  # beyond any rounding
        low, high, waiting = {}, {}, self.children.copy()
        for i, up in enumerate(self.parent):
            if up < 0:
                some = np.arange(len(rows))
                below, above = np.zeros(len(rows)), np.zeros(len(rows))
            else:
                reach = self.distance[i] * norms + slack
                below, above = low[up] - reach, high[up] + reach
                waiting[up] -= 1
                if waiting[up] == 0:
                    del low[up], high[up]
                w = self.windows[i]
                least = min((max(v["low"], v["score"][-1] if len(v["score"]) == NEGATIVES else v["low"])
                             for v in w), default=np.inf)
                most = max((v["high"] for v in w), default=-np.inf)
                some = np.flatnonzero((above >= least) & (below <= most))
                self.rescored, self.met = self.rescored + len(some), self.met + len(rows)
            scores = rows[some] @ anchors[i]
            if self.children[i]:
                below[some] = above[some] = scores
                low[i], high[i] = below, above
            if self.windows[i]:
                self._enter(i, scores.astype(np.int64), ids[some], labels[some])

    def _enter(self, i: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        w = self.windows[i]
        own = ((labels != self.labels[i]) & (scores <= max(v["high"] for v in w))
               & (scores >= min(v["low"] for v in w)))
        scores, ids = scores[own], ids[own]
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        for v in w:
            at = int(np.searchsorted(-scores, -v["high"]))
            s = scores[at:at + NEGATIVES]
            s = s[s >= v["low"]]
            if len(s) == 0 or len(v["score"]) == NEGATIVES and s[0] < v["score"][-1]:
                continue
            s = np.concatenate([v["score"], s])
            found = np.concatenate([v["found"], ids[at:at + len(s) - len(v["score"])]])
            best = _first(s, found, NEGATIVES)
            v["score"], v["found"] = s[best], found[best]

    def rows(self) -> Iterator[dict]:
        for i, windows in enumerate(self.windows):
            for v in windows:
                for score, other in zip(v["score"].tolist(), v["found"].tolist()):
                    yield {"group": self.key, "node": i, "anchor_id": int(self.ids[i]),
                           "positive_rank": v["positive_rank"], "positive_id": v["positive_id"],
                           "positive_score": v["positive_score"],
                           "negative_id": other, "negative_score": score}


def meet_in_blocks(blocks: DataFrame, groups: DataFrame, kind: type, result: pa.Schema, ddl: str,
                   n_parts: int, n_buckets: int) -> DataFrame:
    """Every row block past every anchor group; what the lists of each group hold in the end.

    A task gets the groups of one bucket first and then the blocks of one part, one by one.
    """
    columns = groups.columns
    parts, buckets = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (n_parts, n_buckets))
    left = (groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(n_buckets)).cast("int"))
            .withColumn("part", parts))
    number = F.monotonically_increasing_id()
    right = blocks.withColumn("part", F.pmod(F.shiftright(number, 33) + number, F.lit(n_parts)).cast("int"))
    for c in columns:
        if c not in right.columns:
            right = right.withColumn(c, F.lit(None).cast(groups.schema[c].dataType))
    right = right.withColumn("bucket", buckets)
    task = (F.col("part") * n_buckets + F.col("bucket")).cast("int")
    both = (left.select(*columns, "part", "bucket").unionByName(right.select(*columns, "part", "bucket"))
            .repartitionById(n_parts * n_buckets, task)
            .sortWithinPartitions("part", "bucket", F.col("group").isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list = []
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["group"] is not None:
                    lists.append(kind(r))
                    continue
                block = _unpack(r)
                for own in lists:
                    own.meet(*block)
        for own in lists:
            yield pa.RecordBatch.from_pylist(list(own.rows()), schema=result)

    return both.mapInArrow(run, ddl)


_POSITIVE = "group bigint, node int, positive_id bigint, positive_score bigint"
_POSITIVE_ARROW = pa.schema([("group", pa.int64()), ("node", pa.int32()), ("positive_id", pa.int64()),
                             ("positive_score", pa.int64())])
_NEGATIVE = ("group bigint, node int, anchor_id bigint, positive_rank int, positive_id bigint, "
             "positive_score bigint, negative_id bigint, negative_score bigint")
_NEGATIVE_ARROW = pa.schema([
    ("group", pa.int64()), ("node", pa.int32()), ("anchor_id", pa.int64()), ("positive_rank", pa.int32()),
    ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()),
    ("negative_score", pa.int64())])


def _ranked(df: DataFrame, by: tuple, score: str, other: str, rank: str, most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def hard_negatives(rows: DataFrame, anchors: DataFrame, stage: Stage) -> DataFrame:
    """``rows`` and ``anchors`` as :func:`whole_vectors` gives them; see the top of the module.

    Gives ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score,
    positive_rank``.
    """
    spark = rows.sparkSession
    blocks = stage(rows.mapInArrow(_pack_rows, _BLOCK), "row_blocks")
    chosen = stage(anchors.distinct(), "anchors")
    n_blocks, n_anchors = blocks.count(), chosen.count()
    dealt = chosen.repartitionByRange(max(1, n_anchors // (8 * GROUP)), "label", F.xxhash64("id"))
    groups = stage(dealt.mapInArrow(_pack_groups, _BLOCK)
                   .withColumn("group", F.monotonically_increasing_id()), "anchor_groups")
    n_buckets = max(1, -(-n_anchors // (GROUP * BUCKET)))
    n_parts = max(1, -(-n_blocks // PART_BLOCKS))
    enough = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # tasks for all cores
    n_parts = max(n_parts, min(n_blocks, -(-enough // n_buckets)))

    found = meet_in_blocks(blocks, groups, PositiveLists, _POSITIVE_ARROW, _POSITIVE, n_parts, n_buckets)
    best = _ranked(found, ("group", "node"), "positive_score", "positive_id", "positive_rank", POSITIVES)
    lists = stage(best.groupBy("group").agg(F.collect_list(F.struct(  # POSITIVES an anchor of the group
        "node", "positive_rank", "positive_id", "positive_score")).alias("positives")), "positives")
    known = groups.join(lists, "group")
    negatives = meet_in_blocks(blocks, known, NegativeLists, _NEGATIVE_ARROW, _NEGATIVE, n_parts, n_buckets)
    return _ranked(negatives, ("group", "node", "positive_rank"), "negative_score", "negative_id", "rank",
                   NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                     "negative_score", "positive_rank")


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh id gets the next label, so that some neighbours differ."""
    return rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10)
                           .otherwise(F.col("label")))


def op13_hard_negatives(spark, sf_dir: str, stage: Stage | None = None) -> DataFrame:
    rows = relabelled(whole_vectors(table(spark, sf_dir, "embeddings")))
    return hard_negatives(rows, rows.where(F.col("id") % 100 == 0), stage or Stage(spark))


OP13_SQL = f"""
WITH vectors AS (
  SELECT vec_id::BIGINT AS id,
         CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM (SELECT * FROM vectors WHERE id % 100 = 0) a, vectors b),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS positive_rank
  FROM scored WHERE same AND id <> anchor_id
  QUALIFY positive_rank <= {POSITIVES}),
met AS (
  SELECT p.anchor_id, positive_id, positive_rank, s.id AS negative_id, positive_score,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
    AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score,
       positive_rank::INTEGER AS positive_rank
FROM met WHERE rank <= {NEGATIVES}
"""
