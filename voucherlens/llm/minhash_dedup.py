r"""Near-duplicate groups by MinHash with tensored banding, links confirmed on the full sets.

A document's set are the distinct runs of five words (``[^\x20\x09-\x0D]+``, A-Z lower-cased);
of fewer words, all of them as one run. Documents with equal sets form a class and go on as one.

*Tensored banding.* Two collections of ``n`` bands with ``ROWS`` minhashes each are computed,
``2 * n * ROWS`` minhashes in all. A table key is a pair of bands, one from each collection:
``n ** 2`` tables of ``2 * ROWS`` rows. Computing those tables one by one would take
``2 * ROWS * n ** 2`` minhashes. Bands that no other class shares are left out before the
pairs are formed, since no key with them can be shared. ``n`` follows the threshold
(``bands_for``): two classes right at it share no key with a chance of 3 in 10,000 at most. That
is 12 bands (``BANDS``) for 0.85, where at 0.9 it is about 5 in a million, and 17 for 0.8.

*Verification without all pairs.* In each bucket the members are compared with a leader, the one
with the most neighbours: that links what belongs together in most groups. What remains are
pairs of members of which at least one, x, is not linked to the leader b. Differences from one
leader also tell how two members differ from each other (``relative``), so from here on these
short lists are compared and no texts. With D the shingles a member lacks of b, A those it has
beyond b, and c = |D| + t|A| for threshold t, such a pair is linked only if

    (1 + t) (|Dx & Dy| + |Ax & Ay|) >= cx + cy - (1 - t)|b| > cy,

so a member most of whose differences no other one has is linked with none and is left out, and
of the others y shares more than cy / (1 + t) of its differences with x, hence at least one of
any |Dy| + |Ay| - floor(cy / (1 + t)) of them. An index from the rarest differences to members
finds these pairs (``links_in_group``). One task does that for a leader's group whose differences
are ``GROUP_ELEMENTS`` at most, unless the members met in the index are more than ``GROUP_WORK``.
Other groups are cut into blocks of about ``SMALL`` members and ``BLOCK_ELEMENTS`` differences at
most, and every two blocks are a task. So a group's differences are copied once for each block
and nothing else is written, however many differences its members have in common. This loses no
pair that shares a key.

Scale: all group work is joins that AQE can split and aggregates that combine before the
shuffle; no task gets a bucket, class or component. Texts cross the network once, then only those
of classes that share a key. Every table used twice is staged in shared storage.

Edge cases: null or empty text, or one without words, has an empty set, is linked with nothing
and is its own component; rows with equal id and text are in one component and all of them have
``doc_id = component_id`` or none; ids compare by their own type, a null id is never the
smallest, and a component of null ids only has a null id; an empty table gives an empty result.
Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import id_and_text, schema_with, table
from voucherlens.llm.components import connected_components
from voucherlens.llm.hashing import (
    SPACE_WORDS,
    U64,
    Texts,
    concat_ranges,
    constants,
    mix,
    ngram_hash,
    slices,
)
from voucherlens.staging import Stage

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 12, 4
MISSED = 3e-4  # the chance that a pair right at the threshold shares no key
SMALL = 4096  # members of a block
BLOCK_ELEMENTS = 500_000
GROUP_ELEMENTS = 4_000_000
SLICE_BYTES = 1 << 19  # of texts at once: their shingles take many times as much memory
GROUP_WORK = 30_000_000  # entries of the index met by one group, about ten seconds


def bands_for(percent: int) -> int:
    """The bands of a collection, ``BANDS`` or as many more as keep to ``MISSED``."""
    n, no_band = BANDS, 1 - (percent / 100) ** ROWS
    while 1 - (1 - no_band ** n) ** 2 > MISSED:
        n += 1
    return n


@lru_cache(maxsize=4)
def _hashes(n: int) -> np.ndarray:
    return constants(31, n)


def shingle_sets(texts: Texts, size: int = SHINGLE) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its shingles."""
    starts, ends, before = texts.words(SPACE_WORDS)
    words = texts.span_hash(texts.prefix(lower=True), starts, ends)
    grams = ngram_hash(words, size)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        elif b > a:
            out.append(ngram_hash(words[a:b], b - a))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def bands(shingles: np.ndarray, n: int = BANDS) -> np.ndarray:
    """The 2 * n band hashes: first collection, then second."""
    hashes = _hashes(2 * n * ROWS)
    low = np.full(len(hashes), np.iinfo(np.uint64).max, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):  # memory does not follow the text's length
            part = shingles[i:i + 4096, None] * hashes
            low = np.minimum(low, (part ^ (part >> U64(32))).min(axis=0))
        rows = mix(low.reshape(2 * n, ROWS) + constants(5, ROWS))
        return mix(rows.sum(axis=1, dtype=U64))


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signs = [], [], []
            for _, _, texts in slices(batch.column("text"), SLICE_BYTES):
                for s in shingle_sets(texts):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    signs.append(bands(s, n).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                "n_shingles": pa.array(sizes, pa.int64()),
                "digest": pa.array(digests, pa.binary()),
                "bands": pa.array(signs, pa.list_(pa.int64()))})
    return run


def _table_keys(shared: DataFrame, n: int) -> DataFrame:
    """(key, node): all pairs of a band of the first and one of the second collection."""
    first = F.filter("_b", lambda x: x["i"] < n)
    second = F.filter("_b", lambda x: x["i"] >= n)
    keys = F.flatten(F.transform(first, lambda a: F.transform(
        second, lambda b: F.xxhash64(a["i"], a["band"], b["i"], b["band"]))))
    return shared.select("node", F.explode(keys).alias("key"))


def shared_keys(classes: DataFrame, stage: Stage, n: int = BANDS) -> DataFrame:
    """(key, node) of table keys that at least two classes have, with ``n`` bands a collection."""
    rows = classes.select("node", F.posexplode("bands").alias("i", "band"))
    several = stage(rows.groupBy("i", "band").agg(F.count(F.lit(1)).alias("n"))
                    .where("n > 1").drop("n"), "shared_bands")
    kept = (rows.join(several, ["i", "band"], "left_semi")
            .groupBy("node").agg(F.collect_list(F.struct("i", "band")).alias("_b")))  # <= 2 n
    keys = stage(_table_keys(kept, n), "table_keys")
    return stage(_in_buckets(keys), "buckets")


def _in_buckets(rows: DataFrame) -> DataFrame:
    """(key, node, n): rows whose key occurs at least twice, with the number of its rows."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(sizes, "key")


def leaders_of(buckets: DataFrame, stage: Stage) -> DataFrame:
    """(key, leader): the member of each bucket with the most neighbours."""
    weight = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = stage(buckets.join(weight, "node"), "weighted")
    top = ranked.groupBy("key").agg(
        F.max(F.struct("weight", (-F.col("node")).alias("neg"))).alias("t"))
    return top.select("key", (-F.col("t.neg")).alias("leader"))


class Difference(NamedTuple):
    """How a member's set differs from a leader's: what it has beyond it, what it lacks of it."""

    size: int            # of the leader's set
    added: np.ndarray
    lacking: np.ndarray

    def linked(self, percent: int) -> bool:
        common, union = self.size - len(self.lacking), self.size + len(self.added)
        return 100 * common >= percent * union


def difference(leader: np.ndarray, member: np.ndarray) -> Difference:
    """From two sorted sets of shingles. What is lacking gets another hash than what is added."""
    at = np.searchsorted(leader, member)
    at[at == len(leader)] = 0
    common = leader[at] == member
    lacks = np.ones(len(leader), dtype=bool)
    lacks[at[common]] = False
    return Difference(len(leader), member[~common], mix(leader[lacks] ^ U64(0x5555555555555555)))


def relative(leader: Difference, member: Difference) -> Difference:
    """The member's difference from a leader, both given by their differences from a third set.

    What only one of the two lacks of that set, the other one has beyond it.
    """
    def without(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.setdiff1d(x, y, assume_unique=True)

    return Difference(
        leader.size - len(leader.lacking) + len(leader.added),
        np.concatenate([without(member.added, leader.added), without(leader.lacking, member.lacking)]),
        np.concatenate([without(member.lacking, leader.lacking), without(leader.added, member.added)]))


_VERIFIED = "linked boolean, size int, n_added int, elements array<bigint>"


def _verified(batch: pa.RecordBatch, keep: tuple[str, ...], diffs: list[Difference], at: int,
              percent: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: batch.column(c).slice(at, len(diffs)) for c in keep} | {
        "linked": pa.array([d.linked(percent) for d in diffs], pa.bool_()),
        "size": pa.array([d.size for d in diffs], pa.int32()),
        "n_added": pa.array([len(d.added) for d in diffs], pa.int32()),
        "elements": pa.array([np.concatenate([d.added, d.lacking]).view(np.int64) for d in diffs],
                             pa.list_(pa.int64()))})


def _compare_texts(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader_set = None, None
        for batch in batches:
            for a, b, texts in slices(batch.column("member_text"), SLICE_BYTES):
                members, diffs = shingle_sets(texts), []
                for k in range(a, b):
                    leader = batch.column("leader")[k].as_py()
                    if leader != last:
                        one = pa.array([batch.column("leader_text")[k].as_py()], pa.string())
                        leader_set, last = shingle_sets(next(slices(one))[2])[0], leader
                    diffs.append(difference(leader_set, members[k - a]))
                yield _verified(batch, ("leader", "node"), diffs, a, percent)
    return run


class Components:
    """Disjoint sets of places; joining two renames the smaller one, n log n renames at most."""

    def __init__(self, of: np.ndarray):
        self.of = of
        self.members: dict[int, list[int]] = {}  # of sets of two or more
        names, counts = np.unique(of, return_counts=True)
        for name in names[counts > 1].tolist():
            self.members[name] = np.flatnonzero(of == name).tolist()

    def unite(self, i: int, j: int) -> bool:
        """Whether the two places were in different sets."""
        a, b = int(self.of[i]), int(self.of[j])
        if a == b:
            return False
        x, y = self.members.pop(a, [i]), self.members.pop(b, [j])
        if len(x) < len(y):
            x, y, a = y, x, b
        self.of[y] = a
        x += y
        self.members[a] = x
        return True


def _with_partner(cost: np.ndarray, shared: np.ndarray, open_: np.ndarray, side: np.ndarray,
                  slack: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows may have a link, from how many of their differences other rows have; and ``gain``.

    A link of i and j has (100 + percent) * common >= cost[i] + cost[j] - slack, and neither has
    more in common than it shares at all: so gain[j] >= cost[i] - slack, and the other way round.
    """
    gain = (100 + percent) * shared - cost
    may = np.zeros(len(cost), dtype=bool)
    for s in np.unique(side):
        for state in (True, False):
            mine = np.flatnonzero((side == s) & (open_ == state))
            others = np.flatnonzero(((side != s) | (side < 0)) & (open_ | state))
            if not len(mine) or not len(others):
                continue
            others = others[np.argsort(cost[others], kind="stable")]
            best = np.maximum.accumulate(gain[others])
            to = np.searchsorted(cost[others], slack + gain[mine], side="right")
            may[mine] = (to > 0) & (best[np.maximum(to, 1) - 1] >= cost[mine] - slack)
    return may, gain


def links_in_group(size: int, added: np.ndarray, elements: list[np.ndarray], open_: np.ndarray,
                   percent: int, most_work: int | None = None, side: np.ndarray | None = None
                   ) -> list[tuple[int, int]] | None:
    """Links (places) that connect all that is linked in a group, given by the differences from
    one set of ``size`` shingles. Rows not in ``open_`` are linked with that set, hence connected.
    With ``side`` (0 or 1 per row) only what links the two sides is looked for.

    Rows whose differences are so few that they need none in common are linked with the row of the
    least cost. The others need some in common: rows that cannot have a link, since too few of
    their differences are in any other row, are left out, which makes more differences rare, until
    few more go. Of what stays the number a link needs in common has a lower bound per row, so that
    two linked rows share one of the rarest ``length - need + 1`` differences of both; only
    these are indexed, and only rows of other components are compared. None if the rows to be met
    in the index are more than ``most_work``.
    """
    n = len(elements)
    if n < 2 or not open_.any():
        return []
    lengths = np.array([len(e) for e in elements])
    cost = 100 * (lengths - added) + percent * added
    slack = (100 - percent) * size
    component = Components(np.where(open_, np.arange(n), int(np.argmin(open_))))
    found: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        if component.unite(i, j):
            found.append((i, j))

    low = int(np.argmin(cost))
    for i in np.flatnonzero(cost + cost[low] <= slack).tolist():
        if i != low:
            link(low, i)
    side = np.full(n, -1) if side is None else side
    kinds, which = np.unique(np.concatenate(elements), return_inverse=True)
    kinds = len(kinds)
    owner = np.repeat(np.arange(n), lengths)
    row = np.cumsum(lengths) - lengths
    live, before = np.ones(n, dtype=bool), 2 * n
    while 10 * live.sum() < 9 * before:
        before = int(live.sum())
        # A row that is not open only looks for open ones.
        at = live[owner]
        count = np.bincount(which[at], minlength=kinds)
        shares = np.zeros(len(which), dtype=bool)
        for s in np.unique(side):
            here = at & (side[owner] == s)
            there = at & (side[owner] != s) if s >= 0 else here
            others = np.bincount(which[there], minlength=kinds)
            opened = np.bincount(which[there & open_[owner]], minlength=kinds)
            shares[here] = np.where(open_[owner[here]], others[which[here]] > (s < 0),
                                    opened[which[here]] > 0)
        shared = np.bincount(owner[shares], minlength=n)
        kept = np.flatnonzero(live)
        may, some = _with_partner(cost[kept], shared[kept], open_[kept], side[kept], slack, percent)
        live[kept] = may
        gain = np.zeros(n, dtype=np.int64)
        gain[kept] = some
    if not (live & open_).any():
        return found
    # A link has (100 + percent) * common >= cost[i] + cost[j] - slack, cost[j] >= percent * common,
    # and one of the two is open.
    least = np.where(open_, cost[live].min(), cost[live & open_].min())
    need = np.maximum(1, np.maximum(-((slack - cost - least) // (100 + percent)),
                                    np.where(open_, -((slack - cost) // 100), 1)))
    order = np.lexsort((which, count[which], owner))
    place = np.arange(len(which)) - row[owner]
    kept = order[(place <= (lengths - need)[owner]) & live[owner] & shares[order]]
    if not len(kept):
        return found
    by_owner, by_element = kept, kept[np.argsort(which[kept], kind="stable")]
    posted = np.bincount(which[kept], minlength=len(count))
    post_start = np.cumsum(posted) - posted
    if most_work is not None and int(posted[which[kept[open_[owner[kept]]]]].sum()) > most_work:
        return None
    posting = owner[by_element]
    own_count = np.bincount(owner[by_owner], minlength=n)
    own_start = np.cumsum(own_count) - own_count
    mine = np.zeros(len(count), dtype=bool)
    least_gain, most_cost = int(gain[live].min()), int(cost[live].max())
    for i in np.flatnonzero(open_ & (own_count > 0)).tolist():
        keys = which[by_owner[own_start[i]:own_start[i] + own_count[i]]]
        near = posting[concat_ranges(post_start[keys], posted[keys])]
        near = np.unique(near[component.of[near] != component.of[i]])
        if side[i] >= 0:
            near = near[side[near] != side[i]]
        if least_gain < cost[i] - slack or most_cost > slack + gain[i]:
            near = near[(gain[near] >= cost[i] - slack) & (cost[near] <= slack + gain[i])]
        if not len(near):
            continue
        mine[which[row[i]:row[i] + lengths[i]]] = True
        hit = mine[which[concat_ranges(row[near], lengths[near])]]
        mine[which[row[i]:row[i] + lengths[i]]] = False
        common = np.add.reduceat(hit, np.cumsum(lengths[near]) - lengths[near], dtype=np.int64)
        for j in near[(100 + percent) * common >= cost[i] + cost[near] - slack].tolist():
            link(i, j)
    return found


class _Members(NamedTuple):
    nodes: np.ndarray
    sizes: np.ndarray
    added: np.ndarray
    open_: np.ndarray
    elements: pa.Array

    @classmethod
    def of(cls, table: pa.Table) -> _Members:
        nodes, sizes, added = (table.column(c).to_numpy() for c in ("node", "size", "n_added"))
        open_ = ~table.column("linked").to_numpy(zero_copy_only=False).astype(bool)
        return cls(nodes, sizes, added.astype(np.int64), open_, table.column("elements").combine_chunks())

    def links(self, rows: np.ndarray, percent: int, most_work: int | None = None,
              side: np.ndarray | None = None) -> list[tuple[int, int]] | None:
        """Links, as nodes, of the rows of one group."""
        lists = [np.asarray(self.elements[int(i)].values) for i in rows]
        found = links_in_group(int(self.sizes[rows[0]]), self.added[rows], lists, self.open_[rows],
                               percent, most_work, side)
        return found if found is None else [
            (int(self.nodes[rows[i]]), int(self.nodes[rows[j]])) for i, j in found]


def _as_table(links: list) -> pa.Table:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _links_of_groups(percent: int, most_work: int):
    """Per group its links, or one row of its base and null if it is too much for a task."""
    def run(table: pa.Table) -> pa.Table:
        members, base, out = _Members.of(table), table.column("base").to_numpy(), []
        order = np.lexsort((members.nodes, base))
        for rows in np.split(order, np.flatnonzero(np.diff(base[order])) + 1):
            found = members.links(rows, percent, most_work)
            out += [(int(base[rows[0]]), None)] if found is None else found
        return _as_table(out)
    return run


def _links_of_blocks(percent: int):
    """Links of one block, or between two."""
    def run(table: pa.Table) -> pa.Table:
        members = _Members.of(table)
        order = np.argsort(members.nodes)
        side = table.column("side").to_numpy()[order]
        if side[0] < 0:
            return _as_table(members.links(order, percent))
        if (side == side[0]).all():
            return _as_table([])  # the other block is empty
        return _as_table(members.links(order, percent, side=side))
    return run


_MEMBER = ("base", "node", "linked", "size", "n_added", "elements")


def _group_links(known: DataFrame, tasks: int, percent: int, most_work: int) -> DataFrame:
    """Links inside the groups of ``known`` (base, node and differences), each held by a task;
    (base, null) for the groups that need more than ``most_work``."""
    return (known.select(*_MEMBER).groupBy(F.pmod(F.xxhash64("base"), F.lit(tasks)).alias("task"))
            .applyInArrow(_links_of_groups(percent, most_work), "a bigint, b bigint"))


def _block_links(known: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Links inside the groups ``large`` (base, total, n), two blocks of a group's members a task."""
    blocks = F.ceil(F.greatest(F.col("total") / BLOCK_ELEMENTS, F.col("n") / SMALL))
    copies = (known.select(*_MEMBER).join(large.select("base", blocks.alias("blocks")), "base")
              .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    first, second = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), -1).otherwise(
        (F.col("block") > F.col("other")).cast("int"))
    pairs = copies.select(*_MEMBER, first.alias("first"), second.alias("second"), side.alias("side"))
    # A block meets itself in a task of its own and the others as one of two sides.
    return (pairs.groupBy("base", "first", "second")
            .applyInArrow(_links_of_blocks(percent), "a bigint, b bigint"))


def find_links(buckets: DataFrame, texts: DataFrame, stage: Stage, percent: int = PERCENT
               ) -> DataFrame | None:
    """The components of the classes: (node, root), or None where no two share a key.

    Texts are compared with those of leaders. From then on a member is known by its differences
    from a leader, its *base*, which decide every further link between the base's members.
    """
    if buckets.isEmpty():
        return None
    leaders = leaders_of(buckets, stage)
    members = stage(
        buckets.join(leaders, "key").select("leader", "node").distinct().where("leader <> node"),
        "members")
    known = stage(
        members.join(texts.withColumnRenamed("text", "member_text"), "node")
        .join(texts.select(F.col("node").alias("leader"), F.col("text").alias("leader_text")),
              "leader")
        .select("leader", "node", "leader_text", "member_text")
        .mapInArrow(_compare_texts(percent), "leader bigint, node bigint, " + _VERIFIED), "verified")
    links = known.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    known = known.withColumnRenamed("leader", "base")
    # Groups with a member that is not linked to the base. The usual ones are held by a task.
    groups = stage(
        known.groupBy("base").agg(F.sum(F.size("elements")).alias("total"),
                                  F.count(F.lit(1)).alias("n"),
                                  F.bool_or(~F.col("linked")).alias("open"))
        .where("open and n > 1").select("base", "total", "n"), "open_groups")
    fits = F.col("total") <= GROUP_ELEMENTS
    total = groups.where(fits).agg(F.sum("total")).first()[0] or 0
    done = stage(_group_links(
        known.join(groups.where(fits), "base", "left_semi"),
        int(4 * total // max(1, GROUP_ELEMENTS)) + 1, percent, GROUP_WORK), "group_links")
    links = links.unionByName(done.where("b IS NOT NULL"))
    too_much = done.where("b IS NULL").select(F.col("a").alias("base"))
    large = stage(groups.where(~fits).unionByName(groups.join(too_much, "base", "left_semi")),
                  "large_groups")
    if not large.isEmpty():
        links = links.unionByName(stage(_block_links(known, large, percent), "block_links"))
    return connected_components(links, stage)


def _text_hash() -> Column:
    return F.xxhash64("text", F.crc32(F.col("text").cast("binary")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT, stage: Stage | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    stage = stage or Stage(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", _text_hash())
    n = bands_for(percent)
    signed = stage(texts.mapInArrow(_sign(n), schema_with(
        texts, "text_hash bigint", "n_shingles bigint", "digest binary", "bands array<bigint>")),
        "signatures")
    # Staging fixes the numbers of the classes.
    classes = stage(
        signed.where("n_shingles > 0").groupBy("digest")
        .agg(F.min("doc_id").alias("least"),
             F.min(F.struct("doc_id", "text_hash")).alias("of"),
             F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = shared_keys(classes, stage, n)
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("of.doc_id").alias("_id"), F.col("of.text_hash").alias("_hash"))
    same = (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    # The wanted rows grow with the corpus: never broadcast them, so that one plan holds at every size.
    candidates = stage(texts.join(stage(wanted, "wanted").hint("merge"), same)
                       .select("node", "text").dropDuplicates(["node"]), "candidate_texts")
    roots = find_links(buckets, candidates, stage, percent)
    if roots is None:
        grouped = classes.select("digest", F.col("least").alias("component_id"),
                                 F.col("of.text_hash").alias("first_hash"))
    else:
        of = classes.select("digest", "node", "least", "of.text_hash").join(
            roots, "node", "left").select(
            "digest", "least", "text_hash", F.coalesce("root", "node").alias("root"))
        least = of.groupBy("root").agg(F.min("least").alias("component_id"),
                                       F.min("text_hash").alias("first_hash"))
        grouped = of.join(least, "root").select("digest", "component_id", "first_hash")
    joined = signed.select("doc_id", "text_hash", "n_shingles", "digest").join(
        stage(grouped, "components").withColumnRenamed("digest", "_d"),
        (F.col("digest") == F.col("_d")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    # In a component of null ids the texts with the smallest hash are kept.
    named = F.col("doc_id").isNotNull() | (F.col("n_shingles") == 0) | (
        F.col("text_hash") == F.col("first_hash"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         (F.col("doc_id").eqNullSafe(component) & named).alias("kept"),
                         "text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         percent: int = PERCENT, stage: Stage | None = None) -> DataFrame:
    """``docs`` without all but one document of each component; of rows with equal id and text
    one stays. Rows without words are components of their own."""
    found = near_duplicates(docs, id_col, text_col, percent, stage)
    name = F.concat(F.when(F.col("doc_id").isNull(), "null").otherwise("id "),
                    F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keepers = found.where("kept").select(name.alias("_name"), F.col("text_hash").alias("_hash"))
    row = id_and_text(docs, id_col, text_col, whole=True)
    return (row.select("row", name.alias("_name"), _text_hash().alias("_hash"))
            .join(keepers.distinct(), ["_name", "_hash"])
            .dropDuplicates(["_name", "_hash"]).select("row.*"))


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
