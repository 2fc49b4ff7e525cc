import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from voucherlens.llm import hard_negatives as hn
from voucherlens.llm.queries import ORACLE

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_sql(embeddings):
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    return sorted(con.execute(ORACLE["op13_hard_negatives"]).fetchall())


def by_spark(df, stage):
    rows = hn.relabelled(hn.whole_vectors(df))
    return sorted(tuple(r) for r in hn.hard_negatives(rows, rows.where("id % 100 = 0"), stage).collect())


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, stage, folder):
    got = sorted(tuple(r) for r in hn.op13_hard_negatives(spark, folder, stage).collect())
    assert got == by_sql(spark.read.parquet(f"{folder}/embeddings.parquet").toArrow()) and got


def table(spark, n, spread, seed=1, dim=8, labels=4):
    """Points around as many centres as labels; small spreads make clusters and many ties."""
    rng = np.random.default_rng(seed)
    centre, label = rng.normal(size=(labels, dim)), rng.integers(0, labels, n)
    label[rng.random(n) < 0.4] = 0  # one label holds nearly half of the rows
    x = np.round((centre[label] + spread * rng.normal(size=(n, dim))) * 8) / 8
    return spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(n)], SCHEMA)


@pytest.mark.parametrize("spread", [0.0, 0.05, 1.0])
def test_any_partitions_and_many_ties(spark, stage, spread):
    df = table(spark, 1500, spread)
    want = by_sql(df.toArrow())
    assert by_spark(df.repartition(7), stage) == want
    assert by_spark(df.coalesce(1), stage) == want and (want or spread == 0)


def test_odd_rows(spark, stage):
    nan, inf = float("nan"), float("inf")
    rows = [(i * 50, [0.5, 0.25 * (i % 5), -0.1 * i], i % 3) for i in range(60)]
    rows += [(100, None, 1), (200, [nan, 1.0, 1.0], 1), (300, [1.0, -inf, 1.0], 1), (400, [1.0, None, 1.0], 1),
             (500, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (3, [], 1), (5, [1.0], 1),
             (7, [1.0, 0.5, 0.25, 4.0], 1), (11, [0.5, 0.25, 0.0], 2), (11, [0.5, 0.25, 0.0], 2),
             (13, [-1.0, -1.0, 5.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "group", "rank", "a.b", "vector", "part"):
        df = df.withColumn(c, F.lit(1))
    got = by_spark(df, stage)
    assert got == by_sql(df.select("vec_id", "embedding", "label").toArrow()) and got
    assert by_spark(df.where("false"), stage) == []
    alone = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert by_spark(alone, stage) == []


def test_equal_anchor_rows_count_once(spark, stage):
    df = table(spark, 600, 0.4)
    twice = df.unionByName(df.where("vec_id = 200"))
    got, once = by_spark(twice, stage), by_spark(df, stage)
    assert [r for r in got if r[0] == 200] == [r for r in once if r[0] == 200]


def test_spanning_tree():
    x = np.random.default_rng(2).normal(size=(40, 5))
    order, parent, length = hn.spanning_tree(x)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and (parent[1:] < np.arange(1, 40)).all()
    y = x[order]
    assert np.allclose(length[1:], np.sqrt(((y[1:] - y[parent[1:]]) ** 2).sum(axis=1)))
    edges = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), i, j) for i in range(40) for j in range(i))
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    least = 0.0
    for d, i, j in edges:
        if find(i) != find(j):
            root[find(i)] = find(j)
            least += d
    assert np.isclose(length.sum(), least)


def local(x, labels, anchors, rows_per_block=64):
    """Both passes in this process: the lists of each group, and all results."""
    ids = np.arange(len(x))
    batch = pa.RecordBatch.from_pydict({"id": ids[anchors], "label": labels[anchors],
                                        "vector": pa.array(x[anchors].tolist(), pa.list_(pa.int64()))})
    groups = [r | {"group": g} for g, b in enumerate(hn._pack_groups(iter([batch]))) for r in b.to_pylist()]
    blocks = [(ids[a:a + rows_per_block], labels[a:a + rows_per_block], x[a:a + rows_per_block])
              for a in range(0, len(x), rows_per_block)]
    negatives = []
    for g in groups:
        first = hn.PositiveLists(g)
        for b in blocks:
            first.meet(*b)
        best = [dict(r, positive_rank=1) for r in first.rows()]
        second = hn.NegativeLists(g | {"positives": best})
        for b in blocks:
            second.meet(*b)
        negatives.append(second)
    return groups, negatives


@pytest.mark.parametrize("group, scale", [(3, 40), (100, 40), (512, 40), (16, 3_000_000_000 // 32)])
def test_bounds_lose_nothing_and_save_scores(monkeypatch, group, scale):
    monkeypatch.setattr(hn, "GROUP", group)
    rng = np.random.default_rng(5)
    centre, n = rng.normal(size=(5, 6)), 700
    labels = rng.integers(0, 5, n)
    x = np.round((centre[labels] * 3 + 0.02 * rng.normal(size=(n, 6))) * scale).astype(np.int64)
    labels = np.where(rng.random(n) < 0.2, (labels + 1) % 5, labels)
    anchors = np.arange(0, n, 7)
    groups, lists = local(x, labels, anchors)
    assert all(len(g["ids"]) <= group for g in groups)
    exact = x.astype(object)
    for own in lists:
        for i, windows in enumerate(own.windows):
            a = own.ids[i]
            s = np.array([int(v) for v in exact @ exact[a]], dtype=np.int64)
            same = [j for j in np.lexsort((np.arange(n), -s)) if labels[j] == labels[a] and j != a][:5]
            assert [v["positive_id"] for v in windows] == [j for j in same if s[j] >= 0]
            for v in windows:
                p = int(s[v["positive_id"]])
                want = [j for j in np.lexsort((np.arange(n), -s))
                        if labels[j] != labels[a] and 30 * p <= 100 * int(s[j]) <= 90 * p][:10]
                assert v["found"].tolist() == want and v["score"].tolist() == s[want].tolist()
    if group > 3:
        assert sum(o.rescored for o in lists) < 0.7 * sum(o.met for o in lists)


def test_scores_beyond_a_long_are_an_error():
    big = np.array([[1 << 40, 1 << 40]])
    with pytest.raises(ValueError, match="long"):
        hn.comparable(big, big)
    a, b = hn.comparable(np.array([[1 << 29, 3]]), np.array([[1 << 30, 5, 1]]))
    assert int((a @ b.T)[0, 0]) == (1 << 59) + 15 and a.dtype == np.int64
