import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from llm_cases import ODD, no_documents, odd_documents
from pyspark.sql import functions as F

from voucherlens.llm import source_divergence as sd
from voucherlens.llm.queries import ORACLE
from voucherlens.staging import Stage


def by_sql(documents):
    con = duckdb.connect()
    con.register("documents", documents)
    return sorted(con.execute(ORACLE["op11_source_divergence"]).fetchall())


def by_spark(df, **options):
    with Stage(df.sparkSession) as stage:
        return sorted(tuple(r) for r in sd.source_divergence(df, stage, **options).collect())


def test_query_equals_sql(spark, stage):
    got = sorted(tuple(r) for r in sd.op11_source_divergence(spark, DATA, stage).collect())
    want = by_sql(spark.read.parquet(f"{DATA}/documents.parquet").toArrow())
    assert got == want and {r[2] for r in got} == {"pair", "term"}


def test_any_runs_and_partitions_give_the_same(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    want = by_sql(df.toArrow())
    assert by_spark(df.repartition(5), postings=300) == want
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert by_spark(df.coalesce(1), postings=50) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_odd_rows_equal_sql(spark):
    df = odd_documents(spark)
    df = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.lit("en")))
    for c in ("_s", "salt", "n", "part", "a.b", "shard"):
        df = df.withColumn(c, F.lit(1))
    got = by_spark(df)
    assert got == by_sql(df.select("doc_id", "text", "lang", "source").toArrow())
    assert {(r[0], r[1]) for r in got} >= {("", "src0"), ("en", "src1")} and len(ODD) == df.count()
    assert by_spark(no_documents(spark)) == []


def test_groups_without_terms_have_pairs_of_their_own(spark):
    rows = [("en", "a", "one two"), ("en", "b", "one two two"), ("en", "c", "one 12 two"), ("en", "d", "?"),
            ("de", "a", "eins"), ("de", "b", None), ("fr", "x", "")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = by_spark(df)
    assert got == by_sql(df.toArrow())
    pairs = {(r[0], r[1], r[3]): r[4] for r in got if r[2] == "pair"}
    assert len(pairs) == 12 + 2 and pairs["de", "a", "b"] == 0 and pairs["en", "d", "b"] > 0


def test_one_hot_source_and_one_hot_word(spark):
    rng = random.Random(4)
    rows = [("en" if i % 3 else "de", f"s{0 if i % 2 else i % 11}",
             " ".join(["the"] * 40 + [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(4))}" for _ in range(12)]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert by_spark(df, postings=100) == by_sql(df.toArrow())


@pytest.mark.parametrize("postings, block", [(1, 1), (7, 2), (10_000, 4096)])
def test_runs_merge_to_the_counts(monkeypatch, postings, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    rng = random.Random(1)
    docs = [(rng.choice(["", "en", "ñ"]), rng.choice(["a", "b", ""]),
             " ".join(rng.choice(["x", "Xé", "yy", "漢字", "the", "z\x7f", "zz"]) for _ in range(rng.randrange(9))))
            for _ in range(120)]
    runs, held = [], sd.Block()
    for d in docs:
        held.add(*d)
        if held.size >= postings:
            runs += held.run(3)
            held = sd.Block()
    runs += held.run(3)
    table = pa.Table.from_batches(runs)
    assert all(0 < len(t) <= block and t == sorted(set(t)) for t in table["terms"].to_pylist())
    table = table.sort_by([("shard", "ascending"), ("lang", "ascending"), ("first", "ascending")])
    got = list(sd.merge(sd._opened(table.to_batches())))
    assert [k for k, *_ in got] == sorted({k for k, *_ in got})
    count, seen = Counter(), Counter()
    for lang, source, text in docs:
        terms = sd.terms_of(text)
        count.update((lang, t, source) for t in terms)
        seen.update((lang, t) for t in set(terms))
    assert {(k[1], k[2]): n for k, n, _ in got} == seen
    assert {(k[1], k[2], s): n for k, _, c in got for s, n in c.items()} == count


def test_terms_are_letters_and_what_lies_beyond_ascii():
    import re
    text = "".join(map(chr, range(0, 300))) + " ÀB漢　x"
    want = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [t.decode() for t in sd.terms_of(text)] == want


def test_shares_of_huge_counts_are_exact():
    counts, total = [0, 8_999_999_999, 9_000_000_000, 10**15], 3 * 10**15 + 7
    got = sd.shares(np.array(counts), np.full(4, total))
    assert got.tolist() == [1 + sd.SCALE * (c + 1) // total for c in counts]


@pytest.mark.parametrize("pairs, cells", [(1, 1), (20, 5), (1 << 20, 1 << 20)])
def test_corrections_do_not_depend_on_when_they_are_handed_on(monkeypatch, pairs, cells):
    monkeypatch.setattr(sd, "PAIRS", pairs)
    monkeypatch.setattr(sd, "CELLS", cells)
    rng, names, v = random.Random(2), list("abcde"), 50
    n = [rng.randrange(500) for _ in names]
    postings = [{s: rng.randrange(1, 30) for s in rng.sample(names, rng.randrange(1, 6))} for _ in range(60)]
    sums, got = sd.Corrections("en", names, n, v), Counter()
    rows = [r for p in postings for r in sums.add(list(p), list(p.values()))] + list(sums.rows())
    for r in rows:
        got[r["source"], r["item"]] += r["value"]

    def share(s, c):
        return 1 + sd.SCALE * (c + 1) // (n[names.index(s)] + v)

    def f(p, q):
        return (p - q) ** 2 // q

    want = Counter()
    for p in postings:
        for a in p:
            for b in set(p) - {a}:
                x, y, x0, y0 = share(a, p[a]), share(b, p[b]), share(a, 0), share(b, 0)
                want[a, b] += f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0)
    assert got == want
