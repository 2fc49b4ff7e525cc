import re

import duckdb
import numpy as np
import pytest
from conftest import DATA
from llm_cases import ODD, SPACE_WORD, no_documents, odd_documents

from voucherlens.llm import quality_classifier as qc
from voucherlens.llm import quality_rules as qr
from voucherlens.llm.queries import ORACLE

SF = "/root/testdata/sf0.01"


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    w = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    runs = {}
    for i in range(len(w) - 4):
        runs.setdefault(tuple(w[i:i + 5]), []).append(i)
    repeated = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated), n < 10 or 100 * len(repeated) > 20 * n)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(rows, texts):
    got = sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in rows)
    assert got == sorted((str(i), *base(t)) for i, t in texts)
    assert all(not (r.kept and r.base_failed) for r in rows)


@pytest.mark.parametrize("folder", [DATA, SF])
def test_base_measures(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    check(qr.op8_quality_rules(spark, folder).collect(), [(r.doc_id, r.text) for r in docs])


def test_odd_rows(spark):
    more = [(20, "a b c d e f g a b c d e f g x"), (21, "k " * 30), (22, "a b c d e a b c d e a b c d e"),
            (23, "one two three four five"), (24, "#$%&|<>* " * 12)]
    df = odd_documents(spark).select("doc_id", "text").unionByName(
        spark.createDataFrame(more, "doc_id bigint, text string"))
    check(qr.quality_rules(df).collect(), ODD + more)
    assert len(qr.quality_rules(odd_documents(spark)).collect()) == len(ODD)
    assert qr.quality_rules(no_documents(spark)).count() == 0


def test_rules_keep_clean_documents_and_drop_junk(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = qr.op8_quality_rules(spark, SF).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) > 0.98 * len(good)
    assert sum(not r.kept for r in bad) > 0.8 * len(bad)


def test_rules_are_a_table(spark):
    df = spark.createDataFrame([(1, "the " * 5 + "of and " * 20)], "doc_id bigint, text string")
    one = qr.quality_rules(df, rules=[qr.Rule("few", "n_words", None, 3), qr.Rule("x", "n_words", 1, None)])
    assert one.first().failed_rules == ["few"]
    assert qr.quality_rules(df, rules=[]).first().failed_rules == []
    text = qr.op8_quality_rules(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Join|Generate", text)


# -- classifier -----------------------------------------------------------------------------

def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = qc.FactorisationMachine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    index, x = np.array([1, 4, 7, 19]), rng.normal(size=4)
    z = m.bias + m.linear[index] @ x
    for a in range(4):
        for b in range(a + 1, 4):
            z += m.factors[index[a]] @ m.factors[index[b]] * x[a] * x[b]
    assert m.score(index, x) == pytest.approx(1 / (1 + np.exp(-z)))


def test_fit_learns_an_interaction():
    """The label is the product of two features, which no linear model can tell."""
    rng = np.random.default_rng(1)
    signs = rng.choice([-1.0, 1.0], size=(400, 2))
    rows = [(np.array([0, qc.N_STATS, qc.N_STATS + 1]), np.array([1.0, a, b])) for a, b in signs]
    labels = (signs.prod(axis=1) > 0).astype(float)
    m = qc.fit(rows, labels, rate=0.3)
    right = [(m.score(*r) > 0.5) == (y > 0.5) for r, y in zip(rows, labels)]
    assert np.mean(right) > 0.95


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = qc.op9_quality_classifier(spark, SF).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 30
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_same_model_for_any_partitioning_and_odd_rows(spark):
    df, labels = odd_documents(spark), [(1, 1), (1, 0), (6, 1), (None, 1), (8, None), (9, 0), (11, 0)]
    table = spark.createDataFrame([(*x, 5) for x in labels], "doc_id bigint, quality int, text int")
    texts = df.select("doc_id", "text").fillna("", ["text"])
    one, two = (qc.train(t, table) for t in (texts.coalesce(1), texts.repartition(5)))
    assert (one.linear == two.linear).all() and (one.factors == two.factors).all()
    rows = qc.classify(df, one).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    back = qc.classify(df, one, whole=True).select("row.*")
    assert back.columns == df.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert qc.classify(no_documents(spark), one).count() == 0
    untrained = qc.train(texts, table.where("false"))
    assert {r.score for r in qc.classify(df, untrained).collect()} == {0.5}


@pytest.mark.parametrize("folder", [DATA, SF])
def test_rules_equal_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(ORACLE["op8_quality_rules"]).fetchall())
    assert sorted(tuple(r) for r in qr.op8_quality_rules(spark, folder).collect()) == want


def test_odd_rows_equal_sql(spark):
    con = duckdb.connect()
    rows = [(i, t) for i, t in ODD] + [(30, "• one\nx | y\n- z " * 20), (31, "AB!! CD!!! e!!\n" * 9)]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = ["doc_id", *COLUMNS, "kept"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE['op8_quality_rules']})").fetchall()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in qr.quality_rules(df).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
