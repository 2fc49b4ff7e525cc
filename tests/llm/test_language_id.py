import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from llm_cases import ODD, no_documents, odd_documents
from pyspark.sql import functions as F

from voucherlens.llm import language_id as li

SF = "/root/testdata/sf0.01"


def toy(ordinary, chars="abxyé"):
    """A vocabulary of some pieces and all bytes, and two languages at random."""
    pieces = li.Pieces({p: 256 + i for i, p in enumerate(ordinary)}, list(range(256)), 256 + len(ordinary))
    p = np.random.default_rng(3).random((pieces.size, 2)) + 0.01
    return pieces, np.log(p / p.sum(axis=0))


def segmentations(pieces, ordinary, text):
    """All ways to write a text in pieces, as lists of ids."""
    if not text:
        yield []
        return
    for i, p in enumerate(ordinary):
        if text.startswith(p):
            yield from ([256 + i, *rest] for rest in segmentations(pieces, ordinary, text[len(p):]))
    if ord(text[0]) not in pieces.single:
        yield from ([*pieces.spelt(text[0]), *rest] for rest in segmentations(pieces, ordinary, text[1:]))


TOY = ["▁", "a", "b", "ab", "▁a", "ba", "bab", "▁ab", "é", "aé"]


def test_forward_sums_all_segmentations():
    pieces, logp = toy(TOY)
    rng = random.Random(1)
    units = ["".join(rng.choice("abababé漢") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    got = li.unit_scores(pieces, logp, units)
    for u, row in zip(units, got):
        ways = [logp[w].sum(axis=0) for w in segmentations(pieces, TOY, "▁" + u)]
        assert np.allclose(row, np.logaddexp.reduce(ways), rtol=1e-12)
    assert any(len(list(segmentations(pieces, TOY, "▁" + u))) > 5 for u in units)


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1024])
def test_long_units_are_summed_in_stretches(stretch):
    pieces, logp = toy(TOY)
    rng = random.Random(2)
    for n in (1, 2, 3, 40, 301):
        unit = "".join(rng.choice("abéx") for _ in range(n))
        assert np.allclose(li.long_unit_score(pieces, logp, unit, stretch),
                           li.unit_scores(pieces, logp, [unit])[0], rtol=1e-12)


def test_expected_counts():
    pieces, logp = toy(TOY)
    units, lang, n = ["abab", "a", "é漢ab"], np.array([0, 1, 1]), np.array([3, 1, 2])
    got = Counter()
    for which, piece, grains in zip(*li.expected(pieces, logp, lang, units, n)):
        got[int(which), int(piece)] += int(grains) / li.GRAIN
    want = Counter()
    for u, k, m in zip(units, lang.tolist(), n.tolist()):
        ways = list(segmentations(pieces, TOY, "▁" + u))
        weight = np.array([logp[w, k].sum() for w in ways])
        weight = np.exp(weight - np.logaddexp.reduce(weight))
        for w, x in zip(ways, weight):
            for piece in w:
                want[k, piece] += m * x
    assert got.keys() >= {k for k, v in want.items() if v > 1e-4}
    assert all(abs(got[k] - want[k]) < 1e-4 for k in got | want)


def test_scores_of_texts_and_the_bounded_memo(monkeypatch):
    pieces, logp = toy(TOY)
    monkeypatch.setattr(li, "pieces_of", lambda proto: pieces)
    monkeypatch.setattr(li, "MEMO_UNITS", 5)
    monkeypatch.setattr(li, "CHUNK_CHARS", 4)
    scorer = li.Scorer(li.Model(b"", ["x", "y"], np.log([0.25, 0.75]), logp))
    texts = ["ab a\n ab BA", "", "b" * 50 + " a", "é ab ba abb bba aab", "ab a\n ab BA"]
    for part in ([0, 1], [2, 3], [4], [0, 1, 2, 3, 4]):
        got = scorer.scores([texts[i] for i in part])
        for i, row in zip(part, got):
            want = np.log([0.25, 0.75])
            for unit in texts[i].lower().split():
                want = want + li.unit_scores(pieces, logp, [unit])[0]
            assert np.allclose(row, want, rtol=1e-12)
    assert all(len(u) <= li.MEMO_CHARS for u in scorer.row) and "b" * 50 not in scorer.row


def test_a_text_without_spaces_needs_little_memory():
    pieces, logp = toy(TOY)
    unit = "abéx漢" * 20_000
    tracemalloc.start()
    li.long_unit_score(pieces, logp, unit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


@pytest.fixture(scope="module")
def model(spark):
    from voucherlens.staging import Stage

    with Stage(spark) as stage:
        yield li.train(li.labelled(spark.read.parquet(f"{DATA}/documents.parquet")), stage)


def test_model_is_a_distribution_and_does_not_depend_on_partitions(spark, stage, model):
    assert model.langs == ["de", "en", "es", "fr"] and np.isclose(np.exp(model.prior).sum(), 1)
    assert np.allclose(np.exp(model.logp).sum(axis=0), 1)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(5)
    again = li.train(li.labelled(docs), stage)
    assert (again.logp == model.logp).all() and again.langs == model.langs


def test_held_out_rows_and_lang_are_not_used(spark, stage, model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = li.fold_of(folds=4) == 2
    lied = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    assert (li.train(li.labelled(lied), stage).logp == model.logp).all()
    pred = {r.doc_id: r.lang_pred for r in li.identify(docs.drop("lang", "source"), model).collect()}
    assert pred == {r.doc_id: r.lang_pred for r in li.identify(lied.repartition(3), model).collect()}


def test_held_out_accuracy(spark, stage):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = li.op12_language_id(spark, SF, stage).join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 200
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_sample_is_bounded_and_whole_rows_are_learnt(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"),
                                    F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("lang"))
    got = {r.lang: r["count"] for r in li.sample(docs, 100).groupBy("lang").count().collect()}
    assert got == {"a": 112, "b": 112}  # seven in each of sixteen parts
    assert li.sample(docs, 100).where(li.fold_of(folds=4) == 2).count() == 0
    few = li.sample(docs.where("doc_id < 40"), 100).count()
    assert few == docs.where("doc_id < 40").where(li.fold_of(folds=4) != 2).count()


def test_odd_rows(spark, stage, model):
    df = odd_documents(spark).withColumn("a.b", F.lit(1)).withColumn("_h", F.lit(1)).withColumn("n", F.lit(1))
    rows = li.identify(df, model).collect()
    assert len(rows) == len(ODD) and [r for r in rows if r.doc_id is None][0].lang_pred
    for r in rows:
        texts = [t for i, t in ODD if i == r.doc_id]
        if not any(c.isalpha() for t in texts for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.doc_id in (1, 2, 6, 7, 9, 11, 12, 13):
            assert r.lang_pred in model.langs and 0 < r.score <= 1
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 1}) == 1
    assert li.identify(no_documents(spark), model).count() == 0
    learnt = li.train(li.labelled(df), stage)
    assert learnt.langs == ["en"]
    nothing = li.train(li.labelled(no_documents(spark)), stage)
    assert {(r.lang_pred, r.score) for r in li.identify(df, nothing).collect()} == {("und", 0.0)}
