import os
import weakref

import pytest
from conftest import DATA
from llm_cases import no_documents, odd_documents
from pyspark.sql import functions as F

import corpus_pipeline as cp
from voucherlens.llm import (
    decontamination,
    line_dedup,
    minhash_dedup,
    quality_classifier,
    sentencepiece_codec,
)
from voucherlens.llm.common import id_and_text
from voucherlens.llm.queries import ORACLE, QUERIES
from voucherlens.staging import Stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_is_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op"))
    assert numbers == list(range(1, 14)) and QUERIES["pipeline"] is cp.run
    assert ORACLE.keys() <= QUERIES.keys()
    assert [f.__name__ for _, f in cp.STAGES] == ["quality", "lines", "near_duplicates", "benchmark",
                                                  "tokens"]


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns, each working on its predecessor's rows."""
    with Stage(spark) as stage:
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        out = [docs]
        for name, step in cp.STAGES:
            out.append(stage(step(spark, out[-1], DATA), name.split()[0]))
        yield out


def test_stages_do_what_their_operators_say(spark, kept):
    docs, good, lines, single, clean, tokens = kept
    assert all(df.columns == COLUMNS for df in kept[:-1])
    model = quality_classifier.train(id_and_text(docs), spark.read.parquet(f"{DATA}/labels.parquet"))
    accepted = {r.doc_id for r in quality_classifier.classify(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == accepted and len(accepted) < docs.count()
    assert good.exceptAll(docs).count() == 0
    want = {r.doc_id: r.text for r in line_dedup.site_line_dedup(good).collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert lines.where("n_chars <> length(text)").count() == 0
    firsts = {r.doc_id for r in minhash_dedup.near_duplicates(lines, percent=cp.NEAR_PERCENT).where("kept").collect()}
    assert {r.doc_id for r in single.collect()} == firsts and single.exceptAll(lines).count() == 0
    assert len(firsts) < lines.count()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    free = {r.doc_id for r in decontamination.decontaminate(single, bench).where("n_hit = 0").collect()}
    assert {r.doc_id for r in clean.collect()} == free and clean.exceptAll(single).count() == 0
    ids = {r.doc_id: r.ids for r in sentencepiece_codec.encode(clean).collect()}
    assert {r.doc_id: r.ids for r in tokens.collect()} == ids


def test_run_gives_the_last_stage(spark, kept):
    got = cp.run(spark, DATA)
    assert got.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    assert got.exceptAll(kept[-1]).count() == 0 and got.count() == kept[-1].count()


def test_odd_and_no_rows_pass_all_stages(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        docs = docs.drop("ids", "score")
        for _, step in cp.STAGES[:-1]:
            columns, docs = docs.columns, step(spark, docs, DATA)
            assert docs.columns == columns
        assert cp.STAGES[-1][1](spark, docs, DATA).where("not round_trip").count() == 0


def test_columns_of_any_name_pass_all_stages(spark, stage):
    docs = odd_documents(spark).drop("ids", "score")
    for c in ("_n_lines", "_n_dropped", "a.b", "_row", "_name", "_site", "number", "`x", "item"):
        docs = docs.withColumn(c.replace("`", ""), F.lit(3))
    for _, step in cp.STAGES[:-1]:
        columns, docs = docs.columns, step(spark, docs, DATA, stage)
        assert docs.columns == columns and docs.count() > 0
    assert {tuple(r) for r in docs.select("_n_lines", "`a.b`", "item").collect()} == {(3, 3, 3)}
    assert cp.STAGES[-1][1](spark, docs, DATA).where("not round_trip").count() == 0


def test_counts_of_line_dedup_go_by_names_of_the_caller(spark, stage):
    docs = odd_documents(spark).withColumn("_n_lines", F.lit(1))
    with pytest.raises(ValueError, match="other names"):
        line_dedup.site_line_dedup(docs, stage=stage)
    got = line_dedup.site_line_dedup(docs, stage=stage, counts=("before", "gone"))
    assert got.columns == [*docs.columns, "before", "gone"] and got.where("gone > before").count() == 0


def test_closing_the_stage_of_a_run_leaves_nothing(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/voucherlens"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with Stage(spark) as stage:
        assert cp.run(spark, DATA, stage).count() > 0
        assert len(set(os.listdir(root)) - before) == 1
    assert set(os.listdir(root)) <= before


def test_near_dedup_stage_links_from_80_percent_on(spark):
    """Copies of similarity 0.82 go, those of 0.78 stay; op5 alone links neither."""
    def copy(base, at):  # other words at the start: ``at`` shingles differ
        return [f"x{w}" for w in base[:at]] + base[at:]

    def similarity(at, n=100):
        return (n - 4 - at) / (n - 4 + at)

    bases = [[f"w{g}x{i}" for i in range(100)] for g in range(20)]
    near, far = 9, 12
    assert 0.82 < similarity(near) < 0.85 and 0.77 < similarity(far) < 0.80
    texts = [t for g, b in enumerate(bases) for t in (b, copy(b, near if g < 10 else far))]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r.doc_id for r in cp.near_duplicates(spark, docs, DATA).collect()}
    assert left == {i for i in range(40) if i >= 20 or i % 2 == 0}
    assert minhash_dedup.drop_near_duplicates(docs).count() == 40


def test_one_copy_of_a_large_group_survives(spark):
    """Line dedup before near-dedup must not empty a text because it is there many times."""
    rows = []
    for i in range(90):
        name = "copy" if i % 3 else f"own{i}"
        rows.append((i, "\n".join(f"{name} line {j} says something of {name}" for j in range(12)), "en",
                     f"src{i % 2}", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = cp.near_duplicates(spark, cp.lines(spark, docs, DATA), DATA).collect()
    assert sorted(r.text for r in left) == sorted({r[1] for r in rows})


def calls_of(monkeypatch, spark):
    """Each later call of ``mapInArrow``: its input and, run here, the rows its function gives."""
    kind, made = type(spark.range(1)), []
    plain = kind.mapInArrow

    def noted(self, function, *args, **kwargs):
        def here():
            batches = self.toArrow().to_batches()
            return [r for b in function(iter(batches)) for r in b.to_pylist()]
        made.append((self, here))
        return plain(self, function, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    return made


def test_a_worker_does_not_keep_the_codec_through_the_other_stages(spark, monkeypatch):
    """Codec, memo and tables of powers add up to a large part of an executor's memory."""
    docs = spark.createDataFrame([(1, "some words of a text, ten of them at least here"), (2, None)],
                                 "doc_id bigint, text string")
    bench = docs.selectExpr("'x' AS item_id", "text")
    model = quality_classifier.fit([], [])
    made = calls_of(monkeypatch, spark)
    sentencepiece_codec.encode(docs)
    quality_classifier.classify(docs, model, whole=True)
    decontamination.decontaminate(docs, bench, whole=True)
    monkeypatch.setattr(minhash_dedup, "shared_keys", lambda *_: 1 / 0)
    with Stage(spark) as stage, pytest.raises(ZeroDivisionError):
        minhash_dedup.near_duplicates(docs, stage=stage)
    encode, *others = [here for _, here in made]
    assert len(others) == 3
    for other in others:
        assert [len(r["ids"]) > 0 for r in encode()] == [True, False]
        codec = weakref.ref(sentencepiece_codec.codec_for(sentencepiece_codec.load_model()))
        assert codec() is not None                 # kept from task to task of its own operator
        assert len(other()) == 2
        assert codec() is None


@pytest.mark.parametrize("kind, alone", [("string", True), ("int", False)])
def test_a_text_goes_to_python_once(spark, monkeypatch, kind, alone):
    docs = spark.createDataFrame([(1, "17"), (2, None), (3, "")], "doc_id bigint, note string")
    docs = docs.select("doc_id", F.expr(f"try_cast(note AS {kind})").alias("note"), F.lit(5).alias("text"))
    bench = spark.createDataFrame([("x", "17")], "item_id string, text string")
    made = calls_of(monkeypatch, spark)
    judged = quality_classifier.classify(docs, quality_classifier.fit([], []), text_col="note", whole=True)
    found = decontamination.decontaminate(docs, bench, text_col="note", whole=True)
    for sent, _ in made:
        assert sent.columns == (["doc_id", "row"] if alone else ["doc_id", "text", "row"])
    assert judged.count() == 3
    assert judged.select("row.*").exceptAll(docs).count() == 0
    assert {r.doc_id: (r.n_words, r.n_hit) for r in found.collect()} == {1: (1, 1), 2: (0, 0), 3: (0, 0)}
    assert found.select("row.*").exceptAll(docs).count() == 0
