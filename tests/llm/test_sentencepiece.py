import random
import tracemalloc

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD, no_documents, odd_documents

from voucherlens.llm import sentencepiece_codec as sc

MODEL = sc.PieceModel.parse(sc.load_model())
SCORE = {t: s for i, (t, s) in enumerate(MODEL.pieces)
         if i not in MODEL.special and i not in MODEL.byte_of}


def best_score(text):
    """The highest sum of scores, by trying every piece at every place."""
    longest = max(map(len, SCORE))
    best = [0.0] + [None] * len(text)
    for i in range(1, len(text) + 1):
        options = [best[j] + SCORE[text[j:i]] for j in range(max(0, i - longest), i)
                   if text[j:i] in SCORE]
        if text[i - 1] not in SCORE:
            options.append(best[i - 1] + MODEL.unknown)
        best[i] = max(options)
    return best[-1]


def score(ids, text):
    spelt = sum(c not in SCORE for c in text)
    bytes_ = [i for i in ids if i in MODEL.byte_of]
    return sum(MODEL.pieces[i][1] for i in ids if i not in MODEL.byte_of), spelt, len(bytes_)


texts = st.lists(st.sampled_from(["the", " ", "  ", "tion", "é", "▁", "漢", "\n", "qz", "Straße", "\U0001f600",
                                  "\t", "hello", "\u0085", "\0", ";\r", "naïve", "   "]), max_size=12).map("".join)


@given(texts)
@settings(max_examples=300, deadline=None)
def test_round_trip_and_best_score(text):
    codec = sc.Codec(MODEL, memo=3)
    ids = codec.encode(text)
    assert codec.decode(ids) == text
    prepared = sc.prepare(text)
    whole = MODEL.best(prepared)
    total, spelt, spelt_bytes = score(ids.tolist(), prepared)
    again, *_ = score(whole, prepared)
    assert total == pytest.approx(again)          # unit by unit is as good as at one go
    assert total + spelt * MODEL.unknown == pytest.approx(best_score(prepared)) or spelt_bytes


def test_encode_agrees_with_the_library_as_a_unigram_model():
    import sentencepiece as sp
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(sc.load_model())
    model.trainer_spec.model_type = 1
    library = sp.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec, rnd = sc.Codec(MODEL), random.Random(0)
    vocabulary = [t.replace("▁", " ") for t in SCORE if "\r" not in t]
    for _ in range(300):
        text = "".join(rnd.choices(vocabulary, k=rnd.randint(0, 12)))
        if any(c not in SCORE for c in sc.prepare(text)):
            continue
        mine, theirs = codec.encode(text).tolist(), library.encode(text)
        total = [sum(MODEL.pieces[i][1] for i in x) for x in (mine, theirs)]
        assert total[0] >= total[1] - 1e-3 * abs(total[1])


def held(codec):
    return sum(sc.ENTRY_BYTES + 4 * len(u) + len(ids) for memo in (codec.memo, codec.older)
               for u, ids in memo.items())


def test_memo_is_bounded_in_bytes():
    limit = 50 * sc.ENTRY_BYTES
    codec = sc.Codec(MODEL, memo=limit)
    for i in range(1000):
        text = f"word{i} the other{i}"
        assert codec.decode(codec.encode(text)) == text
        assert held(codec) <= 2 * limit + 10 * sc.ENTRY_BYTES
    rnd = random.Random(7)
    codec = sc.Codec(MODEL, memo=1 << 20)
    for _ in range(300):  # texts without spaces: each is one unit of 1,000 characters
        text = "".join(chr(rnd.randint(0x4e00, 0x9fa5)) for _ in range(1000))
        assert codec.decode(codec.encode(text)) == text
    assert held(codec) == 0  # none of them is remembered


def test_one_long_text_of_many_units_is_cut_too(monkeypatch):
    monkeypatch.setattr(sc, "BLOCK_UNITS", 100)
    limit = 50 * sc.ENTRY_BYTES
    codec = sc.Codec(MODEL, memo=limit)
    text = " ".join(f"unit{i}" for i in range(5000))
    assert codec.encode(text).tolist() == sc.Codec(MODEL).encode(text).tolist()
    assert held(codec) <= 2 * (limit + 150 * sc.ENTRY_BYTES)


def test_a_unit_of_a_million_characters_needs_little_memory():
    for char in ("a", "漢"):
        codec = sc.Codec(MODEL)
        text = char * 1_000_000
        tracemalloc.start()
        ids = codec.encode(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100 << 20, peak
        assert codec.decode(ids) == text


@given(st.text(alphabet="atheion漢é", min_size=65, max_size=200))
@settings(max_examples=50, deadline=None)
def test_long_units_are_segmented_as_well(text):
    total, spelt, _ = score(list(MODEL.best(text)), text)
    assert total + spelt * MODEL.unknown == pytest.approx(best_score(text))



def test_odd_rows(spark, monkeypatch):
    df = odd_documents(spark)
    rows = sc.encode(df).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows)
    assert all((r.n_tokens == 0) == (not t) for r, (_, t) in zip(
        sorted(rows, key=lambda r: (str(r.doc_id), r.n_tokens)),
        sorted(ODD, key=lambda x: (str(x[0]), len(sc.Codec(MODEL).encode(x[1] or ""))))))
    back = sc.decode(sc.encode(df)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in ODD)
    assert sc.encode(no_documents(spark)).count() == 0
    assert sc.decode(sc.encode(no_documents(spark))).count() == 0


def test_ids_that_spell_nothing(spark):
    df = spark.createDataFrame([(1, [0, 1, 2]), (2, None), (3, [3 + 0xFF, 3 + ord("a")])],
                               "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in sc.decode(df).collect()} == {1: "", 2: "", 3: "�a"}


def test_query(spark):
    rows = sc.op7_sentencepiece(spark, DATA).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    text = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id = 3").first().text
    row = next(r for r in rows if r.doc_id == 3)
    assert sc.Codec(MODEL).encode(text).tolist() == row.ids
    total, *_ = score(row.ids, sc.prepare(text))
    assert np.isfinite(total)
