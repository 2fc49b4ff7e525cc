import hashlib
import random
import re

import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import LOWER, ODD, no_documents, odd_documents

from voucherlens.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, window=10):
    """(n_words, hit places, items) by sliding every window over the text."""
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        m = min(window, len(v))
        windows = {tuple(v[i:i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i:i + m]) in windows:
                hit |= set(range(i, i + m))
                ids.add("" if item is None else str(item))
    return len(w), hit, sorted(ids)


def places(ranges):
    return {p for a, b in zip(ranges[0::2], ranges[1::2]) for p in range(a, b)}


ITEMS = [(1, BASE_PART := " ".join(f"wort{i % 37} and the line{i} of text{i * 7 % 101}" for i in range(9))),
         (2, "short ONE"), (3, None), (4, "... !"), (5, "漢字"), (5, "漢字"), (10, "x y"), (None, "tail")]


def items_table(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 150, 1])
def test_odd_rows_in_one_block_and_in_many(spark, stage, block_bytes):
    got = dc.decontaminate(odd_documents(spark), items_table(spark), block_bytes=block_bytes,
                           stage=stage).collect()
    want = [(i, *plain(t, ITEMS)) for i, t in ODD]
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(sorted(places(r.ranges))), tuple(r.items))
                  for r in got) == sorted(
        (str(i), n, len(h), tuple(sorted(h)), tuple(x)) for i, n, h, x in want)
    assert sum(bool(h) for _, _, h, _ in want) > 5


def test_whole_rows_come_back(spark, stage):
    for block in (1 << 20, 100):
        df = odd_documents(spark)
        got = dc.decontaminate(df, items_table(spark), block_bytes=block, whole=True, stage=stage)
        back = got.select("row.*")
        assert back.columns == df.columns
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_empty_tables(spark, stage):
    none = items_table(spark).where("false")
    assert dc.decontaminate(no_documents(spark), items_table(spark), stage=stage).count() == 0
    rows = dc.decontaminate(odd_documents(spark), none, stage=stage).collect()
    assert len(rows) == len(ODD) and not any(r.n_hit for r in rows)


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_query(spark, folder):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = dc.op6_decontamination(spark, folder).collect()
    assert len(rows) == len(texts)
    known = {" ".join(words(t)[i:i + 10]) for _, t in items for i in range(max(1, len(words(t)) - 9))}
    for r in rows:
        w = words(texts[r.doc_id])
        maybe = any(" ".join(w[i:i + 10]) in known for i in range(max(1, len(w) - 9)))
        n, hit, ids = plain(texts[r.doc_id], items) if maybe else (len(w), set(), [])
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)


@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(
    st.lists(st.sampled_from("abc"), max_size=8), max_size=5))
@settings(max_examples=300, deadline=None)
def test_wu_manber(text, items):
    named = [(str(i), " ".join(v)) for i, v in enumerate(items)]
    searchers = dc.compile_items(named, window=5)
    ranges, ids = dc.hits([w.encode() for w in text], searchers)
    n, hit, want = plain(" ".join(text), named, window=5)
    assert {p for a, b in ranges for p in range(a, b)} == hit and sorted(ids) == want


def test_most_places_are_skipped():
    rnd = random.Random(0)
    item = " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(10))
    search, = dc.compile_items([("1", item)])

    class Counted(list):
        reads = 0

        def __getitem__(self, k):
            Counted.reads += not isinstance(k, slice)
            return super().__getitem__(k)

    text = Counted(b"x%d" % rnd.randrange(10 ** 6) for _ in range(9000))
    assert list(search.search(text)) == [] and Counted.reads <= 2 * 9000 / 9 + 2
