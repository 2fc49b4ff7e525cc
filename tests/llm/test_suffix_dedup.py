import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD, no_documents, odd_documents

from voucherlens.llm import suffix_dedup as sd
from voucherlens.llm.deep_shallow import BlindTrie, deep_shallow_sort


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, sha, kept) by counting every string."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def result(df, **options):
    rows = sd.suffix_dedup(df, keep_bytes=True, **options).collect()
    for r in rows:
        a, b = np.array(r.spans[0::2]), np.array(r.spans[1::2])
        assert r.n_removed == (b - a).sum() and r.n_spans == len(a) and (a[1:] > b[:-1]).all()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))
                  for r in rows)


def want(rows, length):
    return sorted((str(i), *w) for (i, _), w in zip(rows, plain([t for _, t in rows], length)))


@pytest.mark.parametrize("hot", [20_000, 1])
def test_documents(spark, stage, hot):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = result(docs, hot_contexts=hot, stage=stage)
    assert got == want(rows, 200)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_many_small_repeats(spark, stage, hot):
    """Short strings make every case frequent: overlaps, borders, periods, edits."""
    rnd = random.Random(hot)
    base = "".join(rnd.choices("ab", k=300))
    texts = []
    for i in range(40):
        a, b = sorted(rnd.sample(range(300), 2))
        text = base[a:b]
        if rnd.random() < 0.5 and text:
            k = rnd.randrange(len(text))
            text = text[:k] + rnd.choice(["", "c", "ab", "\0"]) + text[k + 1:]
        texts.append(text + rnd.choice(["", "x" * 30, base[:25]]))
    texts += ["a" * 100, "ab" * 60, "é" * 40, ""]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(df, length=20, piece=4, hot_contexts=hot, stage=stage) == want(rows, 20)


def test_odd_rows_and_empty_table(spark, stage):
    assert result(odd_documents(spark), stage=stage) == want(ODD, 200)
    assert sd.suffix_dedup(no_documents(spark), stage=stage).count() == 0


def test_query_columns(spark):
    assert sd.op4_suffix_dedup(spark, DATA).columns == [
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


words = st.lists(st.binary(max_size=3), max_size=4).map(b"".join)
deep = st.builds(lambda k, t: b"q" * k + t, st.sampled_from([0, 60, 64, 65, 90]), words)


@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(words, deep)), max_size=60))
@settings(max_examples=200, deadline=None)
def test_deep_shallow_sort(rows):
    groups = np.array([g for g, _ in rows], dtype=np.int64)
    strings = [s for _, s in rows]
    order, lcp = deep_shallow_sort(strings, groups, 128)
    assert [rows[i] for i in order] == sorted(rows)
    for k in range(1, len(rows)):
        (ga, a), (gb, b) = rows[order[k - 1]], rows[order[k]]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (same if ga == gb else -1)


@given(st.lists(words, max_size=50))
@settings(max_examples=200, deadline=None)
def test_blind_trie(strings):
    trie = BlindTrie()
    for i, s in enumerate(strings):
        trie.insert(s, i)
    assert [strings[i] for i in trie.ordered()] == sorted(strings)


def test_ranges_that_touch_are_one():
    a, b = sd.merge_ranges(np.array([5, 0, 20, 3]), np.array([9, 5, 21, 4]))
    assert (a.tolist(), b.tolist()) == ([0, 20], [9, 21])
    assert sd.merge_ranges(np.zeros(0, int), np.zeros(0, int))[0].tolist() == []
