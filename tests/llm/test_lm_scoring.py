import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import no_documents, odd_documents, words

from voucherlens.llm import lm_scoring as lm
from voucherlens.llm.elias_fano import CODE_STEP, EliasFano, NgramTrie, probability, quantise


def expected(rows, mu):
    """(doc_id, held, tokens, known, N, base, model) by dictionaries."""
    tokens = [[*words(t), "\n"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    count, pair, context = Counter(), Counter(), Counter()
    for t, h in zip(tokens, held):
        if not h:
            count.update(t)
            for a, b in zip(["\n", *t[:-1]], t):
                pair[a, b] += 1
                context[a] += 1
    n, v = sum(count.values()), len(count)
    p = {w: (count[w] + 0.5) / (n + 0.5 * (v + 1)) for t in tokens for w in t}
    out = []
    for (i, _), t, h in zip(rows, tokens, held):
        base = sum(math.log10(p[w]) for w in t)
        model = sum(math.log10((pair[a, b] + mu * p[b]) / (context[a] + mu))
                    for a, b in zip(["\n", *t[:-1]], t))
        out.append((i, h, len(t), sum(count[w] > 0 for w in t), n, base, model))
    return out


def compare(df, mu, **options):
    got = sorted(lm.lm_scores(df, mu=mu, **options).collect(), key=str)
    want = expected([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], mu)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [tuple(g)[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        # codes round the pair's share down by less than a step
        assert w[6] - CODE_STEP * 1.001 * w[2] <= g.score <= w[6] + 1e-6


@pytest.mark.parametrize("mu,shard_tokens", [(2000.0, 2_000_000), (5.0, 3000), (1.0, 300)])
def test_scores_follow_the_formulas(spark, stage, mu, shard_tokens):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    compare(docs, mu, shard_tokens=shard_tokens, stage=stage)


def test_odd_rows_in_several_chunks(spark, stage, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 1000)
    compare(odd_documents(spark).repartition(3), 10.0, shard_tokens=500, stage=stage)


def test_empty_table_and_no_training(spark, stage):
    assert lm.lm_scores(no_documents(spark), stage=stage).count() == 0
    held = next(i for i in range(100) if lm.is_held_out(i))
    one = spark.createDataFrame([(held, "some words")], "doc_id bigint, text string")
    row = lm.lm_scores(one, stage=stage).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)
    assert row.base_score == row.score == 0.0


def test_the_model_beats_the_base_on_texts_it_has_not_seen(spark, stage):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.lm_scores(docs, stage=stage).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.8 * len(rows)


@given(st.lists(st.integers(0, 2 ** 62), max_size=200), st.integers(0, 2 ** 62))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, x):
    v = np.sort(np.array(values, dtype=np.uint64))
    universe = int(v[-1]) + 1 if len(v) else 1
    seq, end = EliasFano.read(np.frombuffer(EliasFano.encode(v, universe), np.uint8), 0)
    assert (seq.access(np.arange(len(v))) == v).all()
    ask = np.unique(np.concatenate([v, v + np.uint64(1), np.array([0, x], dtype=np.uint64)]))
    assert (seq.successor(ask) == np.searchsorted(v, ask)).all()


def test_trie_finds_its_ngrams_and_no_others(tmp_path):
    rng = np.random.default_rng(0)
    context = np.sort(rng.integers(0, 1 << 48, 50, dtype=np.uint64).repeat(40))
    successor = rng.integers(0, 1 << 40, 2000, dtype=np.uint64)
    order = np.lexsort((successor, context))
    context, successor = context[order], successor[order]
    logs = np.log10(rng.random(2000))
    data = NgramTrie.build(context, successor, logs)
    (tmp_path / "trie").write_bytes(data)
    for trie in (NgramTrie.from_bytes(data), NgramTrie.open(str(tmp_path / "trie"))):
        one = np.ones(2000, dtype=np.int64)
        assert (trie.find(context, one, successor) == quantise(logs)).all()
        assert not trie.find(context, one, successor ^ np.uint64(1)).any()
        assert not trie.find(context ^ np.uint64(1), one, successor).any()
    p = probability(quantise(logs))
    assert (p <= 10 ** logs * (1 + 1e-6)).all() and (np.log10(p) > logs - CODE_STEP * 1.001).all()
    assert len(data) < 2000 * 8
    empty = NgramTrie.from_bytes(NgramTrie.build(*np.zeros((2, 0), np.uint64), np.zeros(0)))
    assert not empty.find(context, one, successor).any()
