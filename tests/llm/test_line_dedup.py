from collections import Counter

import duckdb
import pytest
from conftest import DATA
from llm_cases import ODD, no_documents, odd_documents

from voucherlens.llm import line_dedup as ld
from voucherlens.llm.queries import ORACLE


def plain(rows, ratio, least):
    """rows of (site, text) -> (n_lines, n_dropped, text)"""
    pages = Counter(s for s, _ in rows)
    seen = Counter((s, x) for s, t in rows if t is not None for x in set(t.split("\n")))
    out = []
    for s, t in rows:
        if t is None:
            out.append((0, 0, None))
            continue
        kept = [x for x in t.split("\n")
                if not x.strip(" ") or seen[s, x] < least or seen[s, x] / pages[s] <= ratio]
        n = len(t.split("\n"))
        out.append((n, n - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("ratio,least", [(0.05, 5), (0.5, 2), (0.0, 1), (1.0, 1)])
def test_odd_rows(spark, stage, ratio, least):
    more = [(None, "src9" if i % 4 else None, "menu\nbody %d\n \nmenu" % i) for i in range(8)]
    rows = [(i, None if i is None else f"src{i % 3}", t) for i, t in ODD] + more
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = ld.site_line_dedup(df, max_ratio=ratio, min_pages=least, stage=stage)
    assert got.columns == ["doc_id", "source", "text", "_n_lines", "_n_dropped"]
    want = plain([(s, t) for _, s, t in rows], ratio, least)
    assert sorted(map(str, ((r.doc_id, r.source, r._n_lines, r._n_dropped, r.text) for r in got.collect()))) == sorted(
        map(str, ((i, s, *w) for (i, s, _), w in zip(rows, want))))


def test_other_columns_and_empty_table(spark, stage):
    df = odd_documents(spark)
    out = ld.site_line_dedup(df, stage=stage)
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"] and out.count() == len(ODD)
    assert ld.site_line_dedup(no_documents(spark), stage=stage).count() == 0


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(ORACLE["op3_line_dedup"]).fetchall())
    got = sorted(tuple(r) for r in ld.op3_line_dedup(spark, folder).collect())
    assert got == want
    assert folder == DATA or sum(r[3] for r in got) > 0


def test_plan_has_no_python(spark):
    text = ld.op3_line_dedup(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


def body(name, n=12):
    return [f"{name} line {i} says something of its own" for i in range(n)]


@pytest.mark.parametrize("pages", [60, 600])
def test_copies_of_a_text_are_no_boilerplate(spark, stage, pages):
    """A host with a third exact copies, a third near copies of another text, and a menu on all."""
    exact, near, rows = body("exact"), body("near"), []
    for i in range(pages):
        own = body(f"own{i}")
        if i % 3 == 1:
            own = exact
        elif i % 3 == 2:  # a word within a line, or a line more
            own = [*near[:i % 12], f"edit {i}", *near[i % 12 + 1:]] if i % 2 else [*near, f"more {i}"]
        rows.append((i, "host", "\n".join(["menu", *own, "footer"]), own))
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, source string, text string")
    plain = {r.doc_id: r.text for r in ld.site_line_dedup(df, stage=stage).collect()}
    assert all(plain[i] == "" for i in range(1, pages, 3))
    got = {r.doc_id: r.text for r in
           ld.site_line_dedup(df.repartition(4), stage=stage, spare_copies=True).collect()}
    assert len(got) == pages
    for i, _, text, own in rows:
        if i % 3 < 2:
            assert got[i] == "\n".join(own)
    left = {t for i, t in got.items() if i % 3 == 2}
    assert any(set(near) <= set(t.split("\n")) for t in left)
    for i, _, text, own in rows:  # what is a page's own stays in any case
        assert i % 3 < 2 or (f"edit {i}" if i % 2 else f"more {i}") in got[i]


def test_spared_pages_and_odd_rows(spark, stage):
    rows = [(i, "h", "\n".join([*body("menu"), f"text {i}"])) for i in range(50)]
    rows += [(50 + i, None, "same\nlines") for i in range(30)] + list(
        (i, None if i is None else "odd", t) for i, t in ODD)
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    out = ld.site_line_dedup(df, stage=stage, spare_copies=True).collect()
    assert len(out) == len(rows)
    menus = [r for r in out if r.source == "h" and r._n_dropped == 0]
    assert len(menus) == 1 and all(
        r.text == f"text {r.doc_id}" for r in out if r.source == "h" and r not in menus)
    assert sorted(str((r.doc_id, r.text)) for r in out if r.source != "h") == sorted(
        str((i, t)) for i, s, t in rows if s != "h")
