"""Every registered query against its SQL twin, and the shape of the plans."""

import re

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
import check
from voucherlens import schema as S
from voucherlens.operators import baselines, rolling, rules
from voucherlens.plans import audit, catalog
from voucherlens.sources import ledger


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert catalog.QUERIES.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, stage, duck, name):
    df = catalog.QUERIES[name](spark, DATA, stage)
    got = check.rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    want = check.rows([d[0] for d in cur.description], cur.fetchall())
    assert got == want
    assert sum(got[1].values()) > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "vendor_id"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_plans_have_no_python_no_cross_join_and_no_single_task_window(spark, stage):
    seen = {}

    def spy(df, name):
        seen[name] = plan(df)
        return stage(df, name)

    run = audit.run(ledger.invoices(spark, DATA), ledger.vendors(spark, DATA),
                    ledger.categories(spark), spy, S.AuditParams(recency_cutoff=ledger.CUTOFF,
                                                                 max_group_rows=100))
    for name, df in run.reports().items():
        seen[f"report {name}"] = plan(df)
    assert {"duplicate_groups", "validated", "audited", "scores", "numbered"} <= seen.keys()
    for name, text in seen.items():
        assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", text), name
        assert "SinglePartition" not in text or name in (
            "report kpi_overview",          # a global aggregate, combined before the exchange
            "scores",                       # the one-row bounds, likewise
        ), name
        # every window is bounded by a key
        assert "Window" not in text or "windowspecdefinition(" in text, name


def test_the_queue_does_not_repeat_the_scores(spark, stage):
    text = plan(catalog.QUERIES["top_risk_vendors"](spark, DATA, stage))
    assert text.count("Subquery") <= 2
    assert text.count("FileScan") <= 8


def test_duplicate_groups_of_a_run_read_one_table(spark, stage):
    seen = {}

    def spy(df, name):
        seen[name] = plan(df)
        return stage(df, name)

    audit.run(ledger.invoices(spark, DATA), ledger.vendors(spark, DATA), ledger.categories(spark),
              spy, catalog.PARAMS,
              inv_keys=ledger.invoices(spark, DATA, category=False, state=False))
    assert seen["duplicate_groups"].count("FileScan") == 1


def test_the_clean_ledger_is_shuffled_once_by_vendor(spark, stage):
    """Window and baseline join share a partitioning, also without broadcasts."""
    clean = stage(ledger.event_invoices(spark, DATA), "clean")
    base = stage(baselines.vendor_baselines(clean), "base")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(baselines.with_zscore(rolling.with_preceding(clean), base))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known = text[:text.rindex("isnull(vendor_id")] if "isnull(vendor_id" in text else text
    by_vendor = re.findall(r"Exchange hashpartitioning\(vendor_id#\d+L?, ", known)
    assert len(by_vendor) <= 2 and "CartesianProduct" not in text
    assert len(re.findall(r"SortMergeJoin \[vendor_id#\d+L?\]", text)) == 1


def test_filters_and_columns_reach_the_staged_scan(spark, stage):
    validated = stage(audit.validate(ledger.invoices(spark, DATA), ledger.vendor_states(spark, DATA),
                                     stage), "validated")
    text = plan(baselines.vendor_baselines(audit.clean_rows(validated)))
    assert "EqualTo(validation_status,CLEAN)" in text
    assert re.search(r"ReadSchema: struct<vendor_id:bigint,amount:decimal\(12,2\),validation_status:string>",
                     text)


def test_duplicate_join_follows_the_size_of_the_groups(spark, stage):
    inv = ledger.invoices(spark, DATA, category=False, state=False)
    groups = stage(rules.duplicate_groups(inv), "groups")
    assert "BroadcastHashJoin" in plan(rules.detect_duplicates(inv, groups=groups))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        big = rules.detect_duplicates(inv, groups=stage(rules.duplicate_groups(inv), "groups"))
        text = plan(big)
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
        assert big.count() == 134
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
