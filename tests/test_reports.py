import os

import pytest
from conftest import DATA, ids
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voucherlens import schema as S
from voucherlens.operators import flags, keys, rules, signals
from voucherlens.plans import audit, reports
from voucherlens.sources import ledger, sinks, tables
from voucherlens.staging import Stage, staging_root


@pytest.fixture(scope="module")
def run(spark):
    stage = Stage(spark)
    return audit.run(ledger.invoices(spark, DATA), ledger.vendors(spark, DATA),
                     ledger.categories(spark), stage, S.AuditParams(recency_cutoff=ledger.CUTOFF))


@pytest.fixture(scope="module")
def out(run):
    return {name: df.collect() for name, df in run.reports().items()}


def test_status_is_flagged_exactly_for_invoices_with_flags(run):
    assert ids(run.audited.where("validation_status = 'FLAGGED'")) == sorted(
        {r.invoice_id for r in run.flags.collect()})
    by_join = flags.with_status(run.audited, run.flags).select("invoice_id", "validation_status")
    assert by_join.exceptAll(run.audited.select("invoice_id", "validation_status")).count() == 0


def test_a_flag_type_occurs_once_per_invoice(run):
    assert run.flags.groupBy("invoice_id", "flag_type").count().where("count > 1").count() == 0


def test_invoices_survive_the_audit(spark, run):
    want = ledger.invoices(spark, DATA)
    assert run.audited.count() == want.count()
    assert run.audited.select(want.columns).exceptAll(want).count() == 0
    assert keys.check_unique(run.audited, "invoice_id").count() == 0


def test_months_and_categories_add_up_to_the_total(out):
    kpi = out["kpi_overview"][0]
    months, cats = out["monthly_trends"], out["category_risk"]
    for rows, flagged in ((months, "flagged"), (cats, "flagged_invoices")):
        assert sum(r.total_invoices for r in rows) == kpi.total_invoices
        assert sum(r[flagged] for r in rows) == kpi.total_flagged
        assert sum(r.total_amount for r in rows) == kpi.total_amount
    assert [r.month for r in months] == sorted(r.month for r in months)
    assert all(r.flag_rate_pct == round(100 * r.flagged_invoices / r.total_invoices, 2) for r in cats)
    assert sum(r.flag_count for r in out["flags_breakdown"]) >= kpi.total_flagged


def test_scores_satisfy_their_definition(out):
    rows = out["vendor_risk_scores"]
    for r in rows:
        composite = (0.3 * r.anomaly_frequency + 0.3 * r.deviation_magnitude
                     + 0.2 * r.validation_failures + 0.2 * r.recency_score)
        assert abs(composite - r.composite_score) <= 0.0105
        assert r.risk_tier == ("HIGH" if r.composite_score >= 35
                               else "MEDIUM" if r.composite_score >= 20 else "LOW")
    for c in ("anomaly_frequency", "deviation_magnitude", "validation_failures", "recency_score"):
        assert min(r[c] for r in rows) == 0 and max(r[c] for r in rows) == 100
    assert [r.composite_score for r in rows] == sorted((r.composite_score for r in rows), reverse=True)


def test_report_columns(run):
    assert {name: df.columns for name, df in run.reports().items()} == {
        "kpi_overview": ["total_invoices", "total_amount", "total_tax_claimed", "total_flagged",
                         "flag_rate_pct"],
        "flags_breakdown": ["flag_type", "severity", "flag_count", "vendors_affected"],
        "monthly_trends": ["month", "total_invoices", "flagged", "total_amount", "avg_amount"],
        "vendor_risk_scores": ["vendor_id", "vendor_name", "category", "state_code",
                               "anomaly_frequency", "deviation_magnitude", "validation_failures",
                               "recency_score", "composite_score", "risk_tier"],
        "invoice_detail": ["invoice_id", "vendor_id", "vendor_name", "category", "gst_category",
                           "gst_rate", "invoice_date", "amount", "tax_claimed", "state_code",
                           "validation_status", "flag_types", "max_severity"],
        "category_risk": ["category_name", "gst_rate", "total_invoices", "flagged_invoices",
                          "avg_amount", "total_amount", "flag_rate_pct"],
    }


def test_invoice_detail(run):
    lexical = run.reports()["invoice_detail"]
    assert lexical.where("(flag_types IS NULL) <> (validation_status = 'CLEAN')").count() == 0
    both = run.audited.where(F.exists("flags", lambda f: f.severity == "HIGH")
                             & F.exists("flags", lambda f: f.severity == "MEDIUM"))
    assert both.count() > 0
    picked = lexical.join(both.select("invoice_id"), "invoice_id", "left_semi")
    assert {r.max_severity for r in picked.collect()} == {"MEDIUM"}
    ordinal = reports.report_invoice_detail(run.audited, run.vendors, run.categories, "ordinal",
                                            ordered=True)
    dates = [r.invoice_date for r in ordinal.collect()]
    assert dates == sorted(dates)
    assert {r.max_severity for r in ordinal.join(both.select("invoice_id"), "invoice_id",
                                                 "left_semi").collect()} == {"HIGH"}
    with pytest.raises(ValueError):
        reports.report_invoice_detail(run.audited, run.vendors, run.categories, "other")


def test_sql_over_the_views_gives_the_reports(spark, run, out):
    run.create_views()

    def same(sql, name):
        got = spark.sql(sql)
        assert got.columns == run.reports()[name].columns
        want = sorted((tuple(map(str, r)) for r in out[name]))
        assert sorted(tuple(map(str, r)) for r in got.collect()) == want

    same("""WITH n AS (SELECT *, if(validation_status = 'CLEAN', 0, 1) bad FROM invoices)
            SELECT count(bad) total_invoices, sum(amount) total_amount, sum(tax_claimed) total_tax_claimed,
                   sum(bad) total_flagged, round(avg(bad) * 100, 2) flag_rate_pct FROM n""",
         "kpi_overview")
    same("""WITH kinds AS (SELECT flag_type, severity, vendor_id, count(*) k FROM flags GROUP BY ALL)
            SELECT flag_type, severity, sum(k) flag_count, count(vendor_id) vendors_affected
            FROM kinds GROUP BY ALL""", "flags_breakdown")
    same("""SELECT vendor_id, vendor_name, category, state_code,
                   s.* EXCEPT (vendor_id, risk_tier), risk_tier
            FROM vendors JOIN vendor_risk_scores s USING (vendor_id)""", "vendor_risk_scores")
    same("""WITH kinds AS (SELECT invoice_id, array_join(sort_array(collect_set(flag_type)), ', ') flag_types,
                                  array_max(collect_list(severity)) max_severity
                           FROM flags GROUP BY invoice_id)
            SELECT invoice_id, vendor_id, vendor_name, category, category_name gst_category, gst_rate,
                   invoice_date, amount, tax_claimed, invoices.state_code, validation_status,
                   flag_types, max_severity
            FROM invoices JOIN vendors USING (vendor_id) JOIN gst_categories USING (category_id)
                 LEFT JOIN kinds USING (invoice_id)""", "invoice_detail")


def test_csv_export(spark, run, out, tmp_path):
    names = sinks.export_reports(run, str(tmp_path))
    sinks.export_reports(run, str(tmp_path))        # replaces, does not append
    assert sorted(names) == sorted(os.listdir(tmp_path))
    for name in names:
        parts = [f for f in os.listdir(tmp_path / name) if f.startswith("part-")]
        assert name in sinks.BIG_REPORTS or len(parts) == 1
        back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / name))
        assert back.columns == run.reports()[name].columns
        assert back.count() == len(out[name])


def test_csv_round_trip(spark, vendors, tmp_path):
    """Separators, quotes, outer spaces, line breaks, empty text, NULL, leading zeros."""
    names = ['Öl, Salz "und" Brot', "  two  ", "first\nsecond, third", "", None, "\\", '"', " , "]
    ven = vendors(*[(i, "07") for i in range(len(names))]).drop("vendor_name").join(
        spark.createDataFrame(list(enumerate(names)), "vendor_id long, vendor_name string"),
        "vendor_id").select(*S.VENDORS.fieldNames())
    sinks.write_csv(ven, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="multi_line=True"):
        tables.read_csv(spark, str(tmp_path / "v"), S.VENDORS)
    back = tables.read_csv(spark, str(tmp_path / "v"), S.VENDORS, multi_line=True)
    assert back.schema == S.VENDORS
    assert sorted(back.collect(), key=str) == sorted(ven.collect(), key=str)


def test_big_csv_files_are_read_in_splits(spark, vendors, tmp_path):
    names = ['a "quoted" one, with a comma', '""', "", None, "plain"]
    ven = vendors(*[(i, "07") for i in range(20_000)]).withColumn(
        "vendor_name", F.element_at(F.array(*map(F.lit, names)), (F.col("vendor_id") % 5 + 1).cast("int")))
    sinks.write_csv(ven, str(tmp_path / "v"), single_file=True)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        back = tables.read_csv(spark, str(tmp_path / "v"), S.VENDORS)
        assert back.rdd.getNumPartitions() > 4
        assert back.exceptAll(ven).count() == 0 and back.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def written(path, *lines):
    path.mkdir()
    for i, text in enumerate(lines):
        (path / f"part-{i}.csv").write_text(text)
    return str(path)


def test_csv_columns_go_by_name(spark, tmp_path):
    head = "state_code,vendor_id,category,extra,vendor_name,gstin,registration_date\n"
    path = written(tmp_path / "v", head + "07,1,Textiles,x,A,07A,2020-01-31\n")
    row = tables.read_csv(spark, path, S.VENDORS).first()
    assert (row.vendor_id, row.category, row.state_code) == (1, "Textiles", "07")
    assert str(row.registration_date) == "2020-01-31"
    with pytest.raises(ValueError, match="category_name"):
        tables.read_csv(spark, path, S.CATEGORIES)


@pytest.mark.parametrize("bad,field", [("bad,x,2020-01-31", "vendor_id"),
                                       ("1,x,notadate", "registration_date")])
def test_csv_with_bad_cells_fails(spark, tmp_path, bad, field):
    schema = T.StructType([S.VENDORS[c] for c in ("vendor_id", "vendor_name", "registration_date")])
    path = written(tmp_path / "v", "vendor_id,vendor_name,registration_date\n" + bad + "\n")
    with pytest.raises(Exception, match=f"{field} is not"):
        tables.read_csv(spark, path, schema).collect()


def test_csv_with_ragged_rows_or_other_headers_fails(spark, tmp_path):
    schema = T.StructType([S.VENDORS["vendor_id"], S.VENDORS["vendor_name"]])
    ragged = written(tmp_path / "r", "vendor_id,vendor_name\n1,a,b\n")
    other = written(tmp_path / "o", "vendor_id,vendor_name\n1,a\n", "vendor_name,vendor_id\nb,2\n")
    for path in (ragged, other):
        with pytest.raises(Exception):
            tables.read_csv(spark, path, schema).collect()


def test_parquet_and_table_sources_and_timestamps(spark, run, tmp_path):
    sinks.write_scores(run.scores, str(tmp_path / "scores"))
    sinks.write_scores(run.scores, str(tmp_path / "scores"))
    back = tables.read_committed(spark, str(tmp_path / "scores"))
    assert back.columns[-1] == "scored_at" and back.count() == run.scores.count()
    sinks.write_flags(run.flags, str(tmp_path / "flags"))
    read = tables.read_committed(spark, str(tmp_path / "flags"), S.FLAGS)
    assert read.schema == S.FLAGS and read.count() == run.flags.count()
    spark.range(3).withColumn("category_id", F.col("id").cast("int")).createOrReplaceTempView("cats_view")
    with pytest.raises(ValueError, match="category_name"):
        tables.read_table(spark, "cats_view", S.CATEGORIES)


def test_jdbc_options():
    got = tables.jdbc_options("jdbc:x", "invoices", user="u", password="p", partition_column="vendor_id",
                              lower=1, upper=1000, partitions=16)
    assert got == {"url": "jdbc:x", "dbtable": "invoices", "fetchsize": "10000", "user": "u",
                   "password": "p", "partitionColumn": "vendor_id", "lowerBound": "1",
                   "upperBound": "1000", "numPartitions": "16"}
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", "invoices", partition_column="vendor_id")
    with pytest.raises(ValueError, match="single_task"):
        tables.jdbc_options("jdbc:x", "invoices")
    assert tables.jdbc_options("jdbc:x", "small", single_task=True)["dbtable"] == "small"


def test_insert_if_absent(spark):
    cols = "invoice_id string, amount int"
    old = spark.createDataFrame([("a", 1), ("b", 2)], cols)
    new = spark.createDataFrame([("b", 9), ("c", 4), ("c", 3), ("d", None)], cols)
    got = sorted(keys.insert_if_absent(old, new, "invoice_id").collect())
    assert [tuple(r) for r in got] == [("a", 1), ("b", 2), ("c", 3), ("d", None)]
    again = keys.insert_if_absent(keys.insert_if_absent(old, new, "invoice_id"), new, "invoice_id")
    assert sorted(again.collect()) == got


def test_rows_without_a_key_are_refused_and_not_lost(spark):
    cols = "invoice_id string, amount int"
    old = spark.createDataFrame([("a", 1)], cols)
    new = spark.createDataFrame([(None, 1), (None, 2), ("b", 3)], cols)
    with pytest.raises(Exception, match="NULL in the key invoice_id"):
        keys.insert_if_absent(old, new, "invoice_id").collect()


def test_known_keys_go_before_anything_is_sorted(spark):
    cols = "invoice_id string, amount int"
    old, new = (spark.createDataFrame([("a", 1)], cols) for _ in range(2))
    text = keys.insert_if_absent(old, new, "invoice_id")._jdf.queryExecution().executedPlan().toString()
    aggregates = [i for i, line in enumerate(text.splitlines()) if "Aggregate" in line]
    anti = next(i for i, line in enumerate(text.splitlines()) if "LeftAnti" in line)
    assert max(aggregates) < anti


def test_key_checks(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    assert sorted(((r.k or 0), r.occurrences) for r in keys.check_unique(parent, "k").collect()) == [
        (0, 1), (2, 2)]
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "k int, t string")
    assert sorted(((r.k, r.t or ""), r.occurrences)
                  for r in keys.check_unique(pairs, "k", "t").collect()) == [
        ((1, "b"), 2), ((2, ""), 1)]
    child = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    assert [r.k for r in keys.check_fk(child, parent, "k").collect()] == [3]


def test_staging_uses_the_folder_of_the_session(spark, monkeypatch):
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir")
    stage = Stage(spark)
    first, second = stage(spark.range(3), "x"), stage(spark.range(4), "x")
    assert (first.count(), second.count()) == (3, 4)
    assert all(f.startswith(stage.path) for f in first.inputFiles())


def test_a_stage_deletes_its_own_folder_only(spark):
    other = Stage(spark)
    other(spark.range(2), "kept")
    with Stage(spark) as stage:
        stage(spark.range(5), "x")
        assert stage.bytes_written() > 0
    assert stage.bytes_written() == 0 and other.bytes_written() > 0
    assert other.path.rsplit("/", 1)[0] == stage.path.rsplit("/", 1)[0]
    stage.close()                                    # once more does no harm
    other.close()


@pytest.mark.parametrize("table", ["vendors", "categories", "invoices"])
def test_the_audit_refuses_repeated_keys(invoices, vendors, categories, stage, table):
    given = dict(vendors=vendors((1, "07")), categories=categories,
                 invoices=invoices(dict(), dict()))
    given[table] = given[table].unionByName(given[table])
    key = {"vendors": "vendor_id", "categories": "category_id", "invoices": "invoice_id"}[table]
    with pytest.raises(ValueError, match=f"{key} is not a key of {table}"):
        audit.run(given["invoices"], given["vendors"], given["categories"], stage)


def test_missing_fields_as_findings(invoices):
    inv = invoices(dict(), dict(vendor_id=None, amount=None))
    found = rules.missing_field_report(inv, emit_flags=True).collect()
    assert [(r.invoice_id, r.severity, r.details) for r in found] == [
        ("I001", "LOW", "Missing: vendor_id, amount")]


def test_frequency_is_ordered_by_rate(run):
    facts = signals.vendor_facts(run.audited, ledger.CUTOFF)
    rates = [r.flag_rate for r in signals.signal_frequency(facts).collect()]
    assert rates == sorted(rates, reverse=True)


def test_staging_refuses_a_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging_root(Session)
