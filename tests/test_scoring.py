import datetime as dt
import random

import pytest
from conftest import day, ids
from pyspark.sql import functions as F

from voucherlens import schema as S
from voucherlens.functions.scoring import risk_tier
from voucherlens.operators import flags, scores, signals
from voucherlens.plans import audit

CUTOFF = day(100)
FLAG_FIELDS = S.FLAG.simpleString()


def with_flags(inv, found):
    """Attaches (invoice_id, flag_type, severity, score) findings."""
    spark = inv.sparkSession
    rows = [(i, None, t, s, f"Z-score: {z:.2f} | x" if t == S.STATISTICAL_ZSCORE else "x", z, None, None)
            for i, t, s, z in found]
    return flags.attach_flags(inv, spark.createDataFrame(rows, S.FLAGS))


def by_vendor(df):
    return {r.vendor_id: r for r in df.collect()}


@pytest.fixture()
def audited(invoices):
    inv = invoices(
        dict(vendor_id=1, invoice_date=day(99)), dict(vendor_id=1, invoice_date=day(100)),
        dict(vendor_id=1, invoice_date=day(101)), dict(vendor_id=2, invoice_date=day(100)),
        dict(vendor_id=3), dict(vendor_id=3), dict(vendor_id=3))
    return with_flags(inv, [
        ("I000", S.STATISTICAL_ZSCORE, "HIGH", 3.016), ("I000", S.IQR_OUTLIER, "MEDIUM", 1.0),
        ("I001", S.STATISTICAL_ZSCORE, "MEDIUM", 2.5), ("I003", S.DUPLICATE, "MEDIUM", None)])


def test_signals(audited):
    facts = signals.vendor_facts(audited, CUTOFF)
    freq = by_vendor(signals.signal_frequency(facts))
    assert (freq[1].flagged_invoices, freq[1].flag_rate) == (2, 66.67)
    assert (freq[2].flag_rate, freq[3].flag_rate) == (100.0, 0.0)
    mag = by_vendor(signals.signal_magnitude(facts))
    assert mag.keys() == {1} and mag[1].avg_zscore == (3.02 + 2.50) / 2
    high = by_vendor(signals.signal_high_severity(facts))
    assert (high[1].high_flag_rate, high[2].high_flag_rate) == (33.33, 0.0)
    rec = by_vendor(signals.signal_recency(facts))
    # one recent flag over two older ones; only recent flags; vendor 3 has none
    assert (rec[1].recent_flags, rec[1].older_flags, rec[1].recency_ratio) == (1, 2, 50.0)
    assert rec[2].recency_ratio == 100.0 and 3 not in rec


def test_magnitude_from_text_equals_typed(audited):
    facts = signals.vendor_facts(audited, CUTOFF)
    table = flags.flag_table(audited)
    assert by_vendor(signals.magnitude_from_text(table)) == by_vendor(signals.signal_magnitude(facts))


def test_recency_equals_the_full_join(audited):
    facts = signals.vendor_facts(audited, CUTOFF)
    dated = flags.flag_table(audited).join(audited.select("invoice_id", "invoice_date"), "invoice_id")

    def count(cond, name):
        return dated.where(cond).groupBy("vendor_id").agg(F.count(F.lit(1)).alias(name))
    both = count(F.col("invoice_date") >= CUTOFF, "recent").join(
        count(F.col("invoice_date") < CUTOFF, "older"), "vendor_id", "full")
    want = {r.vendor_id: (r.recent or 0, r.older or 0,
                          round(100 * (r.recent or 0) / r.older, 2) if r.older else 100.0)
            for r in both.collect()}
    got = {r.vendor_id: (r.recent_flags, r.older_flags, r.recency_ratio)
           for r in signals.signal_recency(facts).collect()}
    assert got == want


def test_null_vendor_counts_no_flagged_invoices(invoices):
    audited = with_flags(invoices(dict(vendor_id=None), dict(vendor_id=1)),
                         [("I000", S.ROLLING_SPIKE, "HIGH", 4.0)])
    got = by_vendor(signals.vendor_signals(signals.vendor_facts(audited, CUTOFF)))
    assert (got[None].frequency, got[None].validation, got[None].recency) == (0.0, 0.0, 0.0)


def signal_rows(spark, *rows):
    return spark.createDataFrame(
        list(rows), "vendor_id long, frequency double, magnitude double, validation double, recency double")


def test_scaling(spark):
    got = by_vendor(scores.minmax_scale(signal_rows(
        spark, (1, 10.0, 2.0, 5.0, 50.0), (2, 30.0, 4.0, 5.0, None), (3, 20.0, None, 5.0, 150.0))))
    assert (got[1].frequency, got[3].frequency, got[2].frequency) == (0.0, 50.0, 100.0)
    # bounds come from vendors that have the signal; a missing one is 0, below the minimum
    assert (got[1].magnitude, got[2].magnitude, got[3].magnitude) == (0.0, 100.0, 0.0)
    assert {r.validation for r in got.values()} == {0.0}          # all equal
    assert (got[2].recency, got[3].recency) == (0.0, 100.0)


def test_scaling_without_any_value(spark):
    got = by_vendor(scores.minmax_scale(signal_rows(spark, (1, 0.0, None, 0.0, None))))
    assert tuple(got[1])[1:] == (0.0, 0.0, 0.0, 0.0)


def test_tier_limits(spark):
    df = spark.createDataFrame([(35.0,), (34.999,), (20.0,), (19.999,)], "c double")
    assert [r.t for r in df.select(risk_tier(F.col("c")).alias("t")).collect()] == [
        "HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_composite_is_weighted_and_tier_uses_unrounded(spark):
    got = by_vendor(scores.score_vendors(signal_rows(
        spark, (1, 0.0, 1.0, 0.0, 0.0), (2, 100.0, 3.0, 100.0, 100.0), (3, 66.65, 1.0, 49.99, 24.99))))
    assert (got[1].composite_score, got[2].composite_score) == (0.0, 100.0)
    assert got[3].composite_score == 34.99 and got[3].risk_tier == "MEDIUM"
    dist = scores.tier_distribution(scores.score_vendors(signal_rows(
        spark, (1, 0.0, 1.0, 0.0, 0.0), (2, 100.0, 3.0, 100.0, 100.0)))).collect()
    assert [(r.risk_tier, r.vendors, float(r.avg_score)) for r in dist] == [
        ("HIGH", 1, 100.0), ("LOW", 1, 0.0)]


def test_queue_is_ordered_limited_and_joined(spark, vendors):
    rows = [(i, 0.0, 0.0, 0.0, 0.0, 90.0 if i < 4 else 50.0, "HIGH") for i in range(12)]
    rows.append((50, 0.0, 0.0, 0.0, 0.0, 30.0, "MEDIUM"))
    table = spark.createDataFrame(
        rows, "vendor_id long, anomaly_frequency double, deviation_magnitude double, "
              "validation_failures double, recency_score double, composite_score double, risk_tier string")
    queue = scores.audit_queue(table, vendors(*[(i, "07") for i in range(1, 60)]), n=5)
    assert [r.vendor_id for r in queue.collect()] == [1, 2, 3, 4, 5]
    assert queue.columns == ["vendor_id", "vendor_name", "category", "composite_score", "risk_tier"]


def test_empty_ledger(invoices, vendors, categories, stage):
    run = audit.run(invoices(), vendors((1, "07")), categories, stage)
    assert run.audited.count() == run.flags.count() == run.scores.count() == 0
    kpi = run.reports()["kpi_overview"].first()
    assert (kpi.total_invoices, kpi.total_flagged, kpi.flag_rate_pct) == (0, 0, None)
    assert all(df.collect() is not None for df in run.reports().values())


def test_result_does_not_depend_on_partitions_or_block_size(spark, invoices, vendors, categories, stage):
    rnd = random.Random(3)
    inv = invoices(*[dict(vendor_id=rnd.choice([1, 1, 1, 2, 3]), category_id=rnd.choice([1, 2]),
                          amount=rnd.choice([100, 200, 5000]) + i % 7, state_code=rnd.choice(["07"] * 9 + ["09"]),
                          invoice_date=day(rnd.randint(0, 200))) for i in range(300)])
    ven = vendors((1, "07"), (2, "07"), (3, "07"))

    def result(df, parts, limit):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            params = S.AuditParams(recency_cutoff=day(100), max_group_rows=limit)
            run = audit.run(df, ven, categories, stage, params)
            return (sorted(run.scores.collect()), sorted(run.flags.drop("score").collect(), key=str),
                    ids(run.audited))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    first = result(inv, 8, 5_000_000)
    assert len(first[1]) > 10
    assert result(inv.repartition(13), 3, 40) == first
    assert result(inv.coalesce(1), 1, 5_000_000) == first     # a second run gives the same again


def test_defaults():
    p = S.AuditParams()
    assert (p.z_min, p.z_high, p.window_rows, p.spike_factor, p.iqr_k) == (2, 3, 30, 3, 1.5)
    assert p.recency_cutoff == dt.date(2024, 7, 1)
    assert p.w_frequency + p.w_magnitude + p.w_validation + p.w_recency == pytest.approx(1)
