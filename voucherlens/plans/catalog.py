"""Every operator as a query over the given tables: ``name -> f(spark, folder)``.

Results leave here in plain types (doubles rounded to four digits, ISO dates) so that another
engine can be compared with them; the operators themselves return decimals and dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voucherlens import schema as S
from voucherlens.operators import (baselines, flags, keys, quantiles, rolling, rules, scores,
                                   signals)
from voucherlens.plans import audit, reports
from voucherlens.sources import commits, ledger
from voucherlens.staging import Stage

PARAMS = S.AuditParams(recency_cutoff=ledger.CUTOFF)
Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    out = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 4)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        else:
            continue
        out[f.name] = c
    return df.withColumns(out) if out else df


def _validated(spark: SparkSession, folder: str, stage: Stage, **kind) -> DataFrame:
    narrow = ledger.invoices(spark, folder, **{**kind, "category": False, "state": False})
    return audit.validate(ledger.invoices(spark, folder, **kind),
                          ledger.vendor_states(spark, folder), stage, narrow)


def _clean(spark: SparkSession, folder: str, stage: Stage, category: bool = False) -> DataFrame:
    cols = ["invoice_id", "vendor_id", "invoice_date", "amount"]
    cols += ["category_id"] if category else []
    rows = audit.clean_rows(_validated(spark, folder, stage, category=category))
    return stage(rows.select(*cols), "clean")


def _audited(spark: SparkSession, folder: str, stage: Stage, **kind) -> DataFrame:
    return audit.find_outliers(
        stage(_validated(spark, folder, stage, **kind), "validated"), stage, PARAMS)


def _facts(spark: SparkSession, folder: str, stage: Stage, **kind) -> DataFrame:
    return signals.vendor_facts(_audited(spark, folder, stage, **kind), PARAMS.recency_cutoff)


def _scores(spark: SparkSession, folder: str, stage: Stage, **kind) -> DataFrame:
    # Staged, so that what is asked of the scores is not pushed through the min-max step.
    return stage(audit.vendor_scores(_audited(spark, folder, stage, **kind), stage, PARAMS),
                 "scores")


def _query(f: Callable[[SparkSession, str, Stage], DataFrame]) -> Query:
    """The result is lazy and reads staged tables: close the stage once it has been used. Without
    one of your own, the query makes one that stays until the checkpoint folder is cleared."""
    return lambda spark, folder, stage=None: plain(f(spark, folder, stage or Stage(spark)))


# --- rule checks -----------------------------------------------------------------------------

def dup_groups(spark, folder, stage):
    return rules.duplicate_groups(ledger.invoices(spark, folder, category=False, state=False))


def flag_duplicate(spark, folder, stage):
    inv = ledger.invoices(spark, folder, category=False, state=False)
    return rules.detect_duplicates(inv, groups=stage(rules.duplicate_groups(inv), "groups"))


def flag_state_mismatch(spark, folder, stage):
    return rules.detect_mismatch(ledger.invoices(spark, folder, category=False),
                                 ledger.vendor_states(spark, folder))


def flag_invalid_amount(spark, folder, stage):
    """Invalid amounts; -1 stands for a missing vendor."""
    return rules.detect_invalid_amount(
        ledger.invoices(spark, folder, category=False, state=False, dirty=True)
    ).fillna(-1, ["vendor_id"])


def missing_fields(spark, folder, stage):
    return rules.missing_field_report(
        ledger.invoices(spark, folder, category=False, state=False, dirty=True))


def validation_status(spark, folder, stage):
    return _validated(spark, folder, stage, category=False).select(
        "invoice_id", "vendor_id", "validation_status")


def validation_summary(spark, folder, stage):
    return reports.validation_summary(_validated(spark, folder, stage, category=False))


def status_from_flag_table(spark, folder, stage):
    """The status by way of a flag table that is joined back to the invoices."""
    inv = stage(ledger.invoices(spark, folder, category=False), "invoices")
    found = flags.union_flags(
        rules.detect_duplicates(inv, groups=stage(rules.duplicate_groups(inv), "groups")),
        rules.detect_mismatch(inv, ledger.vendor_states(spark, folder)),
        rules.detect_invalid_amount(inv))
    return flags.with_status(inv, found).select("invoice_id", "vendor_id", "validation_status")


# --- outliers --------------------------------------------------------------------------------

def zscore(spark, folder, stage):
    clean = _clean(spark, folder, stage)
    base = stage(baselines.vendor_baselines(clean), "baselines")
    return baselines.with_zscore(clean, base).select(
        "invoice_id", "vendor_id", "amount", "baseline", "std_dev", "z_score")


def flag_zscore(spark, folder, stage):
    clean = _clean(spark, folder, stage)
    base = stage(baselines.vendor_baselines(clean), "baselines")
    return baselines.detect_zscore(clean, baselines=base)


def _rolled(clean, stage):
    sizes = stage(clean.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n_rows")), "sizes")
    return rolling.with_preceding_by_size(clean, sizes, PARAMS.max_group_rows, stage)


def rolling_average(spark, folder, stage):
    return _rolled(_clean(spark, folder, stage), stage).select(
        "invoice_id", "vendor_id", "amount", rolling.rolling_mean().alias("rolling_avg"),
        rolling.spike_ratio().alias("spike_ratio"))


def flag_rolling_spike(spark, folder, stage):
    clean = _clean(spark, folder, stage)
    return rolling.detect_rolling_spike(clean, preceding=_rolled(clean, stage))


def flag_rolling_spike_in_blocks(spark, folder, stage):
    """The plan for giant vendors, with every vendor of the data sent through it."""
    clean = _clean(spark, folder, stage)
    rolled = rolling.with_preceding_in_blocks(clean, block_rows=200, stage=stage)
    return rolling.detect_rolling_spike(clean, preceding=rolled)


def category_fences(spark, folder, stage):
    return quantiles.iqr_fences(_clean(spark, folder, stage, category=True), stage)


def flag_iqr(spark, folder, stage):
    clean = _clean(spark, folder, stage, category=True)
    return quantiles.detect_iqr(clean, stage(quantiles.iqr_fences(clean, stage), "fences"))


# --- flags and status of both layers ---------------------------------------------------------

def all_flags(spark, folder, stage):
    return flags.flag_table(_audited(spark, folder, stage))


def flags_by_type(spark, folder, stage):
    return reports.flag_counts(flags.flag_table(_audited(spark, folder, stage)))


def final_status(spark, folder, stage):
    return _audited(spark, folder, stage).select("invoice_id", "vendor_id", "validation_status")


def flag_rate_overall(spark, folder, stage):
    return reports.flag_rate_overall(_audited(spark, folder, stage))


# --- scores ----------------------------------------------------------------------------------

def anomaly_frequency(spark, folder, stage):
    return signals.signal_frequency(_facts(spark, folder, stage))


def deviation_magnitude(spark, folder, stage):
    return signals.signal_magnitude(_facts(spark, folder, stage))


def magnitude_from_text(spark, folder, stage):
    return signals.magnitude_from_text(flags.flag_table(_audited(spark, folder, stage)))


def validation_failure_rate(spark, folder, stage):
    return signals.signal_high_severity(_facts(spark, folder, stage))


def recency_ratio(spark, folder, stage):
    return signals.signal_recency(_facts(spark, folder, stage))


def minmax_normalise(spark, folder, stage):
    return scores.minmax_scale(
        stage(signals.vendor_signals(_facts(spark, folder, stage)), "signals"))


def vendor_scores(spark, folder, stage):
    return _scores(spark, folder, stage)


def risk_tier(spark, folder, stage):
    return _scores(spark, folder, stage).select("vendor_id", "risk_tier")


def tier_distribution(spark, folder, stage):
    return scores.tier_distribution(_scores(spark, folder, stage))


def top_risk_vendors(spark, folder, stage):
    return scores.audit_queue(_scores(spark, folder, stage), ledger.vendors(spark, folder),
                              PARAMS.queue_size)


def top_medium_vendors(spark, folder, stage):
    return scores.audit_queue(_scores(spark, folder, stage), ledger.vendors(spark, folder),
                              PARAMS.queue_size, S.MEDIUM)


def dirty_vendor_scores(spark, folder, stage):
    """Scores of the ledger with negative amounts and missing vendors (as vendor -1)."""
    return _scores(spark, folder, stage, dirty=True).fillna(-1, ["vendor_id"])


# --- reports ---------------------------------------------------------------------------------

def report_kpi(spark, folder, stage):
    return reports.report_kpi(_audited(spark, folder, stage))


def report_flags(spark, folder, stage):
    return reports.report_flags(flags.flag_table(_audited(spark, folder, stage)))


def report_monthly(spark, folder, stage):
    return reports.report_monthly(_audited(spark, folder, stage))


def report_vendor_scores(spark, folder, stage):
    return reports.report_vendor_scores(_scores(spark, folder, stage),
                                        ledger.vendors(spark, folder))


def report_invoice_detail(spark, folder, stage):
    # The vendor table is the result of joins here; staged, its size is known to the join.
    vendors = stage(ledger.vendors(spark, folder), "vendors")
    return reports.report_invoice_detail(_audited(spark, folder, stage), vendors,
                                         ledger.categories(spark))


def report_category(spark, folder, stage):
    return reports.report_category(_audited(spark, folder, stage), ledger.categories(spark))


# --- keys and appends ------------------------------------------------------------------------

def duplicate_ids(spark, folder, stage):
    """Order and line number, which look like a key of the lines and are not."""
    return keys.check_unique(ledger.line_numbers(spark, folder), "l_orderkey", "l_linenumber")


def missing_field_flags(spark, folder, stage):
    """The missing fields as findings; -1 stands for a missing vendor."""
    return rules.missing_field_report(
        ledger.invoices(spark, folder, category=False, state=False, dirty=True),
        emit_flags=True).fillna(-1, ["vendor_id"])


def unknown_vendors(spark, folder, stage):
    """Invoices of vendors that do not exist, in the ledger with broken vendor ids."""
    inv = ledger.invoices(spark, folder, category=False, state=False, dirty=True)
    return keys.check_fk(inv, ledger.vendor_states(spark, folder), "vendor_id").select(
        "invoice_id", "vendor_id")


def insert_if_absent(spark, folder, stage):
    """A ledger without copies receives the whole ledger again, with the tax set to zero."""
    kind = dict(category=False, state=False)
    incoming = ledger.invoices(spark, folder, **kind).withColumn(
        "tax_claimed", F.lit(0).cast(S.MONEY))
    return keys.insert_if_absent(ledger.invoices(spark, folder, copies=False, **kind),
                                 incoming, "invoice_id")


def append_only_new(spark, folder, stage):
    """The same as an append at rest: what the second run adds is written, and nothing else.

    The second run is sent twice, and a third one with the same rows: they add nothing.
    """
    kind = dict(category=False, state=False)
    old = ledger.invoices(spark, folder, copies=False, **kind)
    new = ledger.invoices(spark, folder, **kind).withColumn("tax_claimed", F.lit(0).cast(S.MONEY))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at_rest = commits.KeyedLedger(spark, f"{stage.path}/ledger", old.schema, "invoice_id", buckets)
    for rows, run in ((old, "first"), (new, "second"), (new, "second"), (new, "third")):
        at_rest.append(rows, run)
    return at_rest.rows()


def flag_log(spark, folder, stage):
    """The flags of both layers in a log by layer and date; the second layer is run again."""
    found = stage(_audited(spark, folder, stage), "audited")
    log = commits.FlagLog(spark, f"{stage.path}/flags")
    table = flags.flag_table(found)
    first = F.col("flag_type").isin(*S.LAYER_1)
    for layer, rows in ((1, first), (2, ~first), (2, ~first)):
        log.write(table.where(rows), layer, PARAMS.recency_cutoff)
    return log.flags().drop("flag_date")


# --- the same detectors over the event table -------------------------------------------------

def events_flag_zscore(spark, folder, stage):
    events = ledger.event_invoices(spark, folder)
    base = stage(baselines.vendor_baselines(events), "baselines")
    return baselines.detect_zscore(events, baselines=base)


def events_flag_rolling_spike(spark, folder, stage):
    events = ledger.event_invoices(spark, folder)
    return rolling.detect_rolling_spike(events, preceding=_rolled(events, stage))


def events_flag_iqr(spark, folder, stage):
    events = ledger.event_invoices(spark, folder)
    return quantiles.detect_iqr(events, stage(quantiles.iqr_fences(events, stage), "fences"))


# Amounts with four decimals: the detectors take the scale from the column.

FINE = T.DecimalType(18, 4)


def fine_flag_zscore(spark, folder, stage):
    events = ledger.event_invoices(spark, folder, FINE)
    base = stage(baselines.vendor_baselines(events), "baselines")
    return baselines.detect_zscore(events, baselines=base)


def fine_flag_rolling_spike(spark, folder, stage):
    events = ledger.event_invoices(spark, folder, FINE)
    return rolling.detect_rolling_spike(events, preceding=_rolled(events, stage))


def fine_flag_iqr(spark, folder, stage):
    events = ledger.event_invoices(spark, folder, FINE)
    return quantiles.detect_iqr(events, stage(quantiles.iqr_fences(events, stage), "fences"))


# Amounts below 1, and amounts whose squares no decimal holds.

def small_category_fences(spark, folder, stage):
    """Fences of a thousandth of the values, in millionths."""
    events = ledger.event_invoices(spark, folder)
    small = (F.col("amount") / F.lit(1000)).cast("decimal(18,6)")
    return quantiles.iqr_fences(stage(events.withColumn("amount", small), "small"), stage)


def wide_zscore(spark, folder, stage):
    """z-scores of 10^18 times the values, as decimals of 38 digits."""
    events = ledger.event_invoices(spark, folder)
    wide = (F.col("amount") * F.lit(10 ** 18)).cast("decimal(38,2)")
    rows = events.withColumn("amount", wide)
    base = stage(baselines.vendor_baselines(rows), "baselines")
    return baselines.with_zscore(rows, base).select("invoice_id", "vendor_id", "z_score")


QUERIES: dict[str, Query] = {f.__name__: _query(f) for f in (
    dup_groups, flag_duplicate, flag_state_mismatch, flag_invalid_amount, missing_fields,
    validation_status, validation_summary, status_from_flag_table,
    zscore, flag_zscore, rolling_average, flag_rolling_spike, flag_rolling_spike_in_blocks,
    category_fences, flag_iqr,
    all_flags, flags_by_type, final_status, flag_rate_overall,
    anomaly_frequency, deviation_magnitude, magnitude_from_text, validation_failure_rate,
    recency_ratio, minmax_normalise, vendor_scores, risk_tier, tier_distribution,
    top_risk_vendors, top_medium_vendors, dirty_vendor_scores,
    report_kpi, report_flags, report_monthly, report_vendor_scores, report_invoice_detail,
    report_category,
    duplicate_ids, missing_field_flags, unknown_vendors, insert_if_absent,
    append_only_new, flag_log,
    events_flag_zscore, events_flag_rolling_spike, events_flag_iqr,
    fine_flag_zscore, fine_flag_rolling_spike, fine_flag_iqr,
    small_category_fences, wide_zscore,
)}
