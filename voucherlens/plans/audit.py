"""The audit from ledger to scores, and where its intermediate tables are staged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens import schema as S
from voucherlens.functions.money import exact_type
from voucherlens.operators import (baselines, keys, quantiles, rolling, rules, scores,
                                   signals)
from voucherlens.operators.flags import collect_flags, flag_table, status_of
from voucherlens.plans import reports

Staging = Callable[[DataFrame, str], DataFrame]
MARKS = ("is_duplicate", "is_mismatch", "is_invalid")


def validate(inv: DataFrame, vendors: DataFrame, stage: Staging,
             inv_keys: DataFrame | None = None) -> DataFrame:
    """Layer 1: ``inv`` with one boolean mark per rule check, and a status.

    The findings themselves follow from the marks (``rules.rule_flags``), so the staged table
    stays narrow.

    ``inv_keys`` may give the columns of the duplicate check by a cheaper query than ``inv``;
    Spark prunes columns but not the left joins that would supply the others.
    """
    groups = stage(rules.duplicate_groups(inv if inv_keys is None else inv_keys),
                   "duplicate_groups")
    marked = rules.mark_mismatch(rules.mark_duplicates(inv, groups), vendors)
    any_mark = F.col("is_duplicate") | F.col("is_mismatch") | F.col("is_invalid")
    return (marked
            .withColumn("is_invalid", F.coalesce(rules.is_invalid_amount(), F.lit(False)))
            .withColumn("validation_status", F.when(any_mark, S.FLAGGED).otherwise(S.CLEAN))
            .select(*inv.columns, *MARKS, "validation_status"))


def clean_rows(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("validation_status") == S.CLEAN)


def find_outliers(validated: DataFrame, stage: Staging,
                  params: S.AuditParams = S.AuditParams()) -> DataFrame:
    """Layer 2: all invoices with their findings of both layers and the final status.

    The three detectors read the same clean rows. ``validated`` should be staged: it is read
    for the baselines, the quartiles (both narrow) and the rows themselves. Taking the sums of baselines
    and quartiles in one scan by grouping sets was measured slower: every aggregate then runs over the rows
    of both sets.
    """
    columns = [c for c in validated.columns if c not in (*MARKS, "validation_status")]
    clean = clean_rows(validated).select(*columns)
    kind = exact_type(clean, "amount")
    base = stage(baselines.vendor_baselines(clean), "baselines")
    fences = stage(quantiles.iqr_fences(clean, stage, k=params.iqr_k), "fences")
    rolled = rolling.with_preceding_by_size(clean, base, params.max_group_rows, stage,
                                            rows=params.window_rows)
    judged = baselines.with_zscore(rolled, base).join(fences, "category_id", "left")
    flags = collect_flags(
        (F.col("z_score") > params.z_min, baselines.zscore_finding(
            params.z_min, params.z_high, kind=kind)),
        (rolling.is_spike(params.spike_factor, kind=kind),
         rolling.spike_finding(params.spike_factor, kind=kind)),
        (quantiles.is_outlier(), quantiles.iqr_finding(kind=kind)),
    )
    judged = judged.select(*columns, flags.alias("flags"))
    ruled_out = (validated.where(F.col("validation_status") == S.FLAGGED)
                 .select(*columns, rules.rule_flags().alias("flags")))
    return judged.unionByName(ruled_out).withColumn("validation_status", status_of(F.col("flags")))


def vendor_scores(audited: DataFrame, stage: Staging,
                  params: S.AuditParams = S.AuditParams()) -> DataFrame:
    """Layer 3: one scored row per vendor that has invoices."""
    facts = signals.vendor_facts(audited, params.recency_cutoff)
    return scores.score_vendors(stage(signals.vendor_signals(facts), "signals"), params)


@dataclass(frozen=True)
class Audit:
    """The staged results of one run. Reports are lazy queries over them."""

    audited: DataFrame
    flags: DataFrame
    scores: DataFrame
    vendors: DataFrame
    categories: DataFrame

    def create_views(self) -> None:
        """Names the five tables, so that plain SQL can be run against the results."""
        self.audited.drop("flags").createOrReplaceTempView("invoices")
        self.flags.createOrReplaceTempView("flags")
        self.scores.createOrReplaceTempView("vendor_risk_scores")
        self.vendors.createOrReplaceTempView("vendors")
        self.categories.createOrReplaceTempView("gst_categories")

    def reports(self) -> dict[str, DataFrame]:
        return {
            "kpi_overview": reports.report_kpi(self.audited),
            "flags_breakdown": reports.report_flags(self.flags),
            "monthly_trends": reports.report_monthly(self.audited),
            "vendor_risk_scores": reports.report_vendor_scores(self.scores, self.vendors),
            "invoice_detail": reports.report_invoice_detail(
                self.audited, self.vendors, self.categories),
            "category_risk": reports.report_category(self.audited, self.categories),
        }


def check_keys(inv: DataFrame, vendors: DataFrame, categories: DataFrame,
               invoice_ids: bool = True) -> None:
    """Raises unless the keys of the three tables are unique and not NULL.

    A vendor or category that is there twice would double its invoices in every join. Checking
    the invoice ids costs a shuffle of that one column.
    """
    keys.require_unique(vendors, "vendors", "vendor_id")
    keys.require_unique(categories, "categories", "category_id")
    if invoice_ids:
        keys.require_unique(inv, "invoices", "invoice_id")


def run(inv: DataFrame, vendors: DataFrame, categories: DataFrame, stage: Staging,
        params: S.AuditParams = S.AuditParams(), inv_keys: DataFrame | None = None,
        check_invoice_ids: bool = True) -> Audit:
    """The whole audit. Each big table is written once and read back where it is needed.

    The keys are checked first. ``inv_keys`` may give id, vendor, amount and date of the
    invoices by a cheaper query than ``inv``, for the id check and the duplicate groups.
    """
    check_keys(inv if inv_keys is None else inv_keys, vendors, categories, check_invoice_ids)
    validated = stage(validate(inv, vendors, stage, inv_keys), "validated")
    audited = stage(find_outliers(validated, stage, params), "audited")
    scored = stage(vendor_scores(audited, stage, params), "scores")
    return Audit(audited, flag_table(audited), scored, vendors, categories)
