"""Summary reports over audited invoices, flags and scores.

``audited`` always means invoices with their ``flags`` and ``validation_status``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens import schema as S
from voucherlens.functions.money import mean2, pct2


def _flagged() -> Column:
    return F.count_if(F.col("validation_status") == S.FLAGGED)


def validation_summary(inv: DataFrame) -> DataFrame:
    """One row: clean, flagged and all invoices, with percentages."""
    total = F.col("total_invoices")
    return inv.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(F.col("validation_status") == S.CLEAN).alias("clean_invoices"),
        _flagged().alias("flagged_invoices"),
    ).select("*", pct2(F.col("clean_invoices"), total).alias("clean_pct"),
             pct2(F.col("flagged_invoices"), total).alias("flagged_pct"))


def flag_rate_overall(audited: DataFrame) -> DataFrame:
    """One row: flagged invoices, all invoices and the rate."""
    return audited.agg(_flagged().alias("flagged_invoices"),
                       F.count(F.lit(1)).alias("total_invoices")).select(
        "*", pct2(F.col("flagged_invoices"), F.col("total_invoices")).alias("flag_rate_pct"))


def flag_counts(flags: DataFrame) -> DataFrame:
    """Flags per type and severity, most frequent first."""
    return (flags.groupBy("flag_type", "severity").agg(F.count(F.lit(1)).alias("flag_count"))
            .orderBy(F.desc("flag_count"), "flag_type", "severity"))


def report_kpi(audited: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    return audited.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.sum("amount").alias("total_amount"),
        F.sum("tax_claimed").alias("total_tax_claimed"),
        _flagged().alias("total_flagged"),
    ).withColumn("flag_rate_pct", pct2(F.col("total_flagged"), F.col("total_invoices")))


def report_flags(flags: DataFrame) -> DataFrame:
    """Flags and affected vendors per type and severity.

    Flags are first counted per vendor, so the distinct count needs no expansion of rows.
    """
    per_vendor = flags.groupBy("flag_type", "severity", "vendor_id").agg(
        F.count(F.lit(1)).alias("_n"))
    return (per_vendor.groupBy("flag_type", "severity")
            .agg(F.sum("_n").alias("flag_count"), F.count("vendor_id").alias("vendors_affected"))
            .orderBy(F.desc("flag_count"), "flag_type", "severity"))


def report_monthly(audited: DataFrame) -> DataFrame:
    """Invoices, flagged invoices and amounts per calendar month."""
    return (audited.groupBy(F.trunc("invoice_date", "MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("total_invoices"), _flagged().alias("flagged"),
                 F.sum("amount").alias("total_amount"), F.count("amount").alias("_n"))
            .select("month", "total_invoices", "flagged", "total_amount",
                    mean2(F.col("total_amount"), F.col("_n")).alias("avg_amount"))
            .orderBy("month"))


def report_vendor_scores(scores: DataFrame, vendors: DataFrame) -> DataFrame:
    """Scores with vendor attributes, highest composite first."""
    return (scores.join(vendors.select("vendor_id", "vendor_name", "category", "state_code"),
                        "vendor_id")
            .select("vendor_id", "vendor_name", "category", "state_code", "anomaly_frequency",
                    "deviation_magnitude", "validation_failures", "recency_score",
                    "composite_score", "risk_tier")
            .orderBy(F.desc("composite_score"), "vendor_id"))


def max_severity(flags: Column, severity_order: str = "lexical") -> Column:
    """``lexical`` compares the words (MEDIUM > LOW > HIGH); ``ordinal`` ranks HIGH first."""
    words = F.transform(flags, lambda f: f["severity"])
    if severity_order == "lexical":
        return F.array_max(words)
    if severity_order != "ordinal":
        raise ValueError("severity_order must be 'lexical' or 'ordinal'")
    return (F.when(F.array_contains(words, S.HIGH), S.HIGH)
            .when(F.array_contains(words, S.MEDIUM), S.MEDIUM)
            .when(F.array_contains(words, S.LOW), S.LOW))


def report_invoice_detail(audited: DataFrame, vendors: DataFrame, categories: DataFrame,
                          severity_order: str = "lexical", ordered: bool = False) -> DataFrame:
    """One row per invoice with its vendor, category, flag types and highest severity.

    The findings travel with the invoice, so only the two dimensions are joined. ``ordered``
    adds the global sort by date, which costs a range shuffle of the whole ledger.
    """
    # Most invoices have no findings and skip the array functions.
    has_flags = F.size("flags") > 0
    types = F.array_join(F.array_sort(F.array_distinct(
        F.transform("flags", lambda f: f["flag_type"]))), ", ")
    out = (audited
           .join(vendors.select("vendor_id", "vendor_name", "category"), "vendor_id")
           .join(categories.select("category_id", F.col("category_name").alias("gst_category"),
                                   "gst_rate"), "category_id")
           .select("invoice_id", "vendor_id", "vendor_name", "category", "gst_category",
                   "gst_rate", "invoice_date", "amount", "tax_claimed", "state_code",
                   "validation_status", F.when(has_flags, types).alias("flag_types"),
                   F.when(has_flags, max_severity(F.col("flags"), severity_order))
                   .alias("max_severity")))
    return out.orderBy("invoice_date", "invoice_id") if ordered else out


def report_category(audited: DataFrame, categories: DataFrame) -> DataFrame:
    """Invoices, flagged invoices and amounts per category name and rate, worst rate first.

    Invoices are summed per category id before the join, so only one row per category meets
    the dimension.
    """
    per_id = audited.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("invoice_id").alias("_ids"),
        _flagged().alias("_flagged"), F.sum("amount").alias("_amount"),
        F.count("amount").alias("_amounts"))
    return (per_id.join(categories, "category_id")
            .groupBy("category_name", "gst_rate")
            .agg(F.sum("_ids").alias("total_invoices"), F.sum("_flagged").alias("flagged_invoices"),
                 F.sum("_amount").alias("total_amount"), F.sum("_amounts").alias("_amounts"),
                 F.sum("_rows").alias("_rows"))
            .select("category_name", "gst_rate", "total_invoices", "flagged_invoices",
                    mean2(F.col("total_amount"), F.col("_amounts")).alias("avg_amount"),
                    "total_amount",
                    pct2(F.col("flagged_invoices"), F.col("_rows")).alias("flag_rate_pct"))
            .orderBy(F.desc("flag_rate_pct"), "category_name"))
