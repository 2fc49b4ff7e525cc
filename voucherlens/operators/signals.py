"""Per-vendor risk signals. One aggregate over the audited invoices feeds all four."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens import schema as S
from voucherlens.functions.money import mean, pct2


def vendor_facts(audited: DataFrame, cutoff: dt.date) -> DataFrame:
    """Counts per vendor from invoices that carry their ``flags``.

    Every invoice is one row, so distinct flagged invoices are a plain count, the date of a
    flag needs no join, and everything is combined before the shuffle. Invoices without a
    vendor form one group; it counts as having no flagged invoices, because a NULL vendor
    never joins to its flags.
    """
    known = F.col("vendor_id").isNotNull()
    n_flags = F.size("flags")
    is_high = (n_flags > 0) & F.exists("flags", lambda f: f["severity"] == S.HIGH)
    z = F.filter("flags", lambda f: f["flag_type"] == S.STATISTICAL_ZSCORE)
    z2 = F.when(n_flags > 0, F.round(F.get(z, F.lit(0))["score"], 2).cast("decimal(18,2)"))
    recent = F.col("invoice_date") >= F.lit(cutoff)
    older = F.col("invoice_date") < F.lit(cutoff)
    return audited.groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(known & (n_flags > 0)).alias("flagged_invoices"),
        F.count_if(known & is_high).alias("high_invoices"),
        F.sum(z2).alias("z_total"),
        F.count(z2).alias("z_flags"),
        F.sum(F.when(recent, n_flags).otherwise(0)).alias("recent_flags"),
        F.sum(F.when(older, n_flags).otherwise(0)).alias("older_flags"),
    )


def signal_frequency(facts: DataFrame) -> DataFrame:
    """Flagged invoices per 100 invoices, highest rate first."""
    rate = pct2(F.col("flagged_invoices"), F.col("total_invoices"))
    return (facts.select("vendor_id", "total_invoices", "flagged_invoices",
                         rate.alias("flag_rate"))
            .orderBy(F.desc("flag_rate"), "vendor_id"))


def signal_magnitude(facts: DataFrame) -> DataFrame:
    """Mean z-score of the vendor's z-score flags, each taken with two decimals."""
    return (facts.where(F.col("z_flags") > 0)
            .select("vendor_id",
                    mean(F.col("z_total"), F.col("z_flags")).alias("avg_zscore")))


def signal_high_severity(facts: DataFrame) -> DataFrame:
    """Invoices with a HIGH flag of any type, per 100 invoices."""
    return facts.select("vendor_id", "total_invoices", "high_invoices",
                        pct2(F.col("high_invoices"), F.col("total_invoices")).alias("high_flag_rate"))


def signal_recency(facts: DataFrame) -> DataFrame:
    """Flags on or after the cutoff per 100 flags before it; 100 if there are none before."""
    return (facts.where(F.col("recent_flags") + F.col("older_flags") > 0)
            .select("vendor_id", "recent_flags", "older_flags",
                    F.coalesce(pct2(F.col("recent_flags"), F.col("older_flags")),
                               F.lit(100.0)).alias("recency_ratio")))


def magnitude_from_text(flags: DataFrame) -> DataFrame:
    """As :func:`signal_magnitude`, from the evidence text of a flag table."""
    z = F.split_part(F.split_part("details", F.lit("Z-score: "), F.lit(2)), F.lit(" |"), F.lit(1))
    return (flags.where(F.col("flag_type").isin(S.STATISTICAL_ZSCORE)
                        & F.col("details").like("Z-score:%"))
            .groupBy("vendor_id")
            .agg(F.sum(z.try_cast("decimal(18,2)")).alias("z_total"),
                 F.count(z.try_cast("decimal(18,2)")).alias("z_flags"))
            .select("vendor_id",
                    mean(F.col("z_total"), F.col("z_flags")).alias("avg_zscore")))


def vendor_signals(facts: DataFrame) -> DataFrame:
    """The four signals side by side; NULL where the vendor has no such flags."""
    any_flag = F.col("recent_flags") + F.col("older_flags") > 0
    return facts.select(
        "vendor_id",
        pct2(F.col("flagged_invoices"), F.col("total_invoices")).alias("frequency"),
        mean(F.col("z_total"), F.col("z_flags")).alias("magnitude"),
        pct2(F.col("high_invoices"), F.col("total_invoices")).alias("validation"),
        F.when(any_flag, F.coalesce(pct2(F.col("recent_flags"), F.col("older_flags")),
                                    F.lit(100.0))).alias("recency"),
    )
