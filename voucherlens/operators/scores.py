"""From signals to scores, tiers and the audit queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens import schema as S
from voucherlens.functions.money import mean2
from voucherlens.functions.scoring import minmax_100, risk_tier

SIGNALS = ("frequency", "magnitude", "validation", "recency")


def minmax_scale(df: DataFrame, cols: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Puts each column on a 0-100 scale between its smallest and largest value.

    The bounds are taken over the rows that have the value; rows without it count as 0
    afterwards. They come in through a scalar subquery: one row, computed with partial
    aggregation.
    """
    bounds = df.agg(F.struct(
        *[F.min(c).alias(f"{c}_lo") for c in cols],
        *[F.max(c).alias(f"{c}_hi") for c in cols],
    ).alias("bounds")).scalar()
    return df.withColumn("_bounds", bounds).withColumns({
        c: minmax_100(F.col(c), F.col(f"_bounds.{c}_lo"), F.col(f"_bounds.{c}_hi")) for c in cols
    }).drop("_bounds")


def score_vendors(signals: DataFrame, params: S.AuditParams = S.AuditParams()) -> DataFrame:
    """Weighted composite of the scaled signals, and its tier.

    Tier and composite use unrounded numbers; the stored columns have two decimals.
    """
    scaled = minmax_scale(signals).withColumn(
        "composite",
        F.col("frequency") * params.w_frequency + F.col("magnitude") * params.w_magnitude
        + F.col("validation") * params.w_validation + F.col("recency") * params.w_recency)
    return scaled.select(
        "vendor_id",
        F.round("frequency", 2).alias("anomaly_frequency"),
        F.round("magnitude", 2).alias("deviation_magnitude"),
        F.round("validation", 2).alias("validation_failures"),
        F.round("recency", 2).alias("recency_score"),
        F.round("composite", 2).alias("composite_score"),
        risk_tier(F.col("composite"), params.tier_high, params.tier_medium).alias("risk_tier"),
    )


def tier_distribution(scores: DataFrame) -> DataFrame:
    """Vendors and mean composite per tier, highest mean first."""
    composite = F.col("composite_score").cast("decimal(5,2)")
    return (scores.groupBy("risk_tier")
            .agg(F.count(F.lit(1)).alias("vendors"), F.sum(composite).alias("_total"))
            .select("risk_tier", "vendors",
                    mean2(F.col("_total"), F.col("vendors")).alias("avg_score"))
            .orderBy(F.desc("avg_score"), "risk_tier"))


def audit_queue(scores: DataFrame, vendors: DataFrame, n: int = 10,
                tier: str = S.HIGH) -> DataFrame:
    """The ``n`` highest scores of a tier, with the vendor's name and category."""
    return (scores.where(F.col("risk_tier") == tier)
            .join(vendors.select("vendor_id", "vendor_name", "category"), "vendor_id")
            .select("vendor_id", "vendor_name", "category", "composite_score", "risk_tier")
            .orderBy(F.desc("composite_score"), "vendor_id").limit(n))
