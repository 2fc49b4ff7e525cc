"""Rule checks on single invoices and on groups of equal invoices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens import schema as S
from voucherlens.operators.flags import collect_flags, flag, flag_rows

# Evidence texts of the rule checks.
DUPLICATE_TEXT = "Same vendor, amount, and date as another invoice"
MISMATCH_TEXT = "Invoice state code does not match vendor registered state"
INVALID_TEXT = "Amount <= 0 or negative tax claimed"


def duplicate_finding() -> Column:
    return flag(S.DUPLICATE, S.MEDIUM, F.lit(DUPLICATE_TEXT))


def mismatch_finding() -> Column:
    return flag(S.GSTIN_MISMATCH, S.HIGH, F.lit(MISMATCH_TEXT))


def invalid_finding() -> Column:
    return flag(S.INVALID_AMOUNT, S.HIGH, F.lit(INVALID_TEXT))


def duplicate_groups(inv: DataFrame, keys: Sequence[str] = S.DUPLICATE_KEYS) -> DataFrame:
    """Key combinations that occur more than once.

    Counting is combined before the shuffle, so a group holding a third of the ledger costs
    one row per map task.
    """
    return (inv.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
            .where(F.col("occurrences") > 1))


def detect_duplicates(inv: DataFrame, keys: Sequence[str] = S.DUPLICATE_KEYS,
                      groups: DataFrame | None = None) -> DataFrame:
    """Flags every member of a duplicate group, the first one included.

    A NULL in a key never equals another NULL, so such rows are not flagged. Pass staged
    ``groups`` on big ledgers: the join is then a broadcast if they are few, and otherwise a
    shuffle join that AQE can split when one group is hot.
    """
    groups = duplicate_groups(inv, keys) if groups is None else groups
    return flag_rows(inv.join(groups, list(keys), "left_semi"), duplicate_finding())


def mark_duplicates(inv: DataFrame, groups: DataFrame,
                    keys: Sequence[str] = S.DUPLICATE_KEYS) -> DataFrame:
    """``inv`` plus the boolean ``is_duplicate``."""
    marker = groups.select(*keys, F.lit(True).alias("is_duplicate"))
    return (inv.join(marker, list(keys), "left")
            .withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False))))


def detect_mismatch(inv: DataFrame, vendors: DataFrame) -> DataFrame:
    """Flags invoices whose state differs from the vendor's registered state."""
    registered = vendors.select("vendor_id", F.col("state_code").alias("vendor_state"))
    hits = (inv.join(registered, "vendor_id")
            .where(F.col("state_code") != F.col("vendor_state")))
    return flag_rows(hits, mismatch_finding())


def mark_mismatch(inv: DataFrame, vendors: DataFrame) -> DataFrame:
    """``inv`` plus the boolean ``is_mismatch``; unknown vendors and NULL states give false."""
    registered = vendors.select("vendor_id", F.col("state_code").alias("_vendor_state"))
    return (inv.join(registered, "vendor_id", "left")
            .withColumn("is_mismatch",
                        F.coalesce(F.col("state_code") != F.col("_vendor_state"), F.lit(False)))
            .drop("_vendor_state"))


def is_invalid_amount() -> Column:
    return (F.col("amount") <= 0) | (F.col("tax_claimed") < 0)


def detect_invalid_amount(inv: DataFrame) -> DataFrame:
    """Flags amounts that are not positive and negative tax claims."""
    return flag_rows(inv.where(is_invalid_amount()), invalid_finding())


def rule_flags() -> Column:
    """The findings of the rule checks, from the three boolean marks."""
    return collect_flags(
        (F.col("is_duplicate"), duplicate_finding()),
        (F.col("is_mismatch"), mismatch_finding()),
        (F.col("is_invalid"), invalid_finding()),
    )


def missing_field_report(inv: DataFrame, cols: Sequence[str] = S.REQUIRED_FIELDS,
                         emit_flags: bool = False) -> DataFrame:
    """One row: invoices with any required field missing, and how often each is missing.

    With ``emit_flags`` the findings instead, one row for each invoice with a missing field. They
    are not part of the audit, which only reports them.
    """
    if emit_flags:
        names = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in cols])
        return flag_rows(inv.where(names != ""), flag(
            S.MISSING_FIELD, S.LOW, F.concat(F.lit("Missing: "), names)))
    missing = [F.col(c).isNull() for c in cols]
    any_missing = missing[0]
    for m in missing[1:]:
        any_missing = any_missing | m
    return inv.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(any_missing).alias("missing_any"),
        *[F.count_if(m).alias(f"missing_{c}") for c, m in zip(cols, missing)],
    )
