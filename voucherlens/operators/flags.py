"""Flags as a column, flags as a table, and the status that follows from them.

Inside the audit every invoice carries its findings in one array column ``flags``. An invoice
can hold at most one finding per flag type, so the array is short by construction. This keeps
the whole audit free of joins on ``invoice_id``: the flag table is an explode of the column,
the status is its emptiness, per-vendor signals are plain aggregates over invoices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens import schema as S


def flag(flag_type: str, severity: str | Column, details: Column, *, score: Column | None = None,
         baseline: Column | None = None, threshold: Column | float | None = None) -> Column:
    """One finding, as a struct shaped like ``schema.FLAG``."""
    def number(x):
        if not isinstance(x, Column):
            x = F.lit(x)
        return x.cast("double")

    return F.struct(
        F.lit(flag_type).alias("flag_type"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        details.alias("details"),
        number(score).alias("score"),
        number(baseline).alias("baseline"),
        number(threshold).alias("threshold"),
    )


def no_flags() -> Column:
    return F.array().cast(f"array<{S.FLAG.simpleString()}>")


def collect_flags(*candidates: tuple[Column, Column]) -> Column:
    """The array of those findings whose condition holds.

    Most invoices have none; they skip the array functions, which are not code-generated.
    """
    any_holds = candidates[0][0]
    for cond, _ in candidates[1:]:
        any_holds = any_holds | cond
    found = F.array_compact(F.array(*[F.when(cond, finding) for cond, finding in candidates]))
    return F.when(any_holds, found).otherwise(no_flags())


def flag_table(flagged: DataFrame) -> DataFrame:
    """One row per finding: ``invoice_id, vendor_id`` and the fields of the finding."""
    return (flagged.where(F.size("flags") > 0)
            .select("invoice_id", "vendor_id", F.inline("flags")))


def flag_rows(rows: DataFrame, finding: Column) -> DataFrame:
    """Turns rows already known to be findings into flag-table rows."""
    return rows.select("invoice_id", "vendor_id", finding.alias("f")).select(
        "invoice_id", "vendor_id", "f.*")


def union_flags(*tables: DataFrame) -> DataFrame:
    """Appends the outputs of several detectors."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def status_of(flags: Column) -> Column:
    return F.when(F.size(flags) > 0, S.FLAGGED).otherwise(S.CLEAN)


def with_status(inv: DataFrame, flags: DataFrame) -> DataFrame:
    """``inv`` plus ``validation_status``, from a flag table kept elsewhere."""
    marked = flags.select("invoice_id").distinct().withColumn("_flagged", F.lit(True))
    return (inv.drop("validation_status").join(marked, "invoice_id", "left")
            .withColumn("validation_status",
                        F.when(F.col("_flagged"), S.FLAGGED).otherwise(S.CLEAN))
            .drop("_flagged"))


def attach_flags(inv: DataFrame, flags: DataFrame) -> DataFrame:
    """The inverse of :func:`flag_table`: ``inv`` with ``flags`` and ``validation_status``.

    Repeated findings are dropped first (identity is invoice and type), so at most one entry
    per flag type is collected for an invoice however often a detector was run.
    """
    fields = [f.name for f in S.FLAG.fields]
    per_invoice = (flags.dropDuplicates(["invoice_id", "flag_type"])
                   .groupBy("invoice_id")
                   .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("flags")))
    return (inv.drop("flags", "validation_status").join(per_invoice, "invoice_id", "left")
            .withColumn("flags", F.coalesce("flags", no_flags()))
            .withColumn("validation_status", status_of(F.col("flags"))))
