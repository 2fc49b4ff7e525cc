"""Writing results. Default timestamps are added here and nowhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.operators.keys import check_unique
from voucherlens.plans.audit import Audit
from voucherlens.sources.commits import Check, CommittedFolder

# Reports whose size grows with the ledger or the vendors; written in parallel, never as one file.
BIG_REPORTS = frozenset({"invoice_detail", "vendor_risk_scores"})


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header, replacing what was there. ``single_file`` is for small reports.

    Spaces, quotes, line breaks and the difference between NULL and the empty text survive, see
    :func:`tables.read_csv`.
    """
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite")
     .options(header=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False,
              ignoreTrailingWhiteSpace=False)
     .csv(path))


def export_reports(audit: Audit, folder: str) -> list[str]:
    """All reports as CSV below ``folder``; returns their names."""
    reports = audit.reports()
    for name, df in reports.items():
        write_csv(df, f"{folder}/{name}", single_file=name not in BIG_REPORTS)
    return list(reports)


def write_flags(flags: DataFrame, path: str) -> int:
    """Replaces the flag table, so that a second run does not double it; returns its rows.

    ``commits.FlagLog`` keeps a part for each layer and run date instead. Read with
    :func:`tables.read_committed`.
    """
    return _replace(flags.withColumn("flag_date", F.current_timestamp()), path)


def write_scores(scores: DataFrame, path: str) -> int:
    """Replaces the vendor scores of the previous run; returns their number.

    Whatever goes wrong, readers have the old scores or the new ones. Read with
    :func:`tables.read_committed`.
    """
    def one_row_a_vendor(written: DataFrame) -> None:
        bad = check_unique(written.where(F.col("vendor_id").isNotNull()).select("vendor_id"), "vendor_id")
        if not bad.isEmpty():
            raise ValueError("a vendor is scored more than once")

    return _replace(scores.withColumn("scored_at", F.current_timestamp()), path, one_row_a_vendor)


def _replace(df: DataFrame, path: str, check: Check | None = None) -> int:
    table = CommittedFolder(df.sparkSession, path)
    rows = table.put(df, check=check)
    table.vacuum()
    return rows
