"""Times the headline queries. Prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)

BENCH_ORDER    "given" (default) or "reversed"
BENCH_RUNS     how often (default 1); with more, the median of each query counts

Each query is run to completion with a sink that discards the rows. One untimed audit comes
first, so that the figures are not those of a cold JVM. Every query builds its own intermediate
tables in a stage that is closed after it; nothing is shared between them or left behind.
``staged_mb`` is what each query wrote there.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voucherlens.plans import audit, catalog  # noqa: E402
from voucherlens.session import local_session  # noqa: E402
from voucherlens.sources import ledger  # noqa: E402
from voucherlens.staging import Stage  # noqa: E402

HEADLINE = (
    "flag_duplicate", "flag_state_mismatch", "flag_invalid_amount", "missing_fields",
    "validation_status", "flag_zscore", "flag_rolling_spike", "flag_rolling_spike_in_blocks",
    "category_fences", "flag_iqr", "all_flags", "vendor_scores", "top_risk_vendors",
    "report_kpi", "report_monthly", "report_invoice_detail", "report_category",
    "insert_if_absent", "events_flag_zscore",
)


def finish(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def full_audit(spark, folder, stage) -> None:
    """The pipeline as a user runs it: every stage once, then all six reports."""
    vendors = stage(ledger.vendors(spark, folder), "vendors")
    run = audit.run(ledger.invoices(spark, folder), vendors, ledger.categories(spark), stage,
                    catalog.PARAMS,
                    inv_keys=ledger.invoices(spark, folder, category=False, state=False))
    for df in run.reports().values():
        finish(df)


def timed(spark, work) -> tuple[float, float]:
    """Seconds of ``work(stage)`` and MB it staged."""
    with Stage(spark) as stage:
        start = time.perf_counter()
        work(stage)
        return time.perf_counter() - start, stage.bytes_written() / 1e6


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    with tempfile.TemporaryDirectory(prefix="bench-") as scratch:
        spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench",
                              **{"spark.checkpoint.dir": f"file://{scratch}"})
        timed(spark, lambda stage: full_audit(spark, folder, stage))
        work = {n: lambda stage, n=n: finish(catalog.QUERIES[n](spark, folder, stage))
                for n in HEADLINE}
        work["full_audit"] = lambda stage: full_audit(spark, folder, stage)
        names = list(work)
        if os.environ.get("BENCH_ORDER") == "reversed":
            names.reverse()
        seconds, staged = {n: [] for n in work}, {}
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            for n in names:
                took, staged[n] = timed(spark, work[n])
                seconds[n].append(took)
        spark.stop()
    result = {n: round(median(s), 3) for n, s in seconds.items()}
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(result.values()), 3),
        "unit": "sec",
        "queries": result,
        "staged_mb": {n: round(staged[n], 1) for n in work},
        "sf": folder.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
