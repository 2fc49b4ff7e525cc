"""Table shapes, enumerations and the tunable thresholds of the audit."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

VENDORS = T.StructType([
    T.StructField("vendor_id", T.LongType()),
    T.StructField("vendor_name", T.StringType()),
    T.StructField("gstin", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("state_code", T.StringType()),
    T.StructField("registration_date", T.DateType()),
])

CATEGORIES = T.StructType([
    T.StructField("category_id", T.IntegerType()),
    T.StructField("category_name", T.StringType()),
    T.StructField("gst_rate", T.DecimalType(5, 2)),
    T.StructField("description", T.StringType()),
])

INVOICES = T.StructType([
    T.StructField("invoice_id", T.StringType()),
    T.StructField("vendor_id", T.LongType()),
    T.StructField("category_id", T.IntegerType()),
    T.StructField("invoice_date", T.DateType()),
    T.StructField("amount", MONEY),
    T.StructField("tax_claimed", MONEY),
    T.StructField("state_code", T.StringType()),
])

# One finding about one invoice. `details` is the human-readable evidence; the last three
# fields carry the same numbers typed, so nothing downstream has to parse text.
FLAG = T.StructType([
    T.StructField("flag_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("baseline", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
])

FLAGS = T.StructType([
    T.StructField("invoice_id", T.StringType()),
    T.StructField("vendor_id", T.LongType()),
    *FLAG.fields,
])

# These spellings are part of the output contract.
DUPLICATE = "DUPLICATE"
GSTIN_MISMATCH = "GSTIN_MISMATCH"
INVALID_AMOUNT = "INVALID_AMOUNT"
STATISTICAL_ZSCORE = "STATISTICAL_ZSCORE"
ROLLING_SPIKE = "ROLLING_SPIKE"
IQR_OUTLIER = "IQR_OUTLIER"
MISSING_FIELD = "MISSING_FIELD"  # our own; only on request

LOW, MEDIUM, HIGH = "LOW", "MEDIUM", "HIGH"
PENDING, CLEAN, FLAGGED = "PENDING", "CLEAN", "FLAGGED"

LAYER_1 = (DUPLICATE, GSTIN_MISMATCH, INVALID_AMOUNT, MISSING_FIELD)  # the others are layer 2
DUPLICATE_KEYS = ("vendor_id", "amount", "invoice_date")
REQUIRED_FIELDS = ("invoice_id", "vendor_id", "amount", "invoice_date")


@dataclass(frozen=True)
class AuditParams:
    """Thresholds and weights. The defaults are fixed values of the audit rules."""

    z_min: float = 2.0
    z_high: float = 3.0
    window_rows: int = 30
    spike_factor: int = 3
    iqr_k: float = 1.5
    recency_cutoff: dt.date = dt.date(2024, 7, 1)
    w_frequency: float = 0.30
    w_magnitude: float = 0.30
    w_validation: float = 0.20
    w_recency: float = 0.20
    tier_high: float = 35.0
    tier_medium: float = 20.0
    queue_size: int = 10
    # Vendors with more clean invoices than this are cut into blocks of this many rows
    # before the rolling window, so that no task has to sort a whole giant vendor.
    max_group_rows: int = 5_000_000
