"""Invoice ledgers built from the given order and event tables.

``invoices`` reads only what is asked for: the joins that supply the category and the state
are left out when a query does not need those columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voucherlens import schema as S

CUTOFF = dt.date(2001, 5, 1)

# Category ids and rates for the part types.
CATEGORY_RATES = (
    (1, "ECONOMY", "5.00"),
    (2, "LARGE", "12.00"),
    (3, "MEDIUM", "18.00"),
    (4, "PROMO", "28.00"),
    (5, "SMALL", "0.00"),
    (6, "STANDARD", "18.00"),
)

UNKNOWN = 1_000_000_000  # added to a vendor id to break it

# The columns read here, with their types: stating them saves a job per table that would
# open a file to infer them.
TABLES = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_tax double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long",
    "customer": "c_custkey long, c_nationkey int",
    "part": "p_partkey long, p_type string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}.parquet")


def state_text(nation: Column) -> Column:
    return F.lpad(nation.cast("string"), 2, "0")


def categories(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{name}', CAST({rate} AS DECIMAL(5,2)), 'parts of type {name}')"
                     for i, name, rate in CATEGORY_RATES)
    return spark.sql("SELECT * FROM VALUES " + rows
                     + " AS t(category_id, category_name, gst_rate, description)")


def vendor_states(spark: SparkSession, folder: str) -> DataFrame:
    """Just the registered states: a plain scan, whose size Spark knows before planning."""
    return _read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("vendor_id"),
        state_text(F.col("s_nationkey")).alias("state_code"))


def vendors(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as vendors; their region stands in for the vendor category."""
    nation = _read(spark, folder, "nation")
    region = _read(spark, folder, "region")
    state = state_text(F.col("s_nationkey"))
    return (_read(spark, folder, "supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"),
                    F.concat(state, F.lpad(F.col("s_suppkey").cast("string"), 13, "0"))
                    .alias("gstin"),
                    F.col("r_name").alias("category"), state.alias("state_code"),
                    F.lit(None).cast("date").alias("registration_date")))


def invoices(spark: SparkSession, folder: str, category: bool = True, state: bool = True,
             copies: bool = True, dirty: bool = False) -> DataFrame:
    """Order lines as invoices.

    ``copies`` repeats the lines of every 97th order under a new id, which makes duplicates.
    Every 31st order is invoiced from the customer's state, which makes mismatches. ``dirty``
    negates some amounts, drops some vendor ids and breaks others, so that no vendor has them.
    """
    order = F.col("l_orderkey")
    quantity = F.col("l_quantity").cast("decimal(4,0)")
    amount = (quantity * F.col("l_extendedprice").cast(S.MONEY)).cast(S.MONEY)
    vendor = F.col("l_suppkey")
    line_id = F.concat_ws("-", order, F.col("l_linenumber"), F.col("l_partkey"),
                          F.col("l_suppkey"), F.col("l_quantity").cast("int"))
    if dirty:
        amount = F.when(order % 499 == 0, -amount).otherwise(amount)
        vendor = F.when(order % 983 == 0, vendor + UNKNOWN).when(order % 997 != 0, vendor)
    columns = {
        "invoice_id": line_id,
        "vendor_id": vendor,
        "invoice_date": F.col("l_shipdate").cast("date"),
        "amount": amount,
        "tax_claimed": (amount * F.col("l_tax").cast("decimal(4,2)")).cast(S.MONEY),
    }
    lines = _read(spark, folder, "lineitem")
    if state:
        # Only every 31st order needs its customer, so only those lines meet the orders.
        supplier = _read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
        orders = _read(spark, folder, "orders").where(F.col("o_orderkey") % 31 == 0)
        at_home = (lines.where(order % 31 != 0)
                   .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
                   .select(*lines.columns, F.col("s_nationkey").alias("_nation")))
        moved = (lines.where(order % 31 == 0)
                 .join(orders, order == F.col("o_orderkey"), "left")
                 .join(_read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"),
                       "left")
                 .select(*lines.columns, F.col("c_nationkey").alias("_nation")))
        lines = at_home.unionByName(moved)
        columns["state_code"] = state_text(F.col("_nation"))
    if category:
        part = _read(spark, folder, "part").select("p_partkey", "p_type")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        by_type = F.when(F.lit(False), F.lit(0))
        for i, name, _ in CATEGORY_RATES:
            by_type = by_type.when(F.col("p_type") == name, i)
        columns["category_id"] = by_type
    if copies:
        suffixes = F.when(order % 97 == 0, F.array(F.lit(""), F.lit("-D"))).otherwise(
            F.array(F.lit("")))
        lines = lines.withColumn("_suffix", F.explode(suffixes))
        columns["invoice_id"] = F.concat(line_id, F.col("_suffix"))
    names = [f.name for f in S.INVOICES.fields if f.name in columns]
    return lines.select(*[columns[n].alias(n) for n in names])


def line_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")


def event_invoices(spark: SparkSession, folder: str, money: T.DecimalType = S.MONEY) -> DataFrame:
    """Events as a second ledger: users as vendors, event types as categories."""
    return _read(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("invoice_id"),
        F.col("user_id").alias("vendor_id"),
        F.col("event_type").alias("category_id"),
        F.col("ts").cast("date").alias("invoice_date"),
        F.col("value").cast(money).alias("amount"),
        F.lit(0).cast(S.MONEY).alias("tax_claimed"),
    )
