"""Key constraints as queries, and appending only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once or have a NULL in them; empty when ``keys`` is a key."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
            .where(missing | (F.col("occurrences") > 1)))


def require_unique(df: DataFrame, table: str, *keys: str) -> None:
    """Raises if ``keys`` is no key of ``df``, naming the table, the key and some bad values."""
    bad = check_unique(df.select(*keys), *keys).limit(5).collect()  # five rows at most
    if bad:
        shown = ", ".join(str(tuple(r[k] for k in keys)) for r in bad)
        raise ValueError(f"{', '.join(keys)} is not a key of {table}: {shown}")


def check_fk(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose non-NULL ``key`` has no row in ``parent``."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def first_of_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, the smallest by column order.

    An aggregate that is combined before the shuffle, so a key repeated without end is safe. A
    NULL key is no key: it makes the query fail.
    """
    others = [c for c in rows.columns if c != key]
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"NULL in the key {key}"))
                     ).otherwise(F.col(key))
    keyed = rows.select(*[checked.alias(c) if c == key else F.col(c) for c in rows.columns])
    return (keyed.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*")
            .select(*rows.columns))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` plus those ``incoming`` rows whose key is not there yet, as a table.

    The rows that are there already go first (an anti join), then :func:`first_of_each` chooses
    among the few new ones; incoming rows with a NULL key make the query fail.
    ``sources.commits.KeyedLedger`` writes just the new rows to a ledger at rest.
    """
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"NULL in the key {key}"))
                     ).otherwise(F.col(key))
    rows = incoming.select(*[checked.alias(c) if c == key else F.col(c) for c in existing.columns])
    new = rows.join(existing.select(key), key, "left_anti").select(*existing.columns)
    return existing.unionByName(first_of_each(new, key))
