"""Sums over the preceding rows of each vendor, and the spike check built on them.

A window partitioned by vendor puts each vendor into one task. That is the right plan as long
as no vendor is huge. For the vendors that are, the rows are first put in order by a range
shuffle on the whole sort key, which balances whatever the vendor, and numbered per vendor.
The numbers cut the vendor into blocks of equal length; the last ``rows`` rows of a block are
also sent to the next one as context, and the window then runs per block. The results are
the same, because a row never looks back further than one block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voucherlens import schema as S
from voucherlens.functions.money import exact_type, from_units, is_wide, mean_text2, text2, units
from voucherlens.operators.flags import flag, flag_rows

ORDER = ("invoice_date", "invoice_id")
# Blocks are smaller than the biggest vendor left whole, so that they spread evenly by hash.
BLOCKS_PER_GROUP = 10


def total_order(df: DataFrame, order: Sequence[str], value: str) -> list[str]:
    """``order`` made independent of partitions: rows that still tie are equal in everything
    the window reads or the findings print."""
    more = [c for c in (value, "tax_claimed") if c in df.columns and c not in order]
    return [*order, *more]


def _preceding(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str,
               rows: int) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-rows, -1)
    return (df.withColumn("prev_n", F.count(value).over(w))
            .withColumn("prev_units", F.sum(units(F.col(value), exact_type(df, value))).over(w)))


def with_preceding(clean: DataFrame, key: str = "vendor_id", order: Sequence[str] = ORDER,
                   value: str = "amount", rows: int = 30) -> DataFrame:
    """Adds ``prev_n`` and ``prev_units``: count and sum of ``value`` over the ``rows`` preceding
    rows of the same ``key``, the sum in units of the column's last decimal place. Rows that tie
    in ``order`` go by value."""
    return _preceding(clean, [key], total_order(clean, order, value), value, rows)


def with_preceding_in_blocks(big: DataFrame, block_rows: int,
                             stage: Callable[[DataFrame, str], DataFrame],
                             key: str = "vendor_id", order: Sequence[str] = ORDER,
                             value: str = "amount", rows: int = 30,
                             slices: int | None = None) -> DataFrame:
    """Same result as :func:`with_preceding`, with no task bound to a whole ``key``.

    ``slices`` is the number of partitions of the range shuffle; the session's own number of
    shuffle partitions if not given.
    """
    block_rows = max(block_rows, rows)
    sort_key = [key, *total_order(big, order, value)]
    ranges = sort_key if slices is None else [slices, *sort_key]
    # The id is (partition << 33) + row in partition; staging fixes it for the uses below.
    numbered = stage(
        big.repartitionByRange(*ranges).sortWithinPartitions(*sort_key)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_id", 33)),
        "numbered")
    # One row per slice and key: how many rows of the key come before the slice.
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        numbered.groupBy(key, "_slice")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(F.col(key).alias("_key"), F.col("_slice").alias("_start_slice"), "_first",
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")),
        "slice_starts")
    ranked = numbered.join(
        starts,
        (F.col("_slice") == F.col("_start_slice")) & F.col(key).eqNullSafe(F.col("_key")),
    ).withColumn("_rank", F.col("_id") - F.col("_first") + F.col("_offset"))
    own = F.floor(F.col("_rank") / block_rows)
    is_tail = F.col("_rank") % block_rows >= block_rows - rows
    blocks = ranked.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(is_tail, F.array(own, own + 1)).otherwise(F.array(own))))
    return (_preceding(blocks, [key, "_block"], ["_rank"], value, rows)
            .where(F.col("_block") == F.col("_own"))
            .drop("_id", "_slice", "_key", "_start_slice", "_first", "_offset", "_rank", "_own",
                  "_block"))


def with_preceding_by_size(clean: DataFrame, sizes: DataFrame, max_group_rows: int,
                           stage: Callable[[DataFrame, str], DataFrame],
                           key: str = "vendor_id", order: Sequence[str] = ORDER,
                           value: str = "amount", rows: int = 30) -> DataFrame:
    """Plain window for vendors up to ``max_group_rows`` rows, blocks for the bigger ones.

    ``sizes`` is a staged table with ``key`` and its rows ``n_rows``. At most one key per
    ``max_group_rows`` rows is big, so the list of them is short.
    """
    big = sizes.where(F.col("n_rows") > max_group_rows)
    big_rows = big.agg(F.sum("n_rows")).first()[0]
    if not big_rows:
        return with_preceding(clean, key, order, value, rows)
    big_keys = stage(big.select(F.col(key).alias("_big")), "big_keys")
    same = F.col(key).eqNullSafe(F.col("_big"))
    return with_preceding(
        clean.join(big_keys, same, "left_anti"), key, order, value, rows,
    ).unionByName(with_preceding_in_blocks(
        clean.join(big_keys, same, "left_semi"), max_group_rows // BLOCKS_PER_GROUP, stage,
        key, order, value, rows,
        slices=int(big_rows // max_group_rows) + 1))


def _exact(number: float | int) -> Column:
    return F.lit(Decimal(str(number)))


def is_spike(factor: int | float = 3, value: str = "amount",
             kind: T.DecimalType = S.MONEY) -> Column:
    """``value > factor * mean of the preceding rows``, compared without rounding."""
    return ((F.col("prev_n") > 0)
            & (units(F.col(value), kind) * F.col("prev_n") > F.col("prev_units") * _exact(factor)))


def rolling_mean(kind: T.DecimalType = S.MONEY) -> Column:
    return F.col("prev_units").cast("double") / F.nullif(
        F.col("prev_n") * F.lit(10 ** kind.scale), F.lit(0)).cast("double")


def spike_ratio(value: str = "amount", kind: T.DecimalType = S.MONEY) -> Column:
    return ((units(F.col(value), kind) * F.col("prev_n")).cast("double")
            / F.nullif(F.col("prev_units"), F.lit(0)).cast("double"))


def spike_finding(factor: int | float = 3, value: str = "amount",
                  kind: T.DecimalType = S.MONEY) -> Column:
    # The wording of the evidence.
    details = F.concat(
        F.lit("Spike ratio: "), text2(spike_ratio(value, kind)),
        F.lit("x | Amount: "), text2(F.col(value), is_wide(kind)),
        F.lit(" | Rolling avg: "),
        mean_text2(from_units(F.col("prev_units"), kind), F.col("prev_n"), is_wide(kind)))
    return flag(S.ROLLING_SPIKE, S.HIGH, details, score=spike_ratio(value, kind),
                baseline=rolling_mean(kind), threshold=factor)


def detect_rolling_spike(clean: DataFrame, key: str = "vendor_id", order: Sequence[str] = ORDER,
                         value: str = "amount", rows: int = 30, factor: int | float = 3,
                         preceding: DataFrame | None = None) -> DataFrame:
    """Flags rows above ``factor`` times the mean of the vendor's preceding rows.

    The first invoice of a vendor has no mean and is never flagged.
    """
    kind = exact_type(clean, value)
    if preceding is None:
        preceding = with_preceding(clean, key, order, value, rows)
    return flag_rows(preceding.where(is_spike(factor, value, kind)),
                     spike_finding(factor, value, kind))
