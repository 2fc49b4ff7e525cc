"""Exact grouped percentiles by counting, and the inter-quartile fence check.

Spark's exact ``percentile`` keeps every distinct value of a group in one task. Here the
values are whole numbers of their last decimal place, so a percentile can be found by counting,
in rounds that close in on the wanted ranks:

* The first round counts a group's values in buckets of equal ratio (``PER_FOLD`` for each factor of
  e), whatever their scale, and finds the buckets that hold the ranks, each with the smallest and the largest value
  that really is in it.
* Each further round looks only at the values in those intervals. An interval with at most ``BOUND``
  rows, or less than ``BOUND`` wide, is counted value by value, which gives the answer; any
  other is cut into ``BOUND`` equal parts, of which the one with the rank is the next interval.

So an interval gets at least ``BOUND`` times smaller in a round, and most need two rounds in all. Counts combine
before the shuffle, and no window has more than ``BOUND`` rows, however many rows or distinct values
a group has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voucherlens import schema as S
from voucherlens.functions.money import exact_type, is_wide, text2, units
from voucherlens.operators.flags import flag, flag_rows

BOUND = 1 << 16
# 38 digits are 87.5 factors of e, so with both signs there are less than BOUND buckets.
PER_FOLD = 370

Staging = Callable[[DataFrame, str], DataFrame]


def _bucket(number: Column) -> Column:
    x = number.cast("double")  # any function that does not fall will do
    return (F.signum(x) * F.floor(F.log(F.abs(x) + F.lit(1.0)) * F.lit(float(PER_FOLD)))).cast("int")


def _holding(counted: DataFrame, partition: Sequence[str], order: str) -> DataFrame:
    """``counted`` with the number of values before each row (``_before``) and up to it."""
    upto = Window.partitionBy(*partition).orderBy(order)
    return (counted.withColumn("_upto", F.sum("n").over(upto))
            .withColumn("_before", F.col("_upto") - F.col("n")))


def _counts() -> list[Column]:
    return [F.count("_number").alias("n"), F.min("_number").alias("low"), F.max("_number").alias("high")]


def bucket_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """``_key``, ``_bucket``, and what the first round counts in it: values, smallest, largest."""
    number = units(F.col(value), exact_type(df, value))
    own = df.select(F.col(key).alias("_key"), number.alias("_number"))
    return (own.where(F.col("_key").isNotNull() & F.col("_number").isNotNull())
            .groupBy("_key", _bucket(F.col("_number")).alias("_bucket")).agg(*_counts()))


def first_intervals(counted: DataFrame, probs: Sequence[float]) -> DataFrame:
    """First round. For each group the buckets that hold a wanted rank, as intervals of units
    (``low`` to ``high``, ``n`` values), with the ranks ``wanted`` among their values. The
    ``value`` itself is for the next round to find.

    The percentile at ``p`` of ``n`` sorted values lies at position ``p * (n - 1)``, between
    the two ranks around it. At most two rows per group and probability. ``counted`` is as
    :func:`bucket_counts` gives it.
    """
    total = F.sum("n").over(Window.partitionBy("_key"))
    ranked = _holding(counted.withColumn("_total", total), ["_key"], "_bucket")
    wanted = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            wanted.append(F.struct(F.lit(i).alias("prob"), F.lit(side).alias("side"),
                                   rank.alias("rank"), (at - F.floor(at)).alias("frac")))
    held = ranked.select("_key", "low", "high", "n", _ranks_inside(F.array(*wanted)).alias("wanted"))
    return held.where(F.size("wanted") > 0)


def _ranks_inside(wanted: Column) -> Column:
    """Those of the ``wanted`` ranks that a row of :func:`_holding` holds, counted from its own first."""
    inside = F.filter(wanted, lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_upto")))
    return F.transform(inside, lambda w: w.withField("rank", w["rank"] - F.col("_before")))


def _part(number: Column) -> Column:
    """Place of a number in its interval: itself in a small one, else one of ``BOUND`` parts.

    The parts are cut in floating point, which keeps the order, and the two ends of an interval
    never fall into the same one.
    """
    width = (F.col("_high") - F.col("_low")).cast("double") + F.lit(1.0)
    place = F.floor((number - F.col("_low")).cast("double") * F.lit(float(BOUND)) / width)
    small = (F.col("_n") <= BOUND) | (width <= F.lit(float(BOUND)))
    return F.when(small, number).otherwise(place)


def parts_of_intervals(df: DataFrame, intervals: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of the parts of the given intervals, with the running count inside each."""
    some = intervals.select(F.col("_key").alias("_k"), F.col("low").alias("_low"),
                            F.col("high").alias("_high"), F.col("n").alias("_n"))
    number, kind = F.col("_number"), exact_type(df, value)
    rows = df.select(F.col(key).alias("_key"), units(F.col(value), kind).alias("_number"),
                     F.col(value).cast(kind).alias("_value"))
    met = rows.join(some, (F.col("_key") == F.col("_k")) & (number >= F.col("_low")) & (number <= F.col("_high")))
    parts = met.groupBy("_k", "_low", _part(number).alias("_part")).agg(
        *_counts(), F.min("_value").alias("value"))
    return _holding(parts, ["_k", "_low"], "_part")


def next_intervals(df: DataFrame, intervals: DataFrame, key: str, value: str) -> DataFrame:
    """A further round: ``intervals`` with every open one replaced by its parts with the ranks.

    All are open after the first round; later those with more than one value are.
    """
    first = "value" not in intervals.columns
    is_open = F.lit(True) if first else F.col("low") < F.col("high")
    before = intervals.where(is_open).select(
        "_key", F.col("low").alias("_from"), F.col("wanted").alias("_wanted"))
    parts = parts_of_intervals(df, intervals.where(is_open), key, value)
    held = parts.join(before, (F.col("_key") == F.col("_k")) & (F.col("_from") == F.col("_low")))
    closer = held.select("_key", "low", "high", "n", _ranks_inside(F.col("_wanted")).alias("wanted"),
                         "value").where(F.size("wanted") > 0)
    return closer if first else closer.unionByName(intervals.where(~is_open))


def percentiles(df: DataFrame, stage: Staging, key: str, value: str,
                probs: Sequence[float]) -> DataFrame:
    """``key`` and the exact percentiles ``p0``, ``p1``, … of ``value``, NULLs left out.

    Interpolates in decimals with as many more digits as ``probs`` have (two at least), which is
    exact. ``df`` should be staged: it is read once in each round.
    """
    kind = exact_type(df, value)
    digits = max(2, *(-Decimal(str(p)).as_tuple().exponent for p in probs))
    found = stage(first_intervals(bucket_counts(df, key, value), probs), "rank_intervals")
    wide = found.where(F.col("n") > BOUND)
    while not wide.isEmpty():  # one bit, of a table with a few rows a group
        found = stage(next_intervals(df, found, key, value), "rank_intervals")
        wide = found.where("low < high")
    if "value" not in found.columns:  # every interval is counted value by value: the last round
        found = next_intervals(df, found, key, value)
    result = T.DecimalType(min(38, kind.precision + 4 + digits), kind.scale + digits)

    def pick(i: int, side: str) -> Column:
        return F.max(F.when((F.col("prob") == i) & (F.col("side") == side), F.col("value")))

    def at(i: int) -> Column:
        frac = F.max(F.when(F.col("prob") == i, F.col("frac"))).cast(
            T.DecimalType(digits + 1, digits))
        return (pick(i, "lo") + (pick(i, "hi") - pick(i, "lo")) * frac).cast(result)

    ranks = found.select("_key", "value", F.inline("wanted"))
    return (ranks.groupBy(F.col("_key").alias(key))
            .agg(*[at(i).alias(f"p{i}") for i in range(len(probs))]))


def iqr_fences(clean: DataFrame, stage: Staging, key: str = "category_id", value: str = "amount",
               k: float = 1.5) -> DataFrame:
    """Per ``key``: quartiles, their distance and the upper fence ``q3 + k * iqr``."""
    q = percentiles(clean, stage, key, value, (0.25, 0.75))
    iqr = F.col("q3") - F.col("q1")
    return (q.select(key, F.col("p0").alias("q1"), F.col("p1").alias("q3"))
            .withColumn("iqr", iqr)
            .withColumn("upper_fence", F.col("q3") + F.lit(Decimal(str(k))) * F.col("iqr")))


def is_outlier(value: str = "amount") -> Column:
    return F.col(value) > F.col("upper_fence")


def iqr_finding(value: str = "amount", kind: T.DecimalType = S.MONEY) -> Column:
    amount, wide = F.col(value), is_wide(kind)
    # The wording of the evidence.
    details = F.concat(F.lit("Amount: "), text2(amount, wide),
                       F.lit(" | Upper fence: "), text2(F.col("upper_fence"), wide),
                       F.lit(" | IQR: "), text2(F.col("iqr"), wide))
    return flag(S.IQR_OUTLIER, S.MEDIUM, details,
                score=amount.cast("double")
                / F.nullif(F.col("upper_fence").cast("double"), F.lit(0.0)),
                baseline=F.col("q3"), threshold=F.col("upper_fence"))


def detect_iqr(clean: DataFrame, fences: DataFrame, key: str = "category_id",
               value: str = "amount") -> DataFrame:
    """Flags rows above the upper fence of their category.

    ``fences`` should be staged, so that its size decides how it is joined.
    """
    hits = clean.join(fences, key).where(is_outlier(value))
    return flag_rows(hits, iqr_finding(value, exact_type(clean, value)))
