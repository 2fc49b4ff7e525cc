"""Per-vendor baselines and the z-score against them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voucherlens import schema as S
from voucherlens.functions.money import exact_type, is_wide, mean, mean_text2, text2, units
from voucherlens.operators.flags import flag, flag_rows

_WHOLE = T.DecimalType(38, 0)
# Amounts of up to this many digits have squares of which 10^10 add up in 38 digits.
PLAIN_DIGITS = 14
LIMB = 10 ** 8  # wider amounts are cut into limbs of eight digits


def vendor_baselines(clean: DataFrame, key: str = "vendor_id",
                     value: str = "amount") -> DataFrame:
    """Per ``key``: rows, values, exact sum, mean and sample standard deviation of ``value``.

    An aggregate and not a window: it is combined before the shuffle and never buffers the
    rows of a big vendor. What is combined are whole numbers, so that the result does not depend
    on the order or the partitions of the rows; it is rounded once, in the end. Columns of any
    width are taken; only the sum itself has to fit into 38 digits.
    """
    kind = exact_type(clean, value)
    total = F.sum(F.col(value).cast(kind)).alias("baseline_total")
    count = [F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("baseline_n")]
    if kind.precision <= PLAIN_DIGITS:
        out, variance = _plain_sums(clean, key, value, kind, [*count, total])
    else:
        out, variance = _wide_sums(clean, key, value, kind, [*count, total])
    return (out.withColumn("std_dev", F.sqrt(variance) / F.lit(float(10 ** kind.scale)))
            .withColumn("baseline", mean(F.col("baseline_total"), F.col("baseline_n"), kind.scale))
            .select(key, "n_rows", "baseline_n", "baseline_total", "std_dev", "baseline"))


def _plain_sums(clean: DataFrame, key: str, value: str, kind: T.DecimalType,
                first: list[Column]) -> tuple[DataFrame, Column]:
    """The variance from the sums of the values and of their squares, in units.

    With ``q`` near the mean, ``A = sum (v - q)^2`` and ``r = sum (v - q)`` follow exactly from
    them, and the variance is ``(A - r * r / n) / (n - 1)``.
    """
    v = units(F.col(value), kind).cast(T.DecimalType(min(38, kind.precision), 0))
    out = clean.select(key, F.col(value), v.alias("_v")).groupBy(key).agg(
        *first, F.sum("_v").cast(_WHOLE).alias("_sum"),
        F.sum(F.col("_v") * F.col("_v")).cast(_WHOLE).alias("_squares"))
    n = F.nullif(F.col("baseline_n"), F.lit(0)).cast(T.DecimalType(18, 0))
    out = out.withColumn("_n", n).withColumn(
        "_q", F.expr("`_sum` div `_n`").cast(T.DecimalType(19, 0)))
    out = out.withColumn("_r", (F.col("_sum") - F.col("_q") * F.col("_n")).cast(T.DecimalType(19, 0)))
    spread = (F.col("_squares") - (F.col("_q") * F.col("_sum")).cast(_WHOLE) * 2
              + (F.col("_q") * F.col("_q")).cast(_WHOLE) * F.col("_n"))
    correction = (F.col("_r") * F.col("_r")).cast("double") / F.col("_n").cast("double")
    return out, (spread.cast("double") - correction) / F.nullif(
        F.col("_n") - 1, F.lit(0)).cast("double")


def _wide_sums(clean: DataFrame, key: str, value: str, kind: T.DecimalType,
               first: list[Column]) -> tuple[DataFrame, Column]:
    """The same for amounts whose squares do not fit into a decimal.

    A value is ``sum a_i * LIMB^i``. The sums of the limbs ``a_i`` and of the coefficients of the
    square, ``sum of a_i * a_j over i + j = k``, stay small and are combined like any sum. The
    coefficients of ``n * sum v^2 - (sum v)^2`` follow from them exactly; once per key they are carried into digits
    from 0 to ``LIMB``, which can be added in floating point without cancelling.
    """
    n_limbs = -(-kind.precision // 8)
    limbs = [F.col(f"_a{i}") for i in range(n_limbs)]
    pairs = [[(i, k - i) for i in range(n_limbs) if 0 <= k - i < n_limbs] for k in range(2 * n_limbs - 1)]

    def sum_of(terms: list[Column]) -> Column:
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    rows = clean.select(key, F.col(value), *[a.alias(f"_a{i}") for i, a in enumerate(
        _limbs(F.col(value), kind, n_limbs))])
    out = rows.groupBy(key).agg(
        *first, *[F.sum(a).cast(T.DecimalType(19, 0)).alias(f"_s{i}") for i, a in enumerate(limbs)],
        *[F.sum(sum_of([limbs[i] * limbs[j] for i, j in p]).cast(T.DecimalType(18, 0)))
          .cast(T.DecimalType(28, 0)).alias(f"_c{k}") for k, p in enumerate(pairs)])
    n = F.nullif(F.col("baseline_n"), F.lit(0))
    whole = n.cast(T.DecimalType(18, 0))
    spread = [(whole * F.col(f"_c{k}") - sum_of([(F.col(f"_s{i}") * F.col(f"_s{j}")).cast(_WHOLE)
                                                 for i, j in p])).cast(_WHOLE)
              for k, p in enumerate(pairs)]
    return out, _carried(spread) / (n.cast("double") * F.nullif(n - 1, F.lit(0)).cast("double"))


def _limbs(value: Column, kind: T.DecimalType, n: int) -> list[Column]:
    """The limbs of a value's units, lowest first, all with its sign."""
    if kind.precision <= 18 or kind == T.DecimalType(19, 0):  # fits into a long
        v = (value * F.lit(10 ** kind.scale) if kind.scale else value).cast("long")
        return [F.call_function("div", v, F.lit(LIMB ** i).cast("long")) % F.lit(LIMB) if i else v % F.lit(LIMB)
                for i in range(n)]
    v = units(value, kind).cast(_WHOLE)

    def below(i: int) -> Column:  # what is left of LIMB^i and more
        return v % F.lit(Decimal(LIMB ** i)) if 8 * i < 38 else v

    return [((below(i + 1) - below(i) if i else below(1)) / F.lit(Decimal(LIMB ** i))).cast("long")
            for i in range(n)]


def _carried(coefficients: list[Column]) -> Column:
    """``sum c_k * LIMB^k``, not negative, as a double."""
    start = F.struct(F.lit(0).cast(_WHOLE).alias("carry"), F.lit(0.0).alias("total"), F.lit(1.0).alias("weight"))
    limb = F.lit(Decimal(LIMB))

    def step(acc: Column, c: Column) -> Column:
        t = (acc["carry"] + c).cast(_WHOLE)
        digit = F.pmod(t, limb)
        return F.struct(((t - digit).cast(_WHOLE) / limb).cast(_WHOLE).alias("carry"),
                        (acc["total"] + digit.cast("double") * acc["weight"]).alias("total"),
                        (acc["weight"] * F.lit(float(LIMB))).alias("weight"))

    return F.aggregate(F.array(*coefficients), start, step,
                       lambda acc: acc["total"] + acc["carry"].cast("double") * acc["weight"])


def z_score(value: str = "amount") -> Column:
    """Distance from the baseline in standard deviations; 0 without a usable deviation."""
    return F.when(
        F.col("std_dev") > 0,
        (F.col(value).cast("double") - F.col("baseline")) / F.col("std_dev"),
    ).otherwise(F.lit(0.0))


def with_zscore(clean: DataFrame, baselines: DataFrame | None = None, key: str = "vendor_id",
                value: str = "amount") -> DataFrame:
    """``clean`` plus its baseline columns and ``z_score``. NULL keys form a group of their own.

    The rows with a key meet their baseline by plain equality, which can use a partitioning by
    that key that is there already (the rolling window's). The NULL group has a join of its own.
    """
    if baselines is None:
        baselines = vendor_baselines(clean, key, value)
    right = baselines.withColumnRenamed(key, "_key")
    known = clean.where(F.col(key).isNotNull()).join(
        right.where(F.col("_key").isNotNull()), F.col(key) == F.col("_key"), "left")
    unknown = clean.where(F.col(key).isNull()).join(
        right.where(F.col("_key").isNull()), F.col(key).eqNullSafe(F.col("_key")), "left")
    return known.unionByName(unknown).drop("_key").withColumn("z_score", z_score(value))


def zscore_finding(z_min: float, z_high: float, value: str = "amount",
                   kind: T.DecimalType = S.MONEY) -> Column:
    wide = is_wide(kind)
    z = F.col("z_score")
    # The wording of the evidence, which magnitude_from_text reads back.
    details = F.concat(
        F.lit("Z-score: "), text2(z),
        F.lit(" | Amount: "), text2(F.col(value), wide),
        F.lit(" | Baseline: "), mean_text2(F.col("baseline_total"), F.col("baseline_n"), wide),
        F.lit(" | StdDev: "), text2(F.col("std_dev"), wide))
    return flag(S.STATISTICAL_ZSCORE, F.when(z > z_high, S.HIGH).otherwise(S.MEDIUM), details,
                score=z, baseline=F.col("baseline"), threshold=z_min)


def detect_zscore(clean: DataFrame, key: str = "vendor_id", value: str = "amount",
                  z_min: float = 2.0, z_high: float = 3.0,
                  baselines: DataFrame | None = None) -> DataFrame:
    """Flags rows more than ``z_min`` deviations above their own vendor's baseline."""
    hits = with_zscore(clean, baselines, key, value).where(F.col("z_score") > z_min)
    return flag_rows(hits, zscore_finding(z_min, z_high, value, exact_type(clean, value)))
