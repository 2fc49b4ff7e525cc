"""Reading ledgers kept as files, catalog tables or database tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voucherlens.sources.commits import CommittedFolder


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Selects the columns of ``schema`` with its types; missing columns are an error."""
    return _require(df, schema).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return conform(spark.read.parquet(path), schema)


def read_table(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    return conform(spark.table(name), schema)


def read_committed(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The last committed version of a table that :mod:`sources.commits` wrote."""
    df = CommittedFolder(spark, path).read()
    return df if schema is None else conform(df, schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             multi_line: bool = False, check_lines: bool = True) -> DataFrame:
    """CSV with a header, as :func:`sinks.write_csv` writes it.

    Columns are found by their name in the header, in every file, and read as text first:
    codes keep leading zeros, and a value that is not of its column's type is an error that names
    both, never a silent NULL. An unquoted empty field is NULL, a quoted one the empty text.

    Files are split, so that a big one is read by many tasks. That cannot work where a quoted field
    holds a line break; such a line has an odd number of quotes, and finding one is an error
    (one pass over the lines, which ``check_lines=False`` leaves out for files known to be
    without). ``multi_line=True`` reads them, each file in one task.
    """
    if check_lines and not multi_line:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        if not spark.read.text(path).where(quotes % 2 == 1).isEmpty():
            raise ValueError(f"{path} has line breaks in quoted fields; read it with multi_line=True")
    options = dict(header=True, escape='"', multiLine=multi_line, mode="FAILFAST",
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                   nullValue="\0")  # any text that is not the empty one
    names = spark.read.options(**options).csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.options(**options, enforceSchema=False).schema(text).csv(path)
    return rows.transform(_require, schema).select(*[_typed(f) for f in schema.fields])


def _require(df: DataFrame, schema: T.StructType) -> DataFrame:
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _typed(field: T.StructField) -> Column:
    """A text column as the type of ``field``; what cannot be converted raises."""
    text, value = F.col(field.name), F.col(field.name).try_cast(field.dataType)
    problem = F.concat(F.lit(f"{field.name} is not {field.dataType.simpleString()}: "), text)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(problem)).otherwise(
        value).alias(field.name)


def jdbc_options(url: str, table: str, *, user: str | None = None, password: str | None = None,
                 partition_column: str | None = None, lower: object = None, upper: object = None,
                 partitions: int = 1, fetch_size: int = 10_000,
                 single_task: bool = False) -> dict[str, str]:
    """Options for a partitioned JDBC read.

    Without a partition column one task reads the whole table; that has to be asked for by
    ``single_task``, for small tables.
    """
    if partition_column is None and not single_task:
        raise ValueError("name a partition column, or ask for single_task=True")
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partition column needs its lower and upper bound")
        options.update(partitionColumn=partition_column, lowerBound=str(lower),
                       upperBound=str(upper), numPartitions=str(partitions))
    return options


def read_jdbc(spark: SparkSession, schema: T.StructType, **options) -> DataFrame:
    """A database table. Filters and column selection are pushed to the database by Spark."""
    return conform(spark.read.format("jdbc").options(**jdbc_options(**options)).load(), schema)
