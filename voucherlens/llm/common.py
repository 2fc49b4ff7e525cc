"""What the operators share: reading the tables, choosing columns, hashing text for digests."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once per application.

    The functions that run on executors are found by module name there. ``addPyFile`` sends a
    small archive of the sources along, whatever folder the driver was started in.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.TemporaryDirectory(prefix="voucherlens-src-")
    package = Path(__file__).resolve().parent.parent
    archive = f"{folder.name}/voucherlens_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    _shipped[sc.applicationId] = folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as it is on disk, all rows and columns."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                whole: bool = False) -> DataFrame:
    """Just the id and the text (null counts as empty), under fixed names.

    The operators work on this alone, so whatever other columns a table has cannot clash with
    theirs. With ``whole`` the complete row comes along in one column ``row``, for filters that
    give back their input's columns.
    """
    ship(df.sparkSession)
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if whole else []
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *row)


def sent(texts: DataFrame, text_col: str = "text"
         ) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """What of :func:`id_and_text` goes to Python, and the function that finds a batch's texts there.

    A text that the complete row has as a string is not sent beside it once more.
    """
    if "row" in texts.columns:
        fields = texts.schema["row"].dataType.fields
        at = [i for i, f in enumerate(fields)
              if f.name == text_col and f.dataType == T.StringType()]
        if len(at) == 1:
            return texts.drop("text"), lambda batch: batch.column("row").field(at[0]).fill_null("")
    return texts, lambda batch: batch.column("text")


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What tasks of ``owner`` keep in a Python worker from one to the next.

    Workers are used again by all operators of a session, so one owner's things are kept at a
    time: a task of another one drops them.
    """
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    return _kept[owner]


def fold_of(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it repeatedly."""
    return F.element_at(F.transform(F.array(value), body), 1)


def schema_with(df: DataFrame, *fields: str, keep: tuple[str, ...] = ("doc_id",)) -> T.StructType:
    """The kept columns of ``df`` with their own types, then ``fields`` given as DDL."""
    kept = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in keep])
    return T.StructType(kept.fields + T.StructType.fromDDL(", ".join(fields)).fields)
