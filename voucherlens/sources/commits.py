"""Folders whose contents change by commits only: replace, append and partial replace that cannot
lose data.

A :class:`CommittedFolder` holds named parts. ``put`` writes a part aside, into a folder of its own
that nobody reads yet, compares what was written with what the job counted, and then commits: a small
file in ``_log`` with the next number, which lists the parts that make up the table from then on.
The file is written under another name and renamed, and the rename fails if that number is there
already. So a reader sees the parts of the last commit, whole; a job that fails midway leaves folders without
a commit, which ``vacuum`` removes; of two writers at once one sees the other's commit and goes on
behind it, or gives up if both wanted the same part.

The log is metadata: an entry has a line for each part, however many rows these have.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voucherlens.operators import keys

Check = Callable[[DataFrame], None]


class ConcurrentChange(RuntimeError):
    """Somebody else committed the same part meanwhile."""


class IncompleteWrite(RuntimeError):
    """What was written is not what the job counted."""


class Snapshot(dict):
    """The parts of one version: name to ``{"folder": …, "rows": …}``; no folder without rows."""

    version = 0
    schema: T.StructType | None = None


class CommittedFolder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- files ---------------------------------------------------------------------------------

    def _at(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names)))

    def _files(self):
        return self._at().getFileSystem(self._conf)

    def _names(self, *folder: str) -> list[str]:
        files, path = self._files(), self._at(*folder)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _read(self, *names: str) -> str:
        stream = self._files().open(self._at(*names))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, text: str, *names: str) -> None:
        """A whole file, or none: an error if it is there already."""
        aside, files = self._at("_log", f".{uuid.uuid4().hex}"), self._files()
        stream = files.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        context = self._hadoop.FileContext.getFileContext(files.getUri(), self._conf)
        no_overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(aside), files.makeQualified(self._at(*names)), no_overwrite)
        except Exception as e:
            files.delete(aside, False)
            if files.exists(self._at(*names)):
                raise ConcurrentChange(f"{names[-1]} is there already") from e
            raise

    # --- versions ------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_log") if n.endswith(".json") and n[0] != ".")

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The parts as of a version; of the last one if none is given."""
        known = self.versions()
        out = Snapshot()
        if version is None and not known:
            return out
        out.version = known[-1] if version is None else version
        entry = json.loads(self._read("_log", f"{out.version:010d}.json"))
        out.update(entry["parts"])
        out.schema = T.StructType.fromJson(entry["schema"])
        return out

    def _commit(self, change: Callable[[Snapshot], dict], schema: T.StructType, before: Snapshot,
                touched: str | None) -> None:
        """Adds a version; goes on behind other writers unless they changed the part ``touched``,
        or any part if that is None."""
        now = self.snapshot()
        while True:
            if dict(now) != dict(before) if touched is None else now.get(touched) != before.get(touched):
                raise ConcurrentChange(f"{touched or self.path} was changed by another writer")
            entry = {"parts": change(now), "schema": json.loads(schema.json())}
            try:
                return self._create(json.dumps(entry), "_log", f"{now.version + 1:010d}.json")
            except ConcurrentChange:
                now = self.snapshot()

    # --- changes -------------------------------------------------------------------------------

    def _write(self, df: DataFrame, folder: str) -> None:
        df.write.parquet(f"{self.path}/{folder}")

    def put(self, df: DataFrame, name: str = "all", check: Check | None = None) -> int:
        """Replaces one part, or adds it; returns its rows. The other parts stay as they are.

        ``check`` gets what was written and raises if that must not be committed.
        """
        before = self.snapshot()
        if before.schema is not None and _shape(before.schema) != _shape(df.schema):
            raise ValueError(f"columns are {df.schema.simpleString()}, the table has "
                             f"{before.schema.simpleString()}")
        folder, seen = f"data/{uuid.uuid4().hex}", Observation()
        self._write(df.observe(seen, F.count(F.lit(1)).alias("rows")), folder)
        rows = self._checked(folder, df.schema, seen.get.get("rows", 0), check)
        part = {"folder": folder if rows else None, "rows": rows}
        self._commit(lambda now: {**now, name: part}, df.schema, before, name)
        return rows

    def _checked(self, folder: str, schema: T.StructType, rows: int, check: Check | None) -> int:
        written = self._parquet(schema, [folder] if rows else [])
        found = written.count()  # from the footers
        if found != rows:
            raise IncompleteWrite(f"{folder} has {found} rows of {rows}")
        if check:
            check(written)
        return rows

    def drop(self, name: str) -> None:
        before = self.snapshot()
        if name in before:
            self._commit(lambda now: {k: v for k, v in now.items() if k != name}, before.schema, before, name)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what none of the last ``keep`` versions lists; returns the folders deleted.

        Readers of older versions and writers that have not committed yet must be through.
        """
        known = self.versions()[-keep:]
        live = {p["folder"] for v in known for p in self.snapshot(v).values()}
        dead = [n for n in self._names("data") if f"data/{n}" not in live]
        for n in dead:
            self._files().delete(self._at("data", n), True)
        return len(dead)

    # --- reading -------------------------------------------------------------------------------

    def _parquet(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], T.StructType([  # as files: nothing is required
                T.StructField(f.name, f.dataType) for f in schema.fields]))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, wanted: Callable[[str], bool] = lambda name: True,
             version: int | None = None) -> DataFrame:
        """The parts with a ``wanted`` name; only their folders are opened."""
        now = self.snapshot(version)
        if now.schema is None:
            raise FileNotFoundError(f"nothing was committed to {self.path}")
        return self._parquet(now.schema, [p["folder"] for n, p in sorted(now.items())
                                          if p["folder"] and wanted(n)])


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


class FlagLog(CommittedFolder):
    """The flags of all runs, a part for each layer and run date.

    Running a layer again replaces what it found on that date, also if it finds nothing now, and
    leaves the files of other layers and dates alone.
    """

    @staticmethod
    def part(layer: int, run_date: object) -> str:
        return f"layer={layer}/run_date={run_date}"

    def write(self, flags: DataFrame, layer: int, run_date: object) -> int:
        named = flags.withColumns({"layer": F.lit(layer).cast("int"),
                                   "run_date": F.lit(str(run_date)).cast("date"),
                                   "flag_date": F.current_timestamp()})
        return self.put(named, self.part(layer, run_date))

    def flags(self, layer: int | None = None, run_date: object | None = None) -> DataFrame:
        """The flags of one layer, of one date, of both, or all."""
        def wanted(name: str) -> bool:
            own = name.split("/")
            return ((layer is None or own[0] == f"layer={layer}")
                    and (run_date is None or own[1] == f"run_date={run_date}"))
        return self.read(wanted)


class KeyedLedger(CommittedFolder):
    """Rows under a unique key, to which only new keys are ever added; a part for each run.

    The parts are bucketed by the key. What arrives is combined by key, shuffled to the buckets,
    once, and compared; the rows that are there are read bucket by bucket and never shuffled or
    rewritten. Choose ``buckets`` for the size of the ledger in the end, and the same number for
    ``spark.sql.shuffle.partitions`` when appending: with another one the arriving rows are shuffled twice, or,
    if the buckets are fewer, Spark may prefer to shuffle both sides.
    """

    RUN = "run"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int):
        super().__init__(spark, path)
        self.schema, self.key, self.buckets = schema, key, buckets
        self.columns = T.StructType([*schema.fields, T.StructField(self.RUN, T.StringType())])

    def _write(self, df: DataFrame, folder: str) -> None:
        name = f"voucherlens_{uuid.uuid4().hex}"
        (df.write.bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet")
         .option("path", f"{self.path}/{folder}").saveAsTable(name))
        self.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay

    def rows(self) -> DataFrame:
        """All rows, with the run that brought them."""
        return self.read() if self.versions() else self._parquet(self.columns, [])

    def new_rows(self, incoming: DataFrame, existing: DataFrame) -> DataFrame:
        own = incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        return keys.first_of_each(own, self.key).join(existing.select(self.key), self.key, "left_anti")

    def append(self, incoming: DataFrame, run: str) -> int:
        """Adds the rows whose key is new, as ``run``; returns how many.

        A run that is committed already adds nothing and reads nothing; one that failed is just run again.
        """
        before = self.snapshot()
        if run in before:
            return 0
        with _Bucketed(self, before) as existing:
            new = self.new_rows(incoming, existing).withColumn(self.RUN, F.lit(run))
            folder, seen = f"data/{uuid.uuid4().hex}", Observation()
            self._write(new.observe(seen, F.count(F.lit(1)).alias("rows")), folder)
        rows = self._checked(folder, self.columns, seen.get.get("rows", 0), None)
        part = {"folder": folder if rows else None, "rows": rows}
        # Two runs at once could both bring a key, so no other run may have come in between.
        self._commit(lambda now: {**now, run: part}, self.columns, before, None)
        return rows


class _Bucketed:
    """The committed parts of a keyed ledger as one bucketed table, while it is needed."""

    def __init__(self, ledger: KeyedLedger, parts: Snapshot):
        self.ledger, self.parts = ledger, parts
        self.name = f"voucherlens_{uuid.uuid4().hex}"

    def __enter__(self) -> DataFrame:
        spark, own = self.ledger.spark, self.ledger
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.columns.fields)
        spark.sql(f"CREATE TABLE {self.name} ({columns}, _part STRING) USING parquet "
                  f"PARTITIONED BY (_part) CLUSTERED BY (`{own.key}`) SORTED BY (`{own.key}`) "
                  f"INTO {own.buckets} BUCKETS LOCATION '{own.path}/data'")
        for n, p in enumerate(self.parts.values()):
            if p["folder"]:
                spark.sql(f"ALTER TABLE {self.name} ADD PARTITION (_part = '{n}') "
                          f"LOCATION '{own.path}/{p['folder']}'")
        return spark.table(self.name).drop("_part")

    def __exit__(self, *_: object) -> None:
        self.ledger.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
