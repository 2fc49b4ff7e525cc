"""Replaces, appends and partial replaces that cannot lose data."""

import datetime as dt
import os

import pytest
from conftest import DATA
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voucherlens.plans import catalog
from voucherlens.sources import commits, ledger, sinks, tables

ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])


def rows(spark, first, last, v=1):
    return spark.range(first, last).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"),
                                           F.lit(v).alias("v"))


def failing(df, at="k7"):
    """The rows, of which one breaks the job that writes them."""
    broken = F.when(F.col("k") == at, F.raise_error(F.lit("broken on purpose"))).otherwise(F.col("v"))
    return df.withColumn("v", broken.cast("int"))


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(folder) for f in names}


def test_a_replace_that_fails_midway_leaves_the_old_rows(spark, tmp_path):
    table = commits.CommittedFolder(spark, str(tmp_path))
    assert table.put(rows(spark, 0, 50)) == 50
    with pytest.raises(Exception, match="broken on purpose"):
        table.put(failing(rows(spark, 0, 80, 2).repartition(8, "k")))
    assert table.versions() == [1] and len(os.listdir(tmp_path / "data")) == 2
    old = table.read()
    assert old.count() == 50 and old.where("v <> 1").count() == 0
    assert table.put(rows(spark, 0, 80, 2)) == 80
    assert table.read().agg(F.count("v"), F.min("v")).first() == (80, 2)
    assert table.read(version=1).count() == 50
    assert table.vacuum() == 1 and table.read(version=1).count() == 50
    assert table.vacuum(keep=1) == 1 and table.read().count() == 80


def test_scores_survive_a_failed_run(spark, tmp_path):
    scores = spark.createDataFrame([(i, 1.0 * i) for i in range(20)], "vendor_id int, composite_score double")
    sinks.write_scores(scores, str(tmp_path))
    bad = scores.withColumn("composite_score", F.when(F.col("vendor_id") == 13, F.raise_error(F.lit("broken")))
                            .otherwise(F.lit(0.0)).cast("double"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_scores(bad, str(tmp_path))
    with pytest.raises(ValueError, match="more than once"):
        sinks.write_scores(scores.unionByName(scores), str(tmp_path))
    back = tables.read_committed(spark, str(tmp_path))
    assert sorted(back.drop("scored_at").collect()) == sorted(scores.collect())
    assert sinks.write_scores(scores.where("false"), str(tmp_path)) == 0
    assert tables.read_committed(spark, str(tmp_path)).count() == 0


def test_lost_files_are_noticed_before_the_commit(spark, tmp_path, monkeypatch):
    table = commits.CommittedFolder(spark, str(tmp_path))
    table.put(rows(spark, 0, 9))
    whole = table._write

    def lossy(df, folder):
        whole(df, folder)
        part = next(f for f in sorted(os.listdir(tmp_path / folder)) if f.startswith("part-"))
        os.remove(tmp_path / folder / part)

    monkeypatch.setattr(table, "_write", lossy)
    with pytest.raises(commits.IncompleteWrite):
        table.put(rows(spark, 0, 40).repartition(4))
    assert table.read().count() == 9


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = (commits.CommittedFolder(spark, str(tmp_path)) for _ in range(2))
    one.put(rows(spark, 0, 5), "a")
    whole = one._write

    def meanwhile(name):
        def write(df, folder):
            whole(df, folder)
            two.put(rows(spark, 0, 3, 2), name)
        return write

    monkeypatch.setattr(one, "_write", meanwhile("b"))
    one.put(rows(spark, 0, 6, 3), "a")           # another part: goes on behind it
    assert sorted(one.snapshot()) == ["a", "b"] and one.read().count() == 9
    monkeypatch.setattr(one, "_write", meanwhile("a"))
    with pytest.raises(commits.ConcurrentChange):
        one.put(rows(spark, 0, 7, 4), "a")
    assert one.read(lambda n: n == "a").agg(F.count("v"), F.max("v")).first() == (3, 2)


def test_a_number_is_given_once(spark, tmp_path):
    table = commits.CommittedFolder(spark, str(tmp_path))
    table.put(rows(spark, 0, 1))
    with pytest.raises(commits.ConcurrentChange):
        table._create("{}", "_log", "0000000001.json")
    assert table.snapshot()["all"]["rows"] == 1 and table.versions() == [1]
    assert not [n for n in os.listdir(tmp_path / "_log") if n.startswith(".") and not n.endswith(".crc")]


def test_other_columns_and_empty_folders_are_refused(spark, tmp_path):
    table = commits.CommittedFolder(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.put(rows(spark, 0, 1))
    with pytest.raises(ValueError, match="columns are"):
        table.put(rows(spark, 0, 1).withColumn("w", F.lit(1)), "b")
    table.drop("all")
    assert table.read().count() == 0 and table.read().schema == ROW


FLAG_ROW = "invoice_id string, vendor_id int, flag_type string"


def test_rerunning_a_layer_leaves_the_others_untouched(spark, tmp_path):
    log = commits.FlagLog(spark, str(tmp_path))
    one = spark.createDataFrame([("a", 1, "DUPLICATE"), ("b", 2, "DUPLICATE")], FLAG_ROW)
    two = spark.createDataFrame([("c", 1, "IQR_OUTLIER")], FLAG_ROW)
    day, next_day = dt.date(2024, 5, 1), dt.date(2024, 5, 2)
    for layer, found in ((1, one), (2, two)):
        log.write(found, layer, day)
    log.write(one, 1, next_day)
    before = files(tmp_path / "data")
    assert log.write(two.unionByName(two.withColumn("invoice_id", F.lit("d"))), 2, day) == 2
    assert log.write(two.where("false"), 2, next_day) == 0
    after = files(tmp_path / "data")
    assert before.items() <= after.items()       # nothing is rewritten
    assert [log.flags(*a).count() for a in ((), (1,), (2,), (1, day), (2, day), (None, next_day))] == [
        6, 4, 2, 2, 2, 2]
    assert log.write(two.where("false"), 2, day) == 0     # finding nothing replaces too
    assert log.flags(2).count() == 0 and log.flags(1).count() == 4
    read = {f.split("/data/")[1].split("/")[0] for f in log.flags(1, day).inputFiles()}
    assert read == {log.snapshot()[log.part(1, day)]["folder"].split("/")[1]}
    log.vacuum(keep=1)
    assert log.flags().count() == 4 and log.flags().columns[-3:] == ["layer", "run_date", "flag_date"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def keyed(spark, tmp_path):
    made = commits.KeyedLedger(spark, str(tmp_path / "ledger"), ROW, "k", 8)
    yield made
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("voucherlens_")]


def test_append_writes_only_new_rows(spark, keyed, tmp_path):
    assert keyed.rows().count() == 0
    assert keyed.append(rows(spark, 0, 100), "a") == 100
    before = files(tmp_path / "ledger" / "data")
    assert keyed.append(rows(spark, 60, 150, 2), "b") == 50
    assert keyed.append(rows(spark, 60, 150, 3), "b") == 0        # committed already
    assert keyed.append(rows(spark, 60, 150, 4), "c") == 0        # nothing new
    assert before.items() <= files(tmp_path / "ledger" / "data").items()
    got = {(r.run, r.v): r["count"] for r in keyed.rows().groupBy("run", "v").count().collect()}
    assert got == {("a", 1): 100, ("b", 2): 50} and keyed.rows().select("k").distinct().count() == 150
    again = commits.KeyedLedger(spark, keyed.path, ROW, "k", 8)   # another session finds all of it
    assert again.append(rows(spark, 149, 152, 5), "d") == 2


def test_a_failed_append_can_be_run_again(spark, keyed):
    keyed.append(rows(spark, 0, 5), "a")
    with pytest.raises(Exception, match="broken on purpose"):
        keyed.append(failing(rows(spark, 0, 50, 2).repartition(8), "k7"), "b")
    assert keyed.rows().count() == 5 and list(keyed.snapshot()) == ["a"]
    assert keyed.append(rows(spark, 0, 50, 2), "b") == 45
    assert keyed.vacuum() <= 1 and keyed.rows().count() == 50


def test_repeated_and_missing_keys_in_what_arrives(spark, keyed):
    many = rows(spark, 0, 3).crossJoin(spark.range(400).select(F.col("id").cast("int").alias("n")))
    assert keyed.append(many.select("k", (F.col("n") + 1).alias("v")), "a") == 3
    assert {r.v for r in keyed.rows().collect()} == {1}
    missing = spark.createDataFrame([(None, 1), ("k9", 2)], ROW)
    with pytest.raises(Exception, match="NULL in the key k"):
        keyed.append(missing, "b")
    assert keyed.rows().count() == 3


def test_runs_at_the_same_time_do_not_both_bring_a_key(spark, keyed, monkeypatch):
    keyed.append(rows(spark, 0, 5), "a")
    other, whole = commits.KeyedLedger(spark, keyed.path, ROW, "k", 8), keyed._write

    def write(df, folder):
        whole(df, folder)
        other.append(rows(spark, 3, 9), "other")

    monkeypatch.setattr(keyed, "_write", write)
    with pytest.raises(commits.ConcurrentChange):
        keyed.append(rows(spark, 4, 12), "b")
    monkeypatch.setattr(keyed, "_write", whole)
    assert keyed.append(rows(spark, 4, 12), "b") == 3
    assert keyed.rows().count() == keyed.rows().select("k").distinct().count() == 12


def test_what_is_there_is_not_shuffled(spark, keyed):
    keyed.append(rows(spark, 0, 500), "a")
    keyed.append(rows(spark, 400, 600), "b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with commits._Bucketed(keyed, keyed.snapshot()) as existing:
            arriving = spark.createDataFrame([(f"k{i}", i) for i in range(900)], ROW)
            new = keyed.new_rows(arriving, existing)
            text = plan(new)
            assert new.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left, right = text.split("LeftAnti")[1].split("FileScan")
    assert "Bucketed: true" in right and text.count("Exchange") == 1
    assert left.index("Exchange") < left.rindex("Sort")           # the exchange is on the arriving side


def test_ledger_of_invoices_is_appended_at_rest(spark, stage, tmp_path):
    got = catalog.QUERIES["append_only_new"](spark, DATA, stage)
    whole = catalog.QUERIES["insert_if_absent"](spark, DATA, stage)
    assert got.drop("run").exceptAll(whole).count() == 0 and got.count() == whole.count()
    base = ledger.invoices(spark, DATA, copies=False, category=False, state=False).count()
    assert got.where("run = 'first'").count() == base and got.where("run = 'third'").count() == 0
