"""Bucketed copy-on-write state: buckets rewritten, conflicts, equality with the whole-table changes."""
import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from millwright import fixtures as fx
from millwright.operators import state
from millwright.operators.bucketed import BucketedTable, CommitConflict
from millwright.session import scratch_path


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(spark, keys=("machine_id",), buckets=8):
    return BucketedTable(spark, scratch_path(spark, "bucketed"), list(keys), buckets)


def test_a_change_of_one_key_rewrites_one_bucket(spark):
    t = table(spark)
    t.replace(spark.range(100).select(F.col("id").alias("machine_id"), F.lit("OK").alias("status"), F.lit(0).alias("at")))
    before = t.owners()
    change = spark.createDataFrame([(7, "AT_RISK", 1)], "machine_id long, status string, at int")
    assert t.upsert(change, ["at"]) == 2
    after = t.owners()
    assert len(before) == 8 and [b for b in before if before[b] != after[b]] == t.touched(change) and len(t.touched(change)) == 1
    assert rows(t.read().filter("status <> 'OK'")) == [(7, "AT_RISK", 1)] and t.read().count() == 100
    assert t.read(1).filter("status <> 'OK'").isEmpty()          # the older version stays readable
    t.upsert(change, ["at"])
    assert t.read().count() == 100                               # a repeat adds nothing
    assert t.upsert(change.limit(0), ["at"]) == 3                # no change, no commit


def test_of_two_writers_one_wins_a_version(spark):
    t = table(spark)
    t.replace(spark.createDataFrame([(1, 1)], "machine_id long, v int"))
    mine = spark.createDataFrame([(1, 2)], "machine_id long, v int")
    base = t.version()
    t._publish(base + 1, t._commit_file(base))                   # the other writer
    with pytest.raises(CommitConflict):
        t.replace(mine, t.touched(mine), base)
    with pytest.raises(CommitConflict):
        t._publish(base + 1, t._commit_file(base))
    assert rows(t.read()) == [(1, 1)]
    runs = []

    def how(now, new):
        runs.append(1)
        if len(runs) == 1:                                       # another writer comes in between
            t._publish(t.version() + 1, t._commit_file(t.version()))
        return state.keep_latest(now.unionByName(new), ["machine_id"], ["v"])
    assert t.change(mine, how) == 4 and len(runs) == 2
    assert rows(t.read()) == [(1, 2)]


def test_null_keys_emptied_buckets_and_other_bucket_counts(spark):
    t = table(spark, buckets=4)
    with pytest.raises(LookupError):
        t.read()
    t.replace(spark.createDataFrame([(None, 1), (1, 1), (2, 1)], "machine_id long, v int"))
    t.upsert(spark.createDataFrame([(None, 5)], "machine_id long, v int"), ["v"])
    assert t.read().filter("machine_id is null").first()["v"] == 5
    gone = spark.createDataFrame([(1, 0), (2, 0), (None, 0)], "machine_id long, v int")
    t.change(gone, lambda now, new: now.limit(0))
    assert t.read().isEmpty() and t.owners() == {}
    with pytest.raises(ValueError):
        BucketedTable(spark, t.root, ["machine_id"], 5).read()
    with pytest.raises(ValueError):                              # rows outside the buckets to replace
        t.replace(gone, [])


def test_upserts_in_parts_equal_the_whole_table_change(spark):
    failures = fx.machine_failures(spark, SF_SMALL).select("id", "timestamp", "machine_id", "failure_probability")
    t = table(spark, [F.date_trunc("day", F.col("timestamp")), "machine_id"], 16)
    for part in range(3):
        t.upsert(failures.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == part), ["id"])
    want = state.keep_latest(failures, [F.date_trunc("day", F.col("timestamp")), "machine_id"], ["id"])
    assert rows(t.read()) == rows(want)
