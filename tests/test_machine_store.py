"""Tables by machine: files follow the bytes, lookups read only row groups that may hold their machines."""
import glob

from pyspark.sql import functions as F

from paths import SF_SMALL
from millwright import fixtures as fx
from millwright.session import scratch_path
from millwright.sources import files, machine_store as ms


def _scanned(df):
    """Rows that the scans of ``df`` handed on, from the metrics of the plan that ran."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())
               if "FileScan" in leaves.apply(i).simpleString(200))


def _fleet(spark, n):
    """``n`` even machine ids, each with a list of 20 numbers."""
    return spark.range(0, 2 * n, 2).select(F.col("id").alias("machine_id"), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda x: F.rand(7) * x).alias("v"))


def _written(spark, df, **k):
    return ms.write_by_machine(df, scratch_path(spark, "by-machine"), **k)


def test_files_do_not_follow_the_fleet(spark):
    for n in (100, 20_000):
        path = _written(spark, _fleet(spark, n))
        assert len(glob.glob(f"{path}/part-*")) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert spark.read.parquet(path).count() == n


def test_statistics_and_bloom_filters_prune_row_groups(spark):
    path = _written(spark, _fleet(spark, 40_000), row_group_bytes=256 << 10)
    table = spark.read.parquet(path)
    assert _scanned(table) == 40_000
    one = table.filter(ms.among(ms.KEY, [31_000]))
    assert one.count() == 1 and 0 < _scanned(one) < 10_000
    between = table.filter(ms.among(ms.KEY, [31_001]))  # inside the range of a row group, held by none
    assert between.count() == 0 and _scanned(between) == 0
    many = table.filter(ms.among(ms.KEY, list(range(1, 2001, 40))))  # 50 absent ids in lists of ten
    assert many.count() == 0 and _scanned(many) < 10_000


def test_bloom_filter_decides_without_page_indexes(spark):
    spark.conf.set("parquet.filter.columnindex.enabled", "false")
    try:
        table = spark.read.parquet(_written(spark, _fleet(spark, 5_000)))
        read = [_scanned(table.filter(ms.among(ms.KEY, [i]))) for i in range(1_001, 1_201, 20)]
    finally:
        spark.conf.unset("parquet.filter.columnindex.enabled")
    assert sum(r == 0 for r in read) >= 8  # one in a hundred may be taken for present


def test_lookup_is_the_same_by_literals_and_by_join(spark):
    table = spark.read.parquet(_written(spark, _fleet(spark, 500).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS machine_id, array(1.0D) AS v"))))
    wanted = spark.createDataFrame([(4,), (4,), (5,), (998,), (None,)], "machine_id long")
    for k in (2, 1000):
        assert sorted(r[0] for r in ms.lookup(table, wanted, max_literals=k).collect()) == [4, 998]
    assert ms.lookup(table, wanted.limit(0)).count() == 0
    assert ms.lookup(table.limit(0), wanted).count() == 0


def test_lists_equal_the_arrays_of_a_folder_per_machine(spark):
    lists = ms.prediction_lists(fx.predictions(spark, SF_SMALL), 30)
    folders = scratch_path(spark, "folders")
    lists.select("machine_id", F.to_json("predictions", files.JSON_OPTIONS).alias("value")).write.partitionBy("machine_id").text(folders)
    given = files.machine_recent_predictions(spark, folders, 7)
    ours = ms.last_predictions(spark.read.parquet(_written(spark, lists)), 7)
    assert given.count() == ours.count() > 0
    assert given.select(sorted(given.columns)).exceptAll(ours.select(sorted(ours.columns))).count() == 0


def test_records_of_machines_without_predictions(spark):
    scored = fx.predictions(spark, SF_SMALL).filter("machine_id <> 7")
    registry = fx.registry(spark, SF_SMALL)
    stats = scored.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"))
    store = ms.MachineStore(spark, scratch_path(spark, "store")).write(registry, stats, scored, keep_last=5)
    wanted = spark.createDataFrame([(7,), (8,), (-1,)], "machine_id long")
    rows = {r["machine_id"]: r for r in store.records(wanted, recent=3).collect()}
    have = {r[0] for r in registry.select("machine_id").collect()}
    assert set(rows) == {7, 8} & have
    if 7 in rows:
        assert rows[7]["n"] is None and rows[7]["recent_predictions"] is None
    if 8 in rows:
        seq = [(p["timestamp"], p["seq"]) for p in rows[8]["recent_predictions"]]
        assert len(seq) == min(3, rows[8]["n"]) and seq == sorted(seq, reverse=True)


def test_registry_documents_are_bounded(spark):
    fleet = spark.range(0, 2500).select(F.col("id").alias("machine_id"), F.lit("A").alias("location"))
    docs = files.registry_documents(fleet, machines=400)
    assert docs.count() == 7
    assert files.registry_explode(docs).select("machine_id").distinct().count() == 2500
