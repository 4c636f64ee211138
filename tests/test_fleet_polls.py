"""The streaming source over polled fleet documents: offsets, restarts, rejects, equality with the batch operator."""
from pyspark.sql import functions as F

from paths import SF_SMALL
from millwright import fixtures as fx
from millwright.functions import rules
from millwright.session import scratch_path
from millwright.sources import fleet_polls, messages
from millwright.streaming import live


def documents(spark):
    s = fx.sensors(spark, SF_SMALL)
    return s.groupBy(F.date_trunc("hour", "ts").alias("_h")).agg(
        F.collect_list(F.struct(F.col("machine_id").cast("string").alias("machine_id"), *rules.SENSORS)).alias("machines"),
        F.max("ts").alias("fetched_at")).select("_h", "machines", "fetched_at")


def as_text(docs):
    return docs.select(F.to_json(F.struct("machines", "fetched_at"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("document"))


def run(spark, root, r):
    rows = fleet_polls.fleet_readings(fleet_polls.fleet_documents(spark, root))
    r.run(rows.writeStream.foreachBatch(fleet_polls.two_outputs_writer(r.sink)))


def cells(df):
    return sorted(map(tuple, df.select("machine_id", *rules.SENSORS, "timestamp").collect()))


def test_stream_equals_batch_and_goes_on_after_a_restart(spark):
    docs = documents(spark)
    slices = live.time_slices(docs, 3, "_h")
    root, r = scratch_path(spark, "polls"), live.StreamRun(spark, "fleet")
    for i, part in enumerate(slices):
        assert fleet_polls.land_poll(as_text(part), root) == i + 1
        run(spark, root, r)
    before = sorted(p["poll"] for p in fleet_polls.outputs(spark, r.sink)[0].select("poll").distinct().collect())
    run(spark, root, r)                                          # nothing new: nothing added
    readings, rejects = fleet_polls.outputs(spark, r.sink)
    assert before == [1, 2, 3] and rejects.isEmpty()
    assert cells(readings) == cells(messages.fleet_doc_explode(docs)) and readings.count() == 1000
    batch = fleet_polls.fleet_readings(fleet_polls.fleet_documents(spark, root, stream=False))
    assert cells(batch) == cells(readings)


def test_incomplete_polls_hold_back_later_ones(spark, tmp_path):
    root = f"file://{tmp_path}/polls"
    one = spark.createDataFrame([('{"machines": [{"machine_id": "a"}]}',)], "document string")
    for n in (4, 5, 7):
        fleet_polls.land_poll(one, root, n)
    (tmp_path / "polls" / "poll=6").mkdir()                      # no mark yet
    assert fleet_polls.complete_polls(root) == 5
    r = live.StreamRun(spark, "fleet-gap")
    run(spark, root, r)
    assert sorted(x["poll"] for x in fleet_polls.outputs(spark, r.sink)[0].collect()) == [4, 5]
    fleet_polls.land_poll(one, root, 6)
    run(spark, root, r)
    assert sorted(x["poll"] for x in fleet_polls.outputs(spark, r.sink)[0].collect()) == [4, 5, 6, 7]


def test_rejects_are_kept_with_their_reasons(spark, monkeypatch):
    texts = ['{"machines": [{"machine_id": "a", "torque": 1.5}, {"machine_id": "  "}, 7, {"torque": 2}], "fetched_at": "2024-01-01T00:00:00"}',
             "not json", "[1]", '{"other": 1}', '{"machines": {"machine_id": "b"}}', '{"machines": []}', "  ", '{"machines": null}',
             '{"machines": [{"machine_id": "c", "torque": "n/a", "air_temp": 300}]}']
    root, r = scratch_path(spark, "polls"), live.StreamRun(spark, "fleet-rejects")
    fleet_polls.land_poll(spark.createDataFrame([(t,) for t in texts], "document string").coalesce(1), root)
    run(spark, root, r)
    readings, rejects = fleet_polls.outputs(spark, r.sink)
    assert sorted((x["machine_id"], x["torque"], x["air_temp"]) for x in readings.collect()) == [("a", 1.5, None), ("c", None, 300.0)]
    got = sorted((x["reason"], x["document"]) for x in rejects.collect())
    assert [g[0] for g in got] == ["entry", "json", "json", "machine", "machine", "machines", "machines", "machines"]
    assert ("entry", "7") in got and ("json", "not json") in got and ("machines", '{"other": 1}') in got
    assert {str(x["timestamp"]) for x in rejects.filter("reason = 'entry'").collect()} == {"2024-01-01 00:00:00"}


def test_an_empty_folder_is_an_empty_stream(spark):
    root = scratch_path(spark, "polls")
    assert fleet_polls.complete_polls(root) == 0
    fleet_polls.land_poll(spark.createDataFrame([], "document string"), root)
    r = live.StreamRun(spark, "fleet-empty")
    run(spark, root, r)
    assert fleet_polls.fleet_documents(spark, root, stream=False).isEmpty()


def test_a_file_is_read_in_parts_and_every_line_once(tmp_path, monkeypatch):
    """Parts of any size, lines longer than a part, blank lines, and a compressed file as a whole."""
    import gzip
    folder = tmp_path / "poll=1"
    folder.mkdir()
    lines = [f"{i}:" + "x\u00e4" * (i * 7 % 40) for i in range(60)]
    (folder / "part-0.txt").write_bytes("\n".join([*lines[:30], "", *lines[30:]]).encode())
    (folder / "part-1.txt.gz").write_bytes(gzip.compress(b"last\nbut one\n"))
    (folder / "_SUCCESS").touch()
    for size in (1, 5, 64, 100, 1 << 20):
        monkeypatch.setattr(fleet_polls, "SPLIT_BYTES", size)
        files = fleet_polls._poll_files(f"file://{tmp_path}", 1, 1)
        got = [t for f in files for b in fleet_polls._documents(f) for t in b.column(1).to_pylist()]
        assert got == [*lines, "last", "but one"]
        assert size > 100 or len(files) > 10
