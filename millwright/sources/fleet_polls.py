"""Polled fleet documents as a streaming source with its own offsets (K1 over S6), and their rejects.

A poll of a fleet endpoint can't be repeated, so the poller lands what it got before anything reads it: a
folder ``poll=<n>`` per poll, numbered without gaps, one JSON document per line of its files, and a ``_SUCCESS``
mark when it is complete (what ``df.write.text`` leaves).  The stream's offset is the number of the
last poll taken; a restart goes on after the offset in the checkpoint, a poll without its mark holds
back those after it, so none is passed over.  The source hands on documents as text; Spark parses them.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import rules
from . import messages

FORMAT = "fleet_polls"
DOCUMENT_COLUMNS = "poll long, document string"
#: Text handed to Spark at once, in documents and bytes (a longer document goes alone).
BATCH_DOCUMENTS, BATCH_BYTES = 1024, 4 << 20
#: A landed file is read by a task per so many bytes; compressed files are read as a whole.
SPLIT_BYTES = 4 << 20
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".br")


@dataclass
class PollFile(InputPartition):
    """A landed file of a poll, or its lines that begin at bytes from ``start`` to before ``end``: a task of the stream."""
    poll: int
    path: str
    start: int = 0
    end: int | None = None


def _file_system(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def _listed(path: str, files: bool) -> list:
    from pyarrow import fs
    system, inner = _file_system(path)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return [i for i in found if (i.type == fs.FileType.File) == files]


def poll_folder(root: str, poll: int) -> str:
    return f"{root.rstrip('/')}/poll={poll}"


def complete_polls(root: str, after: int = 0) -> int:
    """Number of the last poll up to which all are complete, ``after`` if none follows."""
    numbers = sorted(int(i.base_name[5:]) for i in _listed(root, False) if i.base_name.startswith("poll=") and i.base_name[5:].isdigit())
    last = after if after else (numbers[0] - 1 if numbers else 0)
    for n in numbers:
        if n == last + 1 and any(i.base_name == "_SUCCESS" for i in _listed(poll_folder(root, n), True)):
            last = n
    return last


def _poll_files(root: str, first: int, last: int) -> list[PollFile]:
    folder, out = root.rstrip("/"), []
    for n in range(first, last + 1):
        for i in sorted(_listed(poll_folder(folder, n), True), key=lambda i: i.base_name):
            if i.base_name[:1] not in "._" and i.size:
                step = i.size if i.base_name.endswith(COMPRESSED) else SPLIT_BYTES
                path = posixpath.join(poll_folder(folder, n), i.base_name)
                out += [PollFile(n, path, a, a + step if a + step < i.size else None) for a in range(0, i.size, step)]
    return out


def _documents(partition: PollFile) -> Iterator:
    """Arrow batches of the lines of a file or a part of it; blank lines are no documents."""
    import io

    import pyarrow as pa
    system, inner = _file_system(partition.path)

    def batch(lines):
        return pa.RecordBatch.from_arrays([pa.array([partition.poll] * len(lines), pa.int64()), pa.array(lines, pa.string())], ["poll", "document"])
    whole = partition.start == 0 and partition.end is None
    with system.open_input_stream(inner) if whole else system.open_input_file(inner) as stream:
        reader, lines, size, at = io.BufferedReader(stream), [], 0, 0
        if partition.start:                                  # the line that runs over the start belongs to the part before
            reader.seek(partition.start - 1)
            at = partition.start - 1 + len(reader.readline())
        for raw in reader:
            if partition.end is not None and at >= partition.end:
                break
            at += len(raw)
            text = raw.decode("utf-8", "replace").strip()
            if not text:
                continue
            if lines and (len(lines) >= BATCH_DOCUMENTS or size + len(raw) > BATCH_BYTES):
                yield batch(lines)
                lines, size = [], 0
            lines.append(text)
            size += len(raw)
        if lines:
            yield batch(lines)


class _PollStream(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        numbers = [int(i.base_name[5:]) for i in _listed(self.root, False) if i.base_name.startswith("poll=") and i.base_name[5:].isdigit()]
        return {"poll": min(numbers) - 1 if numbers else 0}

    def latestOffset(self) -> dict:
        return {"poll": complete_polls(self.root)}

    def partitions(self, start: dict, end: dict) -> list[PollFile]:
        return _poll_files(self.root, start["poll"] + 1, end["poll"])

    def read(self, partition: PollFile) -> Iterator:
        return _documents(partition)


class _PollBatch(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[PollFile]:
        last = complete_polls(self.root)
        return _poll_files(self.root, _PollStream(self.root).initialOffset()["poll"] + 1, last)

    def read(self, partition: PollFile) -> Iterator:
        return _documents(partition) if partition is not None else iter(())


class FleetPolls(DataSource):
    """``spark.readStream.format("fleet_polls").load(root)``, or ``spark.read`` for what is complete now."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return DOCUMENT_COLUMNS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PollStream(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _PollBatch(self.options["path"])


def land_poll(documents: DataFrame, root: str, poll: int | None = None, column: str = "document") -> int:
    """Land the documents of one poll as the next number (or ``poll``; landing a number again replaces it)."""
    number = complete_polls(root) + 1 if poll is None else poll
    documents.select(column).write.mode("overwrite").text(poll_folder(root, number))
    return number


def fleet_documents(spark: SparkSession, root: str, stream: bool = True) -> DataFrame:
    """Documents (poll, document) of the landed polls, as a stream or as they are complete now."""
    spark.dataSource.register(FleetPolls)
    return (spark.readStream if stream else spark.read).format(FORMAT).load(root)


def fleet_readings(documents: DataFrame) -> DataFrame:
    """S6 with rejects: a row per machine entry, ``reason`` null where it is a reading.

    Reasons: ``json`` (no JSON object), ``machines`` (no list of machines), ``entry`` (an entry that is no
    object), ``machine`` (null or blank id).  ``document`` holds the text of what a reason is about, the
    document or the entry, and is null for readings.  Sensors that are absent or no numbers are null.  A document
    with an empty list gives no row.
    """
    text = F.col("document")
    whole = F.from_json(text, "machines string, fetched_at timestamp_ntz")
    is_object = F.coalesce(F.get_json_object(text, "$").startswith("{"), F.lit(False))
    # Every text is parsed in a generator, so once: projections above it only take the fields.
    parsed = documents.select("poll", text.alias("_text"), F.explode(F.array(F.struct(whole.alias("d"), is_object.alias("object")))).alias("_p"))
    machines = F.col("_p.d.machines")
    is_list = F.col("_p.object") & F.coalesce(F.trim(machines).startswith("["), F.lit(False))

    def parts(entry, broken):
        return F.struct(F.lit(broken).alias("broken"), entry.alias("text"), F.from_json(entry, messages.FLEET_ENTRY).alias("f"),
                        F.get_json_object(entry, "$.machine_id").alias("machine"))
    entries = F.transform(F.when(is_list, F.from_json(machines, "array<string>")), lambda entry: parts(entry, False))
    none = F.array(parts(F.lit(None).cast("string"), True))
    rows = parsed.select("poll", "_text", F.col("_p.d.fetched_at").alias("fetched_at"), F.col("_p.object").alias("_object"),
                         F.explode(F.coalesce(entries, none)).alias("_e"))
    broken = F.col("_e.broken")
    object_entry = F.coalesce(F.trim("_e.text").startswith("{"), F.lit(False))
    reason = (F.when(broken & ~F.col("_object"), F.lit("json")).when(broken, F.lit("machines")).when(~object_entry, F.lit("entry"))
              .when(F.coalesce(F.trim("_e.machine"), F.lit("")) == "", F.lit("machine")))
    out = rows.select("poll", F.col("fetched_at").alias("timestamp"), F.col("_e.f").alias("_f"), reason.alias("reason"),
                      F.when(broken, F.col("_text")).otherwise(F.col("_e.text")).alias("_about"))
    kept = F.col("reason").isNull()
    return out.select("poll", *[F.when(kept, F.col(f"_f.{c}")).alias(c) for c in ("machine_id", *rules.SENSORS)], "timestamp",
                      "reason", F.when(~kept, F.col("_about")).alias("document"))


def two_outputs_writer(root: str):
    """``foreachBatch`` body: one pass writes readings and rejects of a batch side by side below its id.

    ``accepted=true`` and ``accepted=false`` folders; a replay overwrites the batch's folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("accepted", F.col("reason").isNull()).write.mode("overwrite").partitionBy("accepted") \
            .parquet(f"{root.rstrip('/')}/batch={batch_id}")
    return write


def outputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(readings, rejects) that ``two_outputs_writer`` left below ``root``."""
    both = spark.read.parquet(root)
    readings = both.filter("accepted = 'true'").drop("accepted", "batch", "reason", "document")
    return readings, both.filter("accepted = 'false'").select("poll", "reason", "document", "timestamp")
