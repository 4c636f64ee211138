"""State as hash buckets with copy-on-write (U1-U8): a change rewrites only the buckets of its keys.

Layout below one root::

    data/<commit>/_bucket=<b>/part-*.parquet     rows of bucket b as that commit left them
    commits/<n>.json                             columns, bucket count, bucket -> commit that wrote it

A commit writes its buckets into a folder of its own and then publishes the next numbered commit
file by a rename that fails where the file already exists, the same primitive streaming checkpoints
rely on.  So readers see a commit as a whole or not at all, a lost writer leaves only an
unreferenced folder, and of two writers that start from one version exactly one wins; the other
gets ``CommitConflict`` and, through ``change``, starts again from the new version.  The rename is
atomic where the file system makes it so (HDFS); a plain local disk looks before it renames.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import state

BUCKET = "_bucket"


class CommitConflict(RuntimeError):
    """Another writer published the version that this commit wanted."""


class BucketedTable:
    """A keyed table in ``buckets`` hash buckets of ``keys`` (Columns or names over the table's columns).

    The key is hashed as a whole, so a machine that holds a third of the rows still spreads over all
    buckets wherever the key holds more than the machine.  Rows with null keys belong to a bucket like any
    others.  ``read`` of a table without commits raises ``LookupError``.  The bucket count is fixed
    by the first commit; opening the table with another one raises ``ValueError``.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.keys = [F.col(k) if isinstance(k, str) else k for k in keys]

    # -- files -------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        """Number of the newest commit, 0 if there is none."""
        return max((int(n[:-5]) for n in self._names(f"{self.root}/commits") if n[:-5].isdigit()), default=0)

    def _commit_file(self, version: int) -> dict:
        fs, p = self._fs(f"{self.root}/commits/{version}.json")
        stream = fs.open(p)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if found["buckets"] != self.buckets:
            raise ValueError(f"{self.root} has {found['buckets']} buckets, not {self.buckets}")
        return found

    def _publish(self, version: int, content: dict) -> None:
        jvm, name = self.spark._jvm, f"{self.root}/commits/{version}.json"
        fs, draft = self._fs(f"{self.root}/commits/.{version}-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE  # fails where the target exists
        target = jvm.org.apache.hadoop.fs.Path(name)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()) \
            if draft.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, options)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(target):
                raise CommitConflict(f"version {version} of {self.root} was published by another writer") from error
            raise

    # -- reads -------------------------------------------------------------------------------

    def owners(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> commit folder that holds its rows; buckets without rows are absent."""
        version = version or self.version()
        return {int(b): c for b, c in self._commit_file(version)["owners"].items()} if version else {}

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """Rows of a version (the newest by default), of all buckets or ``only`` of some."""
        version = version or self.version()
        if not version:
            raise LookupError(f"no commit below {self.root}")
        commit = self._commit_file(version)
        schema = T.StructType.fromJson(commit["schema"])
        wanted = None if only is None else set(only)
        paths = [f"{self.root}/data/{c}/{BUCKET}={b}" for b, c in commit["owners"].items() if wanted is None or int(b) in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # -- writes ------------------------------------------------------------------------------

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets that hold a key of ``changes``: at most ``buckets`` small numbers."""
        return sorted(r[0] for r in changes.select(self.bucket().alias(BUCKET)).distinct().collect())

    def replace(self, rows: DataFrame, only: Sequence[int] | None = None, expected: int | None = None,
                note: dict | None = None) -> int:
        """Publish ``rows`` as the new content of the buckets ``only`` (None: of all), others stay.

        ``rows`` must hold keys of these buckets only.  ``expected`` is the version the rows were made from;
        if it is no longer the newest one, ``CommitConflict`` is raised.  ``note`` is kept in the commit file.
        """
        base = self.version() if expected is None else expected
        if base != self.version():
            raise CommitConflict(f"version {self.version()} of {self.root} is current, not {base}")
        replaced = set(range(self.buckets)) if only is None else set(only)
        name = uuid.uuid4().hex
        folder = f"{self.root}/data/{name}"
        (rows.withColumn(BUCKET, self.bucket()).repartition(max(1, len(replaced)), BUCKET)
         .write.partitionBy(BUCKET).parquet(folder))
        found = {int(n.split("=")[1]) for n in self._names(folder) if n.startswith(f"{BUCKET}=")}
        if not found <= replaced:
            raise ValueError(f"rows of buckets {sorted(found - replaced)} are not among the buckets to replace")
        owners = {b: c for b, c in self.owners(base).items() if b not in replaced} | {b: name for b in found}
        notes = (self._commit_file(base).get("note") or {}) if base else {}
        self._publish(base + 1, {"buckets": self.buckets, "schema": json.loads(rows.schema.json()),
                                 "owners": {str(b): c for b, c in sorted(owners.items())}, "note": {**notes, **(note or {})}})
        return base + 1

    def note(self) -> dict:
        """What commits left under ``note``, newer entries over older ones."""
        version = self.version()
        return self._commit_file(version).get("note") or {} if version else {}

    def change(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame | None = None,
               tries: int = 5, note: dict | None = None) -> int:
        """Apply ``how(state, changes) -> state`` to the buckets that hold a changed key.

        ``how`` sees these buckets' rows only and is any of the keyed changes of ``operators.state``, whose
        result for a key depends on rows of that key alone.  ``empty`` gives the columns of a table
        without commits (default: those of ``changes``).  A change without rows publishes nothing.  On a
        conflict the change starts again from the new version, up to ``tries`` times.
        """
        only = self.touched(changes)
        if not only:
            return self.version()
        for left in reversed(range(tries)):
            base = self.version()
            current = self.read(base, only) if base else (changes if empty is None else empty).limit(0)
            try:
                return self.replace(how(current, changes), only, base, note)
            except CommitConflict:
                if not left:
                    raise

    def upsert(self, changes: DataFrame, order: Sequence[str], tries: int = 5, note: dict | None = None) -> int:
        """The newest row of a key by ``order`` stays, among stored and changed rows; repeats add nothing."""
        return self.change(changes, lambda now, new: state.keep_latest(now.unionByName(new), self.keys, order), None, tries, note)
