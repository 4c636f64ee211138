"""Operator 7: token counts as rollups that signed deltas maintain.

A batch of changes (inserts, deletes, revised counts) is summed to one signed row per source,
language and tokenizer version before it is stored; totals are the sum of the stored batches.  A
batch is stored under its id, and the writer's success mark in its folder is its commit: applying
a committed id again changes nothing, and a folder left by a failed attempt is written anew.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import _word_bounds, utf8
from .common import settled, slices, worker_cache

KEYS = ["source", "lang", "tokenizer_version"]
SLICE_BYTES = 4 << 20


class TokenRollup:
    """Totals of documents and tokens by source, language and tokenizer version, below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self, folder: str) -> bool:
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def batches(self) -> list[str]:
        """Folders of the committed batches."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [f"{self.path}/{s.getPath().getName()}" for s in fs.listStatus(root)]
        return sorted(f for f in found if self._committed(f))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Store one batch; False (and nothing changed) if its id is committed already.

        ``changes``: source, lang, tokenizer_version, old_tokens, new_tokens.  No old count means
        an insert, no new count a delete, both a revised count, neither is ignored.
        """
        folder = f"{self.path}/{batch_id}"
        if self._committed(folder):
            return False
        had, has = F.col("old_tokens").isNotNull(), F.col("new_tokens").isNotNull()
        deltas = (changes.filter(had | has).groupBy(*KEYS)
                  .agg(F.sum(has.cast("long") - had.cast("long")).alias("n_docs"),
                       F.sum(F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).cast("long").alias("n_tokens")))
        deltas.write.mode("overwrite").parquet(folder)
        return True

    def totals(self) -> DataFrame:
        """One row per key that any batch touched; keys whose documents are all gone stay with zeros."""
        schema = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
        folders = self.batches()
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def byte_bpe(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts by a public byte-level vocabulary given as ranks."""
    cache = worker_cache("byte-bpe")
    if path not in cache:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = cache[path].encode_ordinary
    return lambda texts: [len(encode(t)) for t in texts]


def white_space_words(texts: list[str]) -> list[int]:
    raw, at = utf8(pa.array(texts, pa.string()))
    return np.diff(_word_bounds(raw, at)[2]).tolist()


def without_repeated_lines(text: str) -> str:
    """The text with every later copy of one of its lines taken out."""
    lines = text.split("\n")
    return "\n".join(dict.fromkeys(lines)) if len(set(lines)) < len(lines) else text


def token_ledger(docs: DataFrame, vocabulary_path: str, revise: Callable[[str], str] = without_repeated_lines,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, digest, tokenizer_version, n_tokens, revised_tokens per document and version.

    ``revised_tokens`` is null where ``revise`` leaves the text as it is; a null text is empty.
    """
    def count(batches):
        versions = {"byte_bpe_50k": byte_bpe(vocabulary_path), "words": white_space_words}
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = [t or "" for t in part.column(4).to_pylist()]
                new = [revise(t) for t in texts]
                changed = [i for i, (a, b) in enumerate(zip(texts, new)) if a != b]
                for name, counter in versions.items():
                    revised: list[int | None] = [None] * len(texts)
                    for i, n in zip(changed, counter([new[i] for i in changed])):
                        revised[i] = n
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k) for k in range(4)), pa.array([name] * len(texts), pa.string()),
                         pa.array(counter(texts), pa.int64()), pa.array(revised, pa.int64())],
                        ["doc_id", "source", "lang", "digest", "tokenizer_version", "n_tokens", "revised_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), "source", "lang", F.md5(text).alias("digest"), text.alias("text"))
    kind = dict(rows.dtypes)
    return rows.mapInArrow(count, f"doc_id {kind['doc_id']}, source {kind['source']}, lang {kind['lang']}, digest string, "
                                  "tokenizer_version string, n_tokens long, revised_tokens long")


def maintain_token_counts(docs: DataFrame, vocabulary_path: str, rollup: TokenRollup) -> DataFrame:
    """Three batches over all documents, then the totals.

    insert: every document; revise: documents that lose repeated lines; delete: exact copies of a
    document with a smaller id.  Rows that share text and id are kept; a null id is never smaller.
    """
    ledger = settled(token_ledger(docs, vocabulary_path), "token-ledger")
    keys = [F.col(k) for k in KEYS]
    none = F.lit(None).cast("long")
    rollup.apply("batch-1-insert", ledger.select(*keys, none.alias("old_tokens"), F.col("n_tokens").alias("new_tokens")))
    rollup.apply("batch-2-revise", ledger.filter("revised_tokens is not null")
                 .select(*keys, F.col("n_tokens").alias("old_tokens"), F.col("revised_tokens").alias("new_tokens")))
    first = ledger.groupBy("digest").agg(F.min("doc_id").alias("_first"))
    copies = ledger.join(first, "digest").filter("doc_id > _first")
    rollup.apply("batch-3-delete", copies.select(*keys, F.coalesce("revised_tokens", "n_tokens").alias("old_tokens"), none.alias("new_tokens")))
    return rollup.totals()
