"""Operator 8: near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the
nearest of the signed axes.  ``hashes`` of them make a bucket of a table, and every vector also
probes the bucket(s) it came closest to after its own.  Vectors that share a bucket and a label
are compared by cosine in double precision, so no link below the threshold is reported.

Exact copies are first reduced to one representative with a count.  Buckets are compared in blocks
(``blocks.paired_blocks``); a block gives the number of links of each member, counted only in the
first bucket a pair shares, and a forest of its links, never the pairs themselves.  No bucket is
capped.  ``hashes`` follows the largest label, so that buckets stay small as the table grows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import by_block, forest, paired_blocks
from .common import partitions, settled
from .components import connected_components

BLOCK_ROWS = 512
BUCKET_GOAL = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two wide), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def bucket_codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 8) -> np.ndarray:
    """(rows, tables, probes) bucket numbers; the first probe is the row's own bucket."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    y = np.zeros((n, wide))
    y[:, :d] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((n, tables, probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        first, second, loss = [], [], []
        for _ in range(hashes):
            z = y
            for _ in range(3):
                z = hadamard(z * rng.choice([-1.0, 1.0], wide))
            order = np.argsort(-np.abs(z), axis=1, kind="stable")[:, :max(2, probes)]
            top = np.take_along_axis(z, order, 1)
            code = order * 2 + (top < 0)
            first.append(code[:, 0])
            second.append(code[:, 1:])
            loss.append(np.abs(top[:, :1]) - np.abs(top[:, 1:]))
        base = np.zeros(n, np.int64)
        for code in first:
            base = base * (2 * wide) + code
        out[:, t, 0] = base
        # Other probes change one hash, the one that gives up least.
        gaps = np.concatenate(loss, axis=1)
        best = np.argsort(gaps, axis=1, kind="stable")[:, :probes - 1]
        width = second[0].shape[1]
        for j in range(best.shape[1]):
            which, step = best[:, j] // width, best[:, j] % width
            changed = base.copy()
            for i in range(hashes):
                weight = (2 * wide) ** (hashes - 1 - i)
                hit = which == i
                changed[hit] += (second[i][rows[hit], step[hit]] - first[i][hit]) * weight
            out[:, t, 1 + j] = changed
    return out


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vector: Column, label: Column | None = None) -> Column:
    """A vector that has a direction: not null, no null or non-finite component, not all zero."""
    ok = (vector.isNotNull() & (F.size(vector) > 0)
          & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
          & F.exists(vector, lambda x: x != 0))
    ok = F.coalesce(ok, F.lit(False))
    return ok & label.isNotNull() if label is not None else ok


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.93, tables: int = 8, probes: int = 2, hashes: int | None = None,
                           id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Two vectors link if their labels are equal and their cosine is at least ``threshold``.  Vectors
    that are null, zero or hold null or non-finite components, and vectors without label, link with
    nothing and are kept.  Repeated rows (same id, label and vector) are one vector and give equal
    rows.  Vectors of different length never link.  An empty table gives no rows.
    """
    v = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    v = v.withColumn("_ok", usable(F.col("embedding"), F.col("label"))).withColumn("_h1", F.xxhash64("embedding")).withColumn("_h2", F.hash("embedding"))
    good = v.filter("_ok and vec_id is not null")
    same = ["label", "_h1", "_h2"]
    classes = settled(good.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"),
                                              F.first("embedding").alias("embedding")), "vector-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    width = classes.agg(F.max(F.size("embedding"))).first()[0] or 2
    wide = 1 << max(1, (width - 1).bit_length())
    k = hashes or max(1, math.ceil(math.log(max(most / BUCKET_GOAL, 1)) / math.log(2 * wide)))
    n_tables = tables * k

    def hash_rows(batches):
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                codes = bucket_codes(_vectors(part.column(3)), n_tables, k, probes)
                n = part.num_rows
                row = pa.array(np.repeat(np.arange(n), n_tables * probes))
                table = np.tile(np.repeat(np.arange(n_tables), probes), n)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(row) for i in range(4)), pa.array(table.astype(np.int32)), pa.array(codes.reshape(-1))],
                    ["rep", "copies", "label", "embedding", "table", "code"])

    kinds = dict(classes.dtypes)
    hashed = classes.select("rep", "copies", "label", "embedding").mapInArrow(
        hash_rows, f"rep {kinds['rep']}, copies long, label {kinds['label']}, embedding {kinds['embedding']}, table int, code long")
    dealt = paired_blocks(hashed.withColumn("_group", F.xxhash64("label", "table", "code", F.size("embedding"))), "_group", "rep", BLOCK_ROWS)

    def compare(block: pa.Table):
        at = {c: block.column(c).to_numpy() for c in ("rep", "copies", "table", "code", "_part", "_left", "_right", "_group")}
        x = _vectors(block.column("embedding"))
        if len(x) < 2:
            return
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        if at["_left"][0] != at["_right"][0]:
            linked &= at["_part"][:, None] != at["_part"][None, :]
        if linked.any():
            # Count a pair only in the first bucket that it shares.
            i, j = np.nonzero(linked)
            use = np.unique(i)
            codes = np.zeros((len(x), n_tables, probes), np.int64)
            codes[use] = bucket_codes(x[use], n_tables, k, probes)
            t, code = int(at["table"][0]), int(at["code"][0])
            counted = np.ones(len(i), bool)
            for table in range(t + 1):
                for p in range(probes):
                    for q in range(probes):
                        shared = codes[i, table, p] == codes[j, table, q]
                        if table == t:
                            shared &= codes[i, table, p] < code
                        counted &= ~shared
            links = np.zeros(len(x), np.int64)
            np.add.at(links, i[counted], at["copies"][j[counted]])
            root = forest(linked)
            edge = np.flatnonzero(root != np.arange(len(root)))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([at["rep"][edge], at["rep"][some]])),
                 pa.array(np.concatenate([at["rep"][root[edge]], at["rep"][some]])),
                 pa.array(np.concatenate([np.zeros(len(edge), np.int64), links[some]]))], ["a", "b", "links"])

    found = settled(by_block(dealt, "_block", compare, f"a {kinds['rep']}, b {kinds['rep']}, links long"), "vector-links")
    links = found.filter("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("links = 0"), name="vector-components").withColumnRenamed("node", "rep")
    members = (classes.drop("embedding").join(links, "rep", "left").join(parts, "rep", "left")
               .select(*[F.col(c).alias(f"_{c}") for c in same], (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    match = F.col("_ok") & (F.col("label") == F.col("_label")) & (F.col("_h1") == F.col("__h1")) & (F.col("_h2") == F.col("__h2"))
    return (v.drop("embedding").join(members, match, "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
