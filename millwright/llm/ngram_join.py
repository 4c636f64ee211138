"""Operator 1: n-gram Jaccard self-join by vertical partitioning.

The order of all n-grams (their 64-bit hashes) is cut into fragments.  No task ever sees a whole
document's set against another's; each fragment is worked on by itself and the results are summed.

1. Shared n-grams.  Every document's distinct shingles are dealt to the fragments.  A fragment tells
   which of its shingles occur in two or more different sets, and how often.  Sums per set give the
   number of its shared shingles; a set of which less than the threshold is shared can link with
   nothing and is done.
2. Candidates.  The shared shingles, rarest first, are one global order.  Two linked sets have a
   shingle in common among the first ``n - ceil(t n) + 1`` of both, so sets that share such a
   shingle are put into one cluster (connected components, not pairs).
3. Partial overlaps.  Clusters are cut into blocks of bounded size and blocks into fragments; each
   block and fragment yields a matrix of partial overlaps, and the matrices of a block are summed
   per pair and tested exactly.  A block returns the number of links of its members and a forest of
   its links, never the pairs.

Equal sets are one class throughout and are identified by a 64-bit sum of their shingles.  A shingle
that very many sets of one batch hold is known to be shared there; it is announced to its fragment
once instead of being sent there from every set, so no fragment grows with a hot passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import by_block, flat, forest, paired_blocks
from .bytescan import distinct_per_row, mix, shingles, utf8
from .common import fragments_of_bytes, settled, slices, text_batches, tidy
from .components import connected_components

SLICE_BYTES = 1 << 18
FRAGMENT_BYTES = 16 << 20                        # of text, per fragment of the shingles
BATCH_SHINGLES = 500_000
HOT_IN_BATCH = 32
HOT_CLASS = 255
BLOCK_ROWS = 256
FRAGMENTS = 4
STEP = 4096

_DEALT = "kind int, cell int, doc_id long, fp long, n int, keys binary, counts binary, vals binary, hot binary"
_FOUND = "kind int, doc_id long, fp long, n int, bucket int, fps binary, counts binary, vals binary, ranks binary"
_BLOBS = ["fps", "counts", "vals", "ranks"]


def fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    """Number of the fragment of the hash order in which each value lies."""
    return ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def _fingerprints(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number per set; sets are equal if their numbers are."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)))])
    return mix((total[at[1:]] - total[at[:-1]]) ^ mix(np.diff(at).astype(np.uint64)))


def _parts(group: np.ndarray):
    """(value, first, end) of the runs of equal neighbours."""
    if len(group) == 0:
        return
    cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(group[a]), a, b


def _deal(docs: list[tuple], fragments: int) -> pa.RecordBatch:
    """Rows for the fragments from the (ids, fingerprints, values, offsets) of one batch."""
    ids = np.concatenate([d[0] for d in docs])
    fps = np.concatenate([d[1] for d in docs])
    sizes = np.concatenate([np.diff(d[3]) for d in docs])
    values = np.concatenate([d[2] for d in docs])
    out: dict[str, list] = {k: [] for k in ("kind", "cell", "doc_id", "fp", "n", "keys", "counts", "vals", "hot")}

    def row(kind, cell, doc_id=None, fp=None, n=None, keys=None, counts=None, vals=None, hot=None):
        for k, v in zip(out, (kind, cell, doc_id, fp, n, keys, counts, vals, hot)):
            out[k].append(v)

    signed = fps.view(np.int64)
    spread = (mix(ids.view(np.uint64)) % np.uint64(fragments)).astype(np.int64)
    for d, f, n, c in zip(ids.tolist(), signed.tolist(), sizes.tolist(), spread.tolist()):
        row(1, c, doc_id=d, fp=f, n=n)
    _, first = np.unique(fps, return_index=True)
    keep = np.zeros(len(fps), bool)
    keep[first] = True
    owner = np.repeat(np.arange(len(fps)), sizes)
    inside = keep[owner]
    owner, values = owner[inside], values[inside]
    order = np.argsort(values, kind="stable")
    new = np.concatenate([[True], values[order][1:] != values[order][:-1]]) if len(values) else np.zeros(0, bool)
    counts = np.diff(np.append(np.flatnonzero(new), len(values)))
    hot = np.zeros(len(values), bool)
    hot[order] = np.repeat(counts >= HOT_IN_BATCH, counts)
    marks = values[order][new][counts >= HOT_IN_BATCH]
    hot_values = values[hot]
    for o, a, b in _parts(owner[hot]):
        row(2, int(spread[o]), fp=int(signed[o]), n=b - a, vals=hot_values[a:b].tobytes())
    owner, values = owner[~hot], values[~hot]
    cell = fragment_of(values, fragments)
    order = np.argsort(cell, kind="stable")      # owners stay in order within a fragment
    owner, values, cell = owner[order], values[order], cell[order]
    mark_cell = fragment_of(marks, fragments)
    for c, a, b in _parts(cell):
        o = owner[a:b]
        begin = np.concatenate([[0], np.flatnonzero(o[1:] != o[:-1]) + 1])
        row(0, c, keys=fps[o[begin]].tobytes(), counts=np.diff(np.append(begin, len(o))).astype(np.uint32).tobytes(),
            vals=values[a:b].tobytes(), hot=marks[mark_cell == c].tobytes())
    for c in np.setdiff1d(mark_cell, cell).tolist():
        row(0, c, keys=b"", counts=b"", vals=b"", hot=marks[mark_cell == c].tobytes())
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))


def _dealer(k: int, fragments: int):
    def run(batches):
        docs, held = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                raw, at = utf8(part.column(1))
                values, offsets = distinct_per_row(*shingles(raw, at, k))
                docs.append((part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _fingerprints(values, offsets), values, offsets))
                held += len(values) + 8 * part.num_rows
                if held >= BATCH_SHINGLES:
                    yield _deal(docs, fragments)
                    docs, held = [], 0
        if docs:
            yield _deal(docs, fragments)
    return run


def _shared_in_fragment(buckets: int):
    """Documents as they come, and by bucket of sets: the shingles of this fragment that two or more
    sets hold, each with a class of how many do."""
    def work(table: pa.Table):
        kind = table.column("kind").to_numpy()
        docs = table.filter(pa.array(kind == 1))
        if docs.num_rows:
            none = [pa.nulls(docs.num_rows, pa.int32()), *[pa.nulls(docs.num_rows, pa.binary())] * 4]
            yield from pa.Table.from_arrays([docs.column(c) for c in ("kind", "doc_id", "fp", "n")] + none,
                                            ["kind", "doc_id", "fp", "n", "bucket", *_BLOBS]).to_batches()
        known = table.filter(pa.array(kind == 2))
        known_fp = np.repeat(known.column("fp").to_numpy().view(np.uint64), known.column("n").to_numpy())
        known_value = flat(known, "vals", np.uint64)
        blobs = table.filter(pa.array(kind == 0))
        read = lambda c, t: flat(blobs, c, t)
        fp, value = np.repeat(read("keys", np.uint64), read("counts", np.uint32)), read("vals", np.uint64)
        order = np.lexsort((fp, value))
        fp, value = fp[order], value[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (fp[1:] != fp[:-1])])[:len(value)]
        fp, value = fp[new], value[new]
        first = np.concatenate([[True], value[1:] != value[:-1]])[:len(value)]
        count = np.diff(np.append(np.flatnonzero(first), len(value)))
        rank = np.minimum(np.floor(8 * np.log2(count)), HOT_CLASS - 1).astype(np.uint8)
        hot = np.isin(value[first], read("hot", np.uint64))
        rank[hot] = HOT_CLASS
        use = np.repeat((count > 1) | hot, count)
        rank = np.concatenate([np.repeat(rank, count)[use], np.full(len(known_fp), HOT_CLASS, np.uint8)])
        fp, value = np.concatenate([fp[use], known_fp]), np.concatenate([value[use], known_value])
        bucket = (fp % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((fp, bucket))
        fp, value, rank, bucket = fp[order], value[order], rank[order], bucket[order]
        rows = []
        for k, a, b in _parts(bucket):
            sets = [(f, j - i) for f, i, j in _parts(fp[a:b])]
            rows.append((2, None, None, None, k, np.array([f for f, _ in sets], np.uint64).tobytes(), np.array([n for _, n in sets], np.uint32).tobytes(),
                         value[a:b].tobytes(), rank[a:b].tobytes()))
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["kind", "doc_id", "fp", "n", "bucket", *_BLOBS])
    return work


def _gather(percent: int):
    """One row per set of a bucket: its shared shingles, rarest first; sets that share too few are left out."""
    def work(table: pa.Table):
        of_class = table.filter(table.column("fps").is_null())
        blobs = table.filter(table.column("fps").is_valid())
        read = lambda c, t: flat(blobs, c, t)
        fp, value, rank = np.repeat(read("fps", np.int64), read("counts", np.uint32)), read("vals", np.uint64), read("ranks", np.uint8)
        order = np.lexsort((value, fp))
        fp, value, rank = fp[order], value[order], rank[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (fp[1:] != fp[:-1])])[:len(value)]
        fp, value, rank = fp[new], value[new], rank[new]
        sizes = dict(zip(of_class.column("fp").to_pylist(), zip(of_class.column("size").to_pylist(), of_class.column("copies").to_pylist())))
        rows = []
        for f, a, b in _parts(fp):
            n, copies = sizes[f]
            if 100 * (b - a) >= percent * n:
                by_rank = a + np.argsort(rank[a:b], kind="stable")
                rows.append((f, n, copies, value[by_rank].tobytes(), max(0, n - -(-percent * n // 100) + 1 - (n - (b - a)))))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["fp", "size", "copies", "vals", "prefix"])
    return work


def _prefix_rows(batches):
    for batch in batches:
        found = [np.frombuffer(v, np.int64)[:p] for v, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        n = [len(x) for x in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), n))], ["shingle", "fp"])


def _cut_sets(names: list[str]):
    """Cut the set of every row into the fragments of the shingle order."""
    def run(batches):
        for batch in batches:
            sets = [np.sort(np.frombuffer(v, np.uint64)) for v in batch.column(batch.schema.get_field_index("vals")).to_pylist()]
            others = [c for c in names if c != "vals"]
            for f in range(FRAGMENTS):
                low, high = (np.uint64(((x << 64) // FRAGMENTS) & ((1 << 64) - 1)) for x in (f, f + 1))
                cut = [s[np.searchsorted(s, low):(len(s) if f == FRAGMENTS - 1 else np.searchsorted(s, high))].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(cut, pa.binary()), pa.array([f] * len(cut), pa.int32())],
                    [*others, "vals", "fragment"])
    return run


def _partial_overlaps(table: pa.Table):
    """Matrix of the shingles that each pair of a block shares in one fragment."""
    order = np.argsort(table.column("fp").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    sets = [np.frombuffer(v, np.uint64) for v in table.column("vals").to_pylist()]
    m = len(sets)
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    overlap = np.zeros((m, m), np.float32)
    if len(value):
        _, column, count = np.unique(value, return_inverse=True, return_counts=True)
        shared = count > 1
        use = shared[column]
        column, owner = (np.cumsum(shared) - 1)[column][use], owner[use]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for a in range(0, int(shared.sum()), STEP):
            i, j = np.searchsorted(column, [a, a + STEP])
            has = np.zeros((m, STEP), np.float32)
            has[owner[i:j], column[i:j] - a] = 1
            overlap += has @ has.T
    raw = lambda c, t: table.column(c).to_numpy().astype(t).tobytes()
    one = lambda c: table.column(c).combine_chunks()[:1]
    yield pa.RecordBatch.from_arrays(
        [one("_block"), pa.array([raw("fp", np.int64)], pa.binary()), pa.array([raw("size", np.int64)], pa.binary()),
         pa.array([raw("copies", np.int64)], pa.binary()), pa.array([raw("_part", np.int32)], pa.binary()),
         pa.array([bool(one("_left")[0].as_py() != one("_right")[0].as_py())]), pa.array([overlap.astype(np.int32).tobytes()], pa.binary())],
        ["_block", "fps", "sizes", "copies", "parts", "crossed", "overlap"])


def _links(percent: int):
    """Sum the partial overlaps of a block and test its pairs."""
    def work(table: pa.Table):
        read = lambda c, t: np.frombuffer(table.column(c)[0].as_py(), t)
        fp, size, copies, part = read("fps", np.int64), read("sizes", np.int64), read("copies", np.int64), read("parts", np.int32)
        overlap = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column("overlap").to_pylist()).reshape(len(fp), len(fp))
        linked = 100 * overlap >= percent * (size[:, None] + size[None, :] - overlap)
        np.fill_diagonal(linked, False)
        if table.column("crossed")[0].as_py():
            linked &= part[:, None] != part[None, :]
        links = linked @ copies
        root = forest(linked)
        edge, some = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([fp[edge], fp[some]])), pa.array(np.concatenate([fp[root[edge]], fp[some]])),
             pa.array(np.concatenate([np.zeros(len(edge), np.int64), links[some]]))], ["a", "b", "links"])
    return work


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, class_id: one row per input row.

    A document's set holds its distinct ``k``-word shingles (A-Z lower-cased; with fewer words the
    whole sequence as one; without words or text it is empty and links with nothing).  Two
    documents link if 100 * |intersection| >= percent * |union|.  component_id is the smallest
    doc_id reachable by links, n_links the number of other rows linked directly, class_id the
    smallest doc_id with an equal set.  Repeated rows are documents with equal sets; rows that share
    only an id are not linked by it.  A row with null id links with nothing and has a null
    component.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    fragments = fragments_of_bytes(docs, text_col, FRAGMENT_BYTES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = rows.filter("doc_id is not null")
    dealt = named.mapInArrow(tidy(_dealer(k, fragments)), _DEALT)
    found = settled(by_block(dealt, "cell", _shared_in_fragment(fragments), _FOUND, fragments), "ngram-shared")
    members = found.filter("kind = 1").select("doc_id", "fp", "n")
    classes = settled(members.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("size"),
                                                               F.count(F.lit(1)).alias("copies")), "ngram-classes")
    none = [F.lit(None).cast("binary").alias(c) for c in _BLOBS]
    in_bucket = F.expr(f"cast(pmod(pmod(fp, {fragments}) + if(fp < 0, {2 ** 64 % fragments}, 0), {fragments}) as int)").alias("bucket")
    able = (classes.select(in_bucket, "fp", "size", "copies", *none)
            .unionByName(found.filter("kind = 2").select("bucket", F.lit(None).cast("long").alias("fp"), F.lit(None).cast("int").alias("size"),
                                                         F.lit(None).cast("long").alias("copies"), *_BLOBS)))
    sets = settled(by_block(able, "bucket", _gather(percent), "fp long, size int, copies long, vals binary, prefix int", fragments), "ngram-sets")
    prefixes = sets.select("fp", "vals", "prefix").mapInArrow(_prefix_rows, "shingle long, fp long")
    roots = prefixes.groupBy("shingle").agg(F.min("fp").alias("root"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    clusters = connected_components(prefixes.join(roots, "shingle").select("fp", "root").distinct(), "fp", "root", "ngram-clusters")
    placed = paired_blocks(sets.drop("prefix").join(clusters.withColumnRenamed("node", "fp"), "fp"), "component", "fp", BLOCK_ROWS)
    placed = placed.select("fp", "size", "copies", "vals", "_block", "_part", "_left", "_right")
    cut = placed.mapInArrow(_cut_sets(placed.columns), "fp long, size int, copies long, _block long, _part int, _left int, _right int, vals binary, fragment int")
    cut = cut.withColumn("_cell", F.xxhash64("_block", "fragment"))
    partial = by_block(cut, "_cell", _partial_overlaps, "_block long, fps binary, sizes binary, copies binary, parts binary, crossed boolean, overlap binary")
    links = settled(by_block(partial, "_block", _links(percent), "a long, b long, links long"), "ngram-links")

    direct = links.filter("links > 0").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    parts = connected_components(links.filter("links = 0"), name="ngram-components").withColumnRenamed("node", "fp")
    least = (parts.join(classes.select("fp", "class_id"), "fp").groupBy("component").agg(F.min("class_id").alias("component_id")))
    of_class = (classes.join(direct, "fp", "left").join(parts.join(least, "component").select("fp", "component_id"), "fp", "left")
                .select("fp", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component_id", "class_id").alias("component_id")))
    out = (members.join(of_class, "fp", "left")
           .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                   F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                   F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")))
    return out.unionByName(_without_id(rows.filter("doc_id is null"), k))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that reach a smaller doc_id by links; of repeated rows one stays.

    Rows without doc_id link with nothing and all stay.  Ids are taken to name documents: different
    texts under one id stay or go together.
    """
    first = ngram_jaccard_join(docs, k, percent).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    again = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
    return kept.withColumn("_again", again).filter("_again = 1").drop("_again").unionByName(docs.filter("doc_id is null"))


def _without_id(rows: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                _, offsets = distinct_per_row(*shingles(*utf8(part.column(0)), k))
                n = len(offsets) - 1
                null = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([null, pa.array(np.diff(offsets)), null, pa.array(np.zeros(n, np.int64)), null],
                                                 ["doc_id", "n_shingles", "component_id", "n_links", "class_id"])
    return rows.select("text").mapInArrow(run, "doc_id long, n_shingles long, component_id long, n_links long, class_id long")
