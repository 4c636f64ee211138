"""Operator 10: removal of repeated byte strings by a sparse suffix array with bucket refinement.

Every byte that a string of ``LENGTH`` bytes covers is removed if that string also starts in a
document with a smaller id.  Of all suffixes only those at *anchors* are kept: the anchor of a
string is its q-gram with the least hash, so equal strings have it at the same place, and strings
that follow each other mostly share it.  A run of strings with one anchor is a *stretch*.

1. Initial q-gram buckets.  The anchors' q-grams are dealt to fragments of the hash order; a
   fragment tells which buckets hold suffixes of two or more documents.  All others are done.
2. Equal stretches.  Stretches of the remaining buckets are dealt by their q-gram, each distinct
   one once per batch and with its smallest document: every other holder is covered as a whole.
3. Refinement.  Where a bucket holds several distinct stretches, their suffixes are refined from
   buckets of 8 bytes by sorting on (own bucket, bucket of the suffix 8 bytes later), which gives
   buckets of 16 bytes; the new bucket numbers are used again for 32 and then for all ``LENGTH``
   bytes.  A string is covered if its bucket holds one of a smaller document.

Work of one batch is reduced before it is shuffled: what is found repeated inside a batch is not
sent on, so a passage that very many documents share reaches its fragment once per batch.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import by_block, flat, sizes
from .bytescan import _BASE, _BASE_INV, _VALUES, mix, powers, utf8
from .common import fragments_of_bytes, partitions, settled, slices, text_batches, tidy
from .ngram_join import _parts, fragment_of

LENGTH = 50
GRAM = 20
SLICE_BYTES = 1 << 18
FRAGMENT_BYTES = 8 << 20                         # of text, per fragment of the q-grams
BATCH_ANCHORS = 300_000
BATCH_BYTES = 4 << 20
CHUNK_BYTES = 1 << 18                            # of stretches that are compared string by string at once

_DEALT = "kind int, cell int, rid long, keys binary, counts binary, vals binary, hot binary"
_STRETCH = "kind int, cell int, rid long, keys binary, buckets binary, hashes binary, ids binary, starts binary, sizes binary, data binary"
_FOUND = "bucket int, rids binary, counts binary, first binary, second binary"


def stretches(raw: np.ndarray, at: np.ndarray, length: int, gram: int):
    """(document, q-gram hash, first byte, end byte, stretch hash) of all stretches of a batch, in order."""
    none = np.zeros(0, np.int64)
    n = len(raw)
    if n < length:
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[raw] * powers(_BASE, n), out=total[1:])
    inverse = powers(_BASE_INV, n)
    h = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    # Leftmost least hash among the q-grams of every string, by doubling.
    wide = length - gram + 1
    least, where, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < wide:
        step = min(have, wide - have)
        smaller = least[step:] < least[:-step]
        where = np.where(smaller, where[step:], where[:-step])
        least = np.where(smaller, least[step:], least[:-step])
        have += step
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts = np.flatnonzero(owner[: n - length + 1] == owner[length - 1:])
    if len(starts) == 0:
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    anchor = where[starts]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])])
    first = starts[new]
    end = np.concatenate([starts[np.flatnonzero(new)[1:] - 1], starts[-1:]]) + length
    name = mix((total[end] - total[first]) * inverse[first]) ^ mix((end - first).astype(np.uint64) * np.uint64(1 << 20) + (anchor[new] - first).astype(np.uint64))
    return owner[first], h[anchor[new]], first, end, name


def _deal(rids: np.ndarray, owner: np.ndarray, gram: np.ndarray, fragments: int):
    """Rows for the q-gram fragments: q-grams of one row of this batch, and the others as known."""
    order = np.lexsort((owner, gram))
    owner, gram = owner[order], gram[order]
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])
    owner, gram = owner[new], gram[new]
    first = np.concatenate([[True], gram[1:] != gram[:-1]])
    count = np.diff(np.append(np.flatnonzero(first), len(gram)))
    known = np.repeat(count > 1, count)
    marks = gram[first][count > 1]
    cell, mark_cell = fragment_of(gram, fragments), fragment_of(marks, fragments)
    low = (gram & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low_marks = (marks & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    rows = []
    order = np.lexsort((low, owner))
    order = order[known[order]]
    for o, a, b in _parts(owner[order]):
        i = order[a:b]
        rows.append((1, int(rids[o].view(np.uint64) % np.uint64(fragments)), int(rids[o]), None, cell[i].astype(np.int32).tobytes(), low[i].tobytes(), None))
    use = np.flatnonzero(~known)
    use = use[np.lexsort((owner[use], cell[use]))]
    starts = np.searchsorted(mark_cell, np.arange(fragments + 1))
    seen = set()
    for c, a, b in _parts(cell[use]):
        i = use[a:b]
        o = owner[i]
        begin = np.concatenate([[0], np.flatnonzero(o[1:] != o[:-1]) + 1])
        rows.append((0, c, None, rids[o[begin]].tobytes(), np.diff(np.append(begin, len(o))).astype(np.uint32).tobytes(), low[i].tobytes(),
                     low_marks[starts[c]:starts[c + 1]].tobytes()))
        seen.add(c)
    for c in np.unique(mark_cell).tolist():
        if c not in seen:
            rows.append((0, c, None, b"", b"", b"", low_marks[starts[c]:starts[c + 1]].tobytes()))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds],
                                      ["kind", "cell", "rid", "keys", "counts", "vals", "hot"])


def _grams(length: int, gram: int, fragments: int):
    def run(batches):
        rids, owners, grams, docs, held = [], [], [], 0, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                owner, h, *_ = stretches(*utf8(part.column(1)), length, gram)
                rids.append(part.column(0).to_numpy())
                owners.append(owner + docs)
                grams.append(h)
                docs += part.num_rows
                held += len(h)
                if held >= BATCH_ANCHORS:
                    yield _deal(np.concatenate(rids), np.concatenate(owners), np.concatenate(grams), fragments)
                    rids, owners, grams, docs, held = [], [], [], 0, 0
        if held:
            yield _deal(np.concatenate(rids), np.concatenate(owners), np.concatenate(grams), fragments)
    return run


def _bucket_rows(rid: np.ndarray, first: np.ndarray, second: np.ndarray, buckets: int):
    """Two values per entry, brought together by bucket of rows: one record per bucket."""
    bucket = (rid.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((rid, bucket))
    rid, first, second, bucket = rid[order], first[order], second[order], bucket[order]
    rows = []
    for k, a, b in _parts(bucket):
        runs = [(r, j - i) for r, i, j in _parts(rid[a:b])]
        rows.append((k, np.array([r for r, _ in runs], np.int64).tobytes(), np.array([n for _, n in runs], np.uint32).tobytes(),
                     first[a:b].tobytes(), second[a:b].tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))],
                                         ["bucket", "rids", "counts", "first", "second"])


def _per_row(first_type, second_type, names: list[str], merge=None):
    """One record per row of a bucket, with all of its entries."""
    def work(table: pa.Table):
        read = lambda c, t: flat(table, c, t)
        rid = np.repeat(read("rids", np.int64), read("counts", np.uint32))
        order = np.argsort(rid, kind="stable")
        rid, first, second = rid[order], read("first", first_type)[order], read("second", second_type)[order]
        rows = []
        for r, a, b in _parts(rid):
            x, y = merge(first[a:b], second[a:b]) if merge else (first[a:b], second[a:b])
            rows.append((r, x.tobytes(), y.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["rid", *names])
    return work


def _shared_grams(buckets: int):
    """Cell and low 32 bits of the q-grams that two or more rows hold, for each of these rows."""
    def work(table: pa.Table):
        kind = table.column("kind").to_numpy()
        known, blobs = (table.filter(pa.array(kind == k)) for k in (1, 0))
        read = flat
        known_low = read(known, "vals", np.uint32)
        known_rid = np.repeat(known.column("rid").to_numpy(), sizes(known, "vals", np.uint32))
        rid, low = np.repeat(read(blobs, "keys", np.int64), read(blobs, "counts", np.uint32)), read(blobs, "vals", np.uint32)
        order = np.lexsort((rid, low))
        rid, low = rid[order], low[order]
        if len(low):
            first = np.concatenate([[True], low[1:] != low[:-1]])
            distinct = np.concatenate([[True], (low[1:] != low[:-1]) | (rid[1:] != rid[:-1])]).astype(np.int64)
            rows_of = np.add.reduceat(distinct, np.flatnonzero(first))
            use = (rows_of > 1)[np.cumsum(first) - 1] | np.isin(low, read(blobs, "hot", np.uint32))
            rid, low = rid[use], low[use]
        cell = np.full(len(rid), table.column("cell")[0].as_py(), np.int32)
        yield from _bucket_rows(np.concatenate([rid, known_rid]), np.concatenate([cell, read(known, "counts", np.int32)]),
                                np.concatenate([low, known_low]), buckets)
    return work


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the spans [start, end)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _span_rows(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    order = np.argsort(owner, kind="stable")
    owner, starts, ends = owner[order], starts[order], ends[order]
    for o, a, b in _parts(owner):
        s, e = _merged(starts[a:b], ends[a:b])
        yield o, s.astype(np.int64).tobytes(), e.astype(np.int64).tobytes()


def _flush(held: list[tuple], fragments: int) -> pa.RecordBatch:
    """Stretches of a batch: those of the smallest document go to their fragment, the others are covered."""
    rid, doc, gram, start, size, name = (np.concatenate([h[i] for h in held]) for i in range(6))
    data = np.concatenate([h[6] for h in held])
    at = np.concatenate([[0], np.cumsum(size)])
    _, inverse = np.unique(name, return_inverse=True)
    least = np.full(inverse.max() + 1 if len(inverse) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, doc)
    smallest = doc == least[inverse]
    rows = [(1, int(np.int64(o).view(np.uint64) % np.uint64(fragments)), o, None, None, None, None, s, e, None)
            for o, s, e in _span_rows(rid[~smallest], start[~smallest], (start + size)[~smallest])]
    cell = fragment_of(gram, fragments)
    use = np.flatnonzero(smallest)
    use = use[np.argsort(cell[use], kind="stable")]
    for c, a, b in _parts(cell[use]):
        i = use[a:b]
        blob = np.concatenate([data[at[k]:at[k + 1]] for k in i])
        low = (gram[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows.append((0, c, None, rid[i].tobytes(), low.tobytes(), name[i].tobytes(), doc[i].tobytes(), start[i].astype(np.uint32).tobytes(),
                     size[i].astype(np.uint16).tobytes(), zlib.compress(blob.tobytes(), 1)))
    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 7)
    names = ["kind", "cell", "rid", "keys", "buckets", "hashes", "ids", "starts", "sizes", "data"]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def _stretches_of(length: int, gram: int, fragments: int, parts: int):
    """Stretches whose q-gram is shared; columns rid, doc_id, shared (list of cells and values), text."""
    def run(batches):
        held, used = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                raw, at = utf8(part.column(part.schema.get_field_index("text")))
                owner, h, first, end, name = stretches(raw, at, length, gram)
                tag = (fragment_of(h, fragments).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
                keep = np.zeros(len(h), bool)
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                cells, vals = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("cells", "vals"))
                for d in range(part.num_rows):
                    a, b = bounds[d], bounds[d + 1]
                    if a < b:
                        shared = (np.frombuffer(cells[d], np.int32).astype(np.uint64) << np.uint64(32)) | np.frombuffer(vals[d], np.uint32)
                        keep[a:b] = np.isin(tag[a:b], shared)
                if not keep.any():
                    continue
                owner, h, first, end, name = owner[keep], h[keep], first[keep], end[keep], name[keep]
                size = end - first
                shift = np.cumsum(size) - size
                data = raw[np.arange(int(size.sum())) + np.repeat(first - shift, size)]
                rid, doc = (part.column(part.schema.get_field_index(c)).to_numpy()[owner] for c in ("rid", "doc_id"))
                held.append((rid, doc, h, first - at[owner], size, name, data))
                used += len(data)
                if used >= BATCH_BYTES:
                    yield _flush(held, parts)
                    held, used = [], 0
        if held:
            yield _flush(held, parts)
    return run


def string_buckets(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket number) of every ``length``-byte string inside the rows of ``data``.

    Buckets of 8 bytes first (their value is their number); each refinement sorts suffixes by their
    bucket and the bucket of a later offset, and its numbers are the input of the next one.
    """
    end = np.repeat(at[1:], np.diff(at))
    position = np.arange(len(data))
    fits = position + 8 <= end
    grams = np.zeros(len(data), np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    for k in range(8):
        grams = (grams << np.uint64(8)) | padded[k:k + len(data)]
    number = np.zeros(len(data), np.int64)
    number[fits] = np.unique(grams[fits], return_inverse=True)[1]
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        depth += step
        fits = position + depth <= end
        at_depth = position[fits]
        pair = number[at_depth] * np.int64(len(data) + 1) + number[at_depth + step]
        number = np.zeros(len(data), np.int64)
        number[at_depth] = np.unique(pair, return_inverse=True)[1]
    return position[fits], number[fits]


def _whole_groups(items: np.ndarray, group: np.ndarray, size: np.ndarray, most: int):
    """Cut ``items``, sorted by their group, into parts of about ``most`` bytes that hold whole groups."""
    if not len(items):
        return
    new = np.flatnonzero(np.concatenate([[True], group[items[1:]] != group[items[:-1]]]))
    total = np.concatenate([[0], np.cumsum(size[items])])
    begin = 0
    for end in [*new[1:].tolist(), len(items)]:
        if total[end] - total[begin] >= most or end == len(items):
            yield items[begin:end]
            begin = end


def _covered(length: int, buckets: int):
    """Spans of the stretches of one fragment that a smaller document covers, by bucket of rows."""
    def work(table: pa.Table):
        kind = table.column("kind").to_numpy()
        known, blobs = (table.filter(pa.array(kind == k)) for k in (1, 0))
        known_starts, known_ends = (flat(known, c, np.int64) for c in ("starts", "sizes"))
        known_rid = np.repeat(known.column("rid").to_numpy(), sizes(known, "starts", np.int64))
        read = lambda c, t: flat(blobs, c, t)
        rid, bucket, name, doc, start = read("keys", np.int64), read("buckets", np.uint32), read("hashes", np.uint64), read("ids", np.int64), read("starts", np.uint32)
        start, size = start.astype(np.int64), read("sizes", np.uint16).astype(np.int64)
        data = np.empty(int(size.sum()), np.uint8)
        used = 0
        for blob in blobs.column("data"):
            piece = zlib.decompress(blob.as_buffer())
            data[used:used + len(piece)] = np.frombuffer(piece, np.uint8)
            used += len(piece)
        at = np.concatenate([[0], np.cumsum(size)])
        _, example, inverse = np.unique(name, return_index=True, return_inverse=True)
        least = np.full(len(example), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, doc)
        later = doc > least[inverse]
        spans = [(known_rid, known_starts, known_ends), (rid[later], start[later], (start + size)[later])]
        # Distinct stretches that share their q-gram with another one are compared string by string.
        _, of, count = np.unique(bucket[example], return_inverse=True, return_counts=True)
        several = np.flatnonzero(count[of] > 1)
        several = several[np.argsort(of[several], kind="stable")]
        holders = np.flatnonzero(~later)
        holders = holders[np.argsort(inverse[holders], kind="stable")]
        for chosen in _whole_groups(several, of, size[example], CHUNK_BYTES):
            rows = example[chosen]
            lengths = size[rows]
            shift = np.cumsum(lengths) - lengths
            part = data[np.arange(int(lengths.sum())) + np.repeat(at[rows] - shift, lengths)]
            bounds = np.append(shift, len(part))
            position, number = string_buckets(part, bounds, length)
            row = np.searchsorted(bounds, position, side="right") - 1
            first_doc = np.full(number.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(first_doc, number, least[chosen][row])
            hit = first_doc[number] < least[chosen][row]
            # Every holder of a stretch that is its smallest document gets the spans found for it.
            row, offset = row[hit], (position - bounds[row])[hit]
            i, j = np.searchsorted(inverse[holders], chosen[row], "left"), np.searchsorted(inverse[holders], chosen[row], "right")
            times = j - i
            entry = holders[np.repeat(i, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
            begin = start[entry] + np.repeat(offset, times)
            merged = [(o, np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for o, x, y in _span_rows(rid[entry], begin, begin + length)]
            if merged:
                spans.append((np.repeat([o for o, _, _ in merged], [len(x) for _, x, _ in merged]),
                              np.concatenate([x for _, x, _ in merged]), np.concatenate([y for _, _, y in merged])))
        owner, s, e = (np.concatenate(c) for c in zip(*spans))
        rows = [(o, np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for o, x, y in _span_rows(owner, s, e)]
        if rows:
            yield from _bucket_rows(np.repeat([o for o, _, _ in rows], [len(x) for _, x, _ in rows]), np.concatenate([x for _, x, _ in rows]),
                                    np.concatenate([y for _, _, y in rows]), buckets)
    return work


def _cut(batches):
    """Take the spans out of the texts; other columns pass through."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            raw, at = utf8(part.column(part.schema.get_field_index("text")))
            starts, ends = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("starts", "ends"))
            all_s, all_e, kept = [], [], []
            blob = raw.tobytes()
            for d, (s, e) in enumerate(zip(starts, ends)):
                text = blob[at[d]:at[d + 1]]
                if s:
                    s, e = np.frombuffer(s, np.int64), np.frombuffer(e, np.int64)
                    cuts = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
                    text = b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2]))
                    all_s.append(s.tolist())
                    all_e.append(e.tolist())
                else:
                    all_s.append([])
                    all_e.append([])
                kept.append(text)
            passed = [c for c in ("doc_id", "rid", "_carried") if c in part.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(part.schema.get_field_index(c)) for c in passed), pa.array(np.diff(at)),
                 pa.array(all_s, pa.list_(pa.int64())), pa.array(all_e, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                [*passed, "n_bytes", "starts", "ends", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, rid, n_bytes, starts, ends, kept: the removed spans (bytes, sorted, disjoint, not
    touching) and the remaining bytes of every row.

    Matches never cross documents, are judged on the input and may overlap; only a strictly smaller
    id covers, so rows that share an id never cover each other and repeated rows give equal rows.
    A row with null id covers nothing and keeps everything.  A null text is empty; texts shorter
    than ``length`` keep all; an empty table gives no rows.  ``rid`` names the pair of id and text.
    """
    if not 8 <= gram < length <= 4096:
        raise ValueError("gram must be at least 8 and less than length, length at most 4096")
    text_batches(docs.sparkSession)
    fragments = max(4 * partitions(docs.sparkSession), fragments_of_bytes(docs, text_col, FRAGMENT_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *([F.struct(*carry).alias("_carried")] if carry else []))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    columns = ["rid", "doc_id", "text", *(["_carried"] if carry else [])]
    # Both joins below read the named rows by one and the same exchange.
    named = rows.filter("doc_id is not null").select(*columns)
    dealt = named.select("rid", "text").mapInArrow(tidy(_grams(length, gram, fragments)), _DEALT)
    shared = settled(by_block(dealt, "cell", _shared_grams(fragments), _FOUND, fragments), "repeat-grams")
    shared = by_block(shared, "bucket", _per_row(np.int32, np.uint32, ["cells", "vals"]), "rid long, cells binary, vals binary", fragments)
    candidates = named.join(shared, "rid").mapInArrow(tidy(_stretches_of(length, gram, fragments, 4 * fragments)), _STRETCH)
    spans = by_block(candidates, "cell", _covered(length, fragments), _FOUND, fragments)
    spans = by_block(spans, "bucket", _per_row(np.int64, np.int64, ["starts", "ends"], _merged), "rid long, starts binary, ends binary", fragments)
    none = F.lit(None).cast("binary")
    carried = f"_carried {dict(rows.dtypes)['_carried']}, " if carry else ""
    schema = f"doc_id long, rid long, {carried}n_bytes long, starts array<long>, ends array<long>, kept binary"
    cut = named.join(spans, "rid", "left").mapInArrow(tidy(_cut), schema)
    rest = rows.filter("doc_id is null").select(*columns, none.alias("starts"), none.alias("ends")).mapInArrow(tidy(_cut), schema)
    return cut.unionByName(rest)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with their repeated spans taken out of ``text`` and ``n_chars`` counted anew.

    A character of which a span took some bytes goes too.  Documents that lose all of their text,
    white space apart, are left out; documents that lose nothing come back as they are.
    """
    def text_of(batches):
        for batch in batches:
            kept = batch.column(batch.schema.get_field_index("kept")).to_pylist()
            changed = batch.column(batch.schema.get_field_index("_changed")).to_pylist()
            texts = [k.decode("utf-8", "ignore") for k in kept]
            use = pa.array([not c or bool(t.strip()) for t, c in zip(texts, changed)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("_carried", "_changed")] + [pa.array(texts, pa.string())],
                                             ["_carried", "_changed", "_text"]).filter(use)

    others = tuple(c for c in docs.columns if c != "text") + ("_null",)
    cut = remove_repeats(docs.withColumn("_null", F.col("text").isNull()), length, gram, carry=others)
    kind = dict(cut.dtypes)["_carried"]
    rows = cut.select("_carried", (F.size("starts") > 0).alias("_changed"), "kept").mapInArrow(text_of, f"_carried {kind}, _changed boolean, _text string")
    text = F.when(F.col("_carried._null"), F.lit(None)).otherwise(F.col("_text"))
    made = {"text": text, "n_chars": F.when(F.col("_changed"), F.length("_text").cast("long")).otherwise(F.col("_carried.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(made[c] if c in made else F.col("_carried").getField(c)).cast(t).alias(c) for c, t in docs.dtypes])
