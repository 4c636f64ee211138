"""Operator 3: packing documents into fixed-length training sequences.

Documents become token ids (a public BPE vocabulary) closed by one separator id.  A document
longer than a sequence is cut every ``size`` ids; all pieces go through shortest-pack-first over
the histogram of their lengths: lengths are placed longest first, each into the pattern with the
most room, and only pattern counts are updated, so the plan costs the same for a thousand or a
billion pieces.  Patterns are then joined back to pieces by rank within their length.

The histogram has at most ``size`` rows and the plan a few patterns per length; both are bounded
by the sequence length, not by the corpus, and only these two come to the driver.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import chunks, utf8
from .common import settled, slices, text_batches, tidy, worker_cache

SEPARATOR = 2
RANK_ROWS = 1024
CACHE_WORDS = 700_000
CACHE_PIECES = 200_000
SLICE_BYTES = 1 << 20


class WordEncoder:
    """Ids of whole texts through a cache of white-space separated words.

    The vocabulary's pre-tokenizer never joins text across ASCII white space and drops the white
    space, so the ids of a text are those of its words one after the other.  A word of common
    Latin characters is lower-cased, split and looked up piece by piece (its pieces are shared by
    many words); any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in made["normalizer"]["normalizers"]] + [x["type"] for x in made["pre_tokenizer"]["pretokenizers"]]
        split = made["pre_tokenizer"]["pretokenizers"][0]
        self.split = None
        if steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and split["invert"] and split["behavior"] == "Removed":
            self.split = regex.compile(split["pattern"]["Regex"]).findall
        self.plain = regex.compile(r"[!-~\u00A1-\u00AC\u00AE-\u012F\u0131-\u017F]+").fullmatch
        self.model = self.tokenizer.model
        self.special = [t["content"] for t in made["added_tokens"]]
        # The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(0x100, 0x200))
        self.alphabet = {b: chr(b) if b in set(shown) else chr(next(others)) for b in range(256)}
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.pieces: dict[str, list[int]] = {}

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each document."""
        h, start, end, first = chunks(raw, at)
        if len(h) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        unique, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == unique[inside]
        if not known.all():
            if len(self.keys) > CACHE_WORDS:
                self.clear()
                slot[:], known[:] = 0, False
            self._learn(raw, slot[~known], unique[~known], start[where[~known]], end[where[~known]])
            slot = np.searchsorted(self.keys, unique)
        at_word, n_word = self.at[slot][inverse], self.n[slot][inverse]
        ends = np.cumsum(n_word)
        total = int(ends[-1])
        ids = self.ids[np.arange(total) + np.repeat(at_word - (ends - n_word), n_word)]
        return ids, np.diff(np.concatenate([[0], ends])[first])

    def word_ids(self, word: str) -> list[int]:
        if self.split is None or not self.plain(word) or ("<" in word and any(x in word for x in self.special)):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        pieces = self.split(word.lower())
        if len(pieces) == 1:
            return self.piece_ids(pieces[0])
        out: list[int] = []
        for piece in pieces:
            out += self.pieces.get(piece) or self.piece_ids(piece)
        return out

    def piece_ids(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > CACHE_PIECES:
                self.pieces.clear()
            shown = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
            ids = self.pieces[piece] = [t.id for t in self.model.tokenize(shown)]
        return ids

    def _learn(self, raw, slot, keys, start, end) -> None:
        blob = raw.tobytes()
        found = [self.word_ids(blob[a:b].decode("utf-8")) for a, b in zip(start.tolist(), end.tolist())]
        n = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.ids) + np.cumsum(n) - n
        self.keys, self.at, self.n = np.insert(self.keys, slot, keys), np.insert(self.at, slot, at), np.insert(self.n, slot, n)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))])


def encoder(path: str) -> WordEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    cache = worker_cache("word-encoders")
    if path not in cache:
        cache[path] = WordEncoder(path)
    return cache[path]


PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Cut every document's ids (its separator included) into pieces of at most ``size``.

    Returns doc_id, start, length, ids_crc32, doc_tokens and, with ``keep_ids``, the ids themselves.
    A null or empty text has the separator as its only id.
    """
    schema = PIECE + (", ids array<int>" if keep_ids else "")
    text_batches(docs.sparkSession)

    def cut(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                raw, at = utf8(part.column(1))
                ids, n = enc.encode(raw, at)
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, SEPARATOR).astype("<u4")
                n = n + 1
                begin = np.cumsum(n) - n
                pieces = -(-n // size)
                row = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(n[row] - start, size)
                a = begin[row] + start
                crc = [zlib.crc32(ids[i:i + k].tobytes()) for i, k in zip(a.tolist(), length.tolist())]
                out = [part.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                       pa.array(crc, pa.int64()), pa.array(n[row], pa.int64())]
                if keep_ids:  # pieces lie one after the other, document after document
                    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4"))))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
                yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(cut), schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, [(length, how many of it)]) patterns that use up the histogram.

    Lengths go longest first, each into the open pattern with the most room; where none has room,
    new packs get as many of the length as they hold.
    """
    open_by_room: dict[int, list] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            room = max((r for r, p in open_by_room.items() if p and r >= length), default=0)
            if not room:
                per = size // length
                full, rest = divmod(left, per)
                if full:
                    open_by_room[size - per * length].append((full, [(length, per)]))
                if rest:
                    open_by_room[size - rest * length].append((1, [(length, rest)]))
                break
            count, pattern = open_by_room[room].pop()
            # Even out: put one into each pack of the pattern, or fill single packs where few are left.
            used = min(count, left)
            if used < count:
                open_by_room[room].append((count - used, pattern))
            last = pattern[-1]
            grown = pattern[:-1] + [(length, last[1] + 1)] if last[0] == length else pattern + [(length, 1)]
            open_by_room[room - length].append((used, grown))
            left -= used
    return [(c, p) for room in sorted(open_by_room) for c, p in open_by_room[room]]


def place_pieces(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """Add sequence_id, offset and sequence_tokens to every piece (columns ``length`` and ``doc_id``, ``start``)."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}
    patterns = shortest_pack_first(histogram, size)
    slots, used, base = [], defaultdict(int), 0
    for count, pattern in patterns:
        offset, tokens = 0, sum(k * m for k, m in pattern)
        for length, many in pattern:
            slots.append((length, used[length], base, many, offset, tokens))
            used[length] += count * many
            offset += length * many
        base += count
    slots = np.array(sorted(slots), np.int64).reshape(-1, 6)
    keys = slots[:, 0] << 44 | slots[:, 1]

    salted = (pieces.join(F.broadcast(counts.withColumn("_salts", F.ceil(F.col("n") / RANK_ROWS)).drop("n")), "length")
              .withColumn("_salt", F.expr("pmod(xxhash64(doc_id, start), _salts)")).drop("_salts"))
    sums = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", *[c for c in ("ids_crc32",) if c in pieces.columns])
    ranked = (salted.join(sums, ["length", "_salt"])
              .withColumn("_rank", F.col("_first") + F.row_number().over(order) - 1).drop("_first", "_salt"))

    def locate(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            step = rank - slots[i, 1]
            sequence, offset = slots[i, 2] + step // slots[i, 3], slots[i, 4] + length * (step % slots[i, 3])
            keep = [k for k in range(batch.num_columns) if batch.schema.names[k] != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [pa.array(sequence), pa.array(offset), pa.array(slots[i, 5])],
                [batch.schema.names[k] for k in keep] + ["sequence_id", "offset", "sequence_tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "_rank")
    return ranked.mapInArrow(tidy(locate), schema + ", sequence_id long, offset long, sequence_tokens long")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 4096, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset,
    sequence_tokens, padded_length.

    Every id of every document lies in exactly one piece; the pieces of a sequence lie gapless from
    offset 0.  ``padded_length`` is ``size``, except that a sequence whose tokens are a power of
    two needs no padding.  Repeated rows are packed separately, a null id sorts first, a null text
    is empty, an empty table gives no rows.
    """
    pieces = settled(token_pieces(docs, tokenizer_path, size, id_col, text_col, keep_ids), "pieces")
    tokens = F.col("sequence_tokens")
    power = tokens.bitwiseAND(tokens - 1) == 0
    return place_pieces(pieces, size).withColumn("padded_length", F.when(power, tokens).otherwise(F.lit(size)))
