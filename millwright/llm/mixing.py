"""Operator 9: mixing sources to target weights by capped water-filling.

Every source gets a share of the words of the whole corpus in proportion to its weight.  A source
is clamped at ``max_epochs`` times its own size; the excess is shared out again by weight among
the others, until no target is above its clamp.  A target of 2.4 epochs then means two whole
repetitions of every document and a seeded sample of documents for the remaining 0.4.

The sample takes documents in the order of a seeded hash until their words reach the remainder;
the document at the crossing is taken if that comes nearer to it.  The prefix sums are made
over range chunks of the rows in order, so that a source with a third of all rows, or many rows
under one id or none, are spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import row_position, running_sums
from .common import WORD, settled


def source_targets(sizes: DataFrame, cycle: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """source, source_size, n_docs, weight, target from one row per source (source, source_size, n_docs).

    Sources are ranked by code point, null last, and weigh ``cycle`` in turn.
    """
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    ranked = row_position(sizes, [F.col("source").asc_nulls_last()], name="_rank")
    ranked = settled(ranked.withColumn("weight", F.element_at(weights, (F.col("_rank") % len(cycle) + 1).cast("int")))
                     .drop("_rank").withColumn("_cap", F.col("source_size") * max_epochs), "mix-sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # Clamp and share out again; only four sums per step come to the driver.
    clamped, rest, weight = F.lit(False), total, None
    while True:
        row = ranked.agg(F.sum(F.when(~clamped, F.col("weight"))).alias("w"),
                         F.sum(F.when(clamped, F.col("_cap"))).alias("c")).first()
        rest, weight = total - (row["c"] or 0), row["w"]
        if not weight:
            break
        above = clamped | (F.col("_cap") * F.lit(weight).cast("double") < F.lit(rest).cast("double") * F.col("weight"))
        n = ranked.agg(F.sum(F.when(above & ~clamped, 1).otherwise(0))).first()[0]
        if not n:
            break
        # Between two steps the clamped set is a bound on cap / weight, so the condition stays small.
        clamped = F.col("_cap") * F.lit(weight).cast("double") < F.lit(rest).cast("double") * F.col("weight")
    share = F.lit(rest).cast("double") * F.col("weight") / F.lit(weight or 1).cast("double")
    return ranked.select("source", "source_size", "n_docs", "weight",
                         F.when(clamped, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, cycle: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1",
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, whole, extra, copies, taken.

    ``whole`` repetitions hold for every document of the source, ``extra`` (0 or 1) is the seeded
    sample, ``copies`` their sum and ``taken`` = copies * size.  A null text has size 0; a null
    source is a source of its own; repeated rows are separate documents; a null id hashes like an
    empty string.  An empty table gives no rows.  The same rows and seed give the same mix.
    """
    return _mixed(docs, cycle, max_epochs, seed, id_col, source_col, text_col).drop("_row")


def _mixed(docs: DataFrame, cycle: Sequence[int], max_epochs: int, seed: str, id_col: str, source_col: str, text_col: str,
           row_col: str | None = None) -> DataFrame:
    """``mix_sources`` with the row's number, ``row_col`` or else one given here, as _row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
                       F.xxhash64(F.col(text_col)).alias("_text"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row"))
    rows = settled(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = settled(source_targets(sizes, cycle, max_epochs), "mix-targets")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # Rows that share an id and a size follow each other by text; the row's number lets equal rows be cut apart too.
    placed = running_sums(rows.withColumn("_key", key), ["size"], ["source", "_key", "size", "_text", "_row"])
    placed = placed.withColumn("_before", F.col("size_cum") - F.col("size"))
    starts = placed.groupBy(F.col("source").alias("_f")).agg(F.min("_before").alias("_start"))
    known = targets.join(starts, F.col("source").eqNullSafe(F.col("_f"))).drop("_f").withColumnRenamed("source", "_s")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    return (placed.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
            .withColumn("_before", F.col("_before") - F.col("_start"))
            .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
            .withColumn("extra", ((F.col("_before") * 2 + F.col("size")).cast("double") <= rest * 2).cast("long"))
            .withColumn("copies", F.least(F.col("whole") + F.col("extra"), F.lit(max_epochs)).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "whole", "extra", "copies",
                    (F.col("copies") * F.col("size")).alias("taken"), "_row"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: every row as often as its own number of copies says.

    The rows are written once with a number, so that a row keeps its copies whatever it shares with others.
    """
    rows = settled(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    given = {"cycle": (1, 2, 3), "max_epochs": 3, "seed": "mix-1", "id_col": "doc_id", "source_col": "source", "text_col": "text"} | options
    plan = _mixed(rows, row_col="_row", **given).filter("copies > 0").select("_row", F.col("copies").alias("_c"))
    return rows.join(plan, "_row").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_c").cast("int")))).select(*docs.columns)
