"""Shards that all have the corpus' mixture of sources, by proportional stratified interleaving.

Rows of each source are shuffled with a seed and ranked; the row of rank r of n stands at the
fraction (r + 1/2) / n of its source. In the order of these fractions every stretch holds each
source in proportion, so the order is cut into shards whose row counts differ by one at most.

Rows: one per document. Null texts have no bytes and the checksum of nothing; a null source is a
source of its own. Repeated rows are rows of their own (ties go by checksum, then arbitrarily
between equal rows). Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from breadthline.llm.common import ranked, whole_text
from breadthline.session import land


def shards(docs: DataFrame, count: int = 40, seed: int = 17, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The text is read once; ranks move rows of a few numbers. Both ranks are taken over ranges of
    the order, so neither a source with a third of all rows nor the whole order meets in one task.
    """
    text = whole_text(F.col("text")).cast("binary")
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("shuffle"),
    )
    shuffled = land(
        ranked(rows, ["source", "shuffle", "doc_id", "text_crc32"], "shuffled"), "within_source")
    sources = shuffled.groupBy("source").agg(
        F.min("place").alias("first"), F.count("*").alias("rows"))
    placed = shuffled.join(sources, "source").withColumn(
        "fraction", (F.col("place") - F.col("first") + F.lit(0.5)) / F.col("rows"))
    mixed = ranked(
        placed.select("fraction", "source", "shuffle", "doc_id", "size", "text_crc32",
                      F.col("place").alias("tie")),
        ["fraction", "source", "tie"], "mixed")
    total = shuffled.count()
    # The first total % count shards have one row more.
    few, more = divmod(total, count)
    cut = more * (few + 1)
    place = F.col("place")
    shard = F.when(place < cut, F.floor(place / (few + 1))).otherwise(
        more + F.floor((place - cut) / max(few, 1))).cast("int")
    start = F.when(place < cut, F.floor(place / (few + 1)) * (few + 1)).otherwise(
        cut + F.floor((place - cut) / max(few, 1)) * max(few, 1))
    return mixed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
        (place - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def mixture(sharded: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of each source in each shard, for reports."""
    rows = sharded.join(docs.select("doc_id", "source"), "doc_id")
    counts = rows.groupBy("shard", "source").agg(F.count("*").alias("rows"))
    whole = F.sum("rows").over(W.Window.partitionBy("shard"))
    return counts.withColumn("share", F.col("rows") / whole)
