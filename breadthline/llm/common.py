"""What several operators share: reading, splits, ranks and ids of rows."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breadthline.session import land

#: Python workers get their rows in Arrow batches; operators cut them into pieces of this many
#: characters, so that one batch of very long texts never has to fit in numpy arrays at once.
PIECE_CHARS = 1_500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts: the fixed assignment to training and held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


@contextmanager
def no_collection() -> Iterator[None]:
    """Many small objects without cycles come and go: looking for cycles would only take time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """The rows of a batch in runs of about PIECE_CHARS characters, with their texts (null: empty).

    Only the texts of one run are Python strings at a time.
    """
    lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    start, size = 0, 0
    for stop, length in enumerate(lengths, 1):
        size += length
        if size >= PIECE_CHARS or stop == len(lengths):
            part = batch.slice(start, stop - start)
            yield part, [text or "" for text in part.column(column).to_pylist()]
            start, size = stop, 0


def give_back() -> None:
    """Memory that this process has freed but still holds goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim is not None:
        trim(0)


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow; a Python worker waits for further tasks without the memory of the last."""
    def freed(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return freed


def add_columns(docs: DataFrame, prepare: Callable[[], Callable[[list[str]], list]],
                *added: tuple[str, str]) -> DataFrame:
    """`docs` with columns computed from `text`; its own columns pass through untouched.

    `prepare` runs once in each task and gives the function from texts to one list or array for
    each added column (name, type).
    """
    schema = T.StructType([*docs.schema.fields])
    for name, kind in added:
        schema = schema.add(name, "integer" if kind == "int" else kind)
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for batch in batches:
            for part, texts in pieces(batch):
                made = [pa.array(values, type=kinds[kind])
                        for values, (_, kind) in zip(work(texts), added)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=schema.names)

    return docs.mapInArrow(freeing(run), schema)


def keep_rows(docs: DataFrame,
              prepare: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of `docs` for whose text the prepared function says so, as they came."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for batch in batches:
            for part, texts in pieces(batch):
                yield part.filter(pa.array(work(texts), type=pa.bool_()))

    return docs.mapInArrow(freeing(run), docs.schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a sieve for each key, and words of it that are put together at a time.
SIEVE_BITS, SIEVE_PART = 16, 4_096


def sieve(rows: DataFrame, *columns: str) -> Callable[..., Column]:
    """A test for other rows: columns that hold values of `rows` always pass, others about once in 100.

    With it wide rows are left out before a join moves them; what passes is still to be joined. A key
    has four bits in one of the sieve's words of 64 bits, which travel as a scalar subquery: two bytes a key.
    Nulls are values like any other.
    """
    spark = rows.sparkSession
    words = max(1, math.ceil(rows.count() * SIEVE_BITS / 64))

    def place(*values: Column | str) -> tuple[Column, Column]:
        key = F.xxhash64(*values)
        mixed = F.xxhash64(key)
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"),
                                F.pmod(F.shiftright(mixed, 6 * i), F.lit(64)).cast("int"))
                for i in range(4)]
        return (F.pmod(key, F.lit(words)).cast("int"),
                bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3]))

    at, bits = place(*columns)
    filled = rows.select(at.alias("at"), bits.alias("bits")).groupBy("at").agg(
        F.bit_or("bits").alias("word"))
    every = spark.range(words).join(filled, F.col("id") == F.col("at"), "left").select(
        F.floor(F.col("id") / SIEVE_PART).alias("part"), "id",
        F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    parts = every.groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("id", "word"))).alias("held"))
    parts = parts.select("part", F.col("held.word").alias("words"))
    whole = parts.agg(F.sort_array(F.collect_list(F.struct("part", "words"))).alias("held"))
    held = land(whole.select(F.flatten(F.col("held.words")).alias("words")), "sieve")

    def passes(*values: Column | str) -> Column:
        at, bits = place(*values)
        return F.get(held.scalar(), at).bitwiseAND(bits) == bits

    return passes


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `place`, the row's position (from 0) in the total order of the columns `order`.

    Rows are dealt by range and sorted in their partition; the written table fixes each row's
    partition and its number in it, so a lost executor cannot change a rank. Only one count per
    partition goes to the driver. A hot value of the first column is split by the later ones.
    """
    spark = rows.sparkSession
    count = partitions(spark)
    dealt = (
        rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    dealt = land(dealt, name)
    sizes = dict(dealt.groupBy("_part").count().collect())
    starts, total = [], 0
    for part in range(count):
        starts.append(total)
        total += sizes.get(part, 0)
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_part") + 1)
    return dealt.withColumn("place", start + F.col("_seq")).drop("_part", "_seq")
