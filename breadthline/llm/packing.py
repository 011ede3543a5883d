"""Best-fit packing of documents into training sequences by large-item matching.

Lengths are whole numbers up to the capacity, so the packing is decided on a histogram of lengths,
which has at most `capacity` rows however many documents there are. Pieces above a third of the
capacity are matched greedily, at most two to a sequence, largest first with the largest that still
fits; smaller ones, largest first, go to the tightest gap. The outcome is a short list of layouts,
each with the number of sequences that have it. Every piece then finds its own place from its length
and its rank among the pieces of that length, without meeting the others.

Rows: one per document; null texts count as empty and are their end token alone. Longer documents
are cut from the end into full pieces, so the first may be shorter. Rows that repeat an id are
documents of their own. Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from breadthline.llm import pretokens
from breadthline.llm.common import freeing, no_collection, pieces, whole_text
from breadthline.llm.words import Kept, ids_of_texts
from breadthline.session import land

PIECES = (("doc_id", "long"), ("piece", "int"), ("start", "long"), ("length", "long"),
          ("ids_crc32", "long"), ("part", "int"), ("nth", "long"))
SIZES = {"int": pa.int32(), "long": pa.int64()}

#: A text with a gap that is not one blank or one line feed, or with none of its own signs.
ODD_GAPS = (r"^[ \n]|[ \n][ \n]|[ \n]$|^$|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

#: Ids of the pre-tokens that this Python worker has met, by tokenizer file.
_KEPT: dict[str, Kept] = {}


def _encoder(path: str) -> Kept:
    if path not in _KEPT:
        vocab = pretokens.vocabulary(path)

        def compute(wanted: list[str]) -> list[bytes]:
            symbols, left = pretokens.merge_all(vocab, [p.encode() for p in wanted])
            data = symbols.astype("<u4").tobytes()
            ends = (4 * np.cumsum(left)).tolist()
            return [data[a:b] for a, b in zip([0, *ends], ends)]

        _KEPT[path] = Kept(compute)
    return _KEPT[path]


def encode(texts: list[str], path: str, end: int = 0) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, the end token last.

    Where every gap is one blank or one line feed, texts are cut before each blank and around each
    line feed, which no pre-token crosses; others, and those with special strings, are cut into
    their pre-tokens as a whole.
    """
    vocab, kept = pretokens.vocabulary(path), _encoder(path)
    last = end.to_bytes(4, "little")

    def stretches(wanted: list[str]) -> list[bytes]:
        return kept.of_lists([pretokens.SPLITTER.findall(s) for s in wanted])

    column = pa.array(texts, pa.large_string())
    odd = pc.match_substring_regex(column, ODD_GAPS)
    for sign in vocab.special:
        odd = pc.or_(odd, pc.match_substring(column, sign))
    # "\r" stands where a text is cut; texts that have one of their own are odd.
    plain = pc.replace_substring(column.filter(pc.invert(odd)), "\n", "\r\n\r")
    cuts = pc.split_pattern(pc.replace_substring(plain, " ", "\r "), "\r")
    data, ends = ids_of_texts(cuts, kept.of, stretches)
    data, ends = memoryview(data), ends.tolist()
    found = [bytes(data[a:b]) + last for a, b in zip([0, *ends], ends)]
    at = odd.to_pylist()
    rest = _whole([t for t, is_odd in zip(texts, at) if is_odd], vocab, stretches)
    plain_ids, whole = iter(found), iter(rest)
    return [next(whole) + last if is_odd else next(plain_ids) for is_odd in at]


def _whole(texts: list[str], vocab: pretokens.Vocabulary,
           stretches: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Ids of texts of any kind."""
    special = vocab.special_pattern()
    cuts = [special.split(t) if special else [t] for t in texts]
    signs = [special.findall(t) if special else [] for t in texts]
    ids = iter(stretches([part for some in cuts for part in some]))
    found = []
    for some, between in zip(cuts, signs):
        codes = [vocab.special[s].to_bytes(4, "little") for s in between]
        found.append(b"".join(next(ids) + code for _, code in zip(some, [*codes, b""])))
    return found


def cut(docs: DataFrame, capacity: int, path: str) -> DataFrame:
    """Pieces with the partition they were made in and their number there among equal lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for part, texts in pieces(batch):
                columns: list[list] = [[] for _ in PIECES]
                with no_collection():
                    encoded = encode(texts, path)
                for doc_id, number, data in zip(part.column("doc_id").to_pylist(),
                                                part.column("part").to_pylist(), encoded):
                    total = len(data) // 4
                    first = (total - 1) % capacity + 1
                    starts = [0, *range(first, total, capacity)]
                    for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], total])):
                        length = stop - start
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        row = (doc_id, piece, start, length, zlib.crc32(data[4 * start:4 * stop]),
                               number, nth)
                        for column, value in zip(columns, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=SIZES[k]) for c, (_, k) in zip(columns, PIECES)],
                    names=[n for n, _ in PIECES])

    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"),
                       F.spark_partition_id().alias("part"))
    return rows.mapInArrow(freeing(run), ", ".join(f"{n} {k}" for n, k in PIECES))


@dataclass
class Layouts:
    """Runs of ranks of one length that go to one layout, sorted by length and first rank.

    key: length and first rank of the run. sequence: number of its first sequence. each: how many
    pieces of the length a sequence of the layout has. offset: where the first of them starts.
    """
    key: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence and offset of the pieces with these lengths and ranks."""
        at = np.searchsorted(self.key, run_key(length, rank), side="right") - 1
        within = run_key(length, rank) - self.key[at]
        return (self.sequence[at] + within // self.each[at],
                self.offset[at] + within % self.each[at] * length)


def run_key(length, rank):
    return length << 44 | rank


def match(histogram: dict[int, int], capacity: int) -> Layouts:
    """Layouts for a histogram {length: count}. Work depends on the number of lengths alone."""
    left = {length: count for length, count in histogram.items() if count > 0}
    large = sorted(length for length in left if 3 * length > capacity)
    # layouts by gap: lists of [count, ((length, times), ...)]
    open_: dict[int, list[list]] = {}

    def add(gap: int, count: int, items: tuple) -> None:
        if count:
            open_.setdefault(gap, []).append([count, items])

    while large:
        length = large[-1]
        at = bisect.bisect_right(large, capacity - length) - 1
        if at < 0:
            add(capacity - length, left[length], ((length, 1),))
            large.pop()
            continue
        partner = large[at]
        if partner == length:
            pairs, odd = divmod(left[length], 2)
            add(capacity - 2 * length, pairs, ((length, 2),))
            left[length] = odd
            if not pairs:  # one is left: with the next smaller one, or alone
                smaller = large[at - 1] if at > 0 else None
                if smaller is None:
                    add(capacity - length, 1, ((length, 1),))
                else:
                    add(capacity - length - smaller, 1, ((length, 1), (smaller, 1)))
                    left[smaller] -= 1
                left[length] = 0
        else:
            pairs = min(left[length], left[partner])
            add(capacity - length - partner, pairs, ((length, 1), (partner, 1)))
            left[length] -= pairs
            left[partner] -= pairs
        large = [x for x in large if left[x]]
    gaps = sorted(open_)
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        todo = left[length]
        while todo:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full, rest = divmod(todo, each)
                fresh = [(full, each)] + ([(1, rest)] if rest else [])
                for count, times in fresh:
                    gap = capacity - times * length
                    add(gap, count, ((length, times),))
                    if count and gap not in gaps:
                        bisect.insort(gaps, gap)
                break
            gap = gaps[at]
            count, items = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            each = gap // length
            full = min(count, todo // each)
            used = [(full, each)]
            if full < count and todo - full * each:
                used.append((1, todo - full * each))
            for number, times in used:
                if number:
                    rest = gap - times * length
                    add(rest, number, (*items, (length, times)))
                    if rest not in gaps:
                        bisect.insort(gaps, rest)
                    todo -= number * times
            spare = count - sum(number for number, _ in used)
            if spare:
                add(gap, spare, items)
                if gap not in gaps:
                    bisect.insort(gaps, gap)
    return _numbered(open_)


def _numbered(open_: dict[int, list[list]]) -> Layouts:
    runs: list[tuple[int, int, int, int]] = []
    used: dict[int, int] = {}
    sequence = 0
    for gap in sorted(open_):
        for count, items in open_[gap]:
            offset = 0
            for length, times in items:
                runs.append((run_key(length, used.get(length, 0)), sequence, times, offset))
                used[length] = used.get(length, 0) + count * times
                offset += length * times
            sequence += count
    columns = [np.array(c, dtype=np.int64) for c in zip(*sorted(runs))] or [np.zeros(0, int)] * 4
    return Layouts(*columns, sequence)


def pack(docs: DataFrame, capacity: int = 2_048, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    The pieces (numbers only, no ids) are written once; their counts by partition and length, added
    up over the partitions, give each piece its rank among its length. A length that a third of all
    pieces have is spread over the partitions like any other.
    """
    made = land(cut(docs, capacity, path or pretokens.default_path()), "pieces")
    counts = land(made.groupBy("part", "length").agg(F.count("*").alias("n")), "piece_counts")
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())  # `capacity` rows at most
    layouts = match(histogram, capacity)
    earlier = W.Window.partitionBy("length").orderBy("part").rowsBetween(
        W.Window.unboundedPreceding, -1)
    starts = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # The starts grow with the partitions: they are shuffled, never broadcast.
    ranked = made.join(starts.hint("merge"), ["part", "length"]).withColumn(
        "rank", F.col("before") + F.col("nth"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = layouts.place(batch.column("length").to_numpy(),
                                   batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *[pa.array(p, pa.int64()) for p in places]],
                names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(
        freeing(run), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                      "sequence_id long, offset long")
