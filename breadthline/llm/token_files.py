"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

Documents are dealt by range of their id and sorted, and each task writes its stretch of them as
files. A file holds, little-endian:

    ids      all ids end to end, 2 bytes each (4 where the vocabulary needs it), end ids included
    ends     where each document ends, an Elias-Fano sequence
    numbers  the documents' ids less the first of them, likewise
    footer   counts, offsets of the parts, the first document's id, a mark

A document's ids lie between two selects, so a file needs no table of offsets; the document at a
position is a rank. Every attempt of a task writes files of its own name. The table of files is
written by Spark, which keeps the rows of one attempt of each task; readers follow that table, so
files of a lost executor are never read. Ids never leave the files as rows.

Texts are cut at blanks and line feeds, which this vocabulary drops, and stretches of Latin letters
from the signs behind them (`words`); each distinct part goes through the tokenizers library once in a
batch (a worker keeps what it has seen).

Rows: one per document. Null texts count as empty and are the end id alone. Null ids come first;
rows that repeat an id lie side by side in the order of their texts' checksums (equal rows in any
order). Texts of any length are whole; a stretch without blanks is encoded at once. Extra columns are
left out, an empty table gives no files and an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from breadthline.llm.common import no_collection, partitions, whole_text
from breadthline.llm.eliasfano import EliasFano
from breadthline.llm.words import Kept, ids_of_texts
from breadthline.session import land, shared_folder

MARK = b"TOKENEF1"
FOOTER = struct.Struct("<BQQQQQQq8s")
#: Texts are encoded in pieces of this many bytes; a file is closed once it has this many ids.
BATCH_BYTES = 8_000_000
FILE_IDS = 1 << 26

FILES = "part int, nth int, path string, n_docs long, n_ids long, n_bytes long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


# --- encoding -------------------------------------------------------------------------------------

#: Stretches of these signs split into runs of letters, single digits and runs of other signs,
#: whatever their case; apostrophes (short forms) and `<` (special strings) are left to the library.
PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Encoder:
    """The library's ids of texts, end id last; keeps those of stretches it has seen."""

    def __init__(self, path: str, end: int, limit: int = 500_000) -> None:
        import json

        from tokenizers import Tokenizer

        self.end, self.limit, self.kept = end, limit, {}
        self.kept_parts = Kept(lambda words: list(self._cut(words).values()), limit)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        # The same model behind a step that only maps bytes: for pre-tokens that are cut already.
        stored |= {"normalizer": None, "added_tokens": [], "post_processor": None,
                   "truncation": None, "padding": None,
                   "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False,
                                     "trim_offsets": True, "use_regex": False}}
        self.parts = Tokenizer.from_str(json.dumps(stored))
        suffix = stored["model"]["end_of_word_suffix"]
        self.closing = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        self.closing[[i for token, i in stored["model"]["vocab"].items()
                      if token.endswith(suffix)]] = True
        self.kind = np.dtype("<u2" if max(self.whole.get_vocab_size(), end + 1) <= 2**16 else "<u4")

    def _cut(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens."""
        if not words:
            return {}
        found = self.parts.encode_batch_fast([words], is_pretokenized=True,
                                             add_special_tokens=False)[0]
        ids = np.array(found.ids, dtype=self.kind)
        # The last token of every pre-token, and no other, has the mark of a word's end.
        ends = ((np.nonzero(self.closing[ids])[0] + 1) * self.kind.itemsize).tolist()
        data = ids.tobytes()
        return {w: data[a:b] for w, a, b in zip(words, [0, *ends], ends)}

    def _library(self, words: list[str]) -> dict[str, bytes]:
        found = self.whole.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(e.ids, dtype=self.kind).tobytes() for w, e in zip(words, found)}

    def stretches(self, words: list[str]) -> list[bytes]:
        """Ids of distinct stretches without blanks."""
        if len(self.kept) + len(words) > self.limit:
            self.kept = {}
        kept = self.kept
        found = list(map(kept.get, words))
        missing = [w for w, ids in zip(words, found) if ids is None]
        if not missing:
            return found
        plain = [w for w in missing if PLAIN.fullmatch(w)]
        parts = [PARTS.findall(w.lower()) for w in plain]
        known = self._library(list(set(missing).difference(plain)))
        known |= self._cut([p for p in set().union(*parts) if p not in kept])
        kept.update((w, ids) for w, ids in known.items() if len(w) <= 64)
        for word, some in zip(plain, parts):
            known[word] = ids = b"".join([known[p] if p in known else kept[p] for p in some])
            if len(word) <= 64:
                kept[word] = ids
        return [known[w] if ids is None else ids for w, ids in zip(words, found)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has, the end id included."""
        words = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        with no_collection():
            data, ends = ids_of_texts(words, self.kept_parts.of, self.stretches, lower=True)
        ends = ends // self.kind.itemsize
        ids = np.insert(np.frombuffer(data, dtype=self.kind)[:ends[-1]], ends, self.end)
        return ids, np.diff(ends, prepend=0) + 1


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


# --- files ----------------------------------------------------------------------------------------

@dataclass
class Writer:
    """One file; ids go to it as they come, boundaries and document ids when it is closed."""
    uri: str
    kind: np.dtype
    lengths: list[np.ndarray] = field(default_factory=list)
    numbers: list[np.ndarray] = field(default_factory=list)
    nulls: int = 0
    n_ids: int = 0

    def __post_init__(self) -> None:
        system, path = store(self.uri)
        self.out = system.open_output_stream(path)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.out.write(ids.tobytes())
        self.n_ids += len(ids)
        self.lengths.append(lengths)
        self.nulls += doc_ids.null_count
        self.numbers.append(doc_ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))

    def close(self) -> tuple[int, int]:
        """Number of documents, and of bytes in the file."""
        lengths = np.concatenate(self.lengths)
        numbers = np.concatenate(self.numbers)
        first = int(numbers[0]) if len(numbers) else 0
        ends = EliasFano.of(np.cumsum(lengths)).to_bytes()
        # Differences of 64-bit ids wrap around into the unsigned range, where they are right.
        names = EliasFano.of(numbers.view(np.uint64) - np.uint64(first % 2**64)).to_bytes()
        size = self.n_ids * self.kind.itemsize
        self.out.write(ends + names + FOOTER.pack(
            self.kind.itemsize, len(lengths), self.nulls, self.n_ids, size, len(ends), len(names),
            first, MARK))
        self.out.close()
        return len(lengths), size + len(ends) + len(names) + FOOTER.size


class TokenFile:
    """Reads a file: documents by index, by position, or all of them in turn."""

    def __init__(self, uri: str) -> None:
        system, path = store(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        footer = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        width, self.n_docs, self.nulls, self.n_ids, at, ends, names, self.first, mark = footer
        if mark != MARK:
            raise ValueError(f"not a token file: {uri}")
        self.kind = np.dtype(f"<u{width}")
        self.ends = EliasFano.from_bytes(self.file.read_at(ends, at))
        self.names = EliasFano.from_bytes(self.file.read_at(names, at + ends))

    def bounds(self, index: int) -> tuple[int, int]:
        """Where document `index` begins and ends among the ids of the file."""
        return self.ends.select(index - 1) if index else 0, self.ends.select(index)

    def ids(self, start: int, stop: int) -> np.ndarray:
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * width, start * width), self.kind)

    def document(self, index: int) -> np.ndarray:
        return self.ids(*self.bounds(index))

    def document_at(self, position: int) -> int:
        """Index of the document that holds the id at `position`."""
        return self.ends.rank(position + 1)

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        known = self.names.slice(max(0, start - self.nulls), max(0, stop - self.nulls))
        known = (known + np.uint64(self.first % 2**64)).view(np.int64).tolist()
        return [None] * max(0, min(stop, self.nulls) - start) + known

    def __iter__(self) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
        """Stretches of documents: where they begin, their ids, their ends, all their tokens."""
        done, start = 0, 0
        while done < self.n_docs:
            # As many documents as some 4 million ids hold, at least one.
            stop = max(done + 1, self.ends.rank(start + (1 << 22)))
            ends = self.ends.slice(done, stop).astype(np.int64)
            yield start, self.doc_ids(done, stop), ends, self.ids(start, int(ends[-1]))
            done, start = stop, int(ends[-1])

    def close(self) -> None:
        self.file.close()


# --- tables ---------------------------------------------------------------------------------------

def batches_of(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of about `size` bytes of text."""
    sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64))
    start = 0
    while start < len(sizes):
        before = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = 1,
          file_ids: int = FILE_IDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Writes the token files of `docs` to a shared folder; the table of files, `FILES`."""
    path = path or default_path()
    store(folder)[0].create_dir(store(folder)[1], recursive=True)
    text = whole_text(F.col("text"))
    order = ["doc_id", "sum", "row"]
    # The last key splits a document that is repeated very often; nothing that is written shows it.
    dealt = docs.select(
        "doc_id", text.alias("text"), F.xxhash64(text).alias("sum"),
        F.monotonically_increasing_id().alias("row"),
    ).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end)
        attempt, rows, writer, part = uuid.uuid4().hex, [], None, None

        def finish() -> None:
            n_docs, n_bytes = writer.close()
            rows.append((part, len(rows), writer.uri, n_docs, writer.n_ids, n_bytes))

        for batch in batches:
            for some in batches_of(batch, batch_bytes):
                if writer is None:
                    part = some.column("part")[0].as_py()
                    writer = Writer(f"{folder}/{part:05d}-{len(rows):04d}-{attempt}.ids", encode.kind)
                writer.add(some.column("doc_id"), *encode.encode(some.column("text")))
                if writer.n_ids >= file_ids:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if rows:
            columns = [pa.array(c, pa.string() if i == 2 else pa.int32() if i < 2 else pa.int64())
                       for i, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays(
                columns, names=["part", "nth", "path", "n_docs", "n_ids", "n_bytes"])

    return land(dealt.mapInArrow(run, FILES), "token_files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; a file is one task."""
    sizes = dict(files.groupBy("part").agg(F.sum("n_ids")).collect())  # one number a partition
    starts, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    earlier = W.Window.partitionBy("part").orderBy("nth").rowsBetween(
        W.Window.unboundedPreceding, -1)
    # An array of longs is built from one text: a plan with a literal for each partition is slow.
    begun = F.split(F.lit(",".join(map(str, starts))), ",")
    placed = files.select("path", (
        F.element_at(begun, F.col("part") + 1).cast("long")
        + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).alias("start"))
    count = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("path").to_pylist(),
                                   batch.column("start").to_pylist()):
                file = TokenFile(uri)
                for start, names, ends, ids in file:
                    begins = np.concatenate([[start], ends[:-1]])
                    data = memoryview(ids.astype("<u4").view(np.uint8))
                    sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(
                        (begins - start).tolist(), (ends - start).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64()), pa.array(begins + before),
                         pa.array(ends - begins), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
                file.close()

    return placed.repartition(count).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end: int = 1) -> DataFrame:
    """Writes `docs` as token files in the shared folder and reads them back."""
    return read(write(docs, new_folder(docs.sparkSession), path, end))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/breadthline/ids-{uuid.uuid4().hex}"
