"""How two tokenizers cut the same texts, by interval coalescing.

A token covers a range of a text's bytes. All tokens of both sides are sorted by where they start;
the running maximum of their ends says how far the tokens so far reach, and a group breaks where a
token starts at that point: there both sides have a border. Within a group every token of one side
is linked with the tokens of the other whose ranges overlap its own.

Neither vocabulary has a token that goes on from a letter or sign into a blank or a line feed. So
there both sides always have a border, texts are cut there into stretches, and a block of documents
aligns each distinct stretch once; documents are lists of stretches. What a pair of ids counts
(documents of the corpus that hold it linked) comes from the blocks: a block emits each of its pairs
once, with the number of its documents that hold it; these rows are summed, joined with the sums
and go back to their block, whose documents add them up over their stretches. So rows of documents
and links never meet in a shuffle, and a pair that all documents hold has one row for each block.

Rows: one per document. Null and empty texts, and texts that the tokens of a side do not give back
(a sign that the other side's pieces use for a blank), have no tokens: zeros and no digest. Repeated
rows and ids count as documents of their own; null ids stay. A text is aligned as a whole, however
long, and a text longer than a block is a block of its own. Extra columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breadthline.llm.common import whole_text
from breadthline.llm.pretokens import SPLITTER, byte_alphabet
from breadthline.session import land

#: A block ends once its texts have this many characters.
BLOCK_CHARS = 4_000_000
#: Stretches in one call of the libraries, whose answers take far more room than the ids.
CALL = 16_384
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: What an unusual text has: any white space beside single blanks and line feeds within it.
ODD = (r"^[ \n]|[ \n]\z|[ \n][ \n]|[\t\x{0b}-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
       r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
FACTS = ("n_a", "n_b", "n_groups", "n_links")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("piece_bpe_32k.model"))


# --- one side's tokens ----------------------------------------------------------------------------

class Sides:
    """Ids of stretches by both tokenizers, and the bytes of every id.

    A stretch begins with a blank or a line feed. `of` gives the ids of both sides, or None where
    their bytes are not the stretch.
    """

    def __init__(self, a: str, b: str, limit: int = 500_000, longest: int = 64) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        # The same model behind a step that only maps bytes: it gets pre-tokens, in which the strings
        # of special tokens are plain text.
        with open(a, encoding="utf-8") as file:
            stored = json.load(file)
        stored |= {"normalizer": None, "added_tokens": [], "post_processor": None,
                   "truncation": None, "padding": None,
                   "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False,
                                     "trim_offsets": True, "use_regex": False}}
        self.a = Tokenizer.from_str(json.dumps(stored))
        self.parts: dict[str, bytes] = {}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        back = {sign: byte for byte, sign in byte_alphabet().items()}
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(back.get(sign, 63) for sign in self.a.id_to_token(i) or "")
                        for i in range(size)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        self.blank = self.b.piece_to_id("▁")
        if any("▁" in p.lstrip("▁") or "\n" in p
               for p in map(self.b.id_to_piece, range(self.b.get_piece_size()))):
            raise ValueError(f"{b} has pieces that go on into the next word")
        self.limit, self.longest = limit, longest
        self.kept: dict[str, tuple[list, list] | None] = {}

    def _piece(self, number: int) -> bytes:
        if self.b.is_byte(number):
            return bytes([int(self.b.id_to_piece(number)[3:5], 16)])
        return self.b.id_to_piece(number).replace("▁", " ").encode()

    def of(self, stretches: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides as unsigned 32-bit numbers."""
        if len(self.kept) + len(stretches) > self.limit:
            self.kept = {}
        kept = self.kept
        missing = [s for s in stretches if s not in kept]
        if not missing:
            return [kept[s] for s in stretches]
        fresh = {}
        for start in range(0, len(missing), CALL):
            fresh |= self._both(missing[start:start + CALL])
        kept.update((s, x) for s, x in fresh.items() if len(s) <= self.longest)
        return [fresh[s] if s in fresh else kept[s] for s in stretches]

    def _both(self, stretches: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        data = [s.encode() for s in stretches]
        left = self._left(stretches)
        # This side puts a blank before what it encodes: it takes the place of the first one, and is
        # taken off before a line feed, which no piece joins with anything.
        right = self.b.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        for at, stretch in enumerate(stretches):
            if stretch == " ":
                right[at] = [self.blank]
            elif stretch[0] == "\n":
                right[at] = right[at][1:]
        flat = np.fromiter(chain.from_iterable(right), np.uint32)
        raw = flat.tobytes()
        cuts = (4 * np.cumsum(np.fromiter(map(len, right), np.int64, len(right)))).tolist()
        pairs = list(zip(left, [raw[x:y] for x, y in zip([0, *cuts], cuts)]))
        if not (self._give_back(self.a_bytes, self.a_sizes, [x for x, _ in pairs], data)
                and self._give_back(self.b_bytes, self.b_sizes, [y for _, y in pairs], data)):
            pairs = [both if self._give_back(self.a_bytes, self.a_sizes, both[:1], [whole])
                     and self._give_back(self.b_bytes, self.b_sizes, both[1:], [whole]) else None
                     for both, whole in zip(pairs, data)]
        return dict(zip(stretches, pairs))

    def _left(self, stretches: list[str]) -> list[bytes]:
        """Ids of side a; each distinct pre-token is merged once."""
        parts = [SPLITTER.findall(s) for s in stretches]
        if len(self.parts) > self.limit:
            self.parts = {}
        wanted = [p for p in set().union(*parts) if p not in self.parts]
        known = self.parts
        if wanted:
            ids = np.array(self.a.encode_batch_fast(
                [wanted], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.uint32)
            # Tokens cover the bytes of the pre-tokens without a gap, so these tell where each ends.
            sizes = np.array([len(p.encode()) for p in wanted])
            ends = np.searchsorted(np.cumsum(self.a_sizes[ids]), np.cumsum(sizes)) + 1
            raw, cuts = ids.tobytes(), (4 * ends).tolist()
            found = {p: raw[x:y] for p, x, y in zip(wanted, [0, *cuts], cuts)}
            self.parts.update((p, x) for p, x in found.items() if len(p) <= self.longest)
            known = self.parts if max(map(len, wanted)) <= self.longest else self.parts | found
        return [b"".join(map(known.__getitem__, some)) for some in parts]

    @staticmethod
    def _give_back(table: list[bytes], sizes: np.ndarray, ids: list[bytes],
                   data: list[bytes]) -> bool:
        """Whether the ids' bytes are the data, each of its own."""
        flat = np.frombuffer(b"".join(ids), np.uint32)
        reach = np.concatenate([[0], np.cumsum(sizes[flat])])
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        return (np.diff(reach[ends], prepend=0) == list(map(len, data))).all() and (
            b"".join(map(table.__getitem__, flat.tolist())) == b"".join(data))


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> Sides:
    return Sides(a, b)


def cut(texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, list[str]]:
    """Texts, each with a blank before it, in stretches that begin where both sides have a border:
    the order in which the texts come, how many stretches each has, which they are, and all
    distinct ones."""
    rows = pa.array(texts, pa.string())
    odd = np.asarray(pc.match_substring_regex(rows, ODD))
    plain = np.nonzero(~odd & (np.asarray(pc.binary_length(rows)) > 0))[0]
    # The usual text has one blank or line feed between its words: it is cut before each.
    words = pc.split_pattern(pc.replace_substring(rows.take(pa.array(plain)), "\n", " \n"), " ")
    coded = words.flatten().dictionary_encode()
    stretches = [w if w[:1] == "\n" else " " + w for w in coded.dictionary.to_pylist()]
    number = {s: i for i, s in enumerate(stretches)}
    order = plain.tolist()
    counts = [np.asarray(pc.list_value_length(words), dtype=np.int64)]
    which = [np.asarray(coded.indices, dtype=np.int64)]
    for at, text in enumerate(texts):
        if not text or odd[at]:
            some = [number.setdefault(s, len(number)) for s in CUT.split(" " + text)] if text else []
            order.append(at)
            counts.append(np.array([len(some)], dtype=np.int64))
            which.append(np.array(some, dtype=np.int64))
    return order, np.concatenate(counts), np.concatenate(which), list(number)


# --- alignment ------------------------------------------------------------------------------------

@dataclass
class Aligned:
    """Token sequences of several stretches, end to end. a, b: ids. a_group, b_group: the group of
    each token. link_a, link_b: places of linked tokens, in the order of side a."""
    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def coalesce(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Groups and links of two token sequences over the same bytes."""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_start, b_start = a_end - a_sizes, b_end - b_sizes
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), dtype=np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks) - 1
    # Tokens of b that end after a token of a starts and start before it ends: a run of neighbours.
    first = np.searchsorted(b_end, a_start, side="right")
    count = np.searchsorted(b_start, a_end, side="left") - first
    link_a = np.repeat(np.arange(len(a)), count)
    link_b = np.arange(len(link_a)) + np.repeat(first - (np.cumsum(count) - count), count)
    return Aligned(a, b, group[:len(a)], group[len(a):], link_a, link_b)


@lru_cache(maxsize=1)
def _decimals(size: int) -> np.ndarray:
    """Row i: the decimal digits of i, zeros where there are none, and room for a sign."""
    return np.array([str(i).encode() for i in range(size)], dtype="S6").view(np.uint8).reshape(size, 6)


def spelled(found: Aligned, stretch_of_group: np.ndarray, count: int) -> list[bytes]:
    """`a1,a2|b1;` of the groups of each stretch, end to end."""
    ids = np.concatenate([found.a, found.b])
    group = np.concatenate([found.a_group, found.b_group])
    side = np.concatenate([np.zeros(len(found.a), bool), np.ones(len(found.b), bool)])
    order = np.argsort(group * 2 + side, kind="stable")
    ids, group, side = ids[order], group[order], side[order]
    last = np.ones(len(ids), dtype=bool)
    last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    signs = np.where(last, np.where(side, ord(";"), ord("|")), ord(",")).astype(np.uint8)
    wide = np.empty((len(ids), 7), dtype=np.uint8)
    wide[:, :6] = _decimals(100_000)[ids]
    wide[:, 6] = signs
    flat = wide.ravel()
    text = flat[flat != 0].tobytes()
    sizes = np.bincount(stretch_of_group[group], weights=(wide != 0).sum(axis=1), minlength=count)
    ends = np.cumsum(sizes).astype(np.int64).tolist()
    return [text[x:y] for x, y in zip([0, *ends], ends)]


# --- blocks ---------------------------------------------------------------------------------------

def packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for array in arrays:
        np.save(out, array, allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpacked(data: bytes) -> list[np.ndarray]:
    source, arrays = io.BytesIO(zstandard.ZstdDecompressor().decompress(data)), []
    end = len(source.getvalue())
    while source.tell() < end:
        arrays.append(np.load(source, allow_pickle=False))
    return arrays


def bounds_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


@dataclass
class Block:
    """order: which texts its documents are. facts: FACTS of each. digests: of their groups. pairs: the distinct linked pairs,
    a << 32 | b. held: documents that hold each. The rest says which pairs a stretch has, and how
    often a document has which stretch."""
    order: list[int]
    facts: np.ndarray
    digests: list[str]
    pairs: np.ndarray
    held: np.ndarray
    pair_counts: np.ndarray
    pair_of: np.ndarray
    stretch_counts: np.ndarray
    stretch_of: np.ndarray
    times: np.ndarray


def block_of(texts: list[str | None], both: Sides) -> Block:
    """Aligns the texts of a block; its documents come in the order of `order`."""
    order, sizes, flat, stretches = cut([text or "" for text in texts])
    tokens = both.of(stretches)
    odd = np.array([found is None for found in tokens])
    if odd.any():
        ends = np.cumsum(sizes)
        parts = np.split(flat, ends[:-1])
        for at, some in enumerate(parts):
            if odd[some].any():
                # As one stretch; it has no tokens if the whole does not come back either.
                whole = both.of([" " + texts[order[at]]])[0]
                parts[at] = np.array([] if whole is None else [len(tokens)], dtype=np.int64)
                tokens += [] if whole is None else [whole]
                odd = np.append(odd, [False] * (len(tokens) - len(odd)))
        sizes, flat = np.array([len(x) for x in parts]), np.concatenate(parts)
        # Stretches that only texts without tokens have must leave no pairs.
        used = np.bincount(flat.astype(np.int64), minlength=len(tokens)) > 0
        tokens = [found if found and some else (b"", b"") for found, some in zip(tokens, used)]
    count = len(tokens)
    a = np.frombuffer(b"".join([x for x, _ in tokens]), np.uint32).astype(np.int64)
    b = np.frombuffer(b"".join([y for _, y in tokens]), np.uint32).astype(np.int64)
    a_count = np.array([len(x) for x, _ in tokens], dtype=np.int64) // 4
    b_count = np.array([len(y) for _, y in tokens], dtype=np.int64) // 4
    found = coalesce(a, b, both.a_sizes[a], both.b_sizes[b])
    a_stretch = np.repeat(np.arange(count), a_count)
    groups = int(found.a_group[-1]) + 1 if len(a) else 0
    stretch_of_group = np.zeros(groups, dtype=np.int64)
    stretch_of_group[found.a_group] = a_stretch
    texts_of = spelled(found, stretch_of_group, count) if groups else [b""] * count
    pairs, pair_of = np.unique(a[found.link_a] << 32 | b[found.link_b], return_inverse=True)
    pair_counts = np.bincount(a_stretch[found.link_a], minlength=count)
    group_counts = np.bincount(stretch_of_group, minlength=count)
    per_stretch = np.stack([a_count, b_count, group_counts, pair_counts], axis=1)

    ends = np.cumsum(sizes)
    running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(per_stretch[flat], axis=0)])
    facts = running[ends] - running[ends - sizes]
    listed, digests = flat.tolist(), []
    for begin, end in zip((ends - sizes).tolist(), ends.tolist()):
        groups_of = b"".join(map(texts_of.__getitem__, listed[begin:end]))
        digests.append(hashlib.sha256(groups_of[:-1]).hexdigest() if end > begin else "")

    # Each document's distinct stretches, and from them its distinct pairs.
    keys, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(count, 1) + flat,
                            return_counts=True)
    doc_of, stretch_of = np.divmod(keys, max(count, 1))
    firsts = bounds_of(pair_counts)
    taken = pair_counts[stretch_of]
    spread = np.arange(int(taken.sum())) + np.repeat(
        firsts[stretch_of] - (np.cumsum(taken) - taken), taken)
    holds = np.unique(np.repeat(doc_of, taken) * max(len(pairs), 1) + pair_of[spread])
    held = np.bincount(holds % max(len(pairs), 1), minlength=len(pairs))
    return Block(order, facts, digests, pairs, held, pair_counts, pair_of,
                 np.bincount(doc_of, minlength=len(sizes)), stretch_of, times)


def totals(block: list[np.ndarray], counts: np.ndarray, best: np.ndarray) -> np.ndarray:
    """n_best and count_sum of each document, from the counts of the block's pairs."""
    pair_counts, pair_of, stretch_counts, stretch_of, times = block
    stretch_of = np.cumsum(stretch_of)  # kept as differences, which take less room
    values = np.stack([best, counts], axis=1).astype(np.int64)[pair_of]
    running = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(values, axis=0)])
    firsts = bounds_of(pair_counts)
    of_stretch = running[firsts[1:]] - running[firsts[:-1]]
    weighed = of_stretch[stretch_of] * times.astype(np.int64)[:, None]
    running = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(weighed, axis=0)])
    firsts = bounds_of(stretch_counts)
    return running[firsts[1:]] - running[firsts[:-1]]


DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), *[(f, pa.int64()) for f in FACTS],
                           ("groups_sha256", pa.string())]))
BLOCKS = ("block long, docs array<struct<doc_id:long, n_a:long, n_b:long, n_groups:long, "
          "n_links:long, groups_sha256:string>>, inner binary, pairs array<long>, held array<long>")


def blocks(docs: DataFrame, a: str, b: str, chars: int) -> DataFrame:
    """One row for each block of documents."""
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"),
                       F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a, b)
        ids: list[int | None] = []
        texts: list[str] = []
        size, made = 0, 0

        def finish(part: int) -> pa.RecordBatch:
            block = block_of(texts, both)
            lists = [[ids[i] for i in block.order], *block.facts.T.tolist(), block.digests]
            docs_of = pa.array([[dict(zip(("doc_id", *FACTS, "groups_sha256"), row))
                                 for row in zip(*lists)]], type=DOCS)
            inner = packed(block.pair_counts.astype(np.int32), block.pair_of.astype(np.int32),
                           block.stretch_counts.astype(np.int32),
                           np.diff(block.stretch_of, prepend=0).astype(np.int32),
                           block.times.astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made], pa.int64()), docs_of, pa.array([inner], pa.binary()),
                 pa.array([block.pairs], pa.list_(pa.int64())),
                 pa.array([block.held], pa.list_(pa.int64()))],
                names=["block", "docs", "inner", "pairs", "held"])

        part = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else part
            for doc_id, text in zip(batch.column("doc_id").to_pylist(),
                                    batch.column("text").to_pylist()):
                if texts and size + len(text) > chars:
                    yield finish(part)
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield finish(part)

    return rows.mapInArrow(run, BLOCKS)


def align(docs: DataFrame, a: str | None = None, b: str | None = None,
          chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """The documents' rows, and the counts of all linked pairs (a_id, b_id, docs, best)."""
    first, second = default_paths()
    made = land(blocks(docs, a or first, b or second, chars), "aligned_blocks")
    held = made.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "pair"))
    held = held.select("block", "at", F.col("pair.pairs").alias("pair"),
                       F.col("pair.held").alias("held"))
    counts = land(held.groupBy("pair").agg(F.sum("held").alias("docs")), "pair_counts")
    a_id = F.shiftright("pair", 32)
    # One row for each id of side a: no more than its vocabulary has.
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("docs").alias("most"))
    scored = counts.withColumn("a_id", a_id).join(F.broadcast(most), "a_id").select(
        "pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    back = held.select("block", "at", "pair").join(scored.hint("merge"), "pair").select(
        F.col("block").alias("of"), "at", "docs", "best")

    def add_up(own: pa.Table, counted: pa.Table) -> pa.Table:
        row = own.to_pylist()[0] if own.num_rows else None
        if row is None:
            return pa.Table.from_pylist([], schema=RESULT)
        docs_of = pa.Table.from_pylist(row["docs"], schema=pa.schema(list(DOCS.value_type)))
        order = np.argsort(counted.column("at").to_numpy())
        found = totals(unpacked(row["inner"]), counted.column("docs").to_numpy()[order],
                       counted.column("best").to_numpy()[order])
        columns = {name: docs_of.column(name) for name in docs_of.column_names}
        columns |= {"n_best": pa.array(found[:, 0]), "count_sum": pa.array(found[:, 1])}
        return pa.Table.from_pydict({f.name: columns[f.name] for f in RESULT}, schema=RESULT)

    rows = made.select("block", "docs", "inner").groupBy("block").cogroup(
        back.groupBy("of")).applyInArrow(add_up, RESULT_DDL)
    pairs = scored.select(F.shiftright("pair", 32).cast("int").alias("a_id"),
                          F.col("pair").bitwiseAND(2**32 - 1).cast("int").alias("b_id"),
                          "docs", "best")
    return rows, pairs


RESULT = pa.schema([("doc_id", pa.int64()), *[(f, pa.int64()) for f in FACTS],
                    ("n_best", pa.int64()), ("count_sum", pa.int64()),
                    ("groups_sha256", pa.string())])
RESULT_DDL = ", ".join(f"{f.name} {'string' if f.name == 'groups_sha256' else 'long'}"
                       for f in RESULT)


def alignment(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return align(docs)[0]
