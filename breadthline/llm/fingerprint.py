"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Paragraphs are lines; a section ends at a blank line, or after a paragraph whose digest says so
(about every eighth), so that an edit moves section borders near it only. Paragraphs are cut into
pieces of some words the same way: after a sentence's end, and within long sentences after words
that end in one of a few letters. Each piece has a digest and a length; a paragraph's digest covers
its pieces' digests, a section's its paragraphs', the root its sections'.

The fingerprint is text: the root's digest, then the sections, each with its digest and its
paragraphs, each with its pieces. Equal texts have equal fingerprints, different roots different
texts. Two fingerprints are compared from the top: equal branches are counted whole, differing ones
are opened, down to the pieces. Likeness is the share of characters in pieces that both have.

Rows: one per document. Null texts count as empty. The next document is the next row by doc_id,
equal ids by text; null ids come first; after the last row comes the first. A single row is its own
next. Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breadthline.llm.common import partitions, whole_text

#: A piece ends after the end of a sentence, or at a blank after one of these letters, once it has
#: some length; so borders depend on what stands near them, not on where a text begins.
PIECE = re.compile(r"[^\n]{16,}?(?:[.!?|](?=\s)|[dhst,*%$&#](?= )|$)|[^\n]+?$", re.M)
SECTION = 8


def _digest(parts: list[str]) -> str:
    return xxhash.xxh3_64_hexdigest("".join(parts))


def tree(text: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """Root digest and sections; a section is (digest, paragraphs), a paragraph (digest, pieces).

    A piece is its digest (8 hex digits) and its length in characters (hex).
    """
    sections, paragraphs = [], []

    def close() -> None:
        if paragraphs:
            sections.append((_digest([d for d, _ in paragraphs]), list(paragraphs)))
            paragraphs.clear()

    for line in text.split("\n"):
        if not line.strip():
            close()
            continue
        pieces = [f"{xxhash.xxh32_hexdigest(p)}{len(p):x}" for p in PIECE.findall(line)]
        digest = _digest([line])
        paragraphs.append((digest, pieces))
        if int(digest[:2], 16) % SECTION == 0:
            close()
    close()
    root = hashlib.blake2b(text.encode(), digest_size=16)
    root.update("".join(d for d, _ in sections).encode())
    return root.hexdigest(), sections


def fingerprint(text: str) -> str:
    root, sections = tree(text)
    return root + "".join(
        f";{digest}" + "".join(f":{d}," + ",".join(p) for d, p in paragraphs)
        for digest, paragraphs in sections)


def parse(mark: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    root, *sections = mark.split(";")
    found = []
    for section in sections:
        digest, *paragraphs = section.split(":")
        split = [p.split(",") for p in paragraphs]
        found.append((digest, [(p[0], p[1:]) for p in split]))
    return root, found


def _size(piece: str) -> int:
    return int(piece[8:], 16)


def _weigh(branches) -> int:
    return sum(_size(p) for _, pieces in branches for p in pieces)


def _open(sections, shared: Counter) -> list[tuple[str, list[str]]]:
    """Paragraphs of the sections that are not shared; takes the shared ones off the counter."""
    rest = []
    for digest, paragraphs in sections:
        if shared[digest]:
            shared[digest] -= 1
        else:
            rest += paragraphs
    return rest


def likeness(one: str, other: str) -> float:
    """Share of characters in common branches, 0 to 1, from the fingerprints alone."""
    (root, left), (root_other, right) = parse(one), parse(other)
    if root == root_other:
        return 1.0
    total = sum(_weigh(p) for _, p in left) + sum(_weigh(p) for _, p in right)
    if not total:
        return 0.0
    common = Counter(d for d, _ in left) & Counter(d for d, _ in right)
    sizes = {d: _weigh(p) for d, p in left}
    same = sum(sizes[d] * n for d, n in common.items())
    left, right = _open(left, Counter(common)), _open(right, Counter(common))
    common = Counter(d for d, _ in left) & Counter(d for d, _ in right)
    sizes = {d: sum(map(_size, p)) for d, p in left}
    same += sum(sizes[d] * n for d, n in common.items())

    def pieces(paragraphs, shared: Counter) -> Counter:
        rest: Counter = Counter()
        for digest, found in paragraphs:
            if shared[digest]:
                shared[digest] -= 1
            else:
                rest.update(found)
        return rest

    both = pieces(left, Counter(common)) & pieces(right, Counter(common))
    same += sum(_size(p) * n for p, n in both.items())
    return min(1.0, 2 * same / total)


def changes(one: str, other: str) -> list[tuple[int, int]]:
    """(section, paragraph) of the first fingerprint that the second does not have."""
    (root, left), (root_other, right) = parse(one), parse(other)
    if root == root_other:
        return []
    sections = {d for d, _ in right}
    paragraphs = {d for _, some in right for d, _ in some}
    return [(s, p) for s, (digest, some) in enumerate(left) if digest not in sections
            for p, (d, _) in enumerate(some) if d not in paragraphs]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to ranges of doc_id; each range also gets the first rows of the next one.

    The borders are ids that occur, so a range can tell the rows it owns from those it borrows; the
    last range borrows the first row of all. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    count = partitions(spark)
    probes = [i / count for i in range(1, count)] or [0.5]
    found = rows.agg(F.percentile_approx("doc_id", probes, 10_000), F.min("doc_id"),
                     F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    first = None if found[2] else found[1]
    borders = sorted({b for b in found[0] or [] if b is not None and b != first})
    limits = F.array(*[F.lit(b).cast("long") for b in borders]).cast("array<long>")
    doc_id = F.col("doc_id")
    part = F.coalesce(F.size(F.filter(limits, lambda b: b <= doc_id)), F.lit(0))
    part = F.when(doc_id.isNull(), 0).otherwise(part)
    wraps = doc_id.eqNullSafe(F.lit(first).cast("long"))
    lends = F.array_contains(limits, doc_id)
    homes = F.when(wraps, F.array(F.struct(part.alias("part"), F.lit(False).alias("lent")),
                                  F.struct(F.lit(len(borders)).alias("part"),
                                           F.lit(True).alias("lent"))))
    homes = homes.when(lends, F.array(F.struct(part.alias("part"), F.lit(False).alias("lent")),
                                      F.struct((part - 1).alias("part"),
                                               F.lit(True).alias("lent"))))
    homes = homes.otherwise(F.array(F.struct(part.alias("part"), F.lit(False).alias("lent"))))
    return (
        rows.withColumn("home", F.explode(homes)).select("doc_id", "text", "home.part", "home.lent")
        .repartition(count, "part").sortWithinPartitions("part", "lent", "doc_id", "text")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None  # the last row that has not met its next one: part, id, text, fingerprint
        for batch in batches:
            rows = []
            for doc_id, text, part, lent in batch[["doc_id", "text", "part", "lent"]].itertuples(
                    index=False, name=None):
                if waiting is not None and waiting[0] == part:
                    mark = fingerprint(text)
                    _, own_id, own, own_mark = waiting
                    after = edited(own, text)
                    after_mark = fingerprint(after)
                    rows.append((
                        own_id, len(own), hashlib.sha256(after.encode()).hexdigest(), own_mark,
                        after_mark, likeness(own_mark, after_mark), likeness(own_mark, mark)))
                    waiting = None if lent else (part, doc_id, text, mark)
                elif not lent:
                    waiting = (part, doc_id, text, fingerprint(text))
            yield pd.DataFrame(rows, columns=names)

    return with_next(docs).mapInPandas(run, RESULT)
