"""Benchmark decontamination by the CGK embedding and bit-sampling LSH, then exact edit distance.

Texts are folded to lower-case letters and digits with single blanks, so case, layout and strewn
signs do not hide a passage. Items and documents have a window at every word, and at every letter of
scripts that set no blanks.

The CGK walk reads a window with one pointer: at step j it writes the character under the pointer
and moves on or stays, as a random bit for (j, character) says. Two windows at small edit distance
fall into step again after each edit, so their outputs differ in few places; sampling some of the
outputs gives them equal keys with fair probability. Walks and samples are drawn anew in each run;
trials on edited copies of the items tell how many runs a recall needs (`runs_needed`). Equal keys
are candidates. Those that share too few runs of three characters for the distance go; each other is settled by the exact edit distance between the whole item and the
best matching stretch of the document around the window.

Rows: a document may match several items; each pair appears once, at its best stretch. Null and
empty texts and items match nothing; items shorter than `shortest` folded characters are looked up
by pieces, one of which every match holds unchanged, and settled by edit distance as whole words. Repeated rows give repeated results. Extra columns are left out. Empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from breadthline.llm.common import freeing, keep_rows, pieces

STEPS = 64  # length of the sampled part of the walk; it reads about half as many characters
SAMPLE = 14  # more of them cost runs, fewer cost exact comparisons
CODES = 64
RESULT = (("doc_id", "long"), ("item_id", "long"), ("start", "long"), ("stop", "long"),
          ("distance", "int"), ("item_chars", "int"))
KINDS = {"long": pa.int64(), "int": pa.int32()}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane: its folded code point (0: no letter or digit), and
    whether it is a letter of a script that sets no blanks between words."""
    folded = np.zeros(1 << 16, dtype=np.uint16)
    for point in range(1, 1 << 16):
        char = chr(point)
        if char.isalnum():
            low = char.lower()
            folded[point] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else point
    at = np.arange(1 << 16)
    unspaced = np.zeros(1 << 16, dtype=bool)
    for low, high in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF),
                      (0xF900, 0xFAFF)):
        unspaced |= (at >= low) & (at <= high)
    return folded, unspaced & (folded != 0)


FOLDED, UNSPACED = _tables()


@dataclass
class Folded:
    """Folded texts end to end, each after a blank. at: position of each in its own text."""
    codes: np.ndarray
    at: np.ndarray
    anchors: np.ndarray
    owner: np.ndarray  # text of each anchor
    starts: np.ndarray  # where each text begins and, last, where all end

    def signs(self) -> np.ndarray:
        """Codes as the walk reads them, two at a time, with room for a walk at the very end."""
        codes = np.concatenate([self.codes % CODES, np.zeros(STEPS + 1, np.uint16)])
        return codes[:-1] * np.uint16(CODES) + codes[1:]


def fold(texts: list[str]) -> Folded:
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    lengths = np.array([len(p) + 1 for p in points], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    raw = np.zeros(int(lengths.sum()) + 1, dtype=np.uint16)
    for begin, p in zip(begins.tolist(), points):
        raw[begin + 1:begin + 1 + len(p)] = np.where(p < 1 << 16, p, 1)
    codes = FOLDED[raw]
    word = codes != 0
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first sign after a word is its blank
    keep[begins] = True  # and every text begins with one
    first = word.copy()
    first[1:] &= ~word[:-1]
    first |= UNSPACED[raw]
    spots = np.nonzero(first)[0]
    owner = np.searchsorted(begins, spots, side="right") - 1
    number = np.cumsum(keep) - 1
    kept = np.nonzero(keep)[0]
    starts = np.append(number[begins], len(kept)) if len(texts) else np.zeros(1, dtype=np.int64)
    at = kept - np.repeat(begins, np.diff(starts)) - 1 if len(texts) else kept
    return Folded(codes[kept], at, number[spots], owner, starts)


@dataclass
class Walks:
    """Random bits and sampled steps of each run, from a seed: the same on every machine."""
    runs: int
    seed: int = 5
    tables: list[list[np.ndarray]] = field(default_factory=list)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        one, two = np.divmod(np.arange(CODES * CODES), CODES)
        for _ in range(self.runs):
            moves = rng.integers(0, 2, (STEPS, CODES))
            sampled = set(rng.choice(STEPS, SAMPLE, replace=False).tolist())
            # Two steps at once, from the two signs they can read: how far the pointer moves, and
            # above these two bits what is sampled.
            tables = []
            for step in range(0, max(sampled) + 1, 2):
                next_sign = np.where(moves[step][one] == 1, two, one)
                far = moves[step][one] + moves[step + 1][next_sign]
                read = ((one + 1) * (step in sampled) * (CODES + 1)
                        + (next_sign + 1) * (step + 1 in sampled))
                tables.append((far + (read << 2)).astype(np.int32))
            self.tables.append(tables)

    def keys(self, run: int, signs: np.ndarray, anchors: np.ndarray,
             chunk: int = 16_384) -> np.ndarray:
        """Key of the window at each anchor of folded texts given as `signs`."""
        keys = np.empty(len(anchors), dtype=np.uint64)
        for start in range(0, len(anchors), chunk):
            pointer = anchors[start:start + chunk].astype(np.int64)
            key = np.zeros(len(pointer), dtype=np.uint64)
            for table in self.tables[run]:
                # All places are inside; saying so spares a check of each.
                step = table.take(signs.take(pointer, mode="clip"), mode="clip")
                pointer += step & 3
                if table[-1] > 3:
                    key *= np.uint64(0x9E3779B97F4A7C15)
                    key += (step >> 2).view(np.uint32)
            keys[start:start + chunk] = key ^ (key >> np.uint64(29))
        return keys


@dataclass
class Items:
    """Benchmark items of one block, ready to be looked up."""
    ids: list[int]
    folded: list[str]
    keys: list[np.ndarray]  # sorted keys of each run
    owners: list[np.ndarray]  # item and window position for each key
    offsets: list[np.ndarray]
    filters: list[np.ndarray]
    short: dict[str, list[int]]
    grams: dict[int, np.ndarray] = field(default_factory=dict)  # counts of each item looked at

    @classmethod
    def of(cls, ids: list[int], texts: list[str], walks: Walks, shortest: int) -> Items:
        found = fold(texts)
        strings = [
            "".join(map(chr, np.where(part == 0, 32, part))).strip()
            for part in np.split(found.codes, found.starts[1:-1])] if texts else []
        long = np.array([len(s) >= shortest for s in strings], dtype=bool)
        short: dict[str, list[int]] = {}
        for i, s in enumerate(strings):
            if s and not long[i]:
                short.setdefault(s, []).append(i)
        # A window needs enough of its item behind it to be told from chance.
        offset = found.anchors - found.starts[found.owner] - 1
        rest = np.array([len(s) for s in strings], dtype=np.int64)[found.owner] - offset
        use = long[found.owner] & (rest >= STEPS // 2) if len(strings) else np.zeros(0, bool)
        anchors, owner, offset = found.anchors[use], found.owner[use], offset[use]
        keys, owners, offsets, filters = [], [], [], []
        for run in range(walks.runs):
            key = walks.keys(run, found.signs(), anchors)
            order = np.argsort(key, kind="stable")
            keys.append(key[order])
            owners.append(owner[order])
            offsets.append(offset[order])
            bits = np.zeros(1 << 20, dtype=bool)
            bits[(key >> np.uint64(44)).astype(np.int64)] = True
            filters.append(bits)
        return cls(ids, strings, keys, owners, offsets, filters, short)


def edit_search(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and the stretch's end.

    Bit-parallel: one step for each character of the text on numbers as long as the pattern.
    """
    masks: dict[str, int] = {}
    for i, char in enumerate(pattern):
        masks[char] = masks.get(char, 0) | 1 << i
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for i, char in enumerate(text):
        equal = masks.get(char, 0)
        x = equal | minus
        d0 = ((((equal & plus) + plus) ^ plus) | x) & full
        up = minus | (full & ~(d0 | plus))
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(d0 | up))
        minus = up & d0
        if score < best:
            best, end = score, i + 1
    return best, end


def search(texts: list[str], items: Items, walks: Walks,
           most: float) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, start, stop, distance, item length) of all matches, best stretch of each pair.

    start and stop count characters of the text as it came.
    """
    found = fold(texts)
    signs = found.signs()
    candidates: set[tuple[int, int, int]] = set()
    for run in range(walks.runs):
        if not len(items.keys[run]) or not len(found.anchors):
            continue
        keys = walks.keys(run, signs, found.anchors)
        maybe = np.nonzero(items.filters[run][(keys >> np.uint64(44)).astype(np.int64)])[0]
        low = np.searchsorted(items.keys[run], keys[maybe], side="left")
        high = np.searchsorted(items.keys[run], keys[maybe], side="right")
        for anchor, a, b in zip(maybe.tolist(), low.tolist(), high.tolist()):
            for k in range(a, b):
                item = int(items.owners[run][k])
                begin = int(found.anchors[anchor]) - int(items.offsets[run][k])
                candidates.add((int(found.owner[anchor]), item, begin))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], list[int]] = {}
    for text, item, begin in sorted(candidates):
        pattern = items.folded[item]
        slack = int(most * len(pattern)) + 1
        seen = done.setdefault((text, item), [])
        if seen and begin - seen[-1] <= slack // 2:
            continue  # the stretch just settled holds this one
        seen.append(begin)
        low = max(int(found.starts[text]) + 1, begin - 2 * slack)
        high = min(int(found.starts[text + 1]), begin + len(pattern) + 2 * slack)
        around = found.codes[low:high]
        if item not in items.grams:
            items.grams[item] = _grams(np.array([0 if c == " " else ord(c) for c in pattern]))
        # An edit changes three runs of three characters at most.
        shared = np.minimum(items.grams[item], _grams(around)).sum()
        if shared < len(pattern) - 2 - 3 * int(most * len(pattern)):
            continue
        string = "".join(map(chr, np.where(around == 0, 32, around)))
        distance, stop = edit_search(pattern, string)
        if distance > most * len(pattern):
            continue
        _, back = edit_search(pattern[::-1], string[:stop][::-1])
        old = best.get((text, item))
        if old is None or distance < old[0]:
            best[text, item] = distance, low + stop - back, low + stop
    rows = [
        (text, item, int(found.at[a]), int(found.at[b - 1]) + 1, distance,
         len(items.folded[item]))
        for (text, item), (distance, a, b) in best.items()]
    if items.short:
        rows += _short_matches(found, items, most)
    return rows


def _grams(codes: np.ndarray) -> np.ndarray:
    """Counts of the runs of three characters, by a hash."""
    c = codes.astype(np.int64)
    return np.bincount((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % 4_093, minlength=4_093)


def _short_matches(found: Folded, items: Items,
                   most: float) -> list[tuple[int, int, int, int, int, int]]:
    rows = []
    for text in range(len(found.starts) - 1):
        low = int(found.starts[text])
        part = found.codes[low:int(found.starts[text + 1])]
        string = "".join(map(chr, np.where(part == 0, 32, part))) + " "
        for pattern, owners in items.short.items():
            match = _short_match(f" {pattern} ", string, int(most * len(pattern)))
            if match:
                distance, start, stop = match
                start += len(string[start:stop]) - len(string[start:stop].lstrip())
                stop = len(string[:stop].rstrip())
                a, b = int(found.at[low + start]), int(found.at[low + stop - 1]) + 1
                rows += [(text, item, a, b, distance, len(pattern)) for item in owners]
    return rows


def _short_match(pattern: str, string: str, allowed: int) -> tuple[int, int, int] | None:
    """Distance, start and stop of the best stretch within the distance allowed."""
    place = string.find(pattern)
    if place >= 0:
        return 0, place, place + len(pattern)
    # Of one piece more than there are edits, one is unchanged.
    cuts = [len(pattern) * i // (allowed + 1) for i in range(allowed + 2)]
    spans = []
    for a, b in zip(cuts, cuts[1:]):
        place = string.find(pattern[a:b]) if allowed else -1
        while place >= 0:
            spans.append((max(0, place - a - allowed), place - a + len(pattern) + allowed))
            place = string.find(pattern[a:b], place + 1)
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    best = None
    for a, b in merged:
        distance, stop = edit_search(pattern, string[a:b])
        if distance <= allowed and (best is None or distance < best[0]):
            _, back = edit_search(pattern[::-1], string[a:a + stop][::-1])
            best = distance, a + stop - back, a + stop
    return best


def edited(text: str, most: float, rng: np.random.Generator) -> str:
    """The text with as many changed, added and lost characters as `most` allows, anywhere."""
    chars = list(text)
    for _ in range(int(most * len(text))):
        at, kind = int(rng.integers(len(chars))), int(rng.integers(3))
        new = [] if kind == 2 else [text[int(rng.integers(len(text)))]]
        chars[at:at + (kind != 1)] = new
    return "".join(chars)


def runs_needed(texts: list[str], most: float, recall: float, shortest: int, trials: int = 64,
                sample: int = 128) -> int:
    """Runs until copies of the items with all the edits allowed are found with `recall`.

    Measured on at most `sample` items, spread over all: how often one run finds each copy.
    """
    walks = Walks(trials)
    folded = [t for t in texts if len(t) >= shortest]
    folded = folded[::max(1, -(-len(folded) // sample))]
    if not folded:
        return 1
    rng = np.random.default_rng(walks.seed)
    items = Items.of(list(range(len(folded))), folded, walks, 0)
    copies = fold([edited(t, most, rng) for t in folded])
    hits = np.zeros((trials, len(folded)), dtype=bool)
    for run in range(trials):
        of_item = [set() for _ in folded]
        for key, owner in zip(items.keys[run].tolist(), items.owners[run].tolist()):
            of_item[owner].add(key)
        keys = walks.keys(run, copies.signs(), copies.anchors)
        for key, owner in zip(keys.tolist(), copies.owner.tolist()):
            hits[run, owner] |= key in of_item[owner]
    missed = 1 - (hits.sum(axis=0) + 0.5) / (trials + 1)
    runs = 1
    while (missed ** runs).mean() > 1 - recall:
        runs += 1
    return runs


def item_blocks(benchmark: DataFrame, size: int, most: float, recall: float,
                shortest: int) -> Iterator[tuple[Items, Walks]]:
    """The benchmark in blocks of at most `size` items; the driver reads one block at a time."""
    def made(block: list[tuple[int, str]]) -> tuple[Items, Walks]:
        texts = [t for _, t in block]
        walks = Walks(runs_needed(texts, most, recall, shortest))
        return Items.of([i for i, _ in block], texts, walks, shortest), walks

    block: list[tuple[int, str]] = []
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == size:
            yield made(block)
            block = []
    if block:
        yield made(block)


def contamination(docs: DataFrame, benchmark: DataFrame, most: float = 0.2, recall: float = 0.95,
                  shortest: int = 48, block: int = 4_096) -> DataFrame:
    """doc_id, item_id, start, stop, distance, item_chars for each document that holds an item.

    `most`: edit distance allowed, as a share of the item's length. `recall`: of
    passages with all the edits allowed; passages with fewer are found more often. `block`: items that one pass over the
    documents looks for; a larger benchmark takes more passes, so no task ever holds more.
    """
    rows = docs.select("doc_id", "text")

    def pass_for(items: Items, walks: Walks) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in pieces(batch):
                    ids = part.column("doc_id").to_pylist()
                    found = [(ids[t], items.ids[i], *rest)
                             for t, i, *rest in search(texts, items, walks, most)]
                    columns = zip(*found) if found else [()] * len(RESULT)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=KINDS[k]) for c, (_, k) in zip(columns, RESULT)],
                        names=[n for n, _ in RESULT])

        return rows.mapInArrow(freeing(run), ", ".join(f"{n} {k}" for n, k in RESULT))

    empty = rows.sparkSession.createDataFrame([], ", ".join(f"{n} {k}" for n, k in RESULT))
    result = None
    for items, walks in item_blocks(benchmark, block, most, recall, shortest):
        result = pass_for(items, walks) if result is None else result.unionByName(pass_for(items, walks))
    return empty if result is None else result


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, most: float = 0.2, recall: float = 0.95,
                        shortest: int = 48, block: int = 4_096) -> DataFrame:
    """A step of the corpus job: documents that hold no benchmark item, as they came."""

    def without(items: Items, walks: Walks):
        def work(texts: list[str]) -> list[bool]:
            clean = [True] * len(texts)
            for text, *_ in search(texts, items, walks, most):
                clean[text] = False
            return clean

        return lambda: work

    for items, walks in item_blocks(benchmark, block, most, recall, shortest):
        docs = keep_rows(docs, without(items, walks))
    return docs
