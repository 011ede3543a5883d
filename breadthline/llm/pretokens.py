"""Byte-level BPE: vocabulary, pre-tokens and ids of whole texts, for counting and for packing.

The pattern, the byte alphabet and the ids are those of the tokenizer file, whose path is a
parameter. Tests hold both ways of reading a text against the tokenizers library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

# The pattern of this family of vocabularies; white space as its library reads it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|["
           + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+")
SPLITTER = regex.compile(PATTERN)
#: Marks a key that stands for the rest of itself; no other key holds a carriage return.
RAW = "\r"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


SLOT_BITS = 20


def slots_of(keys: np.ndarray, factor: int) -> np.ndarray:
    mixed = keys.view(np.uint64) * np.uint64(factor)
    return (mixed >> np.uint64(64 - SLOT_BITS)).view(np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """first: symbol of each byte. keys: the pairs, left << 32 | right, by rank. merged: what a pair
    becomes. slots: two hash tables that give a pair's rank; a pair that finds its place in the
    first table taken is in the second one. Keys end with -1, for pairs that are not known.
    """
    first: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    slots: tuple[np.ndarray, np.ndarray]
    factors: tuple[int, int]
    special: dict[str, int]

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair, the number of pairs if it is unknown."""
        unknown = len(self.keys) - 1
        rank = self.slots[0][slots_of(keys, self.factors[0])]
        wrong = np.nonzero(self.keys[rank] != keys)[0]
        again = keys[wrong]
        second = self.slots[1][slots_of(again, self.factors[1])]
        rank[wrong] = np.where(self.keys[second] == again, second, unknown)
        return rank

    def special_pattern(self):
        if not self.special:
            return None
        strings = sorted(self.special, key=len, reverse=True)
        return re.compile("|".join(re.escape(s) for s in strings))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    ids = stored["model"]["vocab"]
    signs = byte_alphabet()
    first = np.array([ids[signs[b]] for b in range(256)], dtype=np.int64)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in stored["model"]["merges"]]
    keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs] + [-1], dtype=np.int64)
    merged = np.array([ids[a + b] for a, b in pairs] + [-1], dtype=np.int64)
    tables, factors, left = [], [], np.arange(len(pairs))
    rng = np.random.default_rng(1)
    for last in (False, True):
        while True:
            factor = int(rng.integers(1 << 61, 1 << 62)) * 2 + 1
            places = slots_of(keys[left], factor)
            _, firsts = np.unique(places, return_index=True)
            if not last or len(firsts) == len(left):
                break
        slot = np.full(1 << SLOT_BITS, len(pairs), dtype=np.int32)
        slot[places[firsts]] = left[firsts]
        tables.append(slot)
        factors.append(factor)
        left = np.delete(left, firsts)
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    return Vocabulary(first, keys, merged, tuple(tables), tuple(factors), special)


def keys_of(text: str) -> list[str]:
    """A text as keys of stretches that no pre-token crosses, so that each can be read once.

    Where every gap between words is one blank or one line feed, the text is cut before each:
    `word` stands for a blank and the word, `\\nword` for itself, and the first word is raw. Any
    other text is cut into its pre-tokens, all raw.
    """
    if text.replace("\n", " ").split(" ") != text.split():
        return [RAW + part for part in SPLITTER.findall(text)]
    keys = text.replace("\n", " \n").split(" ")
    keys[0] = RAW + keys[0]
    return keys


def parts_of(key: str) -> list[str]:
    """Pre-tokens of the stretch that a key stands for."""
    if key[:1] == RAW:
        return SPLITTER.findall(key[1:])
    return SPLITTER.findall(key if key[:1] == "\n" else " " + key)


def merge_all(vocab: Vocabulary, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of every sequence after all merges, end to end, and how many each has.

    The sequences lie end to end in one array with the number of the sequence each symbol belongs
    to. A round looks up the rank of all neighbouring pairs at once, finds the lowest rank of each
    sequence, and merges that pair everywhere in it (from the left where it overlaps itself).
    Sequences without a known pair are done. A merged symbol only forms pairs of a higher rank than
    its own, so merging all places of a pair at once gives what merging them one by one gives.
    """
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    symbols = vocab.first[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(sequences), dtype=np.int32), lengths)
    done_symbols, done_owners = [], []
    unknown = len(vocab.keys) - 1
    while len(symbols):
        rank = np.full(len(symbols), unknown, dtype=np.int32)
        same = owner[1:] == owner[:-1]
        inside = np.nonzero(same)[0]
        rank[inside] = vocab.ranks(symbols[inside] << 32 | symbols[inside + 1])
        firsts = np.concatenate([[0], np.nonzero(~same)[0] + 1])
        lowest = np.minimum.reduceat(rank, firsts)
        counts = np.diff(np.append(firsts, len(symbols)))
        open_ = np.repeat(lowest < unknown, counts)
        done_symbols.append(symbols[~open_])
        done_owners.append(owner[~open_])
        symbols, owner, rank = symbols[open_], owner[open_], rank[open_]
        lasting = lowest < unknown
        hit = rank == np.repeat(lowest[lasting], counts[lasting])
        at = np.nonzero(hit)[0]
        touching = np.nonzero(np.diff(at) == 1)[0]
        if len(touching):
            # In a run of hits that touch each other every second one would use a symbol twice.
            begins = np.concatenate([[True], np.diff(at) != 1])
            start = np.maximum.accumulate(np.where(begins, at, 0))
            at = at[(at - start) % 2 == 0]
        symbols[at] = vocab.merged[rank[at]]
        kept = np.ones(len(symbols), dtype=bool)
        kept[at + 1] = False
        symbols, owner = symbols[kept], owner[kept]
    if not done_symbols:
        return np.zeros(0, dtype=np.int64), np.zeros(len(sequences), dtype=np.int64)
    symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owners)
    order = np.argsort(owner, kind="stable")
    return symbols[order], np.bincount(owner, minlength=len(sequences))


class Kept:
    """Results by stretch, for one Python worker; emptied when it has grown to its limit."""

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 600_000,
                 longest: int = 64) -> None:
        self.compute, self.limit, self.longest = compute, limit, longest
        self.found: dict[str, object] = {}

    def of(self, lists: list[list[str]]) -> dict[str, object]:
        """A dictionary that holds every string of the lists."""
        wanted = set().union(*lists) if lists else set()
        if len(self.found) + len(wanted) > self.limit:
            self.found = {}
        missing = [text for text in wanted if text not in self.found]
        if not missing:
            return self.found
        fresh = dict(zip(missing, self.compute(missing)))
        for text, value in fresh.items():
            if len(text) <= self.longest:
                self.found[text] = value
        if any(len(text) > self.longest for text in missing):
            return {**{t: self.found[t] for t in wanted if t in self.found}, **fresh}
        return self.found
