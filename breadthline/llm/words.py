"""Ids of all stretches of a batch of texts, put together in Arrow.

Most stretches are a word of Latin letters with signs behind it, which are pre-tokens of their own.
The words without their signs are far fewer than the stretches; only they are looked up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that every version of Unicode calls letters; signs that are no letters, digits or apostrophes.
WORD = "^(?P<stem> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?]*)$"

Lookup = Callable[[list[str]], list[bytes]]


class Kept:
    """Ids of the pre-tokens that a Python worker has met; emptied when they have grown to the limit."""

    def __init__(self, compute: Lookup, limit: int = 300_000, longest: int = 64) -> None:
        self.compute, self.limit, self.longest = compute, limit, longest
        self.found = {"": b""}

    def of(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens, each asked for once."""
        if len(self.found) + len(parts) > self.limit:
            self.found = {"": b""}
        found = list(map(self.found.get, parts))
        missing = [part for part, ids in zip(parts, found) if ids is None]
        if not missing:
            return found
        fresh = self.compute(missing)
        self.found.update((p, ids) for p, ids in zip(missing, fresh) if len(p) <= self.longest)
        rest = iter(fresh)
        return [next(rest) if ids is None else ids for ids in found]

    def of_lists(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of pre-tokens, end to end."""
        wanted = list(set().union(*lists))
        known = dict(zip(wanted, self.of(wanted)))
        return [b"".join(map(known.__getitem__, some)) for some in lists]


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def ids_of_texts(stretches: pa.Array, parts: Lookup, others: Lookup,
                 lower: bool = False) -> tuple[bytes, np.ndarray]:
    """Ids of texts, given as lists of stretches, end to end, and the byte at which each text ends.

    `parts` gives the ids of pre-tokens (of the empty string none), `others` those of stretches that
    are no WORD; both get distinct strings. `lower`: words are looked up in lower case.
    """
    coded = stretches.flatten().dictionary_encode()
    taken = _ids(coded.dictionary, parts, others, lower).take(coded.indices)
    _, offsets, data = taken.buffers()
    offsets = np.frombuffer(offsets, np.int64)[taken.offset:taken.offset + len(taken) + 1]
    last = np.cumsum(np.asarray(pc.list_value_length(stretches), dtype=np.int64))
    return data or b"", offsets[last]


def _ids(stretches: pa.Array, parts: Lookup, others: Lookup, lower: bool) -> pa.Array:
    """Ids of distinct stretches."""
    split = pc.extract_regex(stretches, WORD)
    other = pc.is_null(split)
    stem, tail = pc.struct_field(split, "stem"), pc.struct_field(split, "tail")

    def looked_up(some: pa.Array) -> pa.Array:
        coded = some.dictionary_encode()
        found = parts(strings(coded.dictionary))
        return pa.array(found, pa.large_binary()).take(coded.indices)

    joined = pc.binary_join_element_wise(
        looked_up(pc.utf8_lower(stem) if lower else stem), looked_up(tail),
        pa.scalar(b"", pa.large_binary()))
    rest = pa.array(others(strings(stretches.filter(other))), pa.large_binary())
    return pc.replace_with_mask(joined, other, rest)
