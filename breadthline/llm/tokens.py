"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch of texts lie end to end in numpy arrays, and all their merges run side by side
(`pretokens.merge_all`); the symbols that survive are the tokens. A worker keeps the counts of short
stretches it has seen, so that each is merged about once.

Rows: one per document. Null texts count as empty: 0 bytes, 0 tokens. Strings of special tokens
inside a text are one token each, as the library has it. Repeated rows get equal counts; extra
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breadthline.llm import pretokens
from breadthline.llm.common import add_columns, whole_text

#: Counts that this Python worker has, by tokenizer file.
_KEPT: dict[str, pretokens.Kept] = {}


def _counter(path: str) -> pretokens.Kept:
    if path not in _KEPT:
        vocab = pretokens.vocabulary(path)

        def compute(found: list[str]) -> list[int]:
            parts = [pretokens.parts_of(key) for key in found]
            wanted = list(set().union(*parts))
            _, left = pretokens.merge_all(vocab, [p.encode() for p in wanted])
            sizes = dict(zip(wanted, left.tolist()))
            return [sum(map(sizes.__getitem__, some)) for some in parts]

        _KEPT[path] = pretokens.Kept(compute)
    return _KEPT[path]


def count(texts: list[str], path: str) -> list[int]:
    """Number of tokens of each text."""
    special = pretokens.vocabulary(path).special_pattern()
    specials = [0] * len(texts)
    lists = []
    for i, text in enumerate(texts):
        if special and special.search(text):
            parts = special.split(text)
            specials[i] = len(parts) - 1
            lists.append([s for part in parts for s in pretokens.keys_of(part)])
        else:
            lists.append(pretokens.keys_of(text))
    known = _counter(path).of(lists)
    return [sum(map(known.__getitem__, some)) + extra for some, extra in zip(lists, specials)]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    path = path or pretokens.default_path()

    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    counted = add_columns(
        rows, lambda: lambda texts: [[len(t.encode()) for t in texts], count(texts, path)],
        ("n_bytes", "long"), ("n_tokens", "long"))
    return counted.select(
        "doc_id", "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"))
