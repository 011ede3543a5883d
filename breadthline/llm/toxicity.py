"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on what marks toxic text and one on the most frequent
words of ordinary text. Both end in the same part of ordinary words, so a window of ordinary prose
costs the same with either; a window with toxic wording is shorter with the toxic dictionary. The difference in bytes is the
compression distance of the window. Windows overlap and cover the whole text. A document's
distances are counted against thresholds and a logistic curve, fitted on the labelled rows, turns
the counts into a probability.

Rows: one per document, in any order. Null and empty texts, and texts shorter than a window, have
one window (possibly empty). Repeated rows get equal scores. Extra columns are left out of the
result; an empty table gives an empty result. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breadthline.llm.common import add_columns, split_of, whole_text

WORD = re.compile(r"[^\W\d_]{3,}")
WINDOW = 128
STEP = 112
#: Bytes of the part that differs, and of the part that both dictionaries share.
OWN = 512
SHARED = 49_152
#: Evidence (log likelihood ratio) that a wording marks a kind before it enters a dictionary, for
#: one text of the kind; it grows with the root of their number, as chance differences do.
EVIDENCE = 1.0
#: Bytes that a window must save before it counts; three grades, each with its own weight.
GRADES = (1, 3, 5)


@dataclass
class CompressionModel:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * len(GRADES) + 1))
    offset: float = -40.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.toxic, self.ordinary):
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                12, strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, source_size=WINDOW,
                dict_size=len(content), write_content_size=False, write_checksum=False,
                write_dict_id=False)
            made.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=words))
        return made

    def score(self, texts: list[str], compressors=None) -> np.ndarray:
        found = features(texts, compressors or self.compressors())
        return 1.0 / (1.0 + np.exp(-np.clip(found @ self.weights + self.offset, -40, 40)))


def fold(text: str) -> str:
    """Lower case with every run of other characters as one blank, so that layout costs nothing."""
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def windows(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All bytes, the (offset, length) of each window and the number of windows of each text."""
    folded = [fold(t).encode() for t in texts]
    lengths = np.array([len(t) for t in folded], dtype=np.int64)
    counts = np.maximum(1, -(-(lengths - (WINDOW - STEP)) // STEP))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    segments = np.empty((len(owner), 2), dtype=np.uint64)
    segments[:, 0] = starts[owner] + number * STEP
    segments[:, 1] = np.minimum(WINDOW, lengths[owner] - number * STEP)
    return b"".join(folded), segments, counts


def distances(data: bytes, segments: np.ndarray, compressors) -> np.ndarray:
    """Bytes that each window saves with the toxic dictionary."""
    lengths = []
    for compressor in compressors:
        found = np.empty(len(segments), dtype=np.int64)
        filled = segments[:, 1] > 0
        found[~filled] = 0
        todo = segments[filled]
        sizes = []
        for start in range(0, len(todo), 65_536):
            part = zstandard.BufferWithSegments(data, todo[start:start + 65_536].tobytes())
            sizes += map(len, compressor.multi_compress_to_buffer(part))
        found[filled] = sizes
        lengths.append(found)
    return lengths[1] - lengths[0]


def features(texts: list[str], compressors) -> np.ndarray:
    """For each grade the number (as a logarithm) and the share of windows that save as much."""
    data, segments, counts = windows(texts)
    saved = distances(data, segments, compressors)
    firsts = np.cumsum(counts) - counts
    columns = []
    for grade in GRADES:
        hits = np.add.reduceat((saved >= grade).astype(np.int64), firsts) if len(texts) else counts
        columns += [np.log1p(hits), np.sqrt(hits / counts)]
    columns.append(np.log1p(counts))
    return np.stack(columns, axis=1).astype(float)


def wordings(text: str) -> set[str]:
    """Whole words (with the blank after them) and the beginnings of words."""
    found = set()
    for word in set(WORD.findall(text.lower())):
        found.add(word + " ")
        found.update(word[:size] for size in range(3, 8) if len(word) >= size)
    return found


def marks(mine: Counter, n_mine: int, other: Counter, n_other: int) -> list[str]:
    """Wordings of one kind of text, strongest first: likelihood ratio of their document counts."""
    found = []
    for wording, count in mine.items():
        rate, base = count / n_mine, (other[wording] + 0.5) / (n_other + 1)
        if count >= 3 and rate > 4 * base:
            evidence = count * math.log(rate / base) - n_mine * (rate - base)
            if evidence >= EVIDENCE * math.sqrt(n_mine):
                found.append((-round(evidence, 6), -len(wording), wording))
    return [wording for _, _, wording in sorted(found)]


def packed(wordings_: Iterable[str], size: int) -> str:
    """Content of a dictionary of at most `size` bytes, the strongest wording last."""
    kept: list[str] = []
    spent = 0
    for wording in wordings_:
        entry = " " + wording
        if any(other.startswith(entry) for other in kept):
            continue
        spent += len(entry.encode())
        if spent > size:
            break
        kept.append(entry)
    return "".join(reversed(kept))


def fit(texts: list[str], labels: np.ndarray, share: float | None = None) -> CompressionModel:
    """Both dictionaries and the weights of the thresholds from labelled texts.

    `share` is that of label 1 where the scores will be used, if the texts have another.
    """
    labels = np.asarray(labels, dtype=int)
    df = {0: Counter(), 1: Counter()}
    words: Counter = Counter()
    n = {kind: max(1, int((labels == kind).sum())) for kind in (0, 1)}
    for text, label in zip(texts, labels):
        df[label].update(wordings(text))
        if label == 0:
            words.update(set(WORD.findall(text.lower())))
    frequent = [word for word, _ in words.most_common(12_000)]
    shared, size = [], 0
    for word in frequent:
        size += len(word.encode()) + 1
        if size > SHARED:
            break
        shared.append(word)
    both = (" " + " ".join(reversed(shared))).encode().rjust(SHARED, b"\n")[-SHARED:]
    toxic = packed(marks(df[1], n[1], df[0], n[0]), OWN)
    ordinary = packed(shared, OWN)
    model = CompressionModel(
        toxic.encode().rjust(OWN, b"\n")[-OWN:] + both,
        ordinary.encode().rjust(OWN, b"\n")[-OWN:] + both)
    if len(set(labels.tolist())) < 2:
        return model
    rows = features(texts, model.compressors())
    model.weights, model.offset = _logistic(rows, labels)
    if share is not None:
        model.offset += log_odds(share) - log_odds(float(labels.mean()))
    return model


def _logistic(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, kept finite by a small ridge."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.3] * rows.shape[1] + [1e-6])
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -40, 40)))
        grade = x.T @ (labels - p) - ridge @ beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, grade)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def training_sample(docs: DataFrame, labels: DataFrame, column: str,
                    limit: int) -> tuple[pd.DataFrame, float]:
    """Labelled texts (text, label) and the share of label 1 among all that could be learned from.

    At most `limit` labelled rows for each value of the label, those with the lowest hash.

    Held-out rows (crc32 of the id modulo 5 is 0) never enter. The rows that stay are chosen by id
    alone before any text moves, so the driver gets `limit` texts of each kind and no more.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)
                     & (split_of(F.col("doc_id"), 5) != 0))
        .select("doc_id", F.col(column).cast("int").alias("label"))
        .distinct()
    )
    counts = dict(known.groupBy("label").count().collect())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = None
    for value in (0, 1):
        part = (
            known.where(F.col("label") == value)
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        )
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text")).join(
        F.broadcast(chosen), "doc_id")  # at most 2 x limit ids
    found = rows.toPandas().sort_values(["doc_id", "text"], kind="stable")
    return found.drop_duplicates("text"), share  # copies would count as evidence again and again


def log_odds(share: float) -> float:
    share = min(max(share, 1e-4), 1 - 1e-4)
    return math.log(share / (1 - share))


def classify(docs: DataFrame, model: CompressionModel, threshold: float = 0.5) -> DataFrame:
    """`docs` with score and predicted."""
    def prepare():
        compressors = model.compressors()

        def work(texts: list[str]) -> list:
            score = model.score(texts, compressors)
            return [score, (score >= threshold).astype(int)]

        return work

    return add_columns(docs, prepare, ("score", "double"), ("predicted", "int"))


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = 3_000) -> DataFrame:
    """doc_id, held_out, score, predicted. `limit`: labelled rows of each kind to learn from."""
    sample, share = training_sample(docs, labels, "toxic", limit)
    model = fit(sample["text"].tolist(), sample["label"].to_numpy(), share)
    scored = classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (split_of(F.col("doc_id"), 5) == 0).alias("held_out"),
                         "score", "predicted")
