"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

Each byte is a symbol that also tells whether its surroundings repeat what stands shortly before.
Symbols are embedded, learned filters of 16 bytes slide over the text by 4, and every overlapping
chunk of 512 bytes (a new one each 256) keeps the strongest answer of each filter. The chunks cover
the whole text. Means and maxima of the chunks' answers are combined into one probability.

Rows: one per document. Null and empty texts are a chunk of padding and get the score of that.
Repeated rows get equal scores; extra columns are left out; an empty table gives an empty result.
Without labels every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breadthline.llm.common import add_columns, split_of
from breadthline.llm.toxicity import log_odds, training_sample

EMBED = 8
STRIDE = 4
WIDTH = 4  # filter width in strides: 16 bytes
FILTERS = 32
HALF = 256  # bytes of half a chunk
STEPS = HALF // STRIDE
LAGS = range(3, 25)  # bytes back at which a repetition counts
NAMES = ("embed", "filters", "bias", "mix", "mix_bias", "out", "out_bias")


@dataclass
class Network:
    embed: np.ndarray  # 512 x EMBED: bytes as such, then bytes of a repetition
    filters: np.ndarray  # STRIDE * EMBED x WIDTH * FILTERS
    bias: np.ndarray  # FILTERS
    mix: np.ndarray  # 2 FILTERS x 16
    mix_bias: np.ndarray
    out: np.ndarray  # 16
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        plain = normal(0.5, 256, EMBED)
        return cls(
            np.vstack([plain, plain + normal(0.3, 1, EMBED)]),
            normal(0.12, STRIDE * EMBED, WIDTH * FILTERS),
            np.zeros(FILTERS, np.float32), normal(0.2, 2 * FILTERS, 16),
            np.zeros(16, np.float32), normal(0.3, 16), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in NAMES]


def blocks_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each padded with zeros to whole half chunks, and the halves of each.

    At least as many zeros follow a text as filters and repetitions reach: neighbours in a batch
    have no part in each other's score.
    """
    raw = [t.encode() for t in texts]
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    halves = -(-(lengths + max(LAGS)) // HALF)
    data = b"".join(r.ljust(int(h) * HALF, b"\0") for r, h in zip(raw, halves))
    return symbols(np.frombuffer(data, dtype=np.uint8)), halves


def symbols(data: np.ndarray) -> np.ndarray:
    """The byte, plus 256 where the four bytes from here on also stand 3 to 24 bytes before."""
    found = data.astype(np.uint16)
    if len(data) < 8:
        return found
    four = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        four |= data[k:len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    again = np.zeros(len(four), dtype=bool)
    for lag in LAGS:
        again[lag:] |= four[lag:] == four[:-lag]
    again &= four != 0
    found[:len(again)] += again.astype(np.uint16) << 8
    return found


def _answers(net: Network, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter answers at each stride, steps x FILTERS, and the embedded bytes.

    The answer at a step is the sum of WIDTH products, one for each stride it covers; one matrix
    product gives all of them, and shifted sums put them together.
    """
    x = net.embed[data].reshape(-1, STRIDE * EMBED)
    parts = (x @ net.filters).reshape(len(x), WIDTH, FILTERS)
    total = parts[:, 0].copy()
    for shift in range(1, WIDTH):
        total[:-shift] += parts[shift:, shift]
    return total, x


def _inside(shaped: np.ndarray, halves: np.ndarray, start: int = 0) -> np.ndarray:
    """Takes out the steps at each text's end whose filters reach into the text after it.

    They begin in the padding, so nothing of the text is lost.
    """
    ends = np.cumsum(halves) - 1 - start
    ends = ends[(ends >= 0) & (ends < len(shaped))]
    shaped[ends, STEPS - WIDTH + 1:] = -1e9
    return shaped


def _chunks(top: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Each half together with the next one of the same text: chunks that overlap by half."""
    last = np.zeros(len(top), dtype=bool)
    last[np.cumsum(halves) - 1] = True
    following = np.vstack([top[1:], top[-1:]])
    return np.where(last[:, None], top, np.maximum(top, following))


def _document(net: Network, top: np.ndarray, halves: np.ndarray) -> np.ndarray:
    chunks = np.maximum(_chunks(top, halves), 0)
    firsts = np.cumsum(halves) - halves
    mean = np.add.reduceat(chunks, firsts, axis=0) / halves[:, None]
    return np.hstack([mean, np.maximum.reduceat(chunks, firsts, axis=0)])


def _probability(net: Network, rows: np.ndarray) -> np.ndarray:
    hidden = np.maximum(rows @ net.mix + net.mix_bias, 0)
    logit = np.clip(hidden @ net.out + net.out_bias, -30, 30)
    # Matrix products of other shapes differ in the last bits; equal texts have equal scores.
    return np.round(1 / (1 + np.exp(-logit.astype(np.float64))), 6)


def score(net: Network, texts: list[str], run: int = 1_024) -> np.ndarray:
    """Probability of each text; answers are computed `run` half chunks at a time."""
    if not texts:
        return np.zeros(0)
    data, halves = blocks_of(texts)
    count = len(data) // HALF
    top = np.empty((count, FILTERS), dtype=np.float32)
    reach = (WIDTH - 1) * STRIDE
    for start in range(0, count, run):
        stop = min(count, start + run)
        part = data[start * HALF:stop * HALF + reach]
        padded = np.zeros((stop - start) * HALF + reach, dtype=data.dtype)
        padded[:len(part)] = part
        total, _ = _answers(net, padded)
        total = total[:(stop - start) * STEPS]
        shaped = _inside(total.reshape(-1, STEPS, FILTERS), halves, start)
        top[start:stop] = shaped.max(axis=1) + net.bias
    return _probability(net, _document(net, top, halves))


def _gradients(net: Network, texts: list[str], labels: np.ndarray,
               weight: np.ndarray) -> list[np.ndarray]:
    data, halves = blocks_of(texts)
    total, x = _answers(net, data)
    shaped = _inside(total.reshape(-1, STEPS, FILTERS), halves)
    where = shaped.argmax(axis=1)
    top = np.take_along_axis(shaped, where[:, None], axis=1)[:, 0] + net.bias
    last = np.zeros(len(top), dtype=bool)
    last[np.cumsum(halves) - 1] = True
    following = np.vstack([top[1:], top[-1:]])
    from_next = ~last[:, None] & (following > top)
    chunks = np.maximum(np.where(from_next, following, top), 0)
    firsts = np.cumsum(halves) - halves
    owner = np.repeat(np.arange(len(texts)), halves)
    mean = np.add.reduceat(chunks, firsts, axis=0) / halves[:, None]
    most = np.maximum.reduceat(chunks, firsts, axis=0)
    rows = np.hstack([mean, most])
    before = rows @ net.mix + net.mix_bias
    hidden = np.maximum(before, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))

    d_logit = (weight * (p - labels) / len(texts)).astype(np.float32)
    d_out, d_out_bias = hidden.T @ d_logit, d_logit.sum(keepdims=True)
    d_before = np.outer(d_logit, net.out) * (before > 0)
    d_mix, d_mix_bias = rows.T @ d_before, d_before.sum(axis=0)
    d_rows = d_before @ net.mix.T
    d_chunks = (d_rows[:, :FILTERS] / halves[:, None])[owner]
    # Neighbouring chunks share a half, so the largest answer may stand in two: the first counts.
    largest = chunks == most[owner]
    so_far = np.cumsum(largest, axis=0)
    so_far -= (so_far[firsts] - largest[firsts])[owner]
    d_chunks = d_chunks + np.where(largest & (so_far == 1), d_rows[:, FILTERS:][owner], 0)
    d_chunks = np.where(chunks > 0, d_chunks, 0)
    d_top = np.where(from_next, 0, d_chunks)
    d_top[1:] += np.where(from_next, d_chunks, 0)[:-1]
    d_total = np.zeros_like(shaped)
    np.put_along_axis(d_total, where[:, None], d_top[:, None].astype(np.float32), axis=1)
    d_total = d_total.reshape(-1, FILTERS)
    d_parts = np.zeros((len(x), WIDTH, FILTERS), dtype=np.float32)
    d_parts[:, 0] = d_total
    for shift in range(1, WIDTH):
        d_parts[shift:, shift] = d_total[:-shift]
    d_parts = d_parts.reshape(len(x), -1)
    d_filters = x.T @ d_parts
    d_x = (d_parts @ net.filters.T).reshape(-1, EMBED)
    d_embed = np.stack(
        [np.bincount(data, weights=d_x[:, k], minlength=512) for k in range(EMBED)], axis=1)
    return [d_embed.astype(np.float32), d_filters, d_top.sum(axis=0).astype(np.float32), d_mix,
            d_mix_bias, d_out, d_out_bias]


def fit(texts: list[str], labels: np.ndarray, share: float | None = None, steps: int = 700,
        batch: int = 24, crop: int = 4_096, seed: int = 7) -> Network:
    """Trains on batches of both kinds alike; of a long text each step sees `crop` characters.

    Cropping is for training only: a random part of a text keeps the text's label. Scores are
    shifted back to `share`, that of label 1 where they will be used.
    """
    net = Network.fresh(seed)
    labels = np.asarray(labels, dtype=np.float32)
    groups = [np.nonzero(labels == kind)[0] for kind in (0, 1)]
    if not len(groups[0]) or not len(groups[1]):
        net.out[:] = 0
        return net
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(g, batch // 2) for g in groups])
        part = []
        for i in chosen:
            text = texts[i]
            start = int(rng.integers(0, max(1, len(text) - crop + 1)))
            part.append(text[start:start + crop])
        grads = _gradients(net, part, labels[chosen], np.ones(len(chosen), np.float32))
        rate = 0.004 * min(1.0, step / 50) * (0.1 + 0.9 * (1 - step / steps))
        for p, g, (m, v) in zip(net.parameters(), grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    share = len(groups[1]) / len(labels) if share is None else share
    net.out_bias += np.float32(np.clip(log_odds(share), -2, 2))
    return net


def classify(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """`docs` with score and predicted."""
    def work(texts: list[str]) -> list:
        found = score(net, texts)
        return [found, (found >= threshold).astype(int)]

    return add_columns(docs, lambda: work, ("score", "double"), ("predicted", "int"))


def quality(docs: DataFrame, labels: DataFrame, limit: int = 2_000) -> DataFrame:
    """doc_id, held_out, score, predicted. `limit`: labelled rows of each kind to learn from."""
    sample, share = training_sample(docs, labels, "quality", limit)
    net = fit(sample["text"].tolist(), sample["label"].to_numpy(), share)
    scored = classify(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", (split_of(F.col("doc_id"), 5) == 0).alias("held_out"),
                         "score", "predicted")
