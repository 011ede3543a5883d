"""Language identification by rank-order profiles.

A language's profile is its most frequent n-grams of one to three letters, by rank. A document's own
n-grams are ranked alike; the distance to a language is the sum of how far each n-gram is out of its
place there, and n-grams that the language does not list cost the most. The least distance wins.

Rows: one per document. Null texts and texts without a letter are `und` with score 0. Equal ranks
are ordered by the n-gram, equal distances by the language's name. Repeated rows get equal results;
extra columns are left out; an empty table gives an empty result. Without any learnable row every
document is `und`.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from breadthline.llm.common import add_columns, keep_rows, split_of

PROFILE = 400
BITS = 16  # a letter's share of an n-gram's number; letters beyond the first plane are folded


def _letters() -> np.ndarray:
    """Lower-case code point of every letter of the first plane, 0 for all that is no letter."""
    found = np.zeros(1 << BITS, dtype=np.uint16)
    for point in range(1, 1 << BITS):
        char = chr(point)
        if char.isalpha():
            lower = char.lower()
            found[point] = ord(lower) if len(lower) == 1 and ord(lower) < 1 << BITS else point
    return found


LETTERS = _letters()


def gram_numbers(text: str) -> np.ndarray:
    """Numbers of all n-grams of a text (1 to 3 letters, with one blank at each word's ends)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.where(points < 1 << BITS, LETTERS[points & 0xFFFF], 0).astype(np.uint64)
    beyond = points >= 1 << BITS
    if beyond.any():
        alphabetic = np.array([chr(p).isalpha() for p in points[beyond]])
        letters[beyond] = np.where(alphabetic, points[beyond] & 0xFFFF | 1, 0)
    padded = np.concatenate([[np.uint64(0)], letters, [np.uint64(0)]])
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)  # runs of non-letters are one blank
    run = padded[keep]
    if not run.any():
        return np.zeros(0, dtype=np.uint64)
    one = run[run != 0]
    two = run[:-1] << np.uint64(BITS) | run[1:]
    three = (two[:-1] << np.uint64(BITS) | run[2:])[run[1:-1] != 0]
    return np.concatenate([one, two | np.uint64(1 << 62), three | np.uint64(1 << 63)])


def ranked_grams(text: str) -> np.ndarray:
    """The PROFILE most frequent n-grams, most frequent first, ties by number."""
    grams, counts = np.unique(gram_numbers(text), return_counts=True)
    if len(grams) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        kept = counts >= least
        grams, counts = grams[kept], counts[kept]
    return grams[np.argsort(-counts, kind="stable")][:PROFILE]


@dataclass
class Profiles:
    names: list[str]
    grams: np.ndarray  # sorted numbers of all n-grams that any language lists
    places: np.ndarray  # languages x grams: rank, or PROFILE where it is not listed

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            mine = ranked_grams(text)
            if not len(mine) or not self.names:
                names.append("und")
                continue
            at = np.searchsorted(self.grams, mine)
            at[at == len(self.grams)] = 0
            known = self.grams[at] == mine
            cost = np.full((len(self.names), len(mine)), PROFILE, dtype=np.int64)
            out = np.abs(self.places[:, at[known]] - np.nonzero(known)[0])
            cost[:, known] = np.where(self.places[:, at[known]] == PROFILE, PROFILE, out)
            distance = cost.sum(axis=1) / (PROFILE * len(mine))
            best = int(distance.argmin())
            names.append(self.names[best])
            # A short text shares few places with any profile: its likeness says how sure it is,
            # its lead over the second language how clear the choice is.
            rest = np.delete(distance, best)
            lead = (rest.min() - distance[best]) if len(rest) else 1 - distance[best]
            scores[i] = np.clip(0.5 + lead * 4, 0, 1) if distance[best] < 1 else 0.0
        return names, scores


def learn(rows: pd.DataFrame) -> Profiles:
    """Profiles from columns text and lang."""
    profiles = {}
    for lang, part in rows.groupby("lang"):
        counts: Counter = Counter()
        for text in part["text"]:
            grams, times = np.unique(gram_numbers(text), return_counts=True)
            for gram, time in zip(grams.tolist(), times.tolist()):
                counts[gram] += time
        if counts:
            order = sorted(counts.items(), key=lambda item: (-item[1], item[0]))
            profiles[lang] = [gram for gram, _ in order[:PROFILE]]
    names = sorted(profiles)
    grams = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.uint64)
    places = np.full((len(names), len(grams)), PROFILE, dtype=np.int64)
    for row, name in enumerate(names):
        listed = np.array(profiles[name], dtype=np.uint64)
        places[row, np.searchsorted(grams, listed)] = np.arange(len(listed))
    return Profiles(names, grams, places)


def training_sample(docs: DataFrame, per_language: int) -> pd.DataFrame:
    """At most `per_language` texts of each language, lowest hash of the id first.

    Only rows that are not held out (crc32 of the id modulo 4 is 2) and have a language. Ids are
    cut down to the sample before texts are read, so the driver gets the sample only.
    """
    open_rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                           & F.col("doc_id").isNotNull() & (split_of(F.col("doc_id"), 4) != 2))
    # Counts of 1,024 ranges of the hash say in which ranges a language's sample lies. Only rows of
    # those ranges are ranked, so a language that has most rows is never dealt to one task.
    hashed = open_rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn(
        "span", F.shiftright("h", 54))
    before = W.Window.partitionBy("lang").orderBy("span").rowsBetween(
        W.Window.unboundedPreceding, -1)
    spans = (
        hashed.groupBy("lang", "span").agg(F.count("*").alias("n"))
        .withColumn("lower", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where(F.col("lower") < per_language).select("lang", "span")
    )
    near = hashed.join(spans, ["lang", "span"], "left_semi")
    order = W.Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = (
        near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
        .select("doc_id").distinct()
    )
    ids = [row[0] for row in chosen.collect()]  # languages x per_language ids at most
    return (
        open_rows.where(F.col("doc_id").isin(ids)).select("doc_id", "lang", "text")
        .dropDuplicates().toPandas().sort_values(["doc_id", "text"], kind="stable")
    )


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """`docs` with lang_pred and score."""
    return add_columns(docs, lambda: profiles.predict, ("lang_pred", "string"), ("score", "double"))


def language(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score. `per_language`: texts to learn each language from."""
    profiles = learn(training_sample(docs.select("doc_id", "lang", "text"), per_language))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select(
        "doc_id", (split_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """A step of the corpus job: rows whose language can be told, with the columns they came with.

    Rejected are null texts, texts without a letter, and texts that share no n-gram with any
    language (score 0). Profiles are learned from these rows' own `lang`, held-out rows excepted.
    """
    profiles = learn(training_sample(docs.select("doc_id", "lang", "text"), per_language))

    def work(texts: list[str]) -> list[bool]:
        names, scores = profiles.predict(texts)
        return [name != "und" and score > 0 for name, score in zip(names, scores)]

    return keep_rows(docs, lambda: work)
