"""Toxicity score: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashes of its words, of pairs of words in a row, and of pairs with one or two words between them,
each feature once a text. Learning takes one text after the other with per-coordinate rates; the L1 term leaves most weights
exactly zero, and what is left (bounded by the hash space) is sent to every task.

Learned from at most about `most` labelled rows (a documented bound; rows are taken by a hash of id, label and text) in one
task, in the order of a hash; applied to every whole text. Rates and penalties were chosen by cross_validate on learning rows.

Defined results: null and empty texts have no feature but the intercept; without labels of both kinds the score is the share
of label 1 (one half without labels); labels other than 0 and 1, and null, are left out; several labels of one id, and several
texts, count each, rows alike in id, label and text once; a column score of the caller is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import labelled_texts, per_text

HASH_BITS, SKIPS = 22, (0, 1, 2)
MOST_WORDS, BLOCK_WORDS = 200_000, 1 << 18
_WORD = re.compile(r"\w+")


class Hashed:
    """Feature numbers of a text; word hashes are remembered in a bounded store."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        h = self.known.get(word)
        if h is None:
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            h = self.known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h

    def features(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.lower()) if text else []
        parts = []
        for at in range(0, len(words), BLOCK_WORDS):
            block = words[at : at + BLOCK_WORDS + max(SKIPS) + 1]
            h = np.fromiter(map(self._word, block), np.uint64, len(block))
            own = [h * np.uint64(0x9E3779B97F4A7C15)]
            for skip in SKIPS:
                if len(h) > skip + 1:
                    own.append((h[: -skip - 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[skip + 1 :] * np.uint64(0x165667B19E3779F9) ^ np.uint64((skip + 1) * 0x27D4EB2F)) * np.uint64(0x9E3779B97F4A7C15))
            parts.append(np.unique(np.concatenate(own) >> np.uint64(64 - HASH_BITS)))
        return np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.zeros(0, np.int64)


def train(rows: list[tuple[np.ndarray, int]], alpha: float = 4.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, their weights, and the intercept."""
    share = float(np.mean([y for _, y in rows])) if rows else 0.5
    if share in (0.0, 1.0) or not rows:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share)))
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    zb = nb = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    start = float(np.log(share / (1 - share)))
    for _ in range(epochs):
        for x, y in rows:
            w = weights(z[x], n[x])
            b = start - zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - sigma * w
            n[x] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * (b - start)
            nb += g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept], start - zb / ((beta + nb**0.5) / alpha)


def cross_validate(rows: list[tuple[np.ndarray, int]], settings: list[dict], folds: int = 3) -> list[tuple[float, dict]]:
    """(mean log loss of rows left out, setting) of each setting of train, the best first; row i is left out of fold i % folds."""
    out = []
    for setting in settings:
        loss = 0.0
        for fold in range(folds):
            kept, w, b = train([r for i, r in enumerate(rows) if i % folds != fold], **setting)
            dense = np.zeros(1 << HASH_BITS, np.float32)
            dense[kept] = w
            for i in range(fold, len(rows), folds):
                x, y = rows[i]
                loss += float(np.logaddexp(0, -(2 * y - 1) * np.clip(dense[x].sum() + b, -35, 35)))
        out.append((loss / max(1, len(rows)), setting))
    return sorted(out, key=lambda r: r[0])


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = 12000) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from rows outside the held-out fold. One task holds the feature numbers of at most about `most` texts."""
    def make():
        hashed = Hashed()
        return lambda text: (hashed.features(text).astype(np.int32),)

    rows = labelled_texts(docs, labels, label_col, held_out(), most, 17).select("doc_id", "mark", per_text(make, "x array<int>")(F.col("text"))["x"].alias("x"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(r.doc_id, r.mark, np.asarray(r.x, np.int64)) for batch in batches for r in batch.itertuples()]
        held.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1], len(r[2]), r[2].tobytes()))
        kept, w, b = train([(x, y) for _, y, x in held])
        yield pd.DataFrame({"x": [kept], "w": [w], "b": [b]})

    model = rows.repartition(1).mapInPandas(fit, "x array<long>, w array<double>, b double").collect()
    if not model:
        return train([])
    return np.array(model[0]["x"], np.int64), np.array(model[0]["w"]), model[0]["b"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text") -> DataFrame:
    """docs with score, the probability of label 1."""
    kept, own, intercept = model

    def make():
        hashed = Hashed()
        w = np.zeros(1 << HASH_BITS, np.float32)
        w[kept] = own

        def one(text: str | None) -> tuple:
            total = float(w[hashed.features(text)].sum()) + intercept
            return (float(1 / (1 + np.exp(-np.clip(total, -35, 35)))),)

        return one

    return docs.withColumn("score", per_text(make, "score double")(F.col(text_col))["score"])


LEAST = 0.3


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
