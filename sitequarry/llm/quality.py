"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on the statistics of labelled rows (boosted, small depth); every path from a root to a node becomes a rule, a
conjunction of thresholds. A logistic regression with lasso penalty over the rules (and the winsorised statistics) keeps few
of them, and those are compiled into one Spark column expression over the statistics' columns.

Learned from at most about `most` labelled rows (a documented bound; rows are taken by a hash of id, label and text), applied
to every whole text.

Defined results: null and empty texts have all statistics 0 and are scored like any other; if no row is labelled, or all
alike, the score is the share of label 1 (one half without labels); labels other than 0 and 1, and null, are left out; several
labels of one id, and several texts, count each, rows alike in id, label and text once; columns stats and score of the caller
are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sitequarry.llm.common import labelled_texts

_UPPER, _LOWER, _DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_SPACE = b" \t\n\r\x0b\x0c"
_STOPS = b".,;:?"
_MARKS = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGITS + _STOPS + b"'\"-()")
#: Statistics of a text, in order.
STATS = ("log_words", "mean_word", "upper_share", "digit_share", "stop_share", "mark_share", "distinct_share", "repeat_share", "line_words", "top_word_share", "high_share", "marked_words", "shout_words")


def statistics(text: str | None) -> tuple[float, ...]:
    """STATS of one text, over the whole of it."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (0.0,) * len(STATS)
    size, n = len(data), len(words)
    letters = size - len(data.translate(None, _SPACE))
    solid = size - letters
    count = lambda kinds: size - len(data.translate(None, kinds))
    kinds = Counter(words)
    distinct, top = len(kinds) / n, max(kinds.values()) / n
    repeats = sum(map(eq, words, islice(words, 1, None))) / n
    lines = data.count(b"\n") + 1
    marked = sum(w[-1] in _MARKS for w in words)
    shout = sum(len(w) > 1 and w.isupper() for w in words)
    high = len(data) - len(data.decode("utf-8", "surrogatepass"))
    return (
        float(np.log1p(n)), solid / n, count(_UPPER) / solid, count(_DIGITS) / solid, count(_STOPS) / solid, count(_MARKS) / solid,
        distinct, repeats, float(np.log1p(n / lines)), top, high / solid, marked / n, shout / n,
    )


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column stats."""

    @pandas_udf("struct<" + ", ".join(f"{s} double" for s in STATS) + ">")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=list(STATS))

    return docs.withColumn("stats", run(F.col(text_col)))


#: A condition: statistic, whether above, threshold. A rule: its conditions, all of which hold.
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]


def grow(x: np.ndarray, residual: np.ndarray, depth: int, least: int, path: Rule = ()) -> list[tuple[Rule, np.ndarray]]:
    """Rules of one regression tree: every node but the root, with the rows that reach it."""
    n = len(residual)
    if depth == 0 or n < 2 * least:
        return []
    best = (1e-9, -1, 0.0)
    base = residual.sum() ** 2 / n
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, r = x[order, j], np.cumsum(residual[order])
        k = np.arange(1, n)
        gain = r[:-1] ** 2 / k + (r[-1] - r[:-1]) ** 2 / (n - k) - base
        gain[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = -1
        i = int(np.argmax(gain)) if n > 1 else 0
        if n > 1 and gain[i] > best[0]:
            best = (float(gain[i]), j, float((v[i] + v[i + 1]) / 2))
    if best[1] < 0:
        return []
    above = x[:, best[1]] > best[2]
    out = []
    for side in (True, False):
        rule = (*path, (STATS[best[1]], side, best[2]))
        rows = above == side
        out.append((rule, rows))
        for deeper, inner in grow(x[rows], residual[rows], depth - 1, least, rule):
            full = np.zeros(n, bool)
            full[np.flatnonzero(rows)[inner]] = True
            out.append((deeper, full))
    return out


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    """Rules of boosted trees, each tree grown on a half of the rows."""
    rng = np.random.default_rng(8)
    score = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        half = rng.permutation(len(y))[: max(2, len(y) // 2)]
        found = grow(x[half], (y - p)[half], depth, max(3, len(y) // 400))
        leaves = [r for r, _ in found if not any(len(s) > len(r) and s[: len(r)] == r for s, _ in found)]
        for rule in leaves:
            rows = holds(rule, x)
            if rows.any():
                w = np.maximum(p[rows] * (1 - p[rows]), 1e-6).sum()
                score[rows] += rate * np.clip((y - p)[rows].sum() / w, -4, 4)
        rules.update(dict.fromkeys(r for r, _ in found))
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, at in rule:
        v = x[:, STATS.index(name)]
        out &= (v > at) if above else (v <= at)
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty on the weights, by accelerated proximal steps."""
    n, m = z.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v = np.ones(m) / max(1, m) ** 0.5
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * (np.linalg.norm(z @ v) ** 2 / n + 1) + 1e-9)
    ahead, ahead_b, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ ahead + ahead_b))) - y
        new = ahead - step * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = ahead_b - step * error.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


class RuleModel:
    """Weighted rules and winsorised linear terms (statistic, low, high, scale)."""

    def __init__(self, intercept: float, rules: list[tuple[float, Rule]], terms: list[tuple[float, str, float, float]]) -> None:
        self.intercept, self.rules, self.terms = intercept, rules, terms

    def column(self, stats: Column) -> Column:
        """The probability of label 1 as one expression over the statistics."""
        total: Column = F.lit(self.intercept)
        for weight, rule in self.rules:
            test = F.lit(True)
            for name, above, at in rule:
                test = test & ((stats[name] > at) if above else (stats[name] <= at))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        for weight, name, low, high in self.terms:
            total = total + weight * F.greatest(F.lit(low), F.least(F.lit(high), stats[name]))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.0015) -> RuleModel:
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return RuleModel(float(np.log(share / (1 - share))), [], [])
    rules = extract_rules(x, y)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    spread = clipped.std(axis=0)
    linear = np.flatnonzero(spread > 1e-9)
    z = np.concatenate([np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0)), 0.4 * (clipped[:, linear] - clipped[:, linear].mean(axis=0)) / spread[linear]], axis=1)
    w, b = lasso(z, y.astype(float), penalty)
    kept = [(float(w[i]), r) for i, r in enumerate(rules) if w[i]]
    terms = []
    for k, j in enumerate(linear):
        if weight := 0.4 * float(w[len(rules) + k]) / float(spread[j]):
            terms.append((weight, STATS[j], float(low[j]), float(high[j])))
            b -= weight * float(clipped[:, j].mean())
    return RuleModel(float(b), kept, terms)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = 12000) -> RuleModel:
    """A model of rows outside the held-out fold. The driver gets the statistics of at most about `most` rows."""
    rows = with_statistics(labelled_texts(docs, labels, label_col, held_out(), most)).select("doc_id", "mark", "stats.*").collect()
    rows.sort()
    return fit(np.array([r[2:] for r in rows], float).reshape(len(rows), len(STATS)), np.array([r[1] for r in rows], int))


def score(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """docs with score, the probability of label 1."""
    return with_statistics(docs, text_col).withColumn("score", model.column(F.col("stats"))).drop("stats")


LEAST = 0.3


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier predicts to be good, with the columns of docs."""
    return score(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), learn(docs, labels)).where(F.col("score") >= LEAST).select("row.*")
