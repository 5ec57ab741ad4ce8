"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its place in the n-gram; a text's vector bundles (adds) those of all its n-grams;
a language's prototype bundles the texts of that language, each scaled to length one. A text gets the language whose
prototype has the largest cosine with its vector; ties go to the first language by name.

Prototypes are learned from at most about `most` labelled rows (a documented bound: rows are taken by a hash of id, language and
text, at a rate that follows from the number of distinct ones), prediction runs over every whole text.

Defined results: null texts, and texts without a letter, are `und` with score 0; runs of other characters count as one space;
without any labelled row everything is `und`; rows alike in id, language and text teach once; columns lang_pred and score of the
caller are replaced. Texts are worked through in blocks of BLOCK characters, each of which begins with the last symbols of the
one before, so that every n-gram of a text counts, wherever it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sitequarry.llm.common import sampled

DIMENSIONS, GRAM, BLOCK, BATCH = 1024, 3, 1 << 19, 128
SPACE = 32


def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([code, 20240607]).integers(0, 2, DIMENSIONS).astype(np.float32) * 2 - 1


class Letters:
    """Which code points are letters, and their permuted vectors; grows as letters turn up."""

    def __init__(self) -> None:
        self.kind = np.full(0x110000, -1, np.int32)  # -1 not seen, 0 no letter, else the letter's number
        self.kind[SPACE] = 0
        self.rolled: list[list[np.ndarray]] = [[] for _ in range(GRAM)]
        self._add(SPACE)  # number 0: what parts words

    def _add(self, code: int) -> None:
        v = letter_vector(code)
        for k in range(GRAM):
            self.rolled[k].append(np.roll(v, GRAM - 1 - k))

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        out = self.kind[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                if chr(code).isalpha():
                    self.kind[code] = len(self.rolled[0])
                    self._add(code)
                else:
                    self.kind[code] = 0
            out = self.kind[codes]
        return out


LETTERS: Letters | None = None


def _letters() -> Letters:
    global LETTERS
    if LETTERS is None:
        LETTERS = Letters()
    return LETTERS


def _symbols(text: str, before: int) -> np.ndarray:
    """The numbers of a lower-case text: letters, and one 0 for each run of other characters. before: the symbol ahead of it."""
    numbers = _letters().numbers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
    # of other characters, the first behind a letter
    return numbers[(numbers > 0) | (np.concatenate([[before], numbers[:-1]]) > 0)]


def _bundle(numbers: np.ndarray, own: np.ndarray, texts: int) -> np.ndarray:
    """A vector for each text, of the n-grams of numbers that lie in one text (own: whose a number is)."""
    letters = _letters()
    out = np.zeros((texts, DIMENSIONS), np.float32)
    if len(numbers) < GRAM:
        return out
    used = np.bincount(numbers, minlength=1)
    local = np.flatnonzero(used)
    place = np.zeros(len(used), np.int64)
    place[local] = np.arange(len(local))
    s, size = place[numbers], len(local)
    grams = s[: len(s) - GRAM + 1].copy()
    for k in range(1, GRAM):
        grams = grams * size + s[k : len(s) - GRAM + 1 + k]
    whole = own[: len(own) - GRAM + 1] == own[GRAM - 1 :]
    grams, rows = grams[whole], own[: len(own) - GRAM + 1][whole]
    if not len(grams):
        return out
    if size**GRAM <= 1 << 24:
        seen = np.bincount(grams, minlength=size**GRAM)
        kinds = np.flatnonzero(seen)
        index = np.zeros(size**GRAM, np.int64)
        index[kinds] = np.arange(len(kinds))
        column = index[grams]
    else:
        kinds, column = np.unique(grams, return_inverse=True)
    for start in range(0, len(kinds), 16384):
        stop = min(len(kinds), start + 16384)
        vectors = np.ones((stop - start, DIMENSIONS), np.float32)
        rest = kinds[start:stop]
        for k in reversed(range(GRAM)):
            table = np.stack([letters.rolled[k][n] for n in local])
            vectors *= table[rest % size]
            rest = rest // size
        inside = (column >= start) & (column < stop)
        counts = np.bincount(rows[inside] * (stop - start) + column[inside] - start, minlength=texts * (stop - start)).reshape(texts, -1)
        out += counts.astype(np.float32) @ vectors
    return out


def bundles(texts: list[str]) -> np.ndarray:
    """A vector for each text, which begins and ends with a space; zero where it has no letter."""
    lowered = [t.lower() for t in texts]
    numbers = _letters().numbers(np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4"))
    own = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    # keep letters, and the first of a run of other characters behind a letter; each text ends with one
    keep = numbers > 0
    keep[1:] |= (numbers[1:] == 0) & (numbers[:-1] > 0)
    numbers, own = numbers[keep], own[keep]
    if not len(numbers):
        return np.zeros((len(texts), DIMENSIONS), np.float32)
    # and each starts with one: a text's first letter follows the space that ends the text before, or the start
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return _bundle(np.insert(numbers, first, 0), np.insert(own, first, own[first]), len(texts))


def long_bundle(text: str, block: int = BLOCK) -> np.ndarray:
    """The vector of one text, block by block: each block starts with the last symbols of the one before."""
    text = text.lower()
    total = np.zeros(DIMENSIONS, np.float64)
    carried = np.zeros(1, np.int64)
    for at in range(0, len(text), block):
        piece = text[at : at + block] + (" " if at + block >= len(text) else "")
        numbers = np.concatenate([carried, _symbols(piece, int(carried[-1]))])
        total += _bundle(numbers, np.zeros(len(numbers), np.int64), 1)[0]
        carried = numbers[1 - GRAM :]
    return total


def vectors(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(position, vector) of each text, a bounded number of characters at a time."""
    batch: list[str] = []
    places: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        text = text or ""
        if len(text) > BLOCK:
            yield i, long_bundle(text)
            continue
        batch.append(text)
        places.append(i)
        held += len(text)
        if len(batch) >= BATCH or held >= BLOCK:
            yield from zip(places, bundles(batch), strict=True)
            batch, places, held = [], [], 0
    if batch:
        yield from zip(places, bundles(batch), strict=True)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = 6000) -> dict[str, np.ndarray]:
    """Prototypes of unit length by language. The driver gets one vector for each language and each of 8 partitions."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = sampled(rows.withColumn("key", F.xxhash64("text")), ["id", "lang", "key"], most, 11)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].tolist()
            for i, v in vectors(batch["text"].tolist()):
                length = np.linalg.norm(v)
                if length:
                    sums[langs[i]] = sums.get(langs[i], 0) + v / length
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.astype(np.float64) for v in sums.values()]})

    parts = rows.repartition(8, "id", "key").mapInPandas(add, "lang string, v array<double>").collect()
    total: dict[str, np.ndarray] = {}
    for r in sorted(parts, key=lambda r: (r["lang"], r["v"])):
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["v"])
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(total.items()) if np.linalg.norm(v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the cosine (0 where it is negative)."""
    names = list(prototypes)
    matrix = np.stack(list(prototypes.values())) if names else np.zeros((0, DIMENSIONS), np.float32)

    @pandas_udf("struct<lang_pred string, score double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            for i, v in vectors(texts.tolist()):
                length = float(np.linalg.norm(v))
                if length and names:
                    cosines = matrix @ v / length
                    best = int(np.argmax(cosines))
                    langs[i], scores[i] = names[best], float(min(1.0, max(0.0, cosines[best])))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    out = docs.withColumn("_lang", run(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col("_lang.lang_pred"), "score": F.col("_lang.score")}).drop("_lang")


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    prototypes = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """The rows of docs whose language is identified with at least this cosine, with the columns of docs.

    Texts of a few dozen words in a learned language have cosines of 0.5 and more, single words 0.1; what is rejected has no letters or none of a known shape.
    """
    prototypes = learn(docs.where(~held_out()))
    return predict(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), prototypes).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
