"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k edits, cut into k + 1 pieces, has at least one piece there unchanged. So each
item is split into error-budget-plus-one pieces, all pieces are found in one pass over the text by an Aho-Corasick automaton,
and each hit is verified by Myers' bit-parallel distance over the stretch of text in which the item could lie. The search is
exact for the budget: every occurrence with at most k edits is found.

Items and texts are compared as lower-case letters and digits with single spaces between words. The budget of an item is one
edit in `per_edit` characters, less one, so pieces have that length at least and chance hits stay rare; items too short for
an edit match as whole words only. Items without a letter or digit never match.

The items are sent to every task if they take at most MOST_BYTES (a checked bound); beyond it they are dealt into groups of at
most that size, and the texts are passed over once for each group.

Defined results: null and empty texts match nothing; null items are left out; items equal after folding match alike, each
under its own id; an occurrence at several places counts once, at its first best end; repeated doc_ids give a row each; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import per_text

MOST_BYTES = 32 << 20
PER_EDIT = 12
_APART = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Lower-case words joined by single spaces."""
    return _APART.sub(" ", text.lower()).strip() if text else ""


def budget(item: str, per_edit: int = PER_EDIT) -> int:
    return max(0, len(item) // per_edit - 1)


def split(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their offsets."""
    bounds = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


class Myers:
    """Distance of a pattern to the best substring that ends at each place of a text."""

    def __init__(self, pattern: str) -> None:
        self.length = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the first best occurrence with at most `most` edits."""
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        up, down, score = full, 0, self.length
        found: tuple[int, int] | None = None
        for i, c in enumerate(text):
            eq = self.masks.get(c, 0)
            x = eq | down
            d = (((x & up) + up) ^ up) | x
            rise, fall = down | (full & ~(d | up)), up & d
            if rise & top:
                score += 1
            elif fall & top:
                score -= 1
            # text may begin anywhere: nothing is carried into the lowest bit
            rise, fall = full & (rise << 1), full & (fall << 1)
            up, down = fall | (full & ~(x | rise)), rise & x
            if score <= most and (found is None or score < found[0]):
                found = (score, i + 1)
                if not score:
                    break
        return found


class Matcher:
    """Automaton over the pieces of a group of items (id, folded text)."""

    def __init__(self, items: list[tuple[int, str]], per_edit: int = PER_EDIT) -> None:
        self.by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            self.by_text.setdefault(text, []).append(item_id)
        self.texts = list(self.by_text)
        self.budgets = [budget(t, per_edit) for t in self.texts]
        self.patterns: dict[int, Myers] = {}
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.texts):
            for offset, piece in split(t, self.budgets[k]):
                owners.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, end in the folded text, budget) of each item that occurs."""
        if not text or not self.texts:
            return
        stretches: dict[int, list[list[int]]] = {}
        for end, (length, own) in self.automaton.iter(text):
            for k, offset in own:
                start, e = end + 1 - length - offset, self.budgets[k]
                low, high = max(0, start - e), min(len(text), start + len(self.texts[k]) + e)
                spans = stretches.setdefault(k, [])
                if spans and low <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(low, spans[-1][0]), max(high, spans[-1][1])
                else:
                    spans.append([low, high])
        for k, spans in stretches.items():
            item, e = self.texts[k], self.budgets[k]
            best: tuple[int, int] | None = None
            at = text.find(item) if e else f" {text} ".find(f" {item} ")
            if at >= 0:
                best = (0, at + len(item))
            elif e:
                pattern = self.patterns.setdefault(k, Myers(item))
                for low, high in spans:
                    hit = pattern.best(text[low:high], e if best is None else best[0] - 1)
                    if hit is not None:
                        best = (hit[0], low + hit[1])
            if best is not None:
                for item_id in self.by_text[item]:
                    yield item_id, best[0], best[1], e


def folded_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in groups of at most MOST_BYTES, each read from the table when its turn comes."""
    rows = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    groups = max(1, -(-2 * size // MOST_BYTES))
    for g in range(groups):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g).collect()
        yield sorted({(r["id"], t) for r in own if (t := fold(r["text"]))})


def matches(docs: DataFrame, benchmark: DataFrame, per_edit: int = PER_EDIT) -> DataFrame:
    """Rows (doc_id, item_id, distance, end, budget): each item that occurs in each text; end counts folded characters."""
    out: DataFrame | None = None
    for items in folded_items(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, per_edit)
            for batch in batches:
                rows: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    for hit in matcher.find(fold(text.as_py())):
                        for column, value in zip(rows, (doc_id.as_py(), *hit), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "distance", "end", "budget"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, distance int, end long, budget int")
        out = found if out is None else out.unionByName(found)
    return out


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each item found in each document: doc_id, item_id, distance, budget. Clean documents have none."""
    return matches(docs, benchmark).select("doc_id", "item_id", "distance", "budget")


def keep_clean(docs: DataFrame, benchmark: DataFrame, per_edit: int = PER_EDIT) -> DataFrame:
    """The rows of docs in which no item occurs, with the columns of docs."""
    out = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    for items in folded_items(benchmark):

        def make(items: list = items):
            matcher = Matcher(items, per_edit)
            return lambda text: (next(matcher.find(fold(text)), None) is None,)

        out = out.where(per_text(make, "clean boolean")(F.col("text"))["clean"])
    return out.select("row.*")
