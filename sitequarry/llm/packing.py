"""Sum-of-squares online packing of token documents into windows.

Each task packs the documents of its partition as they come. An array counts the open windows of each fill level; what is left of
a document after its whole windows goes to the level that makes the sum of the squared counts smallest (an open window, or a new
one; of equal ones the fullest). Full windows are written at once. Open windows hold their ids; when they are too many, and at
the end of a partition, the emptiest are poured into the fullest, cut where needed, until one is left. Those last windows of all
partitions are packed in the same way by few tasks, so that one window in many is padded. Texts are never shuffled.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are packed like any other row; a text of
many windows has one piece in each and one for the rest; an empty table gives no rows; other columns are ignored. Piece boundaries
depend on the partitions the table is read in, ids don't.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import cut

WINDOW, END_ID = 2048, 1
#: Open windows that a task holds at most (their ids: 8 KB each), and last windows that one task of the second round packs.
MOST_OPEN, MOST_LAST = 2048, 2048
END = END_ID.to_bytes(4, "little")
#: Fixed value: how byte-level tokenizers cut a text before they merge.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("last", pa.bool_())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, last boolean"


def _byte_of() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones for themselves, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """A byte-level tokenizer file (vocabulary and merges) as ranks, which give the same ids in a third of the time; special strings of the file keep their ids.

    Ids must be ranks: the result of the k-th merge is the next id. That is checked, as is the kind of the file.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
    byte, special = _byte_of(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = spec["model"]["vocab"]
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    made = [vocabulary[a + b] for a, b in pairs]
    if made != list(range(made[0], made[0] + len(made))) if made else False:
        raise ValueError(f"{path}: ids don't follow the merges")
    return tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)


def ids_of(own: tiktoken.Encoding, text: str | None) -> bytes:
    """Packed ids of a text, the end id behind them."""
    return own.encode_to_numpy(text or "", allowed_special="all").astype("<u4").tobytes() + END


_NEVER = np.iinfo(np.int64).max // 2


class Packer:
    """Open windows by fill level; full ones go to `emit` as lists of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN) -> None:
        self.window, self.most_open = window, most_open
        #: The level array: open windows of each fill level. Levels 0 and `window` are no open windows and stay 0.
        self.count = np.zeros(window + 1, np.int64)
        #: What the sum of squares gains if a window leaves this level, where there is one, and if one comes to it; full windows don't count.
        self.leaves, self.comes = np.full(window + 1, _NEVER), np.ones(window + 1, np.int64)
        self.comes[window] = 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def level(self, size: int) -> int:
        """The fill level that makes the sum of squared counts smallest once a piece of `size` is added, of equal ones the fullest; 0 is a new window."""
        change = self.leaves[1 : self.window - size + 1] + self.comes[size + 1 :]
        if not len(change):
            return 0
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= self.comes[size] else 0

    def _counted(self, fill: int, by: int) -> None:
        c = self.count[fill] + by
        self.count[fill] = c
        self.leaves[fill] = 1 - 2 * c if c else _NEVER
        self.comes[fill] = 2 * c + 1
        self.n_open += by

    def _put(self, pieces: list, fill: int) -> list | None:
        if fill == self.window:
            return pieces
        self.open[fill].append(pieces)
        self._counted(fill, 1)
        return None

    def _take(self, fill: int) -> list:
        self._counted(fill, -1)
        return self.open[fill].pop()

    def add(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> Iterator[list]:
        """Places a run of ids; gives the windows that are full by that."""
        w = 4 * self.window
        for at in range(0, len(ids) - len(ids) % w, w):
            yield [(doc_id, start + at // 4, ids[at : at + w], doc_tokens)]
        rest = ids[len(ids) - len(ids) % w :]
        if rest:
            size = len(rest) // 4
            level = self.level(size)
            pieces = self._take(level) if level else []
            pieces.append((doc_id, start + (len(ids) - len(rest)) // 4, rest, doc_tokens))
            full = self._put(pieces, level + size)
            if full:
                yield full
        if self.n_open > self.most_open:
            yield from self.pour()

    def pour(self) -> Iterator[list]:
        """Pours the emptiest windows into the fullest until at most one is open; gives the full ones."""
        order = [(fill, p) for fill in range(self.window - 1, 0, -1) for p in self.open[fill]]
        for fill, own in enumerate(self.open):
            if own:
                self._counted(fill, -len(own))
                self.open[fill] = []
        low, high = 0, len(order) - 1
        while low < high:
            (fill, to), (left, source) = order[low], order[high]
            doc_id, start, ids, doc_tokens = source.pop()
            moved = min(self.window - fill, len(ids) // 4)
            keep = len(ids) // 4 - moved
            to.append((doc_id, start + keep, ids[4 * keep :], doc_tokens))
            if keep:
                source.append((doc_id, start, ids[: 4 * keep], doc_tokens))
            order[low], order[high] = (fill + moved, to), (left - moved, source)
            if fill + moved == self.window:
                yield to
                low += 1
            if left == moved:
                high -= 1
        if low == high:
            self._put(order[low][1], order[low][0])

    def rest(self) -> list | None:
        return next((w for level in self.open for w in level), None)


def _rows(full: Iterable[tuple[int, list, bool]], with_ids: bool, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows of windows (sequence id, pieces, whether it is the last one of its partition)."""
    columns: list[list] = [[] for _ in _SCHEMA]

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)
        for c in columns:
            c.clear()
        return out

    for number, pieces, last in full:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            size = len(ids) // 4
            for c, value in zip(columns, (doc_id, start, size, zlib.crc32(ids), doc_tokens, number, offset, ids if last or with_ids else None, last), strict=True):
                c.append(value)
            offset += size
        if len(columns[0]) >= (most // 50 if with_ids else most):
            yield batch()
    if columns[0]:
        yield batch()


def _packed(pieces: Iterable[tuple], first: int, window: int) -> Iterator[tuple[int, list, bool]]:
    packer, number = Packer(window), first
    for piece in pieces:
        for full in packer.add(*piece):
            yield number, full, False
            number += 1
    for full in packer.pour():
        yield number, full, False
        number += 1
    if rest := packer.rest():
        yield number, rest, True


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit) if asked for."""

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(tokenizer)

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = ids_of(own, text.as_py())
                    yield doc_id.as_py(), 0, ids, len(ids) // 4

        yield from _rows(_packed(pieces(), TaskContext.get().partitionId() << 32, window), with_ids)

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for b in batches for r in b.to_pylist())
        yield from _rows(_packed(pieces, 1 << 62 | TaskContext.get().partitionId() << 32, window), with_ids)

    once = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(first_round, _DDL))
    last = once.where("last")
    tasks = -(-last.where("offset = 0").count() // MOST_LAST)
    again = last.select("doc_id", "start", "ids", "doc_tokens").repartition(max(1, tasks)).mapInArrow(second_round, _DDL)
    out = once.where("not last").unionByName(again)
    return out.drop("last") if with_ids else out.drop("last", "ids")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Per sequence of pack(with_ids=True): sequence_id, length, ids (array, padded to the window unless its length is a power of two)."""
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.expr("array_sort(collect_list(struct(offset, ids)))").alias("parts"))
    rows = rows.withColumn("ids", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for size, ids in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                padded = size if size & (size - 1) == 0 else window
                made.append(np.concatenate([np.frombuffer(ids, "<u4").astype(np.int32), np.full(padded - size, pad_id, np.int32)]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int32()))], names=["sequence_id", "length", "ids"])

    return rows.select("sequence_id", "length", "ids").mapInArrow(unpack, "sequence_id long, length long, ids array<int>")


def op12(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs, tokenizer, with_ids=False)
