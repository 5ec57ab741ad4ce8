"""SentencePiece encoding and decoding with source offsets.

A text is first normalised as the model says: at each place the longest prefix that the compiled character map knows is
replaced, anything else is copied, white space is handled by the model's flags, and for every byte written the place in the
source is recorded. That normalised text, and not the source, is what is segmented: by the library's model with its own
normaliser taken out. Where no piece of the vocabulary reaches across a word mark, chunks between marks are independent and
each distinct one is segmented once a worker (the store of chunks is bounded). Piece lengths along the normalised text, looked up
in the recorded alignment, give each piece's byte span in the source. Decoding is the library's.

Defined results: null and empty texts have the begin and end ids only and decode to the empty text; pieces made of single
bytes of a character have the span of that character's part; columns of the caller with the names of the results are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from sentencepiece import sentencepiece_model_pb2

from sitequarry.llm.common import per_text

#: The mark that stands for a space (U+2581).
MARK = "▁"
#: Chunks that a worker remembers, and the longest chunk that it remembers (characters).
MOST_CHUNKS, LONGEST_CHUNK = 120_000, 64


class CharMap:
    """The compiled character map: a double-array trie over source bytes, whose values point into a block of replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix of data[at:], 0 if none, and its replacement."""
        units = self.units
        if not units:
            return 0, b""
        # A unit holds its label in the low byte, whether a value follows in bit 8, a shift of its offset in bit 9 and the offset above.
        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        length, value, place = 0, 0, offset(units[0])
        for k in range(at, len(data)):
            place ^= data[k]
            if place >= len(units) or units[place] & 0x800000FF != data[k]:
                break
            unit = units[place]
            place ^= offset(unit)
            if unit & 0x100:
                length, value = k + 1 - at, units[place] & 0x7FFFFFFF
        if not length:
            return 0, b""
        return length, self.replacements[value : self.replacements.index(b"\0", value)]


class Pieces:
    """One model: normalise, encode with spans, decode."""

    given: list[bytes] = []
    suffix = False

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            blob = file.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = proto.normalizer_spec
        self.chars = CharMap(spec.precompiled_charsmap)
        self.squeeze, self.lead, self.escape = spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        # A piece of a single byte covers that byte; any other its text.
        self.lengths = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        # Pieces given by the user are copied as they stand, the longest first.
        self.given = sorted((p.piece.encode() for p in proto.pieces if p.type == p.USER_DEFINED), key=len, reverse=True)
        inside = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        #: Chunks between marks are independent.
        self.by_words = self.lead and self.escape and not self.suffix and not inside and not self.given
        spec.precompiled_charsmap, spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces = b"", False, False, False
        #: The model over normalised text.
        self.segment = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.mark_ids = self._pack(self.segment.encode(MARK))
        self.chunks: dict[bytes, bytes] = {}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the place in the source's bytes."""
        data = text.encode("utf-8", "surrogatepass")
        mark = MARK.encode() if self.escape else b" "
        if not self.chars.units and not self.squeeze and not self.given and not self.suffix:
            # Only spaces change: each becomes a mark.
            source = np.frombuffer(data, np.uint8)
            out = (mark if self.lead and data else b"") + data.replace(b" ", mark)
            width = np.where(source == 32, len(mark), 1)
            places = np.repeat(np.arange(len(data)), width)
            lead = np.zeros(len(out) - len(places), np.int64)
            return out, np.concatenate([lead, places, [len(data)]])
        parts: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            length = next((len(p) for p in self.given if data.startswith(p, at)), 0)
            new = data[at : at + length]
            if not length:
                length, new = self.chars.longest(data, at)
            if not length:
                first = data[at]
                length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[at : at + length]
            parts.append((new, at, at + length))
            at += length
        if self.squeeze:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
        out, places = bytearray(), []
        if parts and self.lead and not self.suffix:
            out += mark
            places += [parts[0][1]] * len(mark)
        spaced = self.squeeze
        for new, start, _ in parts:
            if spaced:
                new = new.lstrip(b" ")
            if new:
                for k in range(len(new)):
                    byte = mark if new[k] == 32 else new[k : k + 1]
                    out += byte
                    places += [start] * len(byte)
                spaced = self.squeeze and new.endswith(b" ")
        end = parts[-1][2] if parts else 0
        while self.squeeze and out.endswith(mark):
            end = places[-len(mark)]
            del out[-len(mark) :], places[-len(mark) :]
        if parts and self.lead and self.suffix:
            out += mark
            places += [end] * len(mark)
        return bytes(out), np.array([*places, end], np.int64)

    def _chunk(self, word: bytes) -> bytes:
        """Ids of a mark followed by word."""
        ids = self.chunks.get(word)
        if ids is None:
            ids = self._pack(self.segment.encode(MARK + word.decode("utf-8", "replace"))) if word else self.mark_ids
            if len(word) <= LONGEST_CHUNK:
                if len(self.chunks) >= MOST_CHUNKS:
                    self.chunks.clear()
                self.chunks[word] = ids
        return ids

    def _body(self, normal: bytes) -> bytes:
        """Packed ids of a normalised text."""
        if not normal:
            return b""
        mark = MARK.encode()
        if not self.by_words or not normal.startswith(mark):
            return self._pack(self.segment.encode(normal.decode("utf-8", "replace")))
        # Behind the first mark each chunk is a run of marks and a word; of a run, all marks but the first belong to the chunk.
        words = normal[len(mark) :].split(mark)
        if b"" in words:
            joined, run = [], b""
            for w in words[:-1]:
                if w:
                    joined.append(run + w)
                    run = b""
                else:
                    run += mark
            joined.append(run + words[-1])
            words = joined
        known = self.chunks
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join(map(self._chunk, words))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, begin and end among them, and the (n x 2) byte spans in the source of the pieces between."""
        normal, places = self.normalise(text or "")
        ids = np.frombuffer(self._pack([self.begin]) + self._body(normal) + self._pack([self.end]), "<u4")
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids[1:-1]])])
        if ends[-1] != len(normal):
            # A piece that isn't in the vocabulary has the length of its surface, which only the library knows.
            ends = np.concatenate([[0], np.cumsum([len(p.encode()) for p in self.segment.encode(normal.decode("utf-8", "replace"), out_type=str)])])
        at = places[np.minimum(ends, len(normal))]
        return ids, np.stack([at[:-1], at[1:]], axis=1)

    def ids(self, text: str | None) -> np.ndarray:
        return self.encode(text)[0]

    def spans(self, text: str | None) -> np.ndarray:
        return self.encode(text)[1]

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """docs with ids array<int> and spans array<struct<begin, end>>, byte spans of the pieces between begin and end ids."""

    @pandas_udf("struct<ids array<int>, begins array<long>, ends array<long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = pieces(model)
        for texts in batches:
            both = [own.encode(t) for t in texts]
            yield pd.DataFrame({"ids": [i.astype(np.int32) for i, _ in both], "begins": [s[:, 0] for _, s in both], "ends": [s[:, 1] for _, s in both]})

    out = docs.withColumn("_encoded", run(F.col(text_col)))
    return out.withColumns({"ids": F.col("_encoded.ids"), "spans": F.expr("zip_with(_encoded.begins, _encoded.ends, (b, e) -> struct(b as begin, e as end))")}).drop("_encoded")


def decode(tokens: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """tokens with decoded, the library's text of ids."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pieces(model)
        for rows in batches:
            yield pd.Series([None if i is None else own.decode(np.asarray(i)) for i in rows])

    return tokens.withColumn("decoded", run(F.col(ids_col)))


def digests(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and spans_sha256 (of the spans as little-endian 64-bit begin and end)."""

    def make():
        own = pieces(model)

        def one(text: str | None) -> tuple:
            ids, spans = own.encode(text)
            return (len(ids), *(hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), own.decode(ids).encode("utf-8", "surrogatepass"), spans.astype("<i8").tobytes())))

        return one

    run = per_text(make, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    out = docs.withColumn("_digest", run(F.col(text_col)))
    return out.withColumns({c: F.col(f"_digest.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")}).drop("_digest")


def op3(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256."""
    return digests(docs.select("doc_id", "text"), model).drop("text")
