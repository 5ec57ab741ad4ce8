"""Fill-in-the-middle transformation, cut by rank and select over packed boundary bits.

A token is a run of other characters with the white space before it; white space at the end of a text is one more. For the
bytes of many texts at once a bit is set at the last byte of each token. The bits are packed into 64-bit words, and a directory
holds the ones before each block of eight words. The total between a text's ends is its n; two cut ranks are drawn from a hash
of the id, and select turns them into byte cuts. A second bit vector over the first bytes of code points ranks those cuts into
characters, so that only three numbers a text return from Python; the texts are put together by column expressions.

Defined results: a null text is an empty one; a null id hashes as no digits; empty texts and texts that hold a marker stay
plain; repeated rows each give a row; an empty table gives no rows; other columns are kept, a column named as the result is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of texts that one bit vector covers, unless one text alone is longer.
STRETCH = 1 << 22


class Bits:
    """A packed bit vector with the ones before each block of 512 bits; rank and select take arrays of queries."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(8 * (len(bits) // 512 + 1), "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64).reshape(-1, 8)
        self.before = np.concatenate([[0], np.cumsum(ones.sum(1))])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, word = at >> 9, at >> 6
        out = self.before[block]
        for k in range(7):
            whole = block * 8 + k
            out = out + np.where(whole < word, np.bitwise_count(self.words[whole]), 0)
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has k ones before it."""
        block = np.searchsorted(self.before, k, "right") - 1
        rest, word = k - self.before[block], block * 8
        for _ in range(7):
            ones = np.bitwise_count(self.words[word]).astype(np.int64)
            # Once a word holds the one sought, rest stays below its count and the place stays.
            on = rest >= ones
            rest, word = rest - np.where(on, ones, 0), word + on
        left, shift = self.words[word], np.zeros(len(k), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            low = (left >> shift) & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            on = rest >= ones
            rest, shift = rest - np.where(on, ones, 0), shift + np.where(on, np.uint64(width), np.uint64(0))
        return word * 64 + shift.astype(np.int64)


def token_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per byte of data, texts end to end that end before `ends`: whether it is the last byte of a token."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    bits = np.zeros(len(data), bool)
    bits[:-1] = ~space[:-1] & space[1:]
    bits[ends[ends > 0] - 1] = True
    return bits


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: n, and the characters before its first cut and between its cuts. one, two: the drawn numbers; a cut stands behind that number modulo n + 1 tokens."""
    tokens, chars = Bits(token_ends(data, ends)), Bits((data & 0xC0) != 0x80)
    first = tokens.rank(starts)
    n = tokens.rank(ends) - first
    low, high = np.minimum(one % (n + 1), two % (n + 1)), np.maximum(one % (n + 1), two % (n + 1))

    def place(k: np.ndarray) -> np.ndarray:
        return np.where(k > 0, tokens.select(np.maximum(first + k - 1, 0)) + 1, starts) if tokens.total else starts

    a, b, base = chars.rank(place(low)), chars.rank(place(high)), chars.rank(starts)
    return n, a - base, b - a


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "prefix_chars", "middle_chars")]))
def _cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, one, two in batches:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        one, two = (np.asarray(x, dtype=np.int64) for x in (one, two))
        parts, at = [], 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, "right")) - 1)
            here = offsets[at : upto + 1] - offsets[at]
            parts.append(cuts(data[offsets[at] : offsets[upto]], here[:-1], here[1:], one[at:upto], two[at:upto]))
            at = upto
        columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64()) for k in range(3)]
        yield pa.StructArray.from_arrays(columns, names=["n", "prefix_chars", "middle_chars"])


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text", into: str = "infill") -> DataFrame:
    """docs with a struct n, form, prefix_chars, middle_chars, output: of each hundred texts about `rate` are cut, of those `spm_rate` with the suffix first."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    plain = (F.length(text) == 0) | (h3 % 100 >= rate)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(marker))
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    cut = docs.withColumn("_cut", _cut(text, h1, h2))
    n, p, m = (F.col(f"_cut.{c}") for c in ("n", "prefix_chars", "middle_chars"))
    prefix, middle, suffix = text.substr(F.lit(1), p.cast("int")), text.substr((p + 1).cast("int"), m.cast("int")), text.substr((p + m + 1).cast("int"), F.length(text))
    output = (
        F.when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(text)
    )
    of_cut = lambda c: F.when(form != "plain", c)
    return cut.withColumn(into, F.struct(n.alias("n"), form.alias("form"), of_cut(p).alias("prefix_chars"), of_cut(m).alias("middle_chars"), output.alias("output"))).drop("_cut")


def restore(output: Column, form: Column) -> Column:
    """The exact text behind an output: a cut text holds no marker, so the first of each is the one that was put in."""
    mark = len(PREFIX)
    second = F.when(form == "spm", F.instr(output, PREFIX)).otherwise(F.instr(output, SUFFIX))
    third = F.instr(output, MIDDLE)
    one = output.substr(F.lit(mark + 1), second - mark - 1)
    two = output.substr(second + mark, third - second - mark)
    middle = output.substr(third + mark, F.length(output))
    return F.when(form == "spm", F.concat(two, middle, one)).when(form == "psm", F.concat(one, middle, two)).otherwise(output)


def op13(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    done = transform(docs.select("doc_id", "text"))
    output, form = F.col("infill.output"), F.col("infill.form")
    return done.select("doc_id", "infill.n", "infill.form", "infill.prefix_chars", "infill.middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restore(output, form), 256).alias("restored_sha256"))
