"""String, number and date scalars as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Advance widths of Helvetica per 1000 units of font size, of the characters from space to tilde in order (the
#: published font metrics); any other character counts FALLBACK_WIDTH.
HELVETICA_WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
FALLBACK_WIDTH, TITLE_PX, DESCRIPTION_PX = 556, 20, 14
#: The characters of each width: one translate() counts a width.
WIDTHS = {w: "".join(chr(32 + i) for i, x in enumerate(HELVETICA_WIDTHS) if x == w) for w in sorted(set(HELVETICA_WIDTHS))}

#: Words that keyword density leaves out.
STOPWORDS = frozenset(
    """a an the and or but if then else when while of to in on at by for with about against between into through during before
    after above below from up down out off over under again further here there all any both each few more most other some such
    no nor not only own same so than too very s t can will just don should now is are was were be been being have has had do
    does did this that these those i you he she it we they me him her us them my your his its our their what which who whom as
    it's i'm you're he's she's we're they're""".split()
)


def collapse(text: Column) -> Column:
    """Runs of white space (Unicode) as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits on doubles."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5) / F.lit(scale)


def int_attribute(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^\d+$"), F.trim(text).cast("int"))


def word_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count two."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def estimate_px(text: Column, font_px: int) -> Column:
    """Estimated width in pixels; null for null or empty texts."""
    total = F.length(text) * FALLBACK_WIDTH
    for width, chars in WIDTHS.items():
        if width != FALLBACK_WIDTH:
            total = total + (F.length(text) - F.length(F.translate(text, chars, ""))) * (width - FALLBACK_WIDTH)
    return F.when(text != "", F.floor(total / 1000 * font_px + 0.5).cast("int"))


def format_count(n: Column, noun: str) -> Column:
    whole = floor_half_up(n)
    return F.concat(F.format_number(whole, 0), F.when(whole == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {noun}s")))


def format_ms(n: Column) -> Column:
    return F.concat(F.format_number(floor_half_up(n), 0), F.lit(" ms"))


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(floor_half_up(n).cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n.cast("double") / 1024)).otherwise(F.format_string("%.2f MB", n.cast("double") / (1024 * 1024)))


def floor_half_up(n: Column) -> Column:
    return F.floor(n.cast("double") + 0.5).cast("long")


def let(value: Column, f) -> Column:
    """f of value, evaluated once: a lambda that names a bare expression evaluates it for every element."""
    return F.transform(F.array(value), f)[0]


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _syllables(word: Column, silent: str) -> Column:
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    trimmed = F.regexp_replace(F.regexp_replace(w, silent, ""), "^y", "")
    return F.when(F.length(w) <= 3, F.lit(1)).otherwise(F.greatest(F.lit(1), F.size(_matches(trimmed, "[aeiouy]{1,2}"))))


def _total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + of(x).cast("int"))


def readability(text: Column) -> Column:
    """Struct of Flesch reading ease and grade (1 decimal), sentences, syllables, words per sentence and band; null fields for texts without words."""
    words = _matches(text, "[A-Za-z][A-Za-z'’-]*")
    ends = F.size(_matches(text, r"[.!?]+(?=\s|$)"))

    def report(c: Column) -> Column:
        n, syllables = c["n"], c["syllables"]
        sentences = F.when(c["ends"] > 0, c["ends"]).otherwise(F.when(n > 0, 1).otherwise(0))
        per_sentence, per_word = n / sentences, syllables / n
        ease = 206.835 - 1.015 * per_sentence.cast("double") - 84.6 * per_word.cast("double")
        grade = 0.39 * per_sentence + 11.8 * per_word - 15.59
        some = n > 0
        return F.struct(
            F.when(some, round_half_up(ease, 1)).alias("ease"), F.when(some, round_half_up(grade, 1)).alias("grade"), sentences.alias("sentences"),
            syllables.alias("syllables"), F.when(some, round_half_up(per_sentence, 1)).alias("words_per_sentence"), F.when(some, ease_band(ease)).alias("band"),
        )

    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), _total(w, lambda x: _syllables(x, "(?:[^laeiouy]es|ed|[^laeiouy]e)$")).alias("syllables"), ends.alias("ends")))
    return let(counts, report)


def ease_band(ease: Column) -> Column:
    out = F.lit("very hard")
    for least, band in ((30, "hard"), (50, "fairly hard"), (60, "plain English"), (70, "fairly easy"), (80, "easy"), (90, "very easy")):
        out = F.when(ease >= least, F.lit(band)).otherwise(out)
    return out


def reading_ease(text: Column) -> Column:
    """The measurements' variant of Flesch reading ease: white-space tokens, its own rule for a silent e; null for blank texts."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    sentences = F.greatest(F.lit(1), F.size(_matches(text, r"[.!?]+(?:\s|$)")))

    def syllables(word: Column) -> Column:
        plain = F.regexp_replace(F.lower(word), "[^a-z]", "")
        return F.when(plain == "", F.lit(0)).otherwise(_syllables(word, "(?:[^aeiouy]e|[^laeiouy]es|[^laeiouy]ed)$"))

    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), _total(w, syllables).alias("s"), sentences.alias("ends")))
    return let(counts, lambda c: F.when(c["n"] > 0, round_half_up(206.835 - 1.015 * (c["n"] / c["ends"]) - 84.6 * (c["s"] / c["n"]), 1)))


def keyword_tokens(text: Column) -> Column:
    words = _matches(F.lower(text), "[a-z][a-z'’-]{1,}")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*sorted(STOPWORDS)))


def significant_words(text: Column) -> Column:
    return F.array_distinct(_matches(F.lower(text), "[a-z0-9]{4,}"))


def plain_words(text: Column) -> Column:
    """The text in lower case with all but letters and digits blanked. Each character has one lower case, as in SQL: Java makes two of a dotted I, and a sigma depend on its place."""
    return F.regexp_replace(F.lower(F.translate(text, "İΣ", "iσ")), r"[^\p{L}\p{N}\s]", " ")


def shingles(text: Column, size: int = 5) -> Column:
    """The set of word n-grams of letters and digits, lower case; none for texts of fewer words."""
    words = F.filter(F.split(plain_words(text), r"(?U)\s+"), lambda w: w != "")
    grams = let(words, lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.array_join(F.slice(w, i + 1, size), " "))))
    return F.coalesce(F.array_distinct(grams), F.array().cast("array<string>"))


def fnv1a(text: str, basis: int = 0x811C9DC5) -> int:
    """FNV-1a over UTF-16 units, modulo 2^32."""
    h = basis
    data = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(data), 2):
        h = ((h ^ (data[i] | data[i + 1] << 8)) * 16777619) & 0xFFFFFFFF
    return h


def fnv1a_all(texts: list[str], basis: int = 0x811C9DC5) -> np.ndarray:
    """fnv1a of many texts at once: unit by unit over all that are long enough."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    lengths = np.array([len(u) for u in units])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([units[i] for i in order]) if len(units) else np.zeros(0, np.uint16)
    lengths = lengths[order]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(units) else np.zeros(0, np.int64)
    h = np.full(len(units), basis, np.uint64)
    for k in range(int(lengths[0]) if len(units) else 0):
        live = np.searchsorted(-lengths, -k, "left")
        h[:live] = ((h[:live] ^ flat[starts[:live] + k]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    out = np.empty_like(h)
    out[order] = h
    return out


def status_class(code: Column) -> Column:
    return F.when(code.isNull(), F.lit("none")).otherwise(F.concat(F.floor(code / 100).cast("string"), F.lit("xx")))


def grade(score: Column) -> Column:
    """Fixed cut-offs: A 90, B 80, C 70, D 60, E 40."""
    out = F.lit("F")
    for least, g in ((40, "E"), (60, "D"), (70, "C"), (80, "B"), (90, "A")):
        out = F.when(score >= least, F.lit(g)).otherwise(out)
    return out


def band(score: Column) -> Column:
    out = F.lit("failing")
    for least, g in ((40, "poor"), (60, "needs work"), (70, "fair"), (80, "good"), (90, "very good")):
        out = F.when(score >= least, F.lit(g)).otherwise(out)
    return out


def size_class(size: Column) -> Column:
    return F.when(size > 500 * 1024, "heavy").when(size > 100 * 1024, "medium").when(size.isNotNull(), "light")


def alt_state(alt: Column) -> Column:
    return F.when(alt.isNull(), "missing").when(F.trim(alt) == "", "empty").otherwise("described")


def w3c_time(text: Column) -> Column:
    """The instant of a W3C date or time, null if malformed."""
    good = text.rlike(r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2}))?)?)?$")
    return F.when(good, F.try_to_timestamp(F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)))


def pacific_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "America/Los_Angeles"))


#: The reporting lag, the provisional tail and the longest span of search metrics, in days.
LAG_DAYS, PROVISIONAL_DAYS, MOST_DAYS = 1, 2, 480


def metric_range(start: Column, end: Column, today: Column) -> Column:
    """A date range put in order, cut at the last reported day and at the longest span."""
    last = F.date_sub(today, LAG_DAYS)
    high = F.least(F.greatest(start, end), last)
    low = F.greatest(F.least(start, end), F.date_sub(high, MOST_DAYS - 1))
    return F.struct(low.alias("start"), high.alias("end"), (F.datediff(high, low) + 1).alias("days"))


def is_provisional(day: Column, today: Column) -> Column:
    return day > F.date_sub(today, LAG_DAYS + PROVISIONAL_DAYS)
