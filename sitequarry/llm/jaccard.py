"""Near copies: candidates by the SimHash search, an exact Jaccard check on whole sets, and an exact search for the links that no fingerprint radius reaches.

Shingles are hashed by XXH64; texts of fewer words than a shingle are one shingle, blank and null texts have none and are
alike. Texts with the same set are one class, with a fingerprint voted by its shingles. simhash.near_sets proposes pairs of
classes within RADIUS bits; those of similarity `least` or more join. Two sets of similarity 0.8 differ in about ten of 64
bits, more than any radius for which the pigeonhole search stays selective, so the rest is searched exactly: shingles are put
in one order, those frequent in a bounded sample last, the most frequent at the end (the order decides the cost only); of two
sets of similarity `least`, the first n - ceil(least * n) + s of each share s places, or all they need if that is less, where
s grows with n from 1 to 3 (long sets can pay for a stricter test; in short ones it would reach the frequent shingles).
Values before a shared one that no other prefix has are missing in the other set, which bounds what a pair can share. In
values that more than STARRED classes share, classes are first compared with a few of them only, and those found alike join;
classes of values that more than LARGE share and that are still apart are then put into buckets by bands of minima of their
whole sets, and each is compared with one class of each of its buckets, a number of pairs in proportion to the classes. Last,
all pairs of classes not yet joined that share enough places are compared, so that no link between groups is lost; only pairs
leave the join whose parities allow the similarity, and of the values that a pair shares only the first few: each row has the
values before its own, and where those of both have as many in common as the pair must share, the pair has left the join before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.llm.common import components, cut, per_text
from sitequarry.llm.simhash import near_sets, vote
from sitequarry.plans.lineage import drop_cut, settled

SEED, WORDS, LEAST, RADIUS = 42, 5, 0.8, 3
#: Sizes of sets from which a pair must share 2 and 3 places of the prefix; members above which a value is first compared in stars, and above which classes still apart are put into buckets by bands; centres of a star.
TWO, THREE, STARRED, LARGE, CENTRES = 60, 150, 3, 16, 2
#: Bands of minima, minima of a band, rounds of comparing within buckets: these decide the cost only, not the links.
BANDS, DEEP, ROUNDS = 24, 12, 2
#: Numbers of 64 bits of a set's parities.
PARITY = 8
#: Values before its own that a row of the last join has: decides how often a pair leaves it, not whether.
BEFORE = 16
#: Sampled texts for the order, frequent shingles kept of them.
SAMPLE, FREQUENT = 20_000, 100_000
#: Bits of a filter for each key in it, the least and the most bits of one (16 MB), bits of one row of it.
EACH, LEAST_BITS, MOST_BITS, CHUNK = 8, 1 << 20, 1 << 27, 1 << 15


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes (int64) of the word shingles."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.int64)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64).view(np.int64)
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(tokens) - words + 1).view(np.int64))


def needed(n: Column | int, least: float) -> Column | int:
    """ceil(least * n), safe from rounding."""
    return F.ceil(n * F.lit(least) - 1e-9) if isinstance(n, Column) else int(np.ceil(n * least - 1e-9))


def shared(n: Column | int) -> Column | int:
    """Places of the prefix that a set of n must share with any that is no smaller."""
    return F.when(n < TWO, 1).when(n < THREE, 2).otherwise(3) if isinstance(n, Column) else 1 + (n >= TWO) + (n >= THREE)


def _prefixes(words: int, least: float, frequent: np.ndarray, rank: np.ndarray):
    """frequent: sorted hashes that come last, in order of rank."""

    def make():
        def one(text: str | None) -> tuple:
            s = shingle_set(text, words)
            if not len(s):
                return 0, 0, [], 0, []
            at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
            last = frequent[at] == s if len(frequent) else np.zeros(len(s), bool)
            ordered = np.concatenate([s[~last], s[last][np.argsort(rank[at[last]])]])
            return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63), len(s), ordered[: len(s) - needed(len(s), least) + shared(len(s))].tolist(), vote(s), parity_of(s)

        return one

    return per_text(make, "id long, n int, prefix array<long>, fp long, p array<long>")


def _sets(words: int):
    return per_text(lambda: lambda text: (shingle_set(text, words).tolist(),), "x array<long>")


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more of a bounded sample of texts, the most frequent ones, in order; and their ranks, the most frequent last."""
    total = docs.count()
    part = docs.where(F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(1, total)) * (1 << 20)))
    counts = part.select(F.explode(_sets(words)(F.col("text"))["x"]).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    found = np.array([r["s"] for r in counts.orderBy(F.col("c").desc(), "s").limit(FREQUENT).collect()], np.int64)
    order = np.argsort(found)
    return found[order], -order


def _maybe(keys: DataFrame):
    """A test of a hash column: false only where the hash is none of keys(h), a cut. It spares rows a shuffle, and a join decides after it; it grows with the keys up to MOST_BITS, beyond which it lets more pass."""
    n = keys.count()
    size = LEAST_BITS
    while size < min(EACH * n, MOST_BITS):
        size *= 2
    place = F.pmod("h", F.lit(size))
    chunks = keys.groupBy(F.floor(place / CHUNK).cast("int").alias("c")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(CHUNK))).alias("m"))
    packed = np.zeros(size // 8, np.uint8)
    for r in chunks.collect():
        packed[r["c"] * CHUNK // 8 : (r["c"] + 1) * CHUNK // 8] = np.frombuffer(r["m"], np.uint8)

    @F.pandas_udf("boolean")
    def test(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return lambda h: test(F.pmod(h, F.lit(size)))


def _sets_of(asked: DataFrame, reps: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, x): the sets of the classes asked(id). The texts of other classes are not shuffled, copies are combined before the shuffle."""
    wanted = cut(reps.join(asked, "id", "left_semi").select("id", "key"), few=True)
    maybe = _maybe(wanted.select(F.xxhash64("key").alias("h")))
    texts = docs.where(maybe(F.xxhash64("key"))).groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")
    sets = cut(texts.select("id", _sets(words)(F.col("text"))["x"].alias("x")))
    drop_cut(wanted)
    return sets


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs(a, b) of classes with their sets(id, x) those of similarity `least` or more, as (u, v)."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return cut(both.where(common >= F.lit(least) * (F.size("xa") + F.size("xb") - common) - 1e-9).select(F.col("a").alias("u"), F.col("b").alias("v")), few=True)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """Of pairs(a, b) of classes those of similarity `least` or more, as (u, v)."""
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets_of(asked, reps, docs, words)
    found = _alike(pairs, sets, least)
    drop_cut(sets)
    return found


def bands_of(x: np.ndarray, factors: np.ndarray) -> list[int]:
    """A key for each band of minima of the set x, not empty. Sets of similarity s share one with probability s ** DEEP."""
    h = x.view(np.uint64)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(least, (h[at : at + 1024, None] * factors).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(-1, DEEP))]


def _bands(seed: int):
    @F.pandas_udf("array<long>")
    def run(sets: pd.Series) -> pd.Series:
        factors = np.random.default_rng(SEED + seed).integers(0, 1 << 63, BANDS * DEEP, np.uint64) * 2 + 1
        return pd.Series([bands_of(np.asarray(x, np.int64), factors) for x in sets])

    return run


def parity_of(x: np.ndarray) -> list[int]:
    """For each of 64 * PARITY places, whether an odd number of the set's values falls there. Two sets differ in at least as many values as their parities in places."""
    odd = np.bincount((x.view(np.uint64) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _by_bands(sets: DataFrame, least: float, seed: int) -> DataFrame:
    """(u, v): links found by comparing each class of sets(id, x, label) with one class of each of its buckets, unless they are joined."""
    index = cut(sets.select("id", "label", F.explode(_bands(seed)("x")).alias("k")))
    centre = index.groupBy("k").agg(F.min(F.struct(F.xxhash64("id", "k").alias("h"), "id", "label")).alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
    star = index.join(centre.select("k", F.col("c.id").alias("o"), F.col("c.label").alias("lo")), "k").where(F.col("label") != F.col("lo"))
    pairs = cut(star.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct(), few=True)
    maybe = _maybe(pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("h")))
    found = _alike(pairs, sets.where(maybe(F.xxhash64("id"))), least)
    drop_cut(index)
    return found


def _labels(found: DataFrame) -> DataFrame:
    return cut(components(found).select(F.col("node").alias("id"), "label"), few=True)


def _enough(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of rows(a, na, b, nb), a row for each kind of shared place and how many they are, `alike`, that share as many as they must."""
    must = F.least(shared(F.least("na", "nb")), needed(F.greatest("na", "nb"), least))
    return rows.groupBy("a", "b", "na", "nb").agg(F.sum("alike").alias("c")).where(F.col("c") >= must).select("a", "b")


def _told_once(near: DataFrame) -> DataFrame:
    """near(k, id, ...), a cut, with one value k of those that the same classes share, and how many they are, `alike`. Long near copies share hundreds of values. Classes are told apart by 128 bits."""
    shared_by = near.groupBy("k").agg(*(F.bit_xor(F.xxhash64("id", F.lit(s))).alias(f"x{s}") for s in range(2)), F.count(F.lit(1)).alias("c"))
    told = cut(near.join(shared_by.groupBy("x0", "x1", "c").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("alike")).select("k", "alike"), "k"))
    drop_cut(near)
    return told


def _mixed(near: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of near(k, id, n, at, own, members, alike) whose value k has several labels, with their label and the one that most members have, `most`: pairs are made from the other members only."""
    told = cut(near.join(joined, "id", "left").withColumn("label", F.coalesce("label", "id")))
    sizes = told.groupBy("k", "label").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("k").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("k", F.col("m.label").alias("most"))
    mixed = cut(told.join(most, "k"))
    drop_cut(told)
    return mixed


def links(classes: DataFrame, reps: DataFrame, docs: DataFrame, words: int, least: float, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that join the classes(id, n, prefix, fp, p) as all pairs of similarity `least` or more would."""
    proposed = near_sets(classes.select("id", "fp"), radius)
    index = classes.select("id", "n", F.posexplode("prefix").alias("at", "k"))
    several = index.groupBy("k").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    before = F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1
    near = _told_once(cut(index.join(several, "k").withColumn("own", F.col("at") - before).where(F.col("n") - F.col("own") >= needed(F.col("n"), least))))
    # values before a shared one are before it in both: those of one class only are not in the other
    most_shared = F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob"))
    alike = most_shared * F.lit(1 + least) >= F.lit(least) * (F.col("na") + F.col("nb")) - 1e-9

    dense = near.where(F.col("members") > STARRED)
    stars = None
    for seed in range(CENTRES):
        centre = dense.groupBy("k").agg(F.min(F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), "id", "n", "own")).alias("c")).select("k", F.col("c.id").alias("a"), F.col("c.n").alias("na"), F.col("c.own").alias("oa"))
        star = dense.select("k", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("own").alias("ob"), "alike").join(centre, "k").where((F.col("a") != F.col("b")) & alike)
        stars = star if stars is None else stars.unionByName(star)
    pairs = cut(_enough(stars, least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(proposed).distinct(), few=True)
    first = _verified(pairs, reps, docs, words, least)
    mixed = _mixed(near, _labels(first))
    drop_cut(near)

    # classes of dense values that are still apart: those that bands bring together need no pair below
    apart = cut(mixed.where(F.col("members") > LARGE).select("id").distinct(), few=True)
    sets = _sets_of(apart, reps, docs, words)
    for seed in range(ROUNDS):
        labelled = sets.join(_labels(first), "id", "left").withColumn("label", F.coalesce("label", "id"))
        first = cut(first.unionByName(_by_bands(labelled, least, seed)), few=True)
    apart_still, mixed = mixed, _mixed(mixed.select("k", "id", "n", "at", "own", "members", "alike"), _labels(first))
    drop_cut(apart_still)
    differ = sum((F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(PARITY)), F.lit(0))
    close = differ * F.lit(1 + least) <= F.lit(1 - least) * (F.col("na") + F.col("nb")) + 1e-9

    def compared(rows: DataFrame) -> DataFrame:
        left = rows.where(F.col("label") != F.col("most")).select("k", F.col("id").alias("a"), F.col("n").alias("na"), F.col("own").alias("oa"), F.col("label").alias("la"), F.col("p").alias("pa"), F.col("earlier").alias("ea"))
        right = rows.select("k", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("own").alias("ob"), F.col("label").alias("lb"), "most", "alike", F.col("p").alias("pb"), F.col("earlier").alias("eb"))
        apart = (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("most")) | (F.col("a") < F.col("b")))
        # a pair leaves at its first shared(n) values at least: in those fewer are shared before; `alike` holds up to some value and at none after
        first = F.size(F.array_intersect("ea", "eb")) < shared(F.least("na", "nb"))
        return left.join(right, "k").where(apart & alike & close & first).select("a", "na", "b", "nb", "alike")

    earlier = F.collect_list("k").over(Window.partitionBy("id").orderBy("at").rowsBetween(-BEFORE, -1))
    cross = compared(cut(mixed.withColumn("earlier", earlier).join(classes.select("id", "p"), "id")))
    ordered = cross.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"), "alike")
    rest = cut(_enough(ordered, least), few=True)
    return first.unionByName(_verified(rest, reps, docs, words, least))


def near_copies(docs: DataFrame, words: int = WORDS, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, key (hash of the text), label (a class that names the group), joined by links of similarity `least` or more."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    shingled = _prefixes(words, least, *_frequent(texts, words))(F.col("text"))
    rows = cut(texts.withColumn("s", shingled).select("doc_id", "key", "s.*"))
    reps = cut(rows.groupBy("id").agg(F.min("key").alias("key")), few=True)
    classes = rows.groupBy("id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("fp").alias("fp"), F.first("p").alias("p")).where("n > 0")
    linked = cut(components(links(classes, reps, texts, words, least, radius)), few=True)
    return rows.join(linked, rows["id"] == linked["node"], "left").select("doc_id", "key", F.coalesce("label", "id").alias("label"))


def keep_one(docs: DataFrame, words: int = WORDS, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """One row of each group, with the columns of docs: that of the smallest doc_id (null only if there is no other), and of rows with that id the one whose text has the smallest hash. Rows alike in id and text count as one."""
    found = settled(lambda: near_copies(docs, words, least, radius))
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("r"))
    kept = cut(first.select(F.col("r.doc_id").alias("_id"), F.col("r.key").alias("_key")), few=True)
    others = found.join(kept, found["doc_id"].eqNullSafe(kept["_id"]) & (found["key"] == kept["_key"]), "left_anti")
    lost = cut(others.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), few=True)
    # only the texts of rows that may be lost are shuffled
    key = F.xxhash64(docs["text"])
    maybe = _maybe(lost.select(F.xxhash64("_id", "_key").alias("h")))(F.xxhash64(docs["doc_id"], key))
    out = docs.where(~maybe).unionByName(docs.where(maybe).join(lost, docs["doc_id"].eqNullSafe(lost["_id"]) & (key == lost["_key"]), "left_anti"))
    several = found.join(kept, found["doc_id"].eqNullSafe(kept["_id"]) & (found["key"] == kept["_key"]), "left_semi").groupBy("doc_id", "key").count().where("count > 1")
    return out.dropDuplicates(["doc_id", "text"]) if several.limit(1).count() else out
