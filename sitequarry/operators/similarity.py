"""Near-duplicate pages: MinHash signatures in bands, and exact Jaccard by an inverted index."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sitequarry.functions import text as tx
from sitequarry.operators import overlap
from sitequarry.operators.graph import components
from sitequarry.plans.lineage import cut, spread

#: Bases of the two hashes from which all others are mixed.
BASES = (0x811C9DC5, 0x9747B28C)


def _minima(h1: np.ndarray, h2: np.ndarray, size: int) -> list[int]:
    """Minima of h1 + i * h2, modulo 2^32 (as 32-bit numbers wrap), for i below size."""
    steps = np.arange(size, dtype=np.uint32)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h1), 1024):
        mixed = h2[at : at + 1024, None] * steps
        mixed += h1[at : at + 1024, None]
        np.minimum(least, mixed.min(axis=0), out=least)
    return least.astype(np.int64).tolist()


def signature(shingles: list[str], size: int = 128) -> list[int]:
    """Minima over the shingles of h1 + i * h2, modulo 2^32, for i below size."""
    return _minima(*(tx.fnv1a_all(shingles, b).astype(np.uint32) for b in BASES), size)


_APART = re.compile(r"[\W_]+")


def shingles_of(text: str | None, size: int) -> list[str]:
    """The set of word n-grams of letters and digits, as the column expression of that name."""
    words = [w for w in _APART.split(text.lower()) if w] if text else []
    return list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(len(words) - size + 1)))


def text_signature(text: str | None, shingle_size: int, size: int = 128) -> list[int] | None:
    """signature() of a text's shingles, None if it has none: they are hashed where they stand in the words put together, by both bases at once, unit by unit over all that are long enough."""
    words = [w for w in _APART.split(text.lower()) if w] if text else []
    n = len(words) - shingle_size + 1
    if n < 1:
        return None
    flat = np.frombuffer(" ".join(words).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if lengths.sum() + len(words) - 1 != len(flat):  # some characters take two units
        lengths = np.array([len(w.encode("utf-16-le", "surrogatepass")) // 2 for w in words])
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n]
    spans = ends[shingle_size - 1 :] - starts
    order = np.argsort(-spans, kind="stable")
    at, spans = starts[order], spans[order]
    h = np.repeat(np.array(BASES, np.uint32)[:, None], n, axis=1)
    for k, live in enumerate(np.searchsorted(-spans, -np.arange(spans[0]), "left").tolist()):
        part = h[:, :live]
        part ^= flat[at[:live] + k]
        part *= np.uint32(16777619)
    return _minima(h[0], h[1], size)


def with_signature(pages: DataFrame, shingle_size: int = 5, size: int = 128) -> DataFrame:
    """pages(text) with sig, null for texts of fewer words than a shingle. Shingles never leave the function: they are several times the text."""

    @F.pandas_udf(ArrayType(LongType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_signature(t, shingle_size, size) for t in texts])

    return pages.withColumn("sig", run("text"))


def bands_of(size: int, threshold: float, recall: float = 0.98) -> tuple[int, int]:
    """(bands, rows) of a signature: the most rows for which a pair at the threshold shares a band with this probability."""
    rows = next((r for r in range(size, 1, -1) if 1 - (1 - threshold**r) ** (size // r) >= recall), 1)
    return size // rows, rows


def signature_classes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): one row (id, sig) for each different signature, id the least of its pages; (member, id) for each page. Copies with equal signatures are told once from here on."""
    kept = signed.where("sig is not null")
    classes = cut(kept.groupBy("sig").agg(F.min("id").alias("id")).select("id", "sig"))
    return classes, kept.select(F.col("id").alias("member"), "sig").join(classes, "sig").select("member", "id")


def _places(sig: pa.ChunkedArray) -> np.ndarray:
    rows = sig.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.uint32).reshape(len(rows), -1)


def _same(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Equal places of each row of one with each of two."""
    out = np.zeros((len(one), len(two)), np.int16)
    for k in range(one.shape[1]):
        out += one[:, k, None] == two[None, :, k]
    return out


def _blocks(rows: DataFrame, group: list[str], block: int) -> DataFrame:
    """rows(id, *group, ...) of groups of any size, dealt by a hash of the id into blocks, once for each pair of blocks (one <= two) of their group."""
    sizes = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other")).drop("other", "blocks")


def _link_block(least: int) -> Callable[[pa.Table], pa.Table]:
    """Of two blocks of a bucket: links (a, b) between components, no more than would join them all."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, part, sig = table["id"].to_pylist(), table["part"].to_numpy(), _places(table["sig"])
        names, component = np.unique(np.array(table["component"].to_pylist(), object), return_inverse=True)
        root = np.arange(len(names))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        left, right = np.flatnonzero(part == table["one"][0].as_py()), np.flatnonzero(part == table["two"][0].as_py())
        made: list[tuple] = []
        for at in range(0, len(left), 256):
            own = left[at : at + 256]
            i, j = np.nonzero((component[own][:, None] != component[right][None, :]) & (_same(sig[own], sig[right]) >= least))
            for a, b in zip(own[i], right[j], strict=True):
                x, y = find(component[a]), find(component[b])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    made.append((ids[a], ids[b]))
        return pa.table({"a": pa.array([a for a, _ in made], table["id"].type), "b": pa.array([b for _, b in made], table["id"].type)})

    return run


def _least_block(table: pa.Table) -> pa.Table:
    """Of two blocks of a cluster: the least number of equal places of two of its classes."""
    part, sig = table["part"].to_numpy(), _places(table["sig"])
    left, right = np.flatnonzero(part == table["one"][0].as_py()), np.flatnonzero(part == table["two"][0].as_py())
    low = min((int(_same(sig[left[at : at + 256]], sig[right]).min()) for at in range(0, len(left) if len(right) else 0, 256)), default=sig.shape[1])
    return pa.table({"component": table["component"][:1], "low": pa.array([low], pa.int32())})


def linked_classes(classes: DataFrame, threshold: float, size: int = 128, rows: int | None = None, block: int = 1024) -> DataFrame:
    """(id, component) of classes(id, sig): connected by pairs that share a band and whose estimate reaches the threshold; classes without a link don't appear.

    A bucket's members are first verified against its least member, which makes one row a member, and joined. Only buckets that
    still hold several components are compared whole, in blocks, between components; each pair of blocks gives no more links
    than join its components. So rows grow with the members of buckets, never with their pairs.
    """
    bands, width = (size // rows, rows) if rows else bands_of(size, threshold)
    least = math.ceil(threshold * size - 1e-9)
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * width + 1, width)))
    banded = classes.select("id", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1").drop("n")
    kept = cut(banded.join(shared, "key"))
    star = _estimated(kept.where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), classes, size).where(F.col("estimate") >= threshold - 1e-9)
    edges = cut(star.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    once = components(classes.select("id"), edges)
    named = kept.select("id", "key").join(once, "id")
    apart = named.groupBy("key").agg((F.min("component") != F.max("component")).alias("apart")).where("apart").select("key")
    open_ = _blocks(named.join(apart, "key").join(classes, "id"), ["key"], block)
    kind = classes.schema["id"].dataType.simpleString()
    more = open_.groupBy("key", "one", "two").applyInArrow(_link_block(least), f"a {kind}, b {kind}")
    edges = cut(edges.unionByName(more.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return components(nodes, edges)


def near_duplicates(pages: DataFrame, size: int = 5, threshold: float = 0.75, signature_size: int = 128, rows: int | None = None, block: int = 1024) -> DataFrame:
    """Clusters of near-duplicate pages(id, text, word_count, content_hash): (cluster_id, id, similarity), similarity the least estimate between two of a cluster.

    Pages whose text recurs, and pages of fewer words than a shingle, are left out. rows: of a band; as many as keep the recall
    of a pair at the threshold at 0.98 where not given.
    """
    repeated = pages.where("word_count > 0").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("content_hash")
    kept = pages.where(F.col("word_count") >= size).join(repeated, "content_hash", "left_anti").select("id", "text")
    signed = cut(with_signature(spread(kept), size, signature_size).select("id", "sig"))
    classes, members = signature_classes(signed)
    members = cut(members)
    linked = cut(linked_classes(classes, threshold, signature_size, rows, block))
    # Pages of one signature are a cluster even without another class.
    alone = members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id").join(linked, "id", "left_anti").select("id", F.col("id").alias("component"))
    clusters = cut(linked.unionByName(alone))
    signs = clusters.join(classes, "id")
    low = _blocks(signs, ["component"], block).groupBy("component", "one", "two").applyInArrow(_least_block, f"component {clusters.schema['component'].dataType.simpleString()}, low int")
    low = low.groupBy("component").agg(F.min("low").alias("low"))
    named = members.join(clusters, "id").join(low, "component")
    return named.select(F.col("component").alias("cluster_id"), F.col("member").alias("id"), tx.round_half_up(F.col("low") / F.lit(float(signature_size)), 3).alias("similarity"))


def _estimated(pairs: DataFrame, signed: DataFrame, size: int) -> DataFrame:
    both = pairs.join(signed.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(signed.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda t, x: t + x)
    return both.withColumn("estimate", same / F.lit(float(size))).drop("sa", "sb")


def jaccard_pairs(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """All pairs (a, b, jaccard) of docs(id, shingles) with exact Jaccard of at least threshold; see overlap."""
    return overlap.similar_pairs(docs.select("id", F.transform("shingles", lambda x: F.xxhash64(x)).alias("source")), overlap.hashed_values, threshold)


def text_jaccard_pairs(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """All pairs (a, b, jaccard) of the distinct texts of docs(id, text), each under its smallest id, whose sets of word n-grams have an exact Jaccard of at least threshold. Texts under one id are one set."""
    plain = tx.plain_words(F.col("text"))
    docs = docs.where("id is not null and text is not null")
    if docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        first = docs.groupBy("text").agg(F.min("id").alias("id"))
        rows = cut(first.groupBy("id").agg(F.collect_list(plain).alias("source")))
    else:
        rows = docs.select("id", F.sha2("text", 256).alias("key"), F.array(plain).alias("source"))
    return overlap.similar_pairs(rows, overlap.hashed_shingles(size), threshold)


def exact_groups(docs: DataFrame, key: str) -> DataFrame:
    """Rows whose key recurs, with the size of their group."""
    sizes = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return docs.join(sizes, key)


def top_similar(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 20_000) -> DataFrame:
    """(query_id, id, place): for each query the k rows of the highest dot product (rounded to 9 places; ties by id), itself left out.

    The queries go to the tasks in blocks of at most about block_rows, each block in one pass over the rows; a task keeps the
    best k of its rows for each query of the block, and only those are shuffled.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("v")).where("query_id is not null and v is not null")
    blocks = max(1, -(-asked.count() // block_rows))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect() if blocks > 1 else asked.collect()
        if not own:
            continue
        ids = np.array([r["query_id"] for r in own], np.int64)
        matrix = np.array([r["v"] for r in own], np.float64)

        def best(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None
            for batch in batches:
                for at in range(0, len(batch), 2048):
                    part = batch.iloc[at : at + 2048]
                    v, own_ids = np.stack([np.asarray(x, np.float64) for x in part["v"]]), part["id"].to_numpy(np.int64)
                    s = np.round(matrix @ v.T, 9)
                    s[ids[:, None] == own_ids[None, :]] = -np.inf
                    # every row at least as good as the k-th of this part: ties are settled below
                    least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
                    q, r = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                    new = pd.DataFrame({"query_id": ids[q], "id": own_ids[r], "dot": s[q, r]})
                    held = new if held is None else pd.concat([held, new], ignore_index=True)
                    held = held.sort_values(["query_id", "dot", "id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
            if held is not None:
                yield held

        found = rows.mapInPandas(best, "query_id long, id long, dot double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return asked.select("query_id", F.col("query_id").alias("id"), F.lit(0).cast("long").alias("place")).limit(0)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("dot").desc(), "id"))
    return out.withColumn("place", place.cast("long")).where(F.col("place") <= k).select("query_id", "id", "place")
