"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors of a label are one class. Labels larger than a shard are cut into overlapping cluster shards: each class goes to
its nearest centroids of its label (centroids come from a bounded sample). In each shard a flat graph is built by inserting
classes in batches, each linked to the robust-pruned result of a greedy search. The shards' adjacency lists are united by
class, and each shard is given the neighbours that its classes have elsewhere. Then every class searches its shards: greedily
from the medoid, and from all that lies in range (or close to it) on to its neighbours. Hits are verified by the cosine in
double precision. Recall is audited against brute force over a sample of classes; below `least_recall` the overlap is doubled
and the search repeated, twice at most; if it is still below, all pairs of a label are compared, in blocks.

Inside a shard links are counted and joined to trees at once, so that a group of many near copies leaves no list of pairs;
only links to classes of other shards leave it as pairs. A pair of classes that share several shards is counted in the first.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors with null label, have no
links and are their own component; equal vectors of a label link (cosine one); vectors of different length have cosines with
none but their like; rows that share a vec_id are rows of their own, with equal ids in their results; rows with null vec_id link
like others, name a component only where no member has an id (null), and are never kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import components, cut

#: Classes in a shard, clusters a class belongs to, links kept of a class, beam of a search.
SHARD, OVERLAP, DEGREE, BEAM, ALPHA = 2000, 2, 16, 32, 1.2
#: Classes of a block of the exact check.
CHECKED = 8192
#: Sampled vectors for the centroids, the most centroids, and the sample of the audit.
SAMPLE, MOST_CENTROIDS, AUDITED = 20_000, 8192, 200


# ---- the graph inside a shard ----


def beam_search(v: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the best `beam` places found (-1 for none), and their similarities."""
    n = len(queries)
    ids, sims = np.full((n, beam), -1), np.full((n, beam), -np.inf, np.float32)
    done, seen = np.zeros((n, beam), bool), np.zeros((n, len(v)), bool)
    ids[:, 0], sims[:, 0] = start, queries @ v[start]
    seen[:, start] = True
    live = np.arange(n)
    while len(live):
        open_sims = np.where(done[live] | (ids[live] < 0), -np.inf, sims[live])
        at = open_sims.argmax(axis=1)
        go = open_sims[np.arange(len(live)), at] > -np.inf
        live, at = live[go], at[go]
        if not len(live):
            break
        done[live, at] = True
        near = graph[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        rows, cols = np.nonzero(fresh)
        if len(rows):
            seen[live[rows], near[rows, cols]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[rows, cols] = np.einsum("ij,ij->i", v[near[rows, cols]], queries[live[rows]])
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_sims = np.concatenate([sims[live], s], axis=1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        r = np.arange(len(live))[:, None]
        ids[live], sims[live], done[live] = all_ids[r, best], all_sims[r, best], all_done[r, best]
    return ids, sims


def robust_prune(v: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each of points (places) at most `degree` of its candidates (-1 for none), the nearest first; a candidate falls if one kept is closer to it, alpha times, than the point."""
    own = np.where(candidates == points[:, None], -1, candidates)
    own = np.sort(own, axis=1)
    own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
    held = v[np.maximum(own, 0)]
    far = 2 - 2 * np.einsum("pcd,pd->pc", held, v[points])
    apart = 2 - 2 * np.matmul(held, held.transpose(0, 2, 1))
    alive = own >= 0
    out = np.full((len(points), degree), -1)
    r = np.arange(len(points))
    for k in range(degree):
        d = np.where(alive, far, np.inf)
        pick = d.argmin(axis=1)
        ok = d[r, pick] < np.inf
        if not ok.any():
            break
        out[ok, k] = own[r, pick][ok]
        alive &= alpha * alpha * apart[r, pick] > far
        alive[r, pick] = False
    return out


def build(v: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 256) -> tuple[np.ndarray, int]:
    """The adjacency (n x degree places, -1 for none) of unit vectors, and their medoid."""
    n = len(v)
    medoid = int((v @ v.mean(axis=0)).argmax())
    graph = np.full((n, degree), -1)
    order = np.random.default_rng(6).permutation(n)
    order = order[order != medoid]
    for final in (False, True):
        at = 0
        while at < len(order):
            size = batch if final else min(batch, max(1, at))
            points = order[at : at + size]
            at += size
            ids, _ = beam_search(v, graph, v[points], medoid, beam)
            graph[points] = robust_prune(v, points, np.concatenate([ids, graph[points]], axis=1), degree, alpha if final else 1.0)
            _link_back(v, graph, points, degree, alpha if final else 1.0)
    return _attach(v, graph), medoid


def _attach(v: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """graph, widened so that the two nearest links of each class lead back to it. Where many lead back to one class, as in a dense group around a centre, they hang below it as a heap: the nearest directly, each further one below an earlier one."""
    n, degree = graph.shape
    extra: list[list[int]] = [[] for _ in range(n)]
    below: dict[int, list[tuple[float, int]]] = {}
    for k in range(min(2, degree)):
        for x in np.flatnonzero(graph[:, k] >= 0).tolist():
            z = int(graph[x, k])
            if not (graph[z] == x).any():
                below.setdefault(z, []).append((-float(v[z] @ v[x]), x))
    for z, own in below.items():
        own.sort()
        for i, (_, x) in enumerate(own):
            extra[z if i < degree else own[(i - degree) // 2][1]].append(x)
    wide = np.full((n, degree + max([0, *map(len, extra)])), -1)
    wide[:, :degree] = graph
    for x, own in enumerate(extra):
        wide[x, degree : degree + len(own)] = own
    return wide


def _link_back(v: np.ndarray, graph: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    rows, cols = np.nonzero(graph[points] >= 0)
    to, of = graph[points][rows, cols], points[rows]
    known = (graph[to] == of[:, None]).any(axis=1)
    to, of = to[~known], of[~known]
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    heads, first, counts = np.unique(to, return_index=True, return_counts=True)
    # the lists that have grown, widest first, in blocks of alike width
    for block in np.array_split(np.argsort(counts, kind="stable"), max(1, len(heads) // 256)):
        if not len(block):
            continue
        width = int(counts[block].max())
        extra = np.full((len(block), width), -1)
        for i, b in enumerate(block):
            extra[i, : counts[b]] = of[first[b] : first[b] + counts[b]]
        lists = np.concatenate([graph[heads[block]], extra], axis=1)
        for part in range(0, len(block), max(1, 20_000 // lists.shape[1] ** 2 + 1) if lists.shape[1] > 400 else len(block)):
            stop = part + (max(1, 20_000 // lists.shape[1] ** 2 + 1) if lists.shape[1] > 400 else len(block))
            graph[heads[block[part:stop]]] = robust_prune(v, heads[block[part:stop]], lists[part:stop], degree, alpha)


def in_range(v: np.ndarray, graph: np.ndarray, points: np.ndarray, start: int, least: float, beam: int = BEAM, slack: float = 0.06) -> tuple[np.ndarray, np.ndarray]:
    """(query places, found places) with similarity of at least `least`: greedy search, then on from all that lies in range or within slack of it."""
    ids, sims = beam_search(v, graph, v[points], start, beam)
    # what the beam has passed over may lie in range: only what it holds counts as seen from here
    seen = np.zeros((len(points), len(v)), bool)
    rows, cols = np.nonzero(ids >= 0)
    seen[rows, ids[rows, cols]] = True
    rows, cols = np.nonzero(sims >= least - slack)
    q, f = rows, ids[rows, cols]
    out_q, out_f = [q], [f]
    close = sims[rows, cols]
    hits = [close >= least - 1e-5]
    while len(q):
        next_q, next_f, next_s = [], [], []
        for at in range(0, len(q), 20_000):
            near = graph[f[at : at + 20_000]]
            r, c = np.nonzero(near >= 0)
            pairs = np.unique(q[at : at + 20_000][r].astype(np.int64) * len(v) + near[r, c])
            pq, pf = pairs // len(v), pairs % len(v)
            fresh = ~seen[pq, pf]
            pq, pf = pq[fresh], pf[fresh]
            seen[pq, pf] = True
            s = np.einsum("ij,ij->i", v[points[pq]], v[pf])
            go = s >= least - slack
            next_q.append(pq[go])
            next_f.append(pf[go])
            next_s.append(s[go])
        q, f, s = np.concatenate(next_q), np.concatenate(next_f), np.concatenate(next_s)
        out_q.append(q)
        out_f.append(f)
        hits.append(s >= least - 1e-5)
    hit = np.concatenate(hits)
    return points[np.concatenate(out_q)[hit]], np.concatenate(out_f)[hit]


# ---- over the table ----


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def classes_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Distinct comparable vectors of each label: id (a hash of label and vector), least (smallest vec_id), label, dim, v (unit), n."""
    good = F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # adding zero makes -0.0 and 0.0 one
    rows = vectors.where(good).select(F.col(id_col).alias("least"), F.col(label_col).cast("string").alias("label"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("raw"))
    rows = rows.groupBy("label", "raw").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n"))
    # scaled by the largest component first: no overflow, and no zero by underflow
    top = F.array_max(F.transform("raw", lambda x: F.abs(x)))
    rows = rows.withColumn("top", top).where(F.col("top") > 0).withColumn("v", F.transform("raw", lambda x: x / F.col("top")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.select(F.xxhash64("label", "raw").alias("id"), "least", F.concat_ws("|", F.size("raw").cast("string"), "label").alias("label"), F.transform("v", lambda x: x / F.col("norm")).alias("v"), "n", "raw")


def centroids(classes: DataFrame, large: DataFrame, shard: int) -> dict[str, np.ndarray]:
    """Centroids of the labels in large(label, size), those of more classes than a shard, from a bounded sample: SAMPLE vectors, or eight for each centroid if that is more."""
    total = large.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return {}
    scale = max(1, -(-total // (shard * MOST_CENTROIDS)))
    rate = min(1.0, max(SAMPLE / total, 8 / (shard * scale)))
    part = classes.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < int(rate * (1 << 20)))
    by_label: dict[str, tuple[int, list]] = {}
    for r in part.join(large, "label").select("label", "size", "id", "v").collect():
        by_label.setdefault(r["label"], (r["size"], []))[1].append((r["id"], r["v"]))
    out = {}
    for label, (size, own) in sorted(by_label.items()):
        k = min(len(own), max(2, -(-size // (shard * scale))))
        if k < 2:
            continue
        v = np.array([x for _, x in sorted(own)])
        c = v[np.random.default_rng(3).choice(len(v), k, replace=False)]
        for _ in range(8):
            near = (v @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, v)
            length = np.linalg.norm(sums, axis=1)
            c = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-12)[:, None], c)
        out[label] = c
    return out


def _assign(cents: dict[str, np.ndarray], overlap: int):
    @F.pandas_udf("array<int>")
    def nearest(labels: pd.Series, vectors: pd.Series) -> pd.Series:
        out: list = [[0]] * len(labels)
        for label in labels.unique():
            c = cents.get(label)
            if c is None:
                continue
            rows = np.flatnonzero(labels.to_numpy() == label)
            for at in range(0, len(rows), 4096):
                own = rows[at : at + 4096]
                s = _matrix(vectors.iloc[own]) @ c.T
                k = min(overlap, len(c))
                best = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1)
                for i, b in zip(own, best, strict=True):
                    out[i] = b.tolist()
        return pd.Series(out)

    return nearest


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id", ignore_index=True)
    graph, medoid = build(_matrix(rows["v"]).astype(np.float32))
    ids = rows["id"].to_numpy()
    near = [ids[g[g >= 0]].tolist() for g in graph]
    return pd.DataFrame({"label": rows["label"], "shard": rows["shard"], "id": ids, "near": near, "medoid": np.arange(len(ids)) == medoid})


def _search_shard(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["own", "id"], ascending=[False, True], ignore_index=True)
        ids, own, n = rows["id"].to_numpy(), rows["own"].to_numpy(), rows["n"].to_numpy()
        exact = _matrix(rows["v"])
        v = exact.astype(np.float32)
        place = {x: i for i, x in enumerate(ids.tolist())}
        lists = [[place[x] for x in near if x in place] for near in rows["near"]]
        graph = np.full((len(ids), max([1, *map(len, lists)])), -1)
        for i, own_list in enumerate(lists):
            graph[i, : len(own_list)] = own_list
        medoids = np.flatnonzero(rows["medoid"].to_numpy() & own)
        start = int(medoids[0]) if len(medoids) else 0
        mine = np.flatnonzero(own)
        # links of each class to classes of this shard, counted here if it is the first that both are in; to others, as pairs
        shard = int(rows["shard"].iloc[0])
        kinds = sorted({tuple(sorted(x)) for x in rows["shards"]})
        kind_of = np.array([kinds.index(tuple(sorted(x))) for x in rows["shards"]])
        first = np.array([[min(set(a) & set(b), default=-1) for b in kinds] for a in kinds])
        pairs: list[np.ndarray] = []
        for at in range(0, len(mine), 256):
            q, f = in_range(v, graph, mine[at : at + 256], start, threshold)
            keep = q != f
            q, f = q[keep], f[keep]
            for part in range(0, len(q), 200_000):
                a, b = q[part : part + 200_000], f[part : part + 200_000]
                true = np.einsum("ij,ij->i", exact[a], exact[b]) >= threshold
                pairs.append(np.minimum(a[true], b[true]).astype(np.int64) * len(ids) + np.maximum(a[true], b[true]))
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        a, b = both // len(ids), both % len(ids)
        inner = own[a] & own[b] if len(both) else np.zeros(0, bool)
        shared = first[kind_of[a], kind_of[b]]
        counted, apart = inner & (shared == shard), ~inner & (shared < 0)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a[counted], n[b[counted]])
        np.add.at(links, b[counted], n[a[counted]])
        root = np.arange(len(ids))
        ra, rb = a[inner], b[inner]
        while True:  # smallest reachable place: hook and jump
            low = np.minimum(root[ra], root[rb])
            new = root.copy()
            np.minimum.at(new, root[ra], low)
            np.minimum.at(new, root[rb], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        out = [pd.DataFrame({"u": ids[links > 0], "w": ids[links > 0], "links": links[links > 0]})]
        moved = root != np.arange(len(ids))
        out.append(pd.DataFrame({"u": ids[moved], "w": ids[root[moved]], "links": np.zeros(moved.sum(), np.int64)}))
        out.append(pd.DataFrame({"u": np.minimum(ids[a[apart]], ids[b[apart]]), "w": np.maximum(ids[a[apart]], ids[b[apart]]), "links": np.full(apart.sum(), -1)}))
        return pd.concat(out, ignore_index=True)

    return run


def _find(classes: DataFrame, threshold: float, shard: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(id, links to other classes' rows) and (u, v) links that join the components."""
    large = classes.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > shard)
    cents = centroids(classes, large, shard)
    placed = cut(classes.select("id", "label", "v", "n", _assign(cents, overlap)("label", "v").alias("shards")))
    members = placed.withColumn("shard", F.explode("shards"))
    built = cut(members.groupBy("label", "shard").applyInPandas(_build_shard, "label string, shard int, id long, near array<long>, medoid boolean"))
    united = cut(built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    here = members.join(built.select("label", "shard", "id", "medoid"), ["label", "shard", "id"]).join(united, "id").withColumn("own", F.lit(True))
    reach = members.select("label", "shard", "id").join(united, "id").select("label", "shard", F.explode("near").alias("id")).distinct()
    reach = reach.join(members.select("label", "shard", "id"), ["label", "shard", "id"], "left_anti")
    there = reach.join(placed.drop("label"), "id").join(united, "id").withColumn("medoid", F.lit(False)).withColumn("own", F.lit(False))
    names = ["label", "shard", "id", "v", "n", "shards", "near", "medoid", "own"]
    found = cut(here.select(names).unionByName(there.select(names)).groupBy("label", "shard").applyInPandas(_search_shard(threshold), "u long, w long, links long"))
    across = found.where(F.col("links") == -1).select("u", "w").distinct()
    sizes_of = placed.select("id", "n")
    other = across.unionByName(across.select(F.col("w").alias("u"), F.col("u").alias("w"))).join(sizes_of.withColumnRenamed("id", "w"), "w").select(F.col("u").alias("id"), F.col("n").alias("links"))
    inside = found.where(F.col("links") > 0).select(F.col("u").alias("id"), "links")
    counts = inside.unionByName(other).groupBy("id").agg(F.sum("links").alias("links"))
    return cut(counts), found.where(F.col("u") != F.col("w")).select("u", F.col("w").alias("v"))


def _compare_blocks(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        ids, n, block = rows["id"].to_numpy(), rows["n"].to_numpy(), rows["block"].to_numpy()
        v = _matrix(rows["v"])
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        right = np.flatnonzero(block == j)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        left = np.flatnonzero(block == i)
        for at in range(0, len(left), 256):
            own = left[at : at + 256]
            x, y = np.nonzero(v[own] @ v[right].T >= threshold)
            a, b = own[x], right[y]
            if i == j:
                a, b = a[a < b], b[a < b]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            while True:  # smallest reachable place of these links and all before: hook the roots and jump
                low = np.minimum(root[a], root[b])
                new = root.copy()
                np.minimum.at(new, root[a], low)
                np.minimum.at(new, root[b], low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
        hit, moved = links > 0, root != np.arange(len(ids))
        out = [pd.DataFrame({"u": ids[hit], "w": ids[hit], "links": links[hit]}), pd.DataFrame({"u": ids[moved], "w": ids[root[moved]], "links": np.zeros(moved.sum(), np.int64)})]
        return pd.concat(out, ignore_index=True)

    return run


def _find_all(classes: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """As _find, by comparing all pairs of blocks of a label: every link, in time that grows with the square of a label's classes. Links are counted before the shuffle."""
    sizes = classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    placed = classes.select("id", "label", "v", "n").join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "label", "v", "n", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = cut(dealt.groupBy("label", "i", "j").applyInPandas(_compare_blocks(threshold), "u long, w long, links long"))
    counts = found.where(F.col("links") > 0).groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    return cut(counts), found.where(F.col("u") != F.col("w")).select("u", F.col("w").alias("v"))


def audit(classes: DataFrame, counts: DataFrame, threshold: float, audited: int = AUDITED) -> float:
    """Links found, as a share of those that brute force finds, of a bounded sample of classes against all classes of their label."""
    total = classes.count()
    # half of the sample from classes with links found, where a miss can show
    with_links = classes.join(counts, "id").select("id", "label", "v", "links")
    a = with_links.orderBy(F.xxhash64("id", F.lit(23))).limit(audited).collect()
    b = classes.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(max(1, total // audited))) == 0).select("id", "label", "v").limit(2 * audited).join(counts, "id", "left").select("id", "label", "v", F.coalesce("links", F.lit(0)).alias("links")).collect()
    sample = {r["id"]: r for r in [*a, *b]}
    by_label: dict[str, tuple[list, np.ndarray]] = {}
    for label in {r["label"] for r in sample.values()}:
        own = sorted(i for i, r in sample.items() if r["label"] == label)
        by_label[label] = (own, np.array([sample[i]["v"] for i in own]))

    def brute(batches):
        sums: dict[int, int] = {}
        for batch in batches:
            for label, rows in batch.groupby("label"):
                if label in by_label:
                    own, m = by_label[label]
                    hit = (m @ _matrix(rows["v"]).T) >= threshold
                    hit &= np.array(own)[:, None] != rows["id"].to_numpy()[None, :]
                    for i, s in zip(own, hit.astype(np.int64) @ rows["n"].to_numpy(), strict=True):
                        sums[i] = sums.get(i, 0) + int(s)
        yield pd.DataFrame({"id": list(sums), "links": list(sums.values())}, dtype="int64")

    true = {r["id"]: r["links"] for r in classes.select("id", "label", "v", "n").mapInPandas(brute, "id long, links long").groupBy("id").agg(F.sum("links").alias("links")).collect()}
    wanted = sum(true.values())
    return sum(min(r["links"], true.get(i, 0)) for i, r in sample.items()) / wanted if wanted else 1.0


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shard: int = SHARD, overlap: int = OVERLAP, least_recall: float = 0.95, complete: bool = False) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) for each row, and the audited recall. complete: an exact check of every pair of a label follows the search, so that no link is missing however few the audit would let pass."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    classes = cut(classes_of(rows, "vec_id", "embedding", "label"))
    for _ in range(3):
        counts, edges = _find(classes, threshold, shard, overlap)
        if complete:
            counts, missed = _find_all(classes, threshold, CHECKED)
            edges, recall = edges.unionByName(missed), 1.0
            break
        recall = audit(classes, counts, threshold)
        if recall >= least_recall:
            break
        overlap *= 2
    else:
        counts, edges = _find_all(classes, threshold, shard)
        recall = 1.0
    linked = components(edges).withColumnRenamed("node", "id").withColumnRenamed("label", "component")
    found = classes.select("id", "least", "n", "label", "raw").join(counts, "id", "left").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = found.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = found.join(named, "component").select(F.col("label").alias("of"), "raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("known"))
    own_label = F.when(F.col("label").isNotNull(), F.concat_ws("|", F.size("embedding").cast("string"), F.col("label").cast("string")))
    keyed = rows.select("vec_id", own_label.alias("of"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("raw"))
    out = keyed.join(of_class, ["of", "raw"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), recall


def op6(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return near_vectors(vectors)[0]
