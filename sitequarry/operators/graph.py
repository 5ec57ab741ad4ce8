"""Link graph: PageRank, inlinks, orphans, connected components."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from sitequarry.functions import urls
from sitequarry.plans.lineage import cut, drop_cut


#: Targets of one list of links: a node with more has several lists, so that no row holds a hub whole.
LIST = 4096


def link_lists(links: DataFrame) -> DataFrame:
    """(src, out, to): the targets of distinct links(src, dst) in lists of about LIST, with the number of links of their source. A round over lists sorts and joins a row for each node instead of one for each link."""
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("out") / LIST))
    return links.join(out, "src").groupBy("src", "out", part.alias("part")).agg(F.collect_list("dst").alias("to")).drop("part")


def pagerank(nodes: DataFrame | None, edges: DataFrame, damping: float = 0.85, most: int = 100, epsilon: float = 1e-6, fixed: int | None = None) -> DataFrame:
    """Ranks of nodes(id), or of all that edges name, over edges(src, dst): self-links and repeated links don't count, the rank of nodes without a link out is shared by all.

    One round is a join and a grouped sum; the driver reads two numbers from it, the largest change and the dangling rank.
    Stops when no rank changes by epsilon, or after `fixed` rounds.
    """
    links = edges.select("src", "dst").distinct()
    if nodes is None:
        links = cut(links)
        nodes = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
        named = links
    else:
        named = links.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    lists = cut(link_lists(named.where(F.col("src") != F.col("dst"))))
    base = cut(nodes.select("id").join(lists.select(F.col("src").alias("id")).distinct().withColumn("leads", F.lit(True)), "id", "left"))
    drop_cut(links)
    n = base.count()
    if not n:
        return base.select("id", F.lit(0.0).alias("rank"))
    now = base.withColumn("rank", F.lit(1.0 / n)).withColumn("change", F.lit(0.0))
    dangling = base.where("leads is null").count() / n
    tiny = sys.float_info.epsilon
    for k in range(fixed or most):
        given = lists.join(now.select(F.col("id").alias("src"), "rank"), "src").select(F.explode("to").alias("id"), (F.col("rank") / F.col("out")).alias("part"))
        gained = given.groupBy("id").agg(F.sum("part").alias("gain"))
        rank = F.greatest(F.lit(tiny), F.lit((1 - damping) / n + damping * dangling / n) + damping * F.coalesce("gain", F.lit(0.0)))
        told = Observation()
        step = now.join(gained, "id", "left").select("id", "leads", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change"))
        # the two numbers come with the rows as they are written: no second pass
        after = cut(step.observe(told, F.max("change").alias("change"), F.coalesce(F.sum(F.when(F.col("leads").isNull(), F.col("rank"))), F.lit(0.0)).alias("dangling")))
        change, dangling = told.get["change"], told.get["dangling"]
        drop_cut(now)
        now = after
        if not fixed and change < epsilon:
            break
    for one in (lists, base):
        drop_cut(one)
    return now.select("id", "rank")


def log_scores(ranks: DataFrame) -> DataFrame:
    """Ranks on a logarithmic scale from 1 to 100; all 100 where they are equal."""
    ends = F.broadcast(ranks.agg(F.min(F.log("rank")).alias("low"), F.max(F.log("rank")).alias("high")))  # one row
    score = F.when(F.col("high") <= F.col("low"), 100).otherwise(F.greatest(F.lit(1), F.least(F.lit(100), F.floor(1 + 99 * (F.log("rank") - F.col("low")) / (F.col("high") - F.col("low")) + 0.5))))
    return ranks.crossJoin(ends).select("*", score.cast("int").alias("score")).drop("low", "high")


def link_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a run: pages by path and query - the first by input order owns a shared key - and internal links between them."""
    key = urls.path_and_query(F.coalesce("normalized_url", "url"))
    keyed = pages.select("page_id", "input_order", key.alias("key"))
    owner = keyed.where("key is not null").groupBy("key").agg(F.min_by("page_id", F.struct(F.col("input_order").isNull(), "input_order", "page_id")).alias("owner"))
    links = pages.select(F.col("page_id").alias("src"), key.alias("from_key"), F.explode("links").alias("l")).where("l.type = 'internal'").select("src", "from_key", urls.path_and_query(F.coalesce("l.target_normalized", "l.target")).alias("key"))
    edges = links.where("key is not null and not (key <=> from_key)").join(owner, "key").select("src", F.col("owner").alias("dst"), "key")
    return keyed.select(F.col("page_id").alias("id"), "key"), edges


def page_graph(pages: DataFrame, **options: float) -> DataFrame:
    """Rank, score and inlinks of each page."""
    nodes, edges = link_graph(pages)
    scored = log_scores(pagerank(nodes, edges, **options))
    inlinks = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("inlinks"), F.countDistinct("src").alias("unique_inlinks"))
    named = pages.select(F.col("page_id").alias("id"), F.coalesce("normalized_url", "url").alias("url"))
    return scored.join(inlinks, "id", "left").join(named, "id").select(F.col("id").alias("page_id"), "url", "rank", "score", F.coalesce("inlinks", F.lit(0)).alias("inlinks"), F.coalesce("unique_inlinks", F.lit(0)).alias("unique_inlinks"))


def simple_rank(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The plain variant: 20 rounds, 5 decimals, no logarithm."""
    return pagerank(nodes, edges, fixed=20).withColumn("rank", F.floor(F.col("rank") * 100000 + 0.5) / 100000)


def components(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """(id, component): the smallest id that links reach, by rounds in which every node takes the least label around it and its label's label. Each round replaces the one before."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    now = cut(nodes.select("id", F.col("id").alias("component")))
    for _ in range(most):
        around = both.join(now.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = now.join(around, "id", "left").select("id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = step.join(step.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left")
        after = cut(jump.select("id", F.least("component", "up").alias("component"), "was"))
        drop_cut(now)
        now = after
        if not after.where("component != was").limit(1).count():
            drop_cut(both)
            return now.select("id", "component")
    raise RuntimeError("components: not done")


def degree_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.countDistinct("dst").alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def link_suggestions(pages: DataFrame, phrases: DataFrame, most: int = 5) -> DataFrame:
    """Pages that mention a phrase (target_id, phrase) of a page that they don't link to, best first, at most `most` for each target."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
    asked = phrases.select("target_id", plain("phrase").alias("phrase")).where("phrase != ''")
    # texts are cut into runs of as many words as phrases have, and joined on equality
    lengths = sorted(r["n"] for r in asked.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect())
    words = pages.select("page_id", F.split(plain("content.text"), " ").alias("w"))

    def run(n: int):
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    runs = [run(n) for n in lengths]
    said = words.select("page_id", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *runs))).alias("phrase"))
    hits = said.join(asked, "phrase").where("page_id != target_id")
    _, edges = link_graph(pages)
    new = hits.join(edges.select(F.col("src").alias("page_id"), F.col("dst").alias("target_id")).distinct(), ["page_id", "target_id"], "left_anti")
    scored = new.groupBy("target_id", "page_id").agg(F.count(F.lit(1)).alias("mentions"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("target_id").orderBy(F.col("mentions").desc(), "page_id"))).where(F.col("place") <= most)
