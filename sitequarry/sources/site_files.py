"""robots.txt and llms.txt from stored bodies, and how far the dates of a sitemap can be trusted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.functions import text as tx
from sitequarry.functions import urls

#: AI agents, who runs them, and whether they obey robots.txt.
AI_AGENTS = (
    ("GPTBot", "OpenAI", True), ("OAI-SearchBot", "OpenAI", True), ("ChatGPT-User", "OpenAI", False), ("ClaudeBot", "Anthropic", True), ("anthropic-ai", "Anthropic", True),
    ("PerplexityBot", "Perplexity", True), ("CCBot", "Common Crawl", True), ("Bytespider", "ByteDance", True), ("cohere-ai", "Cohere", True), ("Google-Extended", "Google", True),
    ("Google-CloudVertexBot", "Google", True), ("Google-Agent", "Google", False), ("Google-NotebookLM", "Google", False),
)


def robots_rules(body: str | None) -> list[tuple[int, str, str, str, int]]:
    """(group, agent, directive, value, line) of robots.txt; agents in consecutive lines share a group."""
    out: list[tuple[int, str, str, str, int]] = []
    agents: list[str] = []
    group, open_agents = -1, False
    for number, raw in enumerate((body or "").splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        name, colon, value = (x.strip() for x in line.partition(":"))
        if not colon:
            continue
        name = name.lower()
        if name == "user-agent":
            if not open_agents:
                group, agents = group + 1, []
            agents.append(value.lower())
            open_agents = True
            out.append((group, value.lower(), "user-agent", value, number))
        elif name in ("allow", "disallow", "crawl-delay"):
            open_agents = False
            out += [(group, a, name, value, number) for a in agents]
        elif name == "sitemap":
            out.append((-1, "", "sitemap", value, number))
    return out


def _pattern(value: str) -> re.Pattern[str]:
    end = value.endswith("$")
    return re.compile("".join(".*" if c == "*" else re.escape(c) for c in value.rstrip("$")) + ("$" if end else ""))


def is_allowed(rules: list[tuple[int, str, str, str, int]], agent: str, path: str) -> bool:
    """The longest match of the agent's group, or else of the group for all; ties are allowed."""
    agent = agent.lower()
    names = {a for _, a, d, _, _ in rules if d == "user-agent"}
    own = max((n for n in names if n != "*" and n and n in agent), key=len, default="*")
    best = (-1, True)
    for _, a, directive, value, _ in rules:
        if a == own and directive in ("allow", "disallow") and value and _pattern(value).match(path):
            best = max(best, (len(value), directive == "allow"))
    return best[1]


def parse_robots(bodies: DataFrame, key: str = "host", body: str = "body") -> DataFrame:
    """A row for each rule of each body: key, group, agent, directive, value, line."""

    @F.arrow_udtf(returnType=f"{key} string, group int, agent string, directive string, value string, line int")
    class Rules:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                rules = robots_rules(text.as_py())
                group, agent, directive, value, line = zip(*rules, strict=True) if rules else [()] * 5
                yield pa.table({key: pa.array([name.as_py()] * len(rules), pa.string()), "group": pa.array(group, pa.int32()), "agent": pa.array(agent, pa.string()), "directive": pa.array(directive, pa.string()), "value": pa.array(value, pa.string()), "line": pa.array(line, pa.int32())})

    return Rules(bodies.select(F.col(key).cast("string"), F.col(body).cast("string")).asTable())


def check_allowed(requests: DataFrame, bodies: DataFrame, agent: str, key: str = "host") -> DataFrame:
    """requests(host, url) with allowed; hosts without robots.txt allow all."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, list] = {}
        for bodies_, paths in batches:
            out = []
            for b, p in zip(bodies_, paths, strict=True):
                if b is not None and b not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[b] = robots_rules(b)
                out.append(True if b is None else is_allowed(known[b], agent, p))
            yield pd.Series(out)

    q = urls.query(F.col("url"))
    return requests.join(bodies.select(key, F.col("body")), key, "left").withColumn("allowed", run("body", F.concat(urls.path(F.col("url")), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))).drop("body")


def effective_rate(rate: Column, delay: Column) -> Column:
    """Requests a second under a crawl delay."""
    return F.when(delay > 0, F.least(rate, 1 / delay)).otherwise(rate)


def ai_access(rules: DataFrame, spark: SparkSession, key: str = "host") -> DataFrame:
    """For each host and AI agent: access, and the group that decides: the agent's own, or else that for all."""
    agents = F.broadcast(spark.createDataFrame(list(AI_AGENTS), "agent string, operator string, obeys boolean"))
    per = rules.where("agent != ''").groupBy(key, F.col("agent").alias("name")).agg(
        F.count_if((F.col("directive") == "disallow") & F.col("value").isin("/", "/*")).alias("root"), F.count_if((F.col("directive") == "disallow") & (F.col("value") != "")).alias("some"), F.count_if((F.col("directive") == "allow") & (F.col("value") != "")).alias("allows"), F.min("line").alias("line"),
    )
    pairs = rules.select(key).distinct().crossJoin(agents)
    own = per.select(F.col(key).alias("own_key"), F.col("name").alias("own"), F.struct(F.col("name").alias("group"), "root", "some", "allows", "line").alias("a"))
    rest = per.where("name = '*'").select(key, F.struct(F.lit("*").alias("group"), "root", "some", "allows", "line").alias("b"))
    rows = pairs.join(own, (pairs[key] == own["own_key"]) & (F.lower(pairs["agent"]) == own["own"]), "left").drop("own_key", "own").join(rest, key, "left").withColumn("g", F.coalesce("a", "b"))
    access = F.when(~F.col("obeys"), "ignores robots.txt").when((F.col("g.root") > 0) & (F.col("g.allows") == 0), "blocked").when(F.col("g.some") > 0, "partly blocked").otherwise("allowed")
    return rows.select(key, "agent", "operator", access.alias("access"), F.col("g.group").alias("matched_group"), F.col("g.line").alias("matched_line"))


def llms_txt(status: Column, content_type: Column, body: Column) -> Column:
    """Whether a response is a real llms.txt."""
    return (status == 200) & ~F.coalesce(content_type, F.lit("")).contains("html") & (F.trim(F.coalesce(body, F.lit(""))) != "") & ~F.lower(F.trim(body)).startswith("<!doctype") & ~F.lower(F.trim(body)).startswith("<html")


def lastmod_trust(entries: DataFrame, now: Column) -> DataFrame:
    """How far the dates of a sitemap can be trusted: counts and one verdict."""
    at = tx.w3c_time(F.col("lastmod"))
    given = F.col("lastmod").isNotNull()
    rows = entries.select("lastmod", given.alias("given"), at.alias("at"), now.alias("now"))
    agg = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("given").alias("with_lastmod"), F.count_if(F.col("given") & F.col("at").isNull()).alias("invalid"), F.countDistinct("lastmod").alias("distinct_values"),
        F.count_if(F.col("at") > F.col("now") + F.expr("interval 24 hours")).alias("future"), F.count_if(F.abs(F.unix_millis("now") - F.unix_millis("at")) <= 3_600_000).alias("within_last_hour"),
        F.min_by("lastmod", "at").alias("oldest"), F.max_by("lastmod", "at").alias("newest"),
    )
    dated = F.col("with_lastmod") - F.col("invalid")
    verdict = (
        F.when(F.col("with_lastmod") == 0, "absent").when(F.col("future") > 0, "suspect-future").when(F.col("invalid") > 0, "suspect-invalid")
        .when((dated > 1) & (F.col("within_last_hour") == dated), "suspect-stamped-now").when((F.col("with_lastmod") > 1) & (F.col("distinct_values") == 1), "suspect-uniform")
        .when(F.col("with_lastmod") < F.col("total"), "partial").otherwise("trustworthy")
    )
    return agg.withColumn("verdict", verdict)
