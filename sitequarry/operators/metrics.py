"""Search-metric time series: rollups, trends, upserts, coverage, and scores of opportunity and decay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import text as tx
from sitequarry.functions import urls


def in_range(rows: DataFrame, start: str, end: str, search_type: str | None = None) -> DataFrame:
    rows = rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.where(F.col("search_type") == search_type) if search_type else rows


def _weighted(position: str = "position") -> Column:
    """Mean position, weighted by impressions."""
    return F.sum(F.col(position) * F.col("impressions")) / F.sum("impressions")


def page_rollup(rows: DataFrame, most: int | None = None) -> DataFrame:
    """All pages, or the `most` of the most impressions: sums, ratio of sums, weighted position, days. A page of one row keeps its stored figures."""
    one = F.count(F.lit(1)) == 1
    out = rows.groupBy("page_url").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.when(one, F.first("ctr")).otherwise(F.when(F.sum("impressions") > 0, F.sum("clicks") / F.sum("impressions")).otherwise(0.0)).alias("ctr"),
        F.when(one, F.first("position")).otherwise(F.when(F.sum("impressions") > 0, _weighted()).otherwise(0.0)).alias("position"), F.count(F.lit(1)).alias("days"),
    )
    return out if most is None else out.orderBy(F.col("impressions").desc(), "page_url").limit(most)


def daily_trend(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")).orderBy("date")


def totals(rows: DataFrame) -> DataFrame:
    """One row, or none without rows."""
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), (F.sum("clicks") / F.sum("impressions")).alias("ctr"), _weighted().alias("position"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("page_url").alias("pages"),
    ).where("rows > 0")


def breakdown(rows: DataFrame, dimension: str, start: str, end: str) -> DataFrame:
    """Rows of one dimension whose window is exactly this; windows are not summed."""
    same = (F.col("window_start") == F.lit(start).cast("date")) & (F.col("window_end") == F.lit(end).cast("date"))
    return rows.where((F.col("dimension") == dimension) & same).orderBy(F.col("impressions").desc(), "key_value")


def coverage_rollup(inspections: DataFrame) -> DataFrame:
    return inspections.groupBy("verdict", "coverage_state").agg(F.count(F.lit(1)).alias("urls")).orderBy(F.col("urls").desc(), "verdict", "coverage_state")


def inspection_order(inspections: DataFrame) -> DataFrame:
    rank = F.lit(4)
    for i, v in enumerate(("FAIL", "NEUTRAL", "PARTIAL", "PASS")):
        rank = F.when(F.col("verdict") == v, i).otherwise(rank)
    return inspections.orderBy(rank, "url")


def upsert(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = ("date", "page_url", "search_type"), order: str = "ingested_at") -> DataFrame:
    """The last write of each key."""
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def is_covered(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Whether the dates held reach over a range; gaps inside don't show."""
    return rows.agg(F.coalesce((F.min("date") <= F.lit(start).cast("date")) & (F.max("date") >= F.lit(end).cast("date")), F.lit(False)).alias("covered"))


def provisional(rows: DataFrame, today: Column) -> DataFrame:
    """Rows of the last days, which are fetched again."""
    return rows.where(tx.is_provisional(F.col("date"), today))


def with_crawl(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, page_id, clicks, impressions, position, crawled, shown) of all pages of a crawl and all URLs that were shown, joined on the normalised URL.

    rows(page_url, clicks, impressions, position), pages(page_id, normalized_url). Rows of one identity are summed before the join;
    of pages that share one the first by page_id is named.
    """
    shown = rows.withColumn("key", F.coalesce(urls.normalize_url("page_url"), F.col("page_url"))).groupBy("key").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), _weighted().alias("position"))
    own = pages.select(F.coalesce("normalized_url", F.lit(None).cast("string")).alias("key"), "page_id").where("key is not null").groupBy("key").agg(F.min("page_id").alias("page_id"))
    both = own.withColumn("crawled", F.lit(True)).join(shown.withColumn("shown", F.lit(True)), "key", "full_outer")
    return both.select("key", "page_id", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("impressions", F.lit(0)).alias("impressions"), "position", F.coalesce("crawled", F.lit(False)).alias("crawled"), F.coalesce("shown", F.lit(False)).alias("shown"))


def asked_and_allowed(asked: DataFrame, allowed: DataFrame, most: int | None = None) -> DataFrame:
    """URLs that were asked for and may be inspected, in the order they were asked for (url, place), `most` of them if given: an intersection on the normalised URL that keeps the first way a URL was written."""
    key = F.coalesce(urls.normalize_url("url"), F.col("url"))
    first = asked.withColumn("key", key).groupBy("key").agg(F.min(F.struct("place", "url")).alias("f")).select("key", "f.*")
    kept = first.join(allowed.select(key.alias("key")).distinct(), "key", "left_semi").select("url", "place")
    return kept if most is None else kept.orderBy("place", "url").limit(most)


def inspection_candidates(pages: DataFrame, inspected: DataFrame, traffic: DataFrame, today: Column, quota: int = 2000, rest_days: int = 7) -> DataFrame:
    """URLs not inspected of late, most impressions first, within the quota."""
    late = inspected.where(F.datediff(today, F.col("inspected_on")) < rest_days).select("url")
    rows = pages.select("url").unionByName(traffic.select("url")).distinct().join(late, "url", "left_anti")
    seen = traffic.groupBy("url").agg(F.sum("impressions").alias("impressions"))
    return rows.join(seen, "url", "left").na.fill(0, ["impressions"]).orderBy(F.col("impressions").desc(), "url").limit(quota)


def inspections_left(attempts: DataFrame, today: Column, quota: int = 2000) -> DataFrame:
    """Attempts by Pacific day and what is left of the quota."""
    return attempts.groupBy(tx.pacific_date(F.col("at")).alias("day")).agg(F.count(F.lit(1)).alias("used")).withColumn("left", F.greatest(F.lit(0), F.lit(quota) - F.col("used")))


#: Expected click rate by position, between which values are interpolated: medians over published studies.
PRIOR_CURVE = ((1, 0.27), (2, 0.156), (3, 0.11), (4, 0.076), (5, 0.062), (6, 0.048), (7, 0.035), (8, 0.027), (9, 0.024), (10, 0.024), (12, 0.017), (15, 0.0105), (20, 0.0047))
#: The curve of one study alone, which the medians replace.
SINGLE_CURVE = ((1, 0.398), (2, 0.187), (3, 0.102), (4, 0.072), (5, 0.051), (6, 0.044), (7, 0.03), (8, 0.021), (9, 0.019), (10, 0.016), (12, 0.012), (15, 0.008), (20, 0.004))
Curve = tuple[tuple[float, float], ...]


def expected_ctr(position: Column, curve: Curve = PRIOR_CURVE) -> Column:
    """The curve at a position, by linear interpolation; its ends beyond them."""
    out = F.lit(curve[-1][1])
    for (a, x), (b, y) in reversed(list(zip(curve, curve[1:], strict=False))):
        out = F.when(position <= b, x + (position - a) * (y - x) / (b - a)).otherwise(out)
    return F.when(position <= curve[0][0], F.lit(curve[0][1])).otherwise(out)


def opportunity(queries: DataFrame, curve: Curve = PRIOR_CURVE, kappa: float | None = None) -> DataFrame:
    """Scores of (page_url, impressions, ctr, position; cpc and difficulty if given): clicks that a better snippet and a better place could bring.

    gap: impressions times what the click rate lacks; upside: impressions times what place 3 (or five places up, from the second
    page) would add; raw: (0.4 gap + 0.6 upside) by value and difficulty; score: 100 (1 - exp(-raw / kappa)), kappa 500 or the
    median clicks of the 50 best pages if those are more. Only rows with 200 impressions and a position from 4 to 20.
    """
    best = queries.groupBy("page_url").agg(F.sum(F.col("impressions") * F.col("ctr")).alias("c")).orderBy(F.col("c").desc(), "page_url").limit(50)
    scale = F.broadcast(best.agg(F.greatest(F.lit(500.0), F.coalesce(F.median("c"), F.lit(0.0))).alias("kappa")))  # one row
    p, ctr, impressions = F.col("position"), F.col("ctr"), F.col("impressions")
    here, target = expected_ctr(p, curve), F.when(p <= 10, F.lit(3.0)).otherwise(p - 5)
    gap = impressions * F.greatest(F.lit(0.0), here - ctr)
    upside = impressions * F.greatest(F.lit(0.0), expected_ctr(target, curve) - F.greatest(ctr, here))
    value = F.least(F.lit(2.0), 1 + F.log10(1 + F.coalesce("cpc", F.lit(0.0)))) if "cpc" in queries.columns else F.lit(1.0)
    damping = 1 / (1 + F.coalesce("difficulty", F.lit(0.0)) / 100) if "difficulty" in queries.columns else F.lit(1.0)
    rows = queries.where((impressions >= 200) & p.between(4, 20)).withColumns({"gap": gap, "upside": upside}).withColumn("raw", (0.4 * F.col("gap") + 0.6 * F.col("upside")) * value * damping)
    rows = rows.withColumn("kappa", F.lit(float(kappa))) if kappa else rows.crossJoin(scale)
    rows = rows.withColumn("score", tx.round_half_up(100 * (1 - F.exp(-F.col("raw") / F.col("kappa"))), 1)).drop("kappa")
    return rows.withColumn("band", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 25, "medium").otherwise("low"))


def page_scores(scored: DataFrame) -> DataFrame:
    """The best score of a page and a tenth of its others."""
    return scored.groupBy("page_url").agg((F.max("score") + 0.1 * (F.sum("score") - F.max("score"))).alias("page_score"))


def refit_curve(rows: DataFrame, curve: Curve = PRIOR_CURVE, weight: float = 1000.0) -> DataFrame:
    """(site, band, expected, own_weight): click rates by position band, shrunk to the curve and made to fall. Bands: 1 to 10, 11-15, 16-20."""
    p = F.floor(F.col("position") + 0.5)
    band = F.when(p <= 10, F.greatest(p, F.lit(1))).when(p <= 15, 11).when(p <= 20, 16).cast("int")
    sums = rows.withColumn("band", band).where("band is not null").groupBy("site", "band").agg(F.sum("clicks").cast("double").alias("clicks"), F.sum("impressions").cast("double").alias("impressions"))
    middle = F.when(F.col("band") == 11, 13.0).when(F.col("band") == 16, 18.0).otherwise(F.col("band").cast("double"))
    fitted = sums.select("site", "band", ((F.col("clicks") + weight * expected_ctr(middle, curve)) / (F.col("impressions") + weight)).alias("e"), (F.col("impressions") + weight).alias("w"), (F.col("impressions") / (F.col("impressions") + weight)).alias("own"))

    def pool(bands: pd.DataFrame) -> pd.DataFrame:
        bands = bands.sort_values("band")
        groups: list[list[float]] = []  # value, weight, how many
        for e, w in zip(bands["e"], bands["w"], strict=True):
            groups.append([e, w, 1])
            while len(groups) > 1 and groups[-2][0] < groups[-1][0]:
                b, a = groups.pop(), groups.pop()
                groups.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
        return pd.DataFrame({"site": bands["site"], "band": bands["band"], "expected": [g[0] for g in groups for _ in range(int(g[2]))], "own_weight": bands["own"]})

    return fitted.groupBy("site").applyInPandas(pool, "site string, band int, expected double, own_weight double")


def decay(rows: DataFrame, least_drop: float = 0.3, worse_by: float = 2.0, days: int = 28, times: int = 3) -> DataFrame:
    """Pages in decay, from (page_url, date, clicks, impressions, position): at each of the last `times` weekly looks the clicks of 28 days are down by 30 % and the position is worse by 2 against the same days a year before, or else against the best 28 days before.

    kind: `demand` if impressions are down as much and the position holds, `ranking` otherwise; severity by lost clicks.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    daily = rows.groupBy("page_url", "date").agg(F.sum("clicks").cast("double").alias("c"), F.sum("impressions").cast("double").alias("i"), F.sum(F.col("position") * F.col("impressions")).alias("pi")).withColumn("d", day)
    own = Window.partitionBy("page_url").orderBy("d")
    span = own.rangeBetween(-(days - 1), 0)
    sums = daily.select("page_url", "date", "d", F.sum("c").over(span).alias("c"), F.sum("i").over(span).alias("i"), (F.sum("pi").over(span) / F.sum("i").over(span)).alias("p"), F.min("d").over(Window.partitionBy("page_url")).alias("first"))
    sums = sums.where(F.col("d") - F.col("first") >= days - 1)
    year = own.rangeBetween(-365 - 3, -365 + 3)
    peak = own.rangeBetween(-364, -days)
    base = lambda w: F.max(F.struct("c", "i", "p")).over(w)
    looks = sums.withColumn("base", F.coalesce(base(year), base(peak))).where("base is not null")
    last = F.max("d").over(Window.partitionBy("page_url"))
    looks = looks.withColumn("ago", last - F.col("d")).where((F.col("ago") % 7 == 0) & (F.col("ago") < 7 * times))
    down = (F.col("c") <= (1 - least_drop) * F.col("base.c")) & (F.col("base.c") > 0)
    fewer = F.col("i") <= (1 - least_drop) * F.col("base.i")
    hit = down & ((F.col("p") >= F.col("base.p") + worse_by) | fewer)
    out = looks.groupBy("page_url").agg(F.count_if(hit).alias("hits"), F.min_by(F.struct("c", "i", "p", "base"), "ago").alias("now")).where(F.col("hits") >= times)
    lost = F.col("now.base.c") - F.col("now.c")
    ranking = F.col("now.p") >= F.col("now.base.p") + worse_by
    return out.select("page_url", lost.alias("lost_clicks"), F.when(ranking, "ranking").otherwise("demand").alias("kind"), F.when(lost >= 2000, "critical").when(lost >= 500, "major").otherwise("minor").alias("severity"))


def confidence(validation: Column, history: Column, own: Column) -> Column:
    """0.6 validation, 0.3 history, 0.1 self-rating."""
    return 0.6 * validation + 0.3 * history + 0.1 * own


def decision(risk: Column, sure: Column) -> Column:
    """What may happen with a change of this risk (0 to 100) and confidence."""
    high = F.when(risk < 25, "auto-apply").when(risk <= 60, "auto-pr").otherwise("recommend-only")
    middle = F.when(risk < 25, "auto-pr").otherwise("recommend-only")
    return F.when(sure >= 0.85, high).when(sure >= 0.6, middle).otherwise("discard")


def verdict(effect: Column, low: Column, high: Column, opinion: Column, exogenous: Column, worsening: Column) -> Column:
    """Keep, roll back or extend a change, by its relative effect on clicks against a counterfactual and the 90 % interval of that."""
    open_ = (low <= 0) & (high >= 0)
    default = F.when(opinion & (effect < 0), "rollback").otherwise("keep")
    return (
        F.when(effect.isNull(), F.when(opinion, "rollback-on-request").otherwise("keep")).when((effect >= 0) | (open_ & (effect >= -0.05)), "keep")
        .when((effect < -0.2) & (high < 0) & ~exogenous, "rollback").when(open_ & (effect >= -0.2) & worsening, "extend").otherwise(default)
    )


def control_effect(daily: DataFrame, changed: DataFrame, change_day: str) -> DataFrame:
    """(page_url, effect): the ratio of a page's clicks after to before a day, against that ratio of all unchanged pages."""
    day = F.lit(change_day).cast("date")
    sums = daily.groupBy("page_url").agg(F.sum(F.when(F.col("date") < day, F.col("clicks"))).alias("before"), F.sum(F.when(F.col("date") >= day, F.col("clicks"))).alias("after"))
    others = F.broadcast(sums.join(changed.select("page_url"), "page_url", "left_anti").agg((F.sum("after") / F.sum("before")).alias("drift")))  # one row
    rows = sums.join(changed.select("page_url"), "page_url", "left_semi").crossJoin(others)
    return rows.where("before > 0 and drift > 0").select("page_url", (F.coalesce("after", F.lit(0)) / (F.col("before") * F.col("drift")) - 1).alias("effect"))


def cusum(series: DataFrame, key: str, order: str, residual: str, slack: float = 0.5, limit: float = 4.0) -> DataFrame:
    """(key, order, low): the lower cumulative sum of standardized residuals where it first passes the limit.

    The sum restarts at zero: it equals the running total of (residual + slack) less the greatest such total before, so it is
    two running windows and no loop.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = series.withColumn("_t", F.sum(F.col(residual) + slack).over(w)).withColumn("_top", F.greatest(F.lit(0.0), F.max("_t").over(w)))
    rows = rows.withColumn("low", F.col("_t") - F.col("_top")).where(F.col("low") < -limit)
    return rows.groupBy(key).agg(F.min_by(F.struct(order, "low"), order).alias("f")).select(key, "f.*")
