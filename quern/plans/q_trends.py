"""Snapshot analytics: event types and users stand for repos in weekly, monthly and long-standing lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import trends as X
from quern.plans.registry import query
from quern.plans.relation import table
from quern.sources.tables import numbered

# users ranked by the value of their events: the latest week, the latest month, and all
_LISTS = """e AS (SELECT user_id, value, ts, max(ts) OVER () AS last FROM events),
g AS (SELECT 'weekly' AS s, 0 AS o, user_id, sum(value) AS v, count(*) AS n FROM e WHERE ts > last - INTERVAL 7 DAY GROUP BY user_id UNION ALL
 SELECT 'monthly', 1, user_id, sum(value), count(*) FROM e WHERE ts > last - INTERVAL 30 DAY GROUP BY user_id UNION ALL SELECT 'high_star', 2, user_id, sum(value), count(*) FROM e GROUP BY user_id),
l AS (SELECT s, o, 'u/' || user_id AS repo, CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 3 = 0 THEN 'agent ' || s ELSE 'thing | ' || s END AS description, n AS period_stars, n * 1000 AS total_stars,
 row_number() OVER (PARTITION BY s ORDER BY n DESC, user_id) AS rank FROM g)"""
_MERGED = """m AS (SELECT repo, coalesce(arg_min(nullif(description, ''), CASE WHEN description <> '' THEN o END), '') AS description, max(total_stars) AS total_stars, coalesce(max(period_stars) FILTER (WHERE s = 'weekly'), 0) AS weekly_stars,
 coalesce(max(period_stars) FILTER (WHERE s = 'monthly'), 0) AS monthly_stars, coalesce(max(rank) FILTER (WHERE s = 'weekly'), 999) AS weekly_rank, coalesce(max(rank) FILTER (WHERE s = 'monthly'), 999) AS monthly_rank, string_agg(s, ',' ORDER BY o) AS signals FROM l GROUP BY repo)"""
_RELEVANT = "regexp_matches(lower(repo || ' ' || description), '" + "|".join(X.RELEVANT) + r"|\bai\b')"


def _list(spark: SparkSession, sf_dir: str, signal: str, days: int | None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    if days is not None:
        last = e.agg(F.max("ts").alias("last"))
        e = e.crossJoin(F.broadcast(last)).filter(F.col("ts") > F.col("last") - F.expr(f"INTERVAL {days} DAYS"))
    g = e.groupBy("user_id").agg(F.count("*").alias("n"))
    text = F.when(F.col("user_id") % 7 == 0, "").when(F.col("user_id") % 3 == 0, f"agent {signal}").otherwise(f"thing | {signal}")
    g = g.select("user_id", F.concat(F.lit("u/"), "user_id").alias("repo"), text.alias("description"), F.col("n").alias("period_stars"), (F.col("n") * 1000).alias("total_stars"))
    return numbered(g, "rank", F.desc("period_stars"), "user_id").drop("user_id")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.merged(_list(spark, sf_dir, "weekly", 7), _list(spark, sf_dir, "monthly", 30), _list(spark, sf_dir, "high_star", None))


@query("j10_period_merge", f"WITH {_LISTS}, {_MERGED} SELECT * FROM m")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).withColumn("signals", F.array_join("signals", ","))


@query("w5_rank_in_period", f"WITH {_LISTS} SELECT s, repo, rank FROM l WHERE s = 'weekly'")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, "weekly", 7).select(F.lit("weekly").alias("s"), "repo", "rank")


@query("o2_trend_order", f"WITH {_LISTS}, {_MERGED} SELECT repo, row_number() OVER (ORDER BY least(weekly_rank, monthly_rank), weekly_stars DESC, monthly_stars DESC, total_stars DESC, repo) AS place FROM m")
def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = (F.least("weekly_rank", "monthly_rank"), F.desc("weekly_stars"), F.desc("monthly_stars"), F.desc("total_stars"), "repo")
    return numbered(_merged(spark, sf_dir), "place", *order).select("repo", "place")


_SELECTED = f"""q AS (SELECT *, {_RELEVANT} AS relevant, least(weekly_rank, monthly_rank) AS best FROM m),
rc AS (SELECT *, 0 AS branch FROM q WHERE relevant AND signals <> 'high_star' ORDER BY best, weekly_stars DESC, monthly_stars DESC, total_stars DESC, repo LIMIT 6),
hs AS (SELECT *, 1 AS branch FROM q WHERE relevant AND signals = 'high_star' ORDER BY total_stars DESC, repo LIMIT 2),
fs AS (SELECT * FROM rc UNION ALL SELECT * FROM hs), rs AS (SELECT *, 2 AS branch FROM q WHERE repo NOT IN (SELECT repo FROM fs) ORDER BY relevant DESC, best, total_stars DESC, repo LIMIT 8),
al AS (SELECT *, row_number() OVER (ORDER BY branch, CASE WHEN branch = 2 THEN CASE WHEN relevant THEN 0 ELSE 1 END ELSE 0 END, CASE WHEN branch = 1 THEN 0 ELSE best END, CASE WHEN branch = 0 THEN -weekly_stars ELSE 0 END, CASE WHEN branch = 0 THEN -monthly_stars ELSE 0 END, -total_stars, repo) AS place FROM (SELECT * FROM fs UNION ALL SELECT * FROM rs)),
se AS (SELECT * FROM al WHERE (branch < 2 OR place <= (SELECT least(8, count(*), greatest(5, count(*) FILTER (WHERE relevant))) FROM q)) AND place <= 8)"""


@query("o3_trend_selection", f"WITH {_LISTS}, {_MERGED}, {_SELECTED} SELECT repo, place FROM se")
def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.selected(_merged(spark, sf_dir)).select("repo", "place")


@query("f8_relevance", f"WITH {_LISTS} SELECT repo, s, {_RELEVANT} AS relevant FROM l WHERE s = 'monthly'")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, "monthly", 30).select("repo", F.lit("monthly").alias("s"), X.relevant(F.col("repo"), F.col("description")).alias("relevant"))


_ROW = """'| [' || repo || '](https://github.com/' || repo || ') | ' || replace(replace(replace(signals, 'weekly', '近一周'), 'monthly', '近一月'), 'high_star', '高 Star') || ' | ' || format('{:,}', total_stars) || ' | '
 || CASE WHEN weekly_stars = 0 AND monthly_stars = 0 THEN '—' ELSE concat_ws(' / ', CASE WHEN weekly_stars > 0 THEN '周 +' || format('{:,}', weekly_stars) END, CASE WHEN monthly_stars > 0 THEN '月 +' || format('{:,}', monthly_stars) END) END
 || ' | ' || replace(CASE WHEN description = '' THEN 'GitHub Trending repository' ELSE description END, '|', '\\|') || ' |'"""


@query("k7_trend_rows", f"WITH {_LISTS}, {_MERGED}, n AS (SELECT * REPLACE (replace(signals, ',', ' / ') AS signals) FROM m) SELECT repo, {_ROW} AS row FROM n".replace("\\\\|", "\\|"))
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = X.table_row(*(F.col(c) for c in ("repo", "description", "signals", "total_stars", "weekly_stars", "monthly_stars")))
    return _merged(spark, sf_dir).select("repo", row.alias("row"))


_ARTICLES = """p AS (SELECT p_partkey // 20 AS page_id, p_partkey % 20 AS k, 'brand-' || p_size || '/part_' || p_partkey AS name, p_name AS description, p_partkey * 37 % 5000 AS period_stars, CAST(p_size AS BIGINT) * 1500 AS total_stars FROM part)"""


@query("s15_page_articles", f"WITH {_ARTICLES} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS rank, name, trim(description) AS description, period_stars, total_stars FROM p WHERE k <> 7")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages of twenty rows each, made of the parts, read back; one row of a page has no link to a repository."""
    at = F.col("p_partkey") % 20
    name = F.concat(F.lit("brand-"), "p_size", F.lit("/part_"), "p_partkey")
    link = F.when(at == 7, F.lit("/sponsors")).otherwise(F.concat(F.lit("/"), name))
    about = F.replace(F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    week = F.when(F.col("p_partkey") % 2 == 0, "week").otherwise("month")
    row = F.concat(
        F.lit('<article class="Box-row d-flex"><h2 class="h3"><a href="/login">x</a><a href="'), link, F.lit('">name</a></h2><p class="col-9 color-fg-muted">\n '), about,
        F.lit(' <br></p><a href="'), link, F.lit('/stargazers"><svg></svg> '), F.format_number(F.col("p_size") * 1500, 0), F.lit('</a><span class="float-sm-right"> '),
        F.format_number(F.col("p_partkey") * 37 % 5000, 0), F.lit(" stars\n this "), week, F.lit("</span></article>"),
    )
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("page_id"), at.alias("at"), row.alias("row"))
    pages = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"]), "\n").alias("rows"))
    return X.page_rows(pages.select("page_id", F.concat(F.lit("<html><body>"), "rows", F.lit("</body></html>")).alias("html")))


@query("s16_page_headings", r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>') AS x FROM pages), e AS (SELECT page_id, unnest(range(1, len(x) + 1)) AS rank, x FROM h)
SELECT page_id, CAST(rank AS INT) AS rank, lower(regexp_extract(x[rank], '(?i)<(h[1-6])', 1)) AS name, trim(regexp_replace(replace(replace(replace(regexp_replace(x[rank], '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'), ' ') AS description, 0 AS period_stars, 0 AS total_stars FROM e""")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.page_rows(table(spark, sf_dir, "pages"), "headings")
