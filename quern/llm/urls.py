"""URL filtering by host rules and by empirical-Bayes reputation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written

#: (verdict, rule); a rule is a host, a slash and the start of a path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Under a country's two letters these labels make a suffix of two labels, under which names are registered (co.uk, com.au).
#: Other suffixes of several labels are a parameter, such as the entries of a public suffix list.
SECOND_LEVEL = ["ac", "co", "com", "edu", "go", "gov", "mil", "ne", "net", "nom", "or", "org", "sch"]
_DOUBLE = r"(^|\.)(" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2}$"
_ADDRESS = r"^(\d+(\.\d+){3}|\[.*)$"
#: A page is blocked if its site's bad rate is above MOST_BAD with a posterior probability above CONFIDENCE.
MOST_BAD, CONFIDENCE = 0.5, 0.95
#: Bounds of a prior's strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
#: The tail of a posterior is summed by Simpson's rule over so many steps of this width.
STEPS, WIDTH = 300, 0.1


def _parts(df: DataFrame, url_col: str) -> DataFrame:
    """host: what follows the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end."""
    u = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    df = df.withColumn("__u", u).withColumn("__at", F.locate("://", F.col("__u")))
    rest = F.when(F.col("__at") > 0, F.expr("substring(__u, __at + 3)")).otherwise("")
    df = df.withColumn("__r", rest).withColumn("__h", F.regexp_extract("__r", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(__r, length(__h) + 1)"), r"^[^?#]*", 0)
    return df.withColumn("path", path).withColumn("host", F.translate("__h", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).drop("__u", "__at", "__r", "__h")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a domain above it and the start of the path; else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def site_of(host: Column) -> Column:
    """The name that a reputation belongs to: the host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", ""), r"\.$", "")


def _labels(site: Column, suffixes: list[str], more: int) -> Column:
    """The site's suffix (more = 0), or its suffix and so many labels before it. An address is all of these itself."""
    out = F.when(site.rlike(_ADDRESS), site)
    for suffix in sorted(suffixes, key=lambda x: (-x.count("."), x)):
        out = out.when((site == suffix) | site.endswith("." + suffix), F.substring_index(site, ".", -(suffix.count(".") + 1 + more)))
    return out.when(site.rlike(_DOUBLE), F.substring_index(site, ".", -2 - more)).otherwise(F.substring_index(site, ".", -1 - more))


def suffix_of(site: Column, suffixes: list[str] | None = None) -> Column:
    return _labels(site, suffixes or [], 0)


def domain_of(site: Column, suffixes: list[str] | None = None) -> Column:
    return _labels(site, suffixes or [], 1)


def _log_gamma(z: Column) -> Column:
    """Stirling's series eight places further on."""
    y = z + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5))
    below = z
    for i in range(1, 8):
        below = below * (z + i)
    return series - F.log(below)


def tail(mean: Column, weight: Column) -> Column:
    """The probability that a rate is at most MOST_BAD, for a beta distribution with this mean and weight (a + b).

    The smaller of the two tails is summed in the logit, in steps scaled to how fast it falls, so that the sum is as good
    for a few pages as for millions.
    """
    heavy = mean > MOST_BAD
    x = F.when(heavy, MOST_BAD).otherwise(1 - MOST_BAD)
    a, b = weight * F.when(heavy, mean).otherwise(1 - mean), weight * F.when(heavy, 1 - mean).otherwise(mean)
    fall = F.greatest(a - (a + b) * x, F.sqrt((a + b) * x * (1 - x)))
    at = F.log(x / (1 - x))
    peak = a * F.log(x) + b * F.log(1 - x)

    def more(total: Column, k: Column) -> Column:
        t = at - k * WIDTH / fall
        part = F.exp(-a * F.log1p(F.exp(-t)) - b * F.log1p(F.exp(t)) - peak)
        return total + part * F.when((k == 0) | (k == STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), more) * WIDTH / 3
    small = F.exp(peak - _log_gamma(a) - _log_gamma(b) + _log_gamma(a + b)) * total / fall
    return F.when(heavy, small).otherwise(1 - small)


def _strength(groups: DataFrame, above: str) -> float:
    """The prior's strength in pages, by moments: from how much the groups' rates (bad of n) spread about the mean above them
    beyond what binomial draws would. One strength a level, from one row."""
    binomial = F.col(above) * (1 - F.col(above))
    row = groups.agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(above), 2)).alias("q"), F.sum(binomial).alias("v"), F.sum(F.col("n") * binomial).alias("nv")).first()
    # E[q] = sum of v * (1 + (n - 1) / (s + 1)), so (s + 1) = (sum n v - sum v) / (q - sum v)
    if row["q"] is None or row["q"] - row["v"] <= 0:
        return MOST_STRENGTH
    return max(LEAST_STRENGTH, min(MOST_STRENGTH, (row["nv"] - row["v"]) / (row["q"] - row["v"]) - 1))


def _shrunk(groups: DataFrame, above: str, strength: float) -> Column:
    return (F.col("bad") + strength * F.col(above)) / (F.col("n") + strength)


def reputations(outcomes: DataFrame, suffixes: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(site, rate, tail) of labelled outcomes (site, bad 0 or 1), shrunk from all pages to suffix to domain to host; then what
    a host without labels has under a domain (domain, ...), a suffix (suffix, ...) and any other (one row).

    A host's posterior is that of its n and bad under a prior about its domain's mean, with the hosts' common strength; a
    host without labels has n = 0, and its domain's mean, or else its suffix's, or that of all pages. Each level is an
    aggregate of the one below, and each is written once, so only the first reads pages, combined before the shuffle.
    """
    hosts = outcomes.groupBy("site").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    site = F.col("site")
    hosts = written(hosts.withColumns({"domain": domain_of(site, suffixes), "suffix": suffix_of(site, suffixes)}), "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    all_ = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    sums = all_.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    root = ((sums["bad"] or 0.0) + 0.5) / ((sums["n"] or 0.0) + 1.0)
    all_ = all_.withColumn("above", F.lit(root))
    all_ = written(all_.select("suffix", _shrunk(all_, "above", _strength(all_, "above")).alias("suffix_mean")), "suffixes")
    domains = domains.join(all_, "suffix")
    domains = written(domains.select("domain", _shrunk(domains, "suffix_mean", _strength(domains, "suffix_mean")).alias("domain_mean")), "domains")
    hosts = hosts.join(domains, "domain")
    s = _strength(hosts, "domain_mean")
    mean, weight = _shrunk(hosts, "domain_mean", s), F.col("n") + s
    rated = lambda rate, weight, to: (rate.alias(f"{to}_rate"), tail(rate, weight).alias(f"{to}_tail"))
    return (
        hosts.select("site", *rated(mean, weight, "host")),
        domains.select("domain", *rated(F.col("domain_mean"), F.lit(s), "domain")),
        all_.select("suffix", *rated(F.col("suffix_mean"), F.lit(s), "suffix")),
        outcomes.sparkSession.range(1).select(*rated(F.lit(root), F.lit(s), "root")),
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", suffixes: list[str] | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_rate, bad_tail.

    The rule that fits decides; where none does, the page is blocked if the posterior bound of its host's bad rate is above
    MOST_BAD: if bad_tail, the probability that the rate isn't above it, is below 1 - CONFIDENCE, which is to say that the
    rate's quantile of that order is above. outcomes has (id, bad) rows of labelled pages; a page with several counts once
    for each. A host without labelled pages has a posterior too, from the level above, see reputations. bad_rate is the
    posterior's mean. `suffixes` are public suffixes of several labels beyond those that SECOND_LEVEL makes.

    A null url, or one without ://, has an empty host and path and no rule; pages without a host have no reputation: they
    are allowed, with null bad_rate and bad_tail, and their labels don't count. Rows that repeat an id are judged each. A
    null id is judged but never labelled. Other columns aren't looked at. An empty table gives no rows.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("__url"))
    parts = _parts(plain, "__url").drop("__url").withColumn("site", site_of(F.col("host")))
    marked = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    known = outcomes.select(F.col("id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("bad")).filter("bad IS NOT NULL")
    labelled = parts.select("page_id", "site").filter("site != ''").join(known, "page_id").select("site", "bad")
    hosts, domains, all_, root = reputations(labelled, suffixes)
    site = F.col("site")
    marked = marked.withColumns({"domain": domain_of(site, suffixes), "suffix": suffix_of(site, suffixes)})
    found = marked.join(hosts, "site", "left").join(domains, "domain", "left").join(all_, "suffix", "left").crossJoin(F.broadcast(root))
    nearest = lambda c: F.when(site != "", F.coalesce(*(f"{x}_{c}" for x in ("host", "domain", "suffix", "root"))))
    blocks = [r for v, r in rules if v == "block"]
    method = F.when(nearest("tail") < 1 - CONFIDENCE, "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNull(), method).when(F.col("rule").isin(blocks), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round(nearest("rate"), 9).alias("bad_rate"), F.round(nearest("tail"), 6).alias("bad_tail"))


_SITE = r"regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''), '\.$', '')"


def _labels_sql(more: int) -> str:
    cut = lambda n: f"array_to_string(string_split(site, '.')[-{n + more}:], '.')"
    return f"CASE WHEN regexp_matches(site, '{_ADDRESS}') THEN site WHEN regexp_matches(site, '{_DOUBLE}') THEN {cut(2)} ELSE {cut(1)} END"


def _strength_sql(above: str, source: str) -> str:
    return f"""SELECT coalesce(greatest({LEAST_STRENGTH}, least({MOST_STRENGTH}, CASE WHEN q - v > 0 THEN (nv - v) / (q - v) - 1 ELSE {MOST_STRENGTH} END)), {MOST_STRENGTH}) AS s
  FROM (SELECT sum(n * power(bad / n - {above}, 2)) AS q, sum({above} * (1 - {above})) AS v, sum(n * {above} * (1 - {above})) AS nv FROM {source})"""


def _tail_sql(source: str) -> str:
    """source (k, rate, weight) with the tail."""
    return f"""SELECT k, rate, CASE WHEN rate > {MOST_BAD} THEN small ELSE 1 - small END AS tail FROM (SELECT *, exp(peak - lgamma(a) - lgamma(b) + lgamma(a + b)) / fall * {WIDTH} / 3 *
  list_sum(list_transform(range(0, {STEPS + 1}), lambda j: exp(-a * ln(1 + exp(-(mid - j * {WIDTH} / fall))) - b * ln(1 + exp(mid - j * {WIDTH} / fall)) - peak) * CASE WHEN j = 0 OR j = {STEPS} THEN 1.0 WHEN j % 2 = 1 THEN 4.0 ELSE 2.0 END)) AS small
  FROM (SELECT *, greatest(a - (a + b) * x, sqrt((a + b) * x * (1 - x))) AS fall, ln(x / (1 - x)) AS mid, a * ln(x) + b * ln(1 - x) AS peak
  FROM (SELECT k, rate::DOUBLE AS rate, CASE WHEN rate > {MOST_BAD} THEN {MOST_BAD} ELSE 1 - {MOST_BAD} END::DOUBLE AS x, (weight * CASE WHEN rate > {MOST_BAD} THEN rate ELSE 1 - rate END)::DOUBLE AS a, (weight * CASE WHEN rate > {MOST_BAD} THEN 1 - rate ELSE rate END)::DOUBLE AS b FROM {source})))"""


ORACLE_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
r AS (SELECT page_id, CASE WHEN contains(u, '://') THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS r FROM u),
p AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM r),
s AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM p),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule, {_SITE} AS site FROM s),
named AS (SELECT *, {_labels_sql(0)} AS suffix, {_labels_sql(1)} AS domain FROM ruled),
l AS (SELECT site, domain, suffix, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM named JOIN labels ON page_id = doc_id WHERE site <> ''),
h AS (SELECT site, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM l GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
w AS (SELECT coalesce((sum(bad) + 0.5) / (sum(n) + 1.0), 0.5) AS root FROM x),
xw AS (SELECT * FROM x, w), xk AS ({_strength_sql('root', 'xw')}), xm AS (SELECT suffix, (bad + s * root) / (n + s) AS m FROM xw, xk),
dx AS (SELECT d.*, m FROM d JOIN xm USING (suffix)), dk AS ({_strength_sql('m', 'dx')}), dm AS (SELECT domain, (bad + s * m) / (n + s) AS m FROM dx, dk),
hd AS (SELECT h.*, m FROM h JOIN dm USING (domain)), hk AS ({_strength_sql('m', 'hd')}),
ha AS (SELECT site AS k, (bad + s * m) / (n + s) AS rate, n + s AS weight FROM hd, hk), ht AS ({_tail_sql('ha')}),
da AS (SELECT domain AS k, m AS rate, s AS weight FROM dm, hk), dt AS ({_tail_sql('da')}),
xa AS (SELECT suffix AS k, m AS rate, s AS weight FROM xm, hk), xt AS ({_tail_sql('xa')}),
wa AS (SELECT 0 AS k, root AS rate, s AS weight FROM w, hk), wt AS ({_tail_sql('wa')}),
b AS (SELECT n.page_id, n.host, n.path, n.rule, CASE WHEN site <> '' THEN coalesce(ht.rate, dt.rate, xt.rate, wt.rate) END AS rate, CASE WHEN site <> '' THEN coalesce(ht.tail, dt.tail, xt.tail, wt.tail) END AS tail
  FROM named n LEFT JOIN ht ON ht.k = n.site LEFT JOIN dt ON dt.k = n.domain LEFT JOIN xt ON xt.k = n.suffix, wt)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NULL THEN CASE WHEN tail < 1 - {CONFIDENCE} THEN 'block' ELSE 'allow' END WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict,
       round(rate, 9) AS bad_rate, round(tail, 6) AS bad_tail
FROM b
"""
