"""URL filtering by empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, column, materialize, table
from .repeats import side

#: (verdict, host, path): fits the host, its subdomains and every path that starts so; the longest rule wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A host is blocked if the upper posterior bound (mean + Z deviations) of its share of good pages stays under GOOD.
Z, GOOD = 1.645, 0.5
#: Bounds of a prior's strength, in pages, and the strength of the corpus-wide prior of a suffix.
STRENGTH = (1.0, 1000.0)
#: Suffixes of two labels under which names are registered; a parameter, as the full list is not ours to keep.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr", "com.ar", "com.tw", "co.kr")


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), ASCII_UPPER, ASCII_LOWER)
    return host, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, domain, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        value = F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def page_outcome(html: Column) -> Column:
    """Label of a page, 1 for good: 50 words or more, at most a tenth as many symbols as characters; null html: 0."""
    text = F.regexp_replace(html, r"<[^>]*>", " ")
    n = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%|", ""))
    return F.coalesce(((n >= 50) & (symbols * 10 <= F.length(text))).cast("int"), F.lit(0))


def levels_of(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain): the public suffix (one label, or two if listed) and that with one label more. A
    port counts to neither; an address of numbers is its own domain under the suffix `ip`."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    listed = two.isin(*suffixes) if suffixes else F.lit(False)
    ip = name.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    suffix = F.when(ip, F.lit("ip")).when(listed, two).otherwise(F.substring_index(name, ".", -1))
    return suffix, F.when(ip, name).when(listed, F.substring_index(name, ".", -3)).otherwise(two)


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and strength of the beta prior of each level (host, domain, suffix), by the method of moments, in one job.

    Spread between groups beyond binomial noise: v = sum n (p - m)^2 / sum n - m (1 - m) k / sum n; strength is
    m (1 - m) / v - 1, within STRENGTH. hosts: host, domain, suffix, n, good. Three rows come to the driver.
    """
    level = lambda k: hosts.groupBy(F.col(k).alias("key")).agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("level", F.lit(k))
    every = level("host").unionByName(level("domain")).unionByName(level("suffix"))
    found = every.groupBy("level").agg(F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("q"), F.count(F.lit(1)).alias("k")).collect()
    out = {k: (0.5, STRENGTH[0]) for k in ("host", "domain", "suffix")}
    for r in found:
        m = r["g"] / r["n"]
        v = max(r["q"] / r["n"] - m * m - m * (1 - m) * r["k"] / r["n"], 1e-9)
        out[r["level"]] = (m, min(max(m * (1 - m) / v - 1, STRENGTH[0]), STRENGTH[1]))
    return out


def host_reputation(counts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """counts: host, n, good (pages and good ones). One row per host: n, good, mean, upper (posterior mean and bound).

    Beta-binomial priors run from suffix to registered domain to host: each level's posterior mean is the mean of the
    next level's prior, whose strength the method of moments takes from that level's own spread. The prior of a suffix
    has the mean of all pages.
    """
    suffix, domain = levels_of(F.col("host"), suffixes)
    hosts = counts.withColumns({"suffix": suffix, "domain": domain})
    prior = priors(hosts)

    def posterior(groups: DataFrame, level: str, mean: Column) -> DataFrame:
        s = F.lit(prior[level][1])
        return groups.withColumn("total", F.col("n") + s).withColumn("mean", (F.col("good") + s * mean) / F.col("total"))

    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    up = posterior(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "suffix", F.lit(prior["suffix"][0])).select("suffix", F.col("mean").alias("up"))
    mid = posterior(domains.join(up, "suffix"), "domain", F.col("up")).select("domain", "suffix", F.col("mean").alias("mid"))
    out = posterior(hosts.join(mid, ["domain", "suffix"]), "host", F.col("mid"))
    return out.select("host", "n", "good", "mean", (F.col("mean") + F.lit(Z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("total") + 1))).alias("upper"))


def judge_urls(pages: DataFrame, rules=RULES, outcome: Column | None = None, id_col="page_id", url_col="url", html_col="html", suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, host_mean, host_upper; one row per input row.

    A page's label is `outcome` (1 good, 0 bad, null counts as bad), or what page_outcome() says of its html (null html:
    bad). Pages that no rule fits are allowed unless their host's upper posterior bound is under GOOD; a url without
    host (null, or no ://) is judged as the host ''. Repeated rows each count; an empty table gives no rows; very long
    texts are read whole; other columns are not read. The outcomes are counted by host into a table once.
    """
    host, path = split_url(column(url_col))
    good = F.coalesce((page_outcome(column(html_col)) if outcome is None else outcome).cast("long"), F.lit(0))
    counts = materialize(pages.select(host.alias("host"), good.alias("good")).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")), "hosts")
    known = materialize(host_reputation(counts, suffixes).select("host", F.col("mean").alias("host_mean"), F.col("upper").alias("host_upper")), "reputation")
    judged = pages.select(column(id_col).alias("page_id"), host.alias("host"), path.alias("path")).join(side(known), "host")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return judged.withColumn("__r", rule).select(
        "page_id", "host", "path", F.col("__r.rule").alias("rule"), F.coalesce(F.col("__r.verdict"), F.when(F.col("host_upper") < GOOD, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "host_mean", "host_upper"
    )


def op4_urls(spark, sf_dir: str) -> DataFrame:
    found = judge_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("host_mean", 6).alias("host_mean"), F.round("host_upper", 6).alias("host_upper"))


def _level_sql(name: str, source: str, key: str, prior: str) -> str:
    return f"""
{name}_m AS (SELECT sum(good) / sum(n) AS m FROM {source}),
{name}_v AS (SELECT any_value(m) AS mean, sum(n * pow(good / n - m, 2)) / sum(n) AS seen, any_value(m * (1 - m)) * count(*) / sum(n) AS noise FROM {source}, {name}_m),
{name}_s AS (SELECT mean AS m, least(greatest(mean * (1 - mean) / greatest(seen - noise, 1e-9) - 1, 1.0), 1000.0) AS s FROM {name}_v),
{name} AS (SELECT *, (good + s * {prior}) / (n + s) AS mean, n + s AS total FROM {source}, {name}_s)"""


_TWO = ", ".join(f"'{x}'" for x in SUFFIXES)
OP4_SQL = rf"""
WITH r AS (SELECT page_id, html, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
t AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path, regexp_replace(html, '<[^>]*>', ' ', 'g') AS txt FROM r),
p AS (SELECT page_id, host, path, CASE WHEN len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) >= 50
       AND (length(txt) - length(translate(txt, '#*$%|', ''))) * 10 <= length(txt) THEN 1 ELSE 0 END AS good FROM t),
h AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM p GROUP BY host),
l AS (SELECT *, list_reverse(string_split(name, '.')) AS l, regexp_matches(name, '^[0-9]+(\.[0-9]+){{3}}$|^\[') AS ip FROM h),
two AS (SELECT *, CASE WHEN len(l) > 1 THEN l[2] || '.' || l[1] ELSE l[1] END AS two FROM l),
hosts AS (SELECT host, n, good, CASE WHEN ip THEN 'ip' WHEN two IN ({_TWO}) THEN two ELSE l[1] END AS suffix,
       CASE WHEN ip THEN name WHEN two IN ({_TWO}) AND len(l) > 2 THEN l[3] || '.' || two ELSE two END AS domain FROM two),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
{_level_sql("su", "suffixes", "suffix", "m")},
dp AS (SELECT domains.*, su.mean AS up FROM domains JOIN su USING (suffix)),
{_level_sql("dm", "dp", "domain", "up")},
hp AS (SELECT hosts.*, dm.mean AS up2 FROM hosts JOIN dm USING (domain, suffix)),
{_level_sql("ho", "hp", "host", "up2")},
ruled AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, ruled.host AS host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN mean + 1.645 * sqrt(mean * (1 - mean) / (total + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
    round(mean, 6) AS host_mean, round(mean + 1.645 * sqrt(mean * (1 - mean) / (total + 1)), 6) AS host_upper
FROM ruled JOIN ho USING (host)
"""
