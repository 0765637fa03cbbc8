"""URL filter by empirical-Bayes host reputation, in DataFrame expressions only.

A page has an outcome: 1 bad, 0 good, null unlabelled.  Outcomes are counted by host; the counts roll up to the
registered domain and to the suffix.  Each level's bad rate is shrunk towards the level above by a beta prior:

    suffix  ~ Beta(M1 * rate of all pages), domain ~ Beta(M2 * posterior mean of its suffix),
    host    ~ Beta(M3 * posterior mean of its domain)

The strengths M1, M2, M3 are estimated from all counts by moments: with the mean m of the others under the same parent
(and one page of the level above that), the squares ``(bad - n m)^2`` of a beta-binomial sum to
``sum(n m (1 - m) (1 + (n - 1) r))``, where ``r = 1 / (M + 1)`` (kept within ``STRENGTHS``; the larger where nothing was
counted twice).  A host is blocked when the lower bound of its posterior
exceeds the limit; the bound is that of the log-odds, whose variance is about ``1 / alpha + 1 / beta``.
Explicit rules (host suffix and path prefix, the longest wins) override the verdict.

The registered domain is one label more than the suffix, which has several labels where ``SUFFIXES`` holds it.

Only counts by host are shuffled, pre-aggregated in every task, so a host with a third of the pages is one row of the
shuffle.  Verdicts return to the pages by a join on host that Spark may broadcast or split.

A null url, or one without ``://``, has an empty host and path; it fits no rule and takes the verdict of the empty
host.  Urls and pages of any length are read whole.  Repeated rows are judged each; extra columns are not read,
whatever their names; hosts and rules of equal length cannot both fit, so there are no ties; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of the contract, as (action, host, path prefix).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Suffixes of several labels under which owners register; all others have one label.
SUFFIXES = tuple(
    f"{second}.{country}"
    for country, seconds in {
        "uk": "co org me ltd plc net sch ac gov nhs police",
        "au": "com net org edu gov asn id",
        "nz": "co net org ac govt geek gen school maori",
        "jp": "co ne or ac ad ed go gr lg",
        "kr": "co ne or ac re pe go",
        "br": "com net org gov edu blog art eco",
        "in": "co net org gen firm ind ac edu gov nic",
        "za": "co net org ac gov web",
        "cn": "com net org edu gov ac",
        "tw": "com net org edu gov idv",
        "hk": "com net org edu gov idv",
        "sg": "com net org edu gov per",
        "my": "com net org edu gov name",
        "id": "co or ac go web sch my",
        "th": "co or ac go in net",
        "tr": "com net org edu gov gen web bel",
        "il": "co org net ac gov muni",
        "mx": "com net org edu gob",
        "ar": "com net org edu gob gov",
        "ua": "com net org edu gov in kiev",
        "pl": "com net org edu gov info",
        "io": "github gitlab",
        "com": "blogspot appspot herokuapp",
        "app": "netlify vercel web",
        "dev": "pages workers",
    }.items()
    for second in seconds.split()
)
#: Least and largest prior strength, in pages.
STRENGTHS = (1.0, 1000.0)
LIMIT = 0.5
Z = 1.645
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of gambling, pharmacy and loan spam that mark a page as bad.
SPAM_WORDS = ("casino", "jackpot", "poker", "viagra", "cialis", "payday", "sportsbet", "replica-watch", "xxx", "free-slots")


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, on, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(prefix)
        rule, action = F.when(fits, on + prefix).otherwise(rule), F.when(fits, kind).otherwise(action)
    return rule, action


def spam_outcome(url: Column, html: Column) -> Column:
    """The labelled outcome of a page: 1 when url or html holds a spam word, 0 when it has html, else null."""
    text = F.lower(F.concat_ws(" ", url, html))
    return F.when(F.greatest(*(text.contains(w).cast("int") for w in SPAM_WORDS)) == 1, 1).when(html.isNotNull(), 0).cast("int")


def reputation_levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its userinfo, port and final dot; an address is both its own domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"(?<=[^.])\.$", "")
    address = bare.rlike(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$") | bare.startswith("[")
    two, three = F.regexp_extract(bare, r"([^.]+\.)?[^.]*$", 0), F.regexp_extract(bare, r"([^.]+\.)?([^.]+\.)?[^.]*$", 0)
    wide = two.isin(*SUFFIXES)
    return F.when(address, bare).when(wide, three).otherwise(two), F.when(address, bare).when(wide, two).otherwise(F.regexp_extract(bare, r"[^.]*$", 0))


def _strength(counts: DataFrame, n: str, bad: str, parent_n: str, parent_bad: str, above: str) -> Column:
    """The prior strength of a level, as a scalar subquery, from its counts, those of the parents and the means above them."""
    n, bad, parent_n, parent_bad = (F.col(c).cast("double") for c in (n, bad, parent_n, parent_bad))
    mean = (parent_bad - bad + F.col(above)) / (parent_n - n + 1)
    spread, twice = F.sum((bad - n * mean) * (bad - n * mean) - n * mean * (1 - mean)), F.sum(n * (n - 1) * mean * (1 - mean))
    r = F.when(twice > 0, spread / twice).otherwise(0.0)
    least, most = STRENGTHS
    return counts.agg(F.when(r > 1 / (most + 1), F.greatest(1 / r - 1, F.lit(least))).otherwise(most)).scalar()


def host_reputation(pages: DataFrame) -> DataFrame:
    """host, n, bad, alpha, beta: the beta posterior of every host of (host, outcome) rows."""
    hosts = pages.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad"))
    domain, suffix = reputation_levels(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("d_n"), F.sum("bad").alias("d_bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("d_n").alias("s_n"), F.sum("d_bad").alias("s_bad"))
    total = suffixes.agg(F.sum("s_n").alias("t_n"), F.sum("s_bad").alias("t_bad"))
    suffixes = suffixes.withColumns({c: total.select(c).scalar() for c in ("t_n", "t_bad")})
    suffixes = suffixes.withColumn("rate", (F.col("t_bad") + 0.5) / (F.col("t_n") + 1.0))  # of Jeffreys' prior
    suffixes = suffixes.withColumn("m", _strength(suffixes, "s_n", "s_bad", "t_n", "t_bad", "rate"))
    suffixes = suffixes.select("suffix", "s_n", "s_bad", "rate", ((F.col("s_bad") + F.col("m") * F.col("rate")) / (F.col("s_n") + F.col("m"))).alias("s_mean"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.withColumn("m", _strength(domains, "d_n", "d_bad", "s_n", "s_bad", "rate"))
    domains = domains.select("domain", "suffix", "d_n", "d_bad", "s_mean", ((F.col("d_bad") + F.col("m") * F.col("s_mean")) / (F.col("d_n") + F.col("m"))).alias("d_mean"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    hosts = hosts.withColumn("m", _strength(hosts, "n", "bad", "d_n", "d_bad", "s_mean"))
    return hosts.select("host", "n", "bad", (F.col("bad") + F.col("m") * F.col("d_mean")).alias("alpha"), (F.col("n") - F.col("bad") + F.col("m") * (1 - F.col("d_mean"))).alias("beta"))


def lower_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    """Of a beta posterior, by the mean and deviation of its log-odds."""
    return 1 / (1 + F.exp(-(F.log(alpha / beta) - z * F.sqrt(1 / alpha + 1 / beta))))


def judge(pages: DataFrame, outcome: Column | None = None, rules=RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict and bad_bound of every page."""
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    labelled = pages.select(url_host(url).alias("host"), (spam_outcome(url, F.col("html").cast("string")) if outcome is None else outcome).alias("outcome"))
    reputation = host_reputation(labelled).select("host", lower_bound(F.col("alpha"), F.col("beta"), z).alias("bad_bound"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bad_bound") > limit, "block").otherwise("allow")
    return parsed.join(reputation, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, by_host).alias("verdict"), "bad_bound")
