"""URL filters: explicit host/path rules, then an empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and public suffix.  Each level has a beta prior whose mean is its parent's
posterior mean and whose strength is fitted by moments over all units of the level (beta-binomial).  A host's posterior is a beta
distribution; a page is blocked when its probability that the host's bad rate is over `most_bad` reaches `SURE`: the posterior's lower
bound is then over `most_bad`.  A host without outcomes has the posterior mean of the narrowest level that has some.  DataFrame functions only.

For the reputation a host is taken without user and port.  Its suffix is its last label, or the last two where a two-letter label follows
one of `SECOND` (as in co.uk); its registered domain is one label more; an address of four numbers is its own domain.

Nulls: a null url, or one without "://", has an empty host and path and is judged as host "".  Outcomes with a null page_id or no label are
left out; a page labelled twice counts twice.  Repeated pages come back repeated.  Empty tables give the flat prior and empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialise

#: (verdict, host, path); fixed values of the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Labels that with a country's two letters make a suffix; fixed values.
SECOND = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
NUMBERS = r"^[0-9]+(\.[0-9]+){3}$"
#: Probability from which a host is surely bad, and places on each side at which its posterior is summed.
SURE, PLACES = 0.95, 200
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def bare(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def public_suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    wide = F.substring_index(two, ".", 1).isin(*SECOND) & (F.length(F.substring_index(host, ".", -1)) == 2) & host.contains(".")
    return F.when(host.rlike(NUMBERS), host).when(wide, two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    suffix = public_suffix(host)
    return F.when(suffix == host, host).when(suffix.contains("."), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of columns host and path: the longest that fits; at most 1,000 rules are compiled into one expression."""
    if len(rules) > 1000:
        raise ValueError("over 1,000 rules: split them by suffix and apply them in turn")
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def prior_strength(units: DataFrame, least: float = 1.0, most: float = 1000.0) -> float:
    """Pseudo-count a + b of the level's beta prior by the moments of the beta-binomial; units: (n, bad).  Three sums reach the driver."""
    k, n, nn, bad, bb = units.agg(
        F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum("bad"), F.sum(F.col("bad") * F.col("bad") / F.col("n"))
    ).first()
    if not n or k < 2 or bad in (0, n):
        return most
    p = bad / n
    free = n - nn / n - (k - 1)
    if free <= 0:
        return most
    rho = (bb - n * p * p - p * (1 - p) * (k - 1)) / (p * (1 - p) * free)
    return round(min(most, max(least, 1 / rho - 1 if rho > 0 else most)), 3)


def probability_over(a: Column, b: Column, least: float) -> Column:
    """P(rate > least) of Beta(a, b).  In log odds u the density is e^(a u) / (1 + e^u)^(a + b): smooth and of one hump, so sums at even places on
    both sides of the bound, over twelve deviations about the hump, are its integral's parts (Simpson's rule)."""
    edge = math.log(least / (1 - least))
    top = F.log(a / b)
    reach = 12 * F.sqrt(1 / a + 1 / b)
    height = lambda u: a * u - (a + b) * F.log1p(F.exp(-F.abs(u))) - (a + b) * F.greatest(u, F.lit(0.0))
    peak = height(top)

    def area(lo: Column, hi: Column) -> Column:
        step = (hi - lo) / PLACES
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(PLACES - 1)), F.lit(0.0), lambda t, i: t + (2 + 2 * (i % 2)) * F.exp(height(lo + step * i) - peak))
        return step * (inner + F.exp(height(lo) - peak) + F.exp(height(hi) - peak)) / 3

    lo, hi = F.least(top - reach, F.lit(edge)), F.greatest(top + reach, F.lit(edge))
    over, under = area(F.lit(edge), hi), area(lo, F.lit(edge))
    return over / (over + under)


def levels(outcomes: DataFrame, most_bad: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """outcomes (host, bad 0/1) -> hosts (host, n, rate, over), domains (domain, domain_rate), suffixes (suffix, suffix_rate), the mean.  rate:
    posterior mean of the bad rate; over: the probability that it is over most_bad."""
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("host")))
    hosts = materialise(hosts, "hosts")  # the levels and their priors read these counts, not the pages
    counts = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    mean = ((bad or 0) + 1) / ((n or 0) + 2)

    def shrunk(units: DataFrame, prior: Column) -> Column:
        s = prior_strength(units)
        return (F.col("bad") + s * prior) / (F.col("n") + s)

    by_suffix = suffixes.select("suffix", shrunk(suffixes, F.lit(mean)).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", shrunk(domains, F.col("suffix_rate")).alias("domain_rate"))
    s = prior_strength(hosts)
    rate = (F.col("bad") + s * F.col("domain_rate")) / (F.col("n") + s)
    by_host = hosts.join(by_domain, "domain").select("host", "n", rate.alias("rate"), (F.col("n") + s).alias("mass"))
    by_host = by_host.select("host", "n", "rate", probability_over(F.col("rate") * F.col("mass"), (1 - F.col("rate")) * F.col("mass"), most_bad).alias("over"))
    return materialise(by_host, "hosts"), materialise(by_domain, "domains"), materialise(by_suffix, "suffixes"), mean


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, most_bad: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate (the posterior mean) for every row of pages.  labels: doc_id (a page_id), quality, toxic; bad
    is quality 0 or toxic 1.

    Hosts are counted by partial aggregation before any shuffle; the levels' tables are joined back as tables, so adaptive execution splits a host
    with very many pages."""
    host, path = host_and_path(F.col("url"))
    found = pages.select("page_id", host.alias("full_host"), path.alias("path")).withColumn("host", bare(F.col("full_host")))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    judged = labels.where("doc_id is not null and (quality is not null or toxic is not null)").select(F.col("doc_id").alias("page_id"), bad.cast("long").alias("bad"))
    hosts, domains, suffixes, mean = levels(found.select("page_id", "host").join(judged, "page_id").select("host", "bad"), most_bad)
    # hosts of pages, each once: all that is known of a host is one row, and pages meet that
    known = found.select("host").distinct().withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("host")))
    known = known.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    known = known.select("host", F.coalesce("rate", "domain_rate", "suffix_rate", F.lit(mean)).alias("bad_rate"), (F.coalesce("over", F.lit(0.0)) >= SURE).alias("poor"))
    met = found.join(materialise(known, "known"), "host").select("page_id", F.col("full_host").alias("host"), "path", "bad_rate", "poor")
    rule, verdict = rule_of(rules)
    return met.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("poor"), "block").otherwise("allow")).alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"))


#: The whole method word by word; each row's bad_rate shows the levels at work.
ORACLE = r"""
with found as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
bare as (select *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') bare from found),
split as (select *, string_split(bare, '.') l, regexp_matches(bare, '^[0-9]+(\.[0-9]+){3}$') numbers,
    len(string_split(bare, '.')) > 1 and length(list_extract(string_split(bare, '.'), -1)) = 2 and list_extract(string_split(bare, '.'), -2) in ('ac', 'co', 'com', 'edu', 'go', 'gov', 'ne', 'net', 'or', 'org') wide from bare),
named as (select page_id, bare, host full_host, path, case when numbers then bare when wide then array_to_string(list_slice(l, -2, -1), '.') else list_extract(l, -1) end suffix,
    case when numbers then bare when wide then array_to_string(list_slice(l, -3, -1), '.') else array_to_string(list_slice(l, -2, -1), '.') end domain from split),
outcomes as (
  select bare host, domain, suffix, case when coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 then 1 else 0 end bad
  from named join labels on page_id = doc_id where quality is not null or toxic is not null),
h as (select host, domain, suffix, count(*) n, sum(bad) bad from outcomes group by all),
d as (select domain, suffix, sum(n) n, sum(bad) bad from h group by all),
s as (select suffix, sum(n) n, sum(bad) bad from d group by all),
m as (select 's' lv, count(*) k, sum(n) n, sum(n*n) nn, sum(bad) b, sum(bad*bad/n) bb from s union all
      select 'd', count(*), sum(n), sum(n*n), sum(bad), sum(bad*bad/n) from d union all
      select 'h', count(*), sum(n), sum(n*n), sum(bad), sum(bad*bad/n) from h),
r as (select lv, k, n, b, n - nn / n - (k - 1) fr, (bb - n * (b/n) * (b/n) - (b/n) * (1 - b/n) * (k - 1)) / nullif((b/n) * (1 - b/n) * (n - nn / n - (k - 1)), 0) rho from m),
p as (select lv, case when coalesce(n, 0) = 0 or k < 2 or b = 0 or b = n or fr <= 0 then 1000.0
  else round(least(1000.0, greatest(1.0, case when rho > 0 then 1 / rho - 1 else 1000.0 end)), 3) end st from r),
sr as (select suffix, (bad + (select st from p where lv = 's') * (select (sum(bad) + 1) / (sum(n) + 2) from s)) / (n + (select st from p where lv = 's')) q from s),
dr as (select domain, (bad + (select st from p where lv = 'd') * q) / (n + (select st from p where lv = 'd')) q from d join sr using (suffix)),
hr as (select host, (bad + (select st from p where lv = 'h') * q) / (n + (select st from p where lv = 'h')) q, n + (select st from p where lv = 'h') w from h join dr using (domain)),
ab as (select host, q, q * w a, (1 - q) * w b, ln(q / (1 - q)) top, 12 * sqrt(1 / (q * w) + 1 / ((1 - q) * w)) reach from hr),
ends as (select *, least(top - reach, 0) lo, greatest(top + reach, 0) hi, a * top - (a + b) * ln(1 + exp(-abs(top))) - (a + b) * greatest(top, 0) peak from ab),
places as (select host, q, side, step, case when i in (0, 200) then 1 else 2 + 2 * (i % 2) end * exp(a * u - (a + b) * ln(1 + exp(-abs(u))) - (a + b) * greatest(u, 0) - peak) y from
  (select *, base + step * i u from (select *, unnest(range(0, 201)) i from
    (select *, 'over' side, 0.0 base, hi / 200 step from ends union all select *, 'under', lo, -lo / 200 from ends)))),
area as (select host, sum(case when side = 'over' then step * y else 0 end) / sum(step * y) p from places group by 1),
ruled as (
  select page_id, bare, domain, suffix, full_host host, path from named),
verdicts as (
  select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from ruled)
select page_id, v.host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when coalesce(p, 0) >= 0.95 then 'block' else 'allow' end verdict,
  round(coalesce(hr.q, dr.q, sr.q, (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) from s)), 6) bad_rate
from verdicts v left join hr on hr.host = bare left join dr on dr.domain = v.domain left join sr on sr.suffix = v.suffix left join area on area.host = bare
"""
