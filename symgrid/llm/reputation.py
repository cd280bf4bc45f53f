"""URL filter by empirical-Bayes host reputation.

Labelled pages say how often a host's pages are bad. A host with few labels borrows from its
registered domain, that from its public suffix, and that from the whole: each level's posterior mean
without the member in question is the prior mean of that member, so no label counts twice. How strongly
a level shrinks follows from how much its members differ beyond chance (method of moments for the
beta-binomial). A page goes when the lower quantile of its host's posterior, a beta distribution, is
above the cutoff: by default the bad rate of all labelled pages, so that hosts go which are surely
worse than the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, fresh

#: Second labels under which country domains register names (co.uk, com.br, ...), as most rules of the public list have it.
REGISTRY_LABELS = ("ac", "asn", "co", "com", "ed", "edu", "firm", "gen", "go", "gob", "gov", "gouv", "govt", "id", "ind", "inf", "info", "int", "k12", "lg", "ltd", "me", "mil", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "pro", "res", "sch", "school", "tm", "web")
#: Suffixes of two labels under which unrelated users have their own sites.
SHARED_SUFFIXES = ("github.io", "gitlab.io", "blogspot.com", "wordpress.com", "tumblr.com", "netlify.app", "vercel.app", "pages.dev", "web.app", "herokuapp.com", "azurewebsites.net", "cloudfront.net", "appspot.com", "readthedocs.io", "neocities.org", "weebly.com", "wixsite.com", "livejournal.com", "substack.com", "eu.org")
#: The posterior's quantile of 5 % as so many normal deviations.
Z = 1.645
#: Pages go whose host's bad rate is above this with 95 % certainty; None: above that of all labelled pages.
CUTOFF = None
#: Bounds of the intra-class correlation; 0.002 means a prior worth 499 pages, 0.5 one worth one.
RHO = (0.002, 0.5)
BROADCAST_ROWS = 200_000
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)"


def host(url: Column) -> Column:
    """Lower-cased host without port and final dot; '' where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 2)), r"[.]+$", ""), F.lit(""))


def _two_labels(h: Column) -> Column:
    """Whether the public suffix of a host is its last two labels. A suffix alone is a host of itself."""
    parts = F.split(h, "[.]")
    last, second = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    shared = F.concat_ws(".", F.slice(parts, -2, 2)).isin(*SHARED_SUFFIXES)
    return (F.size(parts) > 2) & (shared | ((F.length(last) == 2) & second.isin(*REGISTRY_LABELS)))


def suffix(h: Column) -> Column:
    parts = F.split(h, "[.]")
    return F.when(h.rlike(r"^[0-9.]+$"), F.lit("ip")).when(_two_labels(h), F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(F.element_at(parts, -1))


def registered_domain(h: Column) -> Column:
    parts = F.split(h, "[.]")
    n = F.when(_two_labels(h), F.lit(3)).otherwise(F.lit(2))
    return F.when(h.rlike(r"^[0-9.]+$") | (F.size(parts) <= n), h).otherwise(F.concat_ws(".", F.slice(parts, -n, n)))


def beta_lower(a: Column, b: Column) -> Column:
    """The quantile at Z deviations below of a beta distribution, by its Fisher-z approximation.

    With ``a`` up to 1 the density is greatest at 0 and the quantile is taken as 0; with ``b`` up to 1
    the normal approximation stands in.
    """
    u, v = 1 / (2 * a - 1), 1 / (2 * b - 1)
    lam = F.lit((Z * Z - 3) / 6)
    h = 2 / (u + v)
    w = Z * F.sqrt(h + lam) / h - (v - u) * (lam + 5.0 / 6 - 2 / (3 * h))
    mean = a / (a + b)
    plain = F.greatest(mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1)), F.lit(0.0))
    return F.when(a <= 1, F.lit(0.0)).when(b <= 1, plain).otherwise(a / (a + b * F.exp(2 * w)))


def _strength(level: DataFrame) -> DataFrame:
    """``strength`` in pages of the prior for the members ``n, k`` of one level."""
    m = level.agg(F.sum("n").cast("double").alias("N"), F.sum("k").cast("double").alias("K"), F.count(F.lit(1)).cast("double").alias("C"), F.sum(F.col("n").cast("double") * F.col("n")).alias("Q"), F.sum(F.col("k").cast("double") * F.col("k") / F.greatest("n", F.lit(1))).alias("P"))
    mean = F.col("K") / F.greatest("N", F.lit(1.0))
    chance = mean * (1 - mean)
    between = F.col("P") - F.col("N") * mean * mean
    room = chance * (F.col("N") - F.col("Q") / F.greatest("N", F.lit(1.0)) - (F.col("C") - 1))
    rho = F.when(room > 0, (between - chance * (F.col("C") - 1)) / room).otherwise(F.lit(RHO[0]))
    rho = F.least(F.greatest(rho, F.lit(RHO[0])), F.lit(RHO[1]))
    return m.select(((1 - rho) / rho).alias("strength"), mean.alias("mean"))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, labelled, bad, mean, lower, base``: posterior of the bad rate of every host in ``pages``, and the rate of all.

    ``pages`` has ``page_id, url``; ``labels`` has ``doc_id, quality, toxic``, and its ``doc_id`` is read
    as the number of a page. A label is bad if the quality is 0 or toxic is 1; one with both null says
    nothing. Repeated pages and labels each count.
    """
    seen = labels.select(F.col("doc_id").cast("long").alias("id"), F.when(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)), 1).when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise(0).alias("bad"))
    seen = seen.where("id is not null and bad is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    own = pages.select(F.col("page_id").cast("long").alias("id"), host(F.col("url").cast("string")).alias("host"))
    hosts = own.join(seen, "id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    hosts = cut(hosts.select("host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "k"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    sh, sd, ss = (_strength(x) for x in (hosts, domains, suffixes))
    up = lambda level: level.select(F.col("strength").alias("w"), F.col("mean").alias("m0"))
    s = suffixes.crossJoin(F.broadcast(up(ss))).select("suffix", F.col("n").alias("ns"), F.col("k").alias("ks"), "w", "m0")
    s = s.crossJoin(F.broadcast(sd.select(F.col("strength").alias("wd"))))
    d = domains.join(s, "suffix")  # what a domain borrows comes from the other domains of its suffix
    d = d.select("domain", "suffix", F.col("n").alias("nd"), F.col("k").alias("kd"), "wd", ((F.col("w") * F.col("m0") + F.col("ks") - F.col("k")) / (F.col("w") + F.col("ns") - F.col("n"))).alias("ms"))
    h = hosts.join(d, ["domain", "suffix"]).crossJoin(F.broadcast(sh.withColumnRenamed("mean", "sh_mean")))
    h = h.withColumn("md", (F.col("wd") * F.col("ms") + F.col("kd") - F.col("k")) / (F.col("wd") + F.col("nd") - F.col("n")))
    mean = (F.col("strength") * F.col("md") + F.col("k")) / (F.col("strength") + F.col("n"))
    weight = F.col("strength") + F.col("n")
    h = h.select("host", F.col("n").alias("labelled"), F.col("k").alias("bad"), mean.alias("mean"), weight.alias("weight"), F.col("sh_mean").alias("base"))
    lower = beta_lower(F.col("mean") * F.col("weight"), (1 - F.col("mean")) * F.col("weight"))
    return h.select("host", "labelled", "bad", F.round("mean", 6).alias("mean"), F.round(lower, 6).alias("lower"), F.round("base", 6).alias("base"))


def filter_urls(pages: DataFrame, labels: DataFrame, cutoff: float | None = CUTOFF, keep_scores: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``pages`` whose host's bad rate is not surely above ``cutoff``; all columns unchanged.

    Without a cutoff it is the bad rate of all labelled pages. A bound that ties with it keeps its
    host. Pages without a host (null or malformed urls) share the host ''; very long urls are hosts
    like others. Pages of unlabelled hosts have the prior of their domain or suffix. With no labels at
    all every page stays; an empty table gives an empty one. ``keep_scores`` adds ``host, mean, lower``,
    with underscores where ``pages`` has such a column. Only the hosts that fail are joined otherwise.
    """
    h, m, low = fresh(pages, "_host", "_mean", "_lower")
    fails = F.col("lower") > (F.col("base") if cutoff is None else F.lit(cutoff))
    rep = cut(reputations(pages, labels).withColumn("fails", fails))
    rep = (rep if keep_scores else rep.where("fails")).select(F.col("host").alias(h), F.col("mean").alias(m), F.col("lower").alias(low), "fails")
    if rep.count() <= broadcast_rows:
        rep = F.broadcast(rep)
    keyed = pages.withColumn(h, host(F.col("url").cast("string")))
    own = [F.col(f"`{c}`") for c in pages.columns]
    if not keep_scores:
        return keyed.join(rep, h, "left_anti").select(*own)
    extra = [F.col(c).alias(name) for c, name in zip((h, m, low), fresh(pages, "host", "mean", "lower"), strict=True)]
    return keyed.join(rep.where("not fails").drop("fails"), h).select(*own, *extra)


def _sql() -> str:
    listed = lambda names: ", ".join(f"'{x}'" for x in names)
    lam = (Z * Z - 3) / 6
    strength = lambda name, level: f"""{name} as (select case when true then (1 - rho) / rho end as strength, mean from (select mean, least(greatest(case when room > 0 then (P - N * mean * mean - mean * (1 - mean) * (C - 1)) / room else {RHO[0]} end, {RHO[0]}), {RHO[1]}) as rho
  from (select *, mean * (1 - mean) * (N - Q / greatest(N, 1.0) - (C - 1)) as room from (select *, K / greatest(N, 1.0) as mean
  from (select sum(n)::double as N, sum(k)::double as K, count(*)::double as C, sum(n::double * n) as Q, sum(k::double * k / greatest(n, 1)) as P from {level})))))"""  # noqa: E731
    return f"""with seen as (select doc_id as id, count(*) as n, sum(case when coalesce(quality = 0, false) or coalesce(toxic = 1, false) then 1 else 0 end)::bigint as k from labels where doc_id is not null and (quality is not null or toxic is not null) group by 1),
own as (select page_id, url, coalesce(regexp_replace(lower(regexp_extract(url, '{_HOST}', 2)), '[.]+$', ''), '') as host from pages),
h0 as (select host, coalesce(sum(n), 0)::bigint as n, coalesce(sum(k), 0)::bigint as k, string_split(host, '.') as parts from own left join seen on page_id = id group by host),
h1 as (select *, regexp_matches(host, '^[0-9.]+$') as ip, len(parts) > 2 and (array_to_string(parts[-2:], '.') in ({listed(SHARED_SUFFIXES)}) or length(parts[-1]) = 2 and parts[-2] in ({listed(REGISTRY_LABELS)})) as two from h0),
hosts as (select host, n, k, case when ip or len(parts) <= (case when two then 3 else 2 end) then host when two then array_to_string(parts[-3:], '.') else array_to_string(parts[-2:], '.') end as domain,
  case when ip then 'ip' when two then array_to_string(parts[-2:], '.') else parts[-1] end as suffix from h1),
domains as (select domain, suffix, sum(n)::bigint as n, sum(k)::bigint as k from hosts group by all),
suffixes as (select suffix, sum(n)::bigint as n, sum(k)::bigint as k from domains group by all),
{strength("sh", "hosts")}, {strength("sd", "domains")}, {strength("ss", "suffixes")},
s as (select suffix, n as ns, k as ks, strength as w, mean as m0 from suffixes, ss),
d as (select domain, d0.suffix, n as nd, k as kd, strength as wd, (w * m0 + ks - k) / (w + ns - n) as ms from domains d0 join s on d0.suffix = s.suffix, sd),
h as (select host, n, k, (wd * ms + kd - k) / (wd + nd - n) as md from hosts join d on hosts.domain = d.domain and hosts.suffix = d.suffix),
p as (select host, (strength * md + k) / (strength + n) as mean, strength + n as weight, h2.mean as base from h, sh h2),
ab as (select host, mean, base, mean * weight as a, (1 - mean) * weight as b from p),
uv as (select *, 1 / (2 * a - 1) as u, 1 / (2 * b - 1) as v, 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1)) as hh from ab),
r as (select host, round(mean, 6) as mean, round(base, 6) as base, round(case when a <= 1 then 0.0 when b <= 1 then greatest(mean - {Z} * sqrt(mean * (1 - mean) / (a + b + 1)), 0.0)
  else a / (a + b * exp(2 * ({Z} * sqrt(hh + {lam}) / hh - (v - u) * ({lam} + 5.0::double / 6 - 2 / (3 * hh))))) end, 6) as lower from uv)
select page_id, url, own.host, mean, lower from own join r on own.host = r.host where not lower > base"""


SQL = _sql()
