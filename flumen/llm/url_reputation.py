"""URL filters by empirical-Bayes host reputation.

Page outcomes are an input of their own: a row of ``labels`` whose ``doc_id`` is the page's ``page_id``, quality 1
good and 0 bad. They are counted by host. Good rates are shrunk through beta-binomial priors from the top
down: suffixes towards the overall rate, registered domains towards their suffix, hosts towards their
domain. The strength of each prior is estimated from the counts of its level by the method of moments. A
page is blocked if the upper posterior bound of its host's good rate is below ``least``. Fixed rules for
hosts and paths stand above that; the longest one that fits decides, of equally long ones the first given.

In this hierarchy a host is named without user and port. A suffix is the last label, or the last two where
``second_labels`` and a country's two letters make up a suffix (co.uk) or where ``shared_domains`` lists them,
under which anyone can register. A numeric address is its own domain and suffix, so what is known of one
says nothing of another.

Built-in expressions only. Null urls and urls without ``://`` have an empty host and path, and are
judged by what is known of the empty host. Urls are read whole, however long. Without labels everything
that no rule blocks is allowed; an upper bound of exactly ``least`` allows. Repeated rows of pages give
repeated results, each with its outcome; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, stored

#: Verdict, host and path of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Labels that make up a suffix with the two letters of a country.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Domains whose subdomains have owners of their own.
SHARED_DOMAINS = ("appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "firebaseapp.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wixsite.com", "wordpress.com", "workers.dev")
Z = 1.645
LEAST = 0.5
WEAKEST, STRONGEST = 1, 1000


def parse_urls(pages: DataFrame) -> DataFrame:
    """page_id, host (A-Z lower-cased) and path."""
    rows = pages.selectExpr("page_id", "coalesce(url, '') AS url").selectExpr("page_id", "IF(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '') AS rest")
    rows = rows.selectExpr("page_id", "rest", "regexp_extract(rest, '^[^/?#]*', 0) AS raw")
    return rows.selectExpr(
        "page_id",
        "translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host",
        "regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*', 0) AS path",
    )


def _case(rules, what) -> str:
    fits = " ".join(
        f"WHEN (host = '{h}' OR endswith(host, '.{h}')) AND startswith(path, '{p}') THEN '{what((v, h, p))}'" for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {fits} END" if fits else "CAST(NULL AS string)"


def _name(host: str) -> str:
    """SQL: a host without user, port and closing dots."""
    return f"regexp_replace(regexp_replace(regexp_replace({host}, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '')"


def _listed(values) -> str:
    return ", ".join("'" + v + "'" for v in values) or "''"


def _levels(names: DataFrame, second_labels=SECOND_LABELS, shared_domains=SHARED_DOMAINS) -> DataFrame:
    """Names of hosts with their domain and suffix."""
    two = f"length(substring_index(name, '.', -1)) = 2 AND substring_index(substring_index(name, '.', -2), '.', 1) IN ({_listed(second_labels)})"
    return (
        names.selectExpr("*", "name RLIKE '^([0-9]+[.]){3}[0-9]+$' OR startswith(name, '[') AS numeric", f"IF(instr(name, '.') > 0 AND ({two}) OR substring_index(name, '.', -2) IN ({_listed(shared_domains)}), 2, 1) AS k")
        .selectExpr("*", "IF(numeric, name, substring_index(name, '.', -k - 1)) AS domain", "IF(numeric, name, substring_index(name, '.', -k)) AS suffix")
        .drop("numeric", "k")
    )


def _strength(counts: DataFrame) -> tuple[int, float]:
    """(prior strength in pages, overall rate) of units with ``n`` and ``good``: one row of sums."""
    s = counts.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.expr("CAST(good AS DOUBLE) * good / n")).alias("q")
    ).first()
    return strength(s["k"], s["n"] or 0, s["good"] or 0, s["nn"] or 0, s["q"] or 0.0)


def strength(k: int, n: int, good: int, nn: int, q: float) -> tuple[int, float]:
    """Method of moments; q is the sum of good**2 / n. No spread between units: the strongest prior."""
    if not n:
        return STRONGEST, 0.5
    p = (good + 0.5) / (n + 1)
    spread = q - 2 * p * good + p * p * n
    room = n - nn / n - (k - 1)
    rho = (spread / (p * (1 - p)) - (k - 1)) / room if room > 0 else 0.0
    if rho <= 1 / (STRONGEST + 1):
        return STRONGEST, p
    return max(WEAKEST, int((1 - rho) / rho + 0.5)), p


def host_counts(parsed: DataFrame, labels: DataFrame) -> DataFrame:
    """name, n and good of labelled hosts."""
    outcomes = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("page_id"), "quality")
    return parsed.select("page_id", "name").join(outcomes, "page_id").groupBy("name").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"))


def judge_pages(
    pages: DataFrame, labels: DataFrame, rules=RULES, z: float = Z, least: float = LEAST, second_labels=SECOND_LABELS, shared_domains=SHARED_DOMAINS
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    parsed = parse_urls(pages).withColumn("name", F.expr(_name("host")))
    levels = lambda names: _levels(names, second_labels, shared_domains)
    # one row a labelled host, read by the estimates of three levels
    folder = shared_folder(pages.sparkSession)
    hosts = stored(levels(host_counts(parsed, labels)), folder, "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    ms, overall = _strength(suffixes)
    md, mh = _strength(domains)[0], _strength(hosts)[0]
    # every host of the pages gets its bound. A level's prior leaves out what the level below it counts
    # itself, so no page is evidence twice; unlabelled hosts fall back on the nearest labelled level
    named = levels(parsed.where(F.expr(_case(rules, lambda r: r[0])).isNull()).select("name").distinct())
    counted = lambda df, key, x: df.select(key, F.col("n").alias(f"n{x}"), F.col("good").alias(f"g{x}"))
    bounds = (
        named.join(counted(hosts, "name", "h"), "name", "left")
        .join(counted(domains, "domain", "d"), "domain", "left")
        .join(counted(suffixes, "suffix", "s"), "suffix", "left")
        .selectExpr("name", *[f"coalesce({c}, 0L) AS {c}" for c in ("nh", "gh", "nd", "gd", "ns", "gs")])
        .selectExpr("*", f"(gs - gd + {ms} * {overall!r}D) / (ns - nd + {ms}) AS ps")
        .selectExpr("*", f"(gd - gh + {md} * ps) / (nd - nh + {md}) AS pd")
        .selectExpr("name", f"gh + {mh} * pd AS a", f"nh - gh + {mh} * (1 - pd) AS b")
        .selectExpr("name", f"a / (a + b) + {z!r}D * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper")
    )
    # written, so that the last join knows its size and can split the pages of a hot host
    bad = stored(bounds.where(f"upper < {least!r}D").selectExpr("name", "true AS bad"), folder, "bad")
    return (
        parsed.selectExpr("*", f"{_case(rules, lambda r: r[1] + r[2])} AS rule", f"{_case(rules, lambda r: r[0])} AS ruled")
        .join(bad, "name", "left")
        .selectExpr("page_id", "host", "path", "rule", "coalesce(ruled, IF(bad, 'block', 'allow')) AS verdict")
    )


def oracle(rules=RULES, z: float = Z, least: float = LEAST, second_labels=SECOND_LABELS, shared_domains=SHARED_DOMAINS) -> str:
    """The same by DuckDB."""
    fits = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{what((v, h, p))}'" for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))) + " END"
    sums = lambda table: f"SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good, sum(n * n)::DOUBLE AS nn, sum(good::DOUBLE * good / n) AS q FROM {table}"

    def prior(table: str) -> str:
        return f"""(SELECT CASE WHEN n IS NULL OR rho <= 1 / {STRONGEST + 1}.0 THEN {STRONGEST} ELSE greatest({WEAKEST}, floor((1 - rho) / rho + 0.5)) END AS m, coalesce(p, 0.5) AS p FROM (
          SELECT *, CASE WHEN n - nn / n - (k - 1) > 0 THEN ((q - 2 * p * good + p * p * n) / (p * (1 - p)) - (k - 1)) / (n - nn / n - (k - 1)) ELSE 0 END AS rho
          FROM (SELECT *, (good + 0.5) / (n + 1) AS p FROM ({sums(table)}))))"""

    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
parsed AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
named AS (SELECT *, {_name("host")} AS name FROM parsed),
seen AS (SELECT name, count(quality) AS n, coalesce(sum(quality), 0) AS good FROM named LEFT JOIN (SELECT * FROM labels WHERE quality IN (0, 1)) ON page_id = doc_id GROUP BY name),
parts AS (SELECT *, string_split(name, '.') AS p, regexp_matches(name, '^([0-9]+[.]){{3}}[0-9]+$') OR starts_with(name, '[') AS numeric FROM seen),
tops AS (SELECT *, CASE WHEN (len(p) > 1 AND length(p[-1]) = 2 AND p[-2] IN ({_listed(second_labels)})) OR array_to_string(p[-2:], '.') IN ({_listed(shared_domains)}) THEN 2 ELSE 1 END AS k FROM parts),
levels AS (SELECT name, n, good, CASE WHEN numeric THEN name ELSE array_to_string(p[-(k + 1):], '.') END AS domain,
           CASE WHEN numeric THEN name ELSE array_to_string(p[-k:], '.') END AS suffix FROM tops),
hosts AS (SELECT * FROM levels WHERE n > 0),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
ms AS (SELECT * FROM {prior("suffixes")}), md AS (SELECT * FROM {prior("domains")}), mh AS (SELECT * FROM {prior("hosts")}),
joined AS (SELECT l.name, l.n AS nh, l.good AS gh, coalesce(d.n, 0) AS nd, coalesce(d.good, 0) AS gd, coalesce(s.n, 0) AS ns, coalesce(s.good, 0) AS gs
           FROM levels l LEFT JOIN domains d ON d.domain = l.domain LEFT JOIN suffixes s ON s.suffix = l.suffix),
ps AS (SELECT *, (gs - gd + ms.m * ms.p) / (ns - nd + ms.m) AS ps FROM joined, ms),
pd AS (SELECT *, (gd - gh + md.m * ps) / (nd - nh + md.m) AS pd FROM ps, md),
ab AS (SELECT name, gh + mh.m * pd AS a, nh - gh + mh.m * (1 - pd) AS b FROM pd, mh),
bad AS (SELECT name FROM ab WHERE a / (a + b) + {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {least})
SELECT page_id, host, path, {fits(lambda r: r[1] + r[2])} AS rule,
       coalesce({fits(lambda r: r[0])}, CASE WHEN name IN (SELECT name FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM named"""
