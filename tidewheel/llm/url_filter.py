"""URL filtering by rules, and by empirical-Bayes host reputation where no rule decides.

Page outcomes (good or bad) come with a label, or from what a page holds: ``page_outcomes`` calls a page good that has words
enough and few symbols among them. They say nothing of rules, so hosts that no rule knows are judged too. Outcomes are shrunk through beta-binomial priors: the suffix's rate towards the
rate of all pages, the registered domain's towards its suffix's, the host's towards its domain's. The
strength of each level's prior is estimated from the spread between its groups by moments. A page is blocked
when even the upper bound of its host's posterior, mean plus ``z`` standard deviations, stays under
``threshold``; without evidence against it, it is allowed.

The registered domain is a host's last label before its suffix, with it. The suffix is the last label, or the last
two where a country's code follows one of ``SECOND_LEVEL`` (co.uk, com.au); no longer public suffixes are told apart.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its
path follows up to ``?``, ``#`` or the end. Null urls and urls without ``://`` have an empty host and path,
which no rule fits. Repeated rows count as often as they stand there. Rules of one length that fit alike are tried in
their order as texts. An empty table gives an empty one; urls may be of any length. Input columns named like an added one
(host, path, rule, verdict, bound) are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.components import checkpointed

#: Rules up to this many become one conditional expression; beyond it they are joined by key.
CHAIN = 64
#: Host posteriors are broadcast only up to this many hosts.
BROADCAST_HOSTS = 50_000

#: What a good page has: words at least; symbols that it has few of.
LEAST_WORDS, SYMBOLS = 20, "#*%|$"

#: Labels under which countries register names (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
_TWO = f"(^|[.])({'|'.join(SECOND_LEVEL)})[.][a-z]{{2}}$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def with_rule(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``pages`` (host, path) with ``rule`` and ``rule_verdict`` of the longest fitting rule.

    ``rules``: (verdict, host and path prefix), such as ``("block", "net/es/")``.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    if len(rules) <= CHAIN:
        rule, verdict = None, None
        for what, text in ordered:
            host, path = split_rule(text)
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            rule = F.when(fits, text) if rule is None else rule.when(fits, text)
            verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
        none = F.lit(None).cast("string")
        return pages.withColumn("rule", none if rule is None else rule).withColumn("rule_verdict", none if verdict is None else verdict)
    # many rules: each page looks its own host suffixes and path prefixes up, one row per page in and out
    spark = pages.sparkSession
    listed = spark.createDataFrame([(t, v) for v, t in ordered], "key string, v string").groupBy("key").agg(F.min("v").alias("v"))
    lengths = sorted({len(split_rule(t)[1]) for _, t in ordered})
    labels = F.split("host", "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    paths = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths]))
    keys = F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))
    marked = pages.withColumn("__row", F.monotonically_increasing_id())
    hits = (
        marked.select("__row", F.explode(keys).alias("key"))
        .join(listed, "key")
        .groupBy("__row")
        .agg(F.max(F.struct(F.length("key").alias("n"), "key", "v")).alias("__x"))
    )
    return marked.join(hits, "__row", "left").withColumn("rule", F.col("__x.key")).withColumn("rule_verdict", F.col("__x.v")).drop("__row", "__x")


def domain_of(host: Column) -> Column:
    return F.when(host.rlike(_TWO), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.when(host.rlike(_TWO), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _strength(groups: DataFrame) -> tuple[float, float]:
    """The prior's strength in pages, by moments of groups (good, n), 1 to 1000; and the mean of all."""
    total = groups.agg(
        F.sum("good").alias("y"), F.sum("n").alias("n"), F.count("*").alias("g"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("good").cast("double") * F.col("good") / F.col("n")).alias("yy"),
    )
    n, y = F.col("n").cast("double"), F.col("y").cast("double")
    m = y / n
    spread = F.col("yy") - y * m
    room = m * (1 - m) * (n - F.col("nn") / n - (F.col("g") - 1))
    rho = F.when(room > 0, (spread - m * (1 - m) * (F.col("g") - 1)) / room)
    row = total.select(
        F.when(rho > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), 1 / rho - 1))).otherwise(F.lit(1000.0)).alias("k"),
        F.coalesce((y + 1) / (n + 2), F.lit(0.5)).alias("m"),
    ).first()
    return row["k"], row["m"]


def host_counts(outcomes: DataFrame) -> DataFrame:
    """``(host, good, n)`` of labelled pages (host, good)."""
    return outcomes.groupBy("host").agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("n"))


def host_posteriors(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Posterior tables ``(name, a, b)`` of hosts, domains and suffixes, and the prior (a, b) of all.

    ``counts``: (host, good, n) of hosts with labelled pages, as ``host_counts`` gives them. Of each level only
    strength and mean, two numbers, come to the driver.
    """
    host = counts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domain = host.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffix = domain.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))

    def shrunk(groups: DataFrame, k: float, prior, name: str) -> DataFrame:
        return groups.select(name, (k * prior + F.col("good")).alias("a"), (k * (1 - prior) + F.col("n") - F.col("good")).alias("b"))

    above = F.col("a") / (F.col("a") + F.col("b"))
    k, m = _strength(suffix)
    s = shrunk(suffix, k, F.lit(m), "suffix")
    d = domain.join(s, "suffix").withColumn("pm", above)
    d = shrunk(d, _strength(domain)[0], F.col("pm"), "domain")
    h = host.join(d, "domain").withColumn("pm", above)
    return shrunk(h, _strength(host)[0], F.col("pm"), "host"), d, s, (k * m, k * (1 - m))


def page_outcomes(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(host, good)`` of every page that has html: good pages have ``LEAST_WORDS`` words or more, and a symbol in ten words at most.

    Tags count as blanks. Null html tells nothing.
    """
    text = F.regexp_replace(F.col(f"`{html_column}`"), "<[^>]*>", " ")
    made = pages.filter(F.col(f"`{html_column}`").isNotNull()).select(host_of(F.col(f"`{url_column}`")).alias("host"), text.alias("text"))
    words, symbols = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    return made.select("host", ((words >= LEAST_WORDS) & (10 * symbols <= words)).alias("good"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], outcomes: DataFrame | None = None, url_column: str = "url", z: float = 1.64, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict, bound (of the posterior used; null where a rule decides).

    ``outcomes``: labelled pages (host, good); by default those that a rule decides.
    """
    ruled = with_rule(pages.withColumn("host", host_of(F.col(f"`{url_column}`"))).withColumn("path", path_of(F.col(f"`{url_column}`"))), rules)
    # what the levels need of the pages, by host: urls are parsed once for it and once for the result
    decided = F.col("rule").isNotNull()
    seen = checkpointed(
        ruled.groupBy("host").agg(F.count_if(decided & (F.col("rule_verdict") == "allow")).alias("good"), F.count_if(decided).alias("n"), F.count_if(~decided).alias("free"))
    )
    counts = seen.filter("n > 0").select("host", "good", "n") if outcomes is None else checkpointed(host_counts(outcomes))
    host, domain, suffix, overall = host_posteriors(counts)
    # hosts that need a verdict, once each; the finest level with evidence speaks for them
    asked = seen.filter("free > 0").select("host")
    levels = (
        asked.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
        .join(host.select("host", F.struct("a", "b").alias("h")), "host", "left")
        .join(domain.select("domain", F.struct("a", "b").alias("d")), "domain", "left")
        .join(suffix.select("suffix", F.struct("a", "b").alias("s")), "suffix", "left")
        .withColumn("x", F.coalesce("h", "d", "s", F.struct(F.lit(overall[0]).alias("a"), F.lit(overall[1]).alias("b"))))
    )
    total = F.col("x.a") + F.col("x.b")
    mean = F.col("x.a") / total
    bound = mean + z * F.sqrt(mean * (1 - mean) / (total + 1))
    answers = levels.select("host", F.round(bound, 6).alias("bound"), F.when(bound < threshold, "block").otherwise("allow").alias("__by_host"))
    if answers.count() <= BROADCAST_HOSTS:
        answers = F.broadcast(answers)
    judged = ruled.join(answers, "host", "left")
    free = F.col("rule").isNull()
    return (
        judged.withColumn("verdict", F.when(free, F.col("__by_host")).otherwise(F.col("rule_verdict")))
        .withColumn("bound", F.when(free, F.col("bound")))
        .select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "bound")], "host", "path", "rule", "verdict", "bound")
    )


#: The contract's rules.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def oracle(rules: list[tuple[str, str]] = RULES, z: float = 1.64, threshold: float = 0.5) -> str:
    """DuckDB SQL for ``judge`` with ``page_outcomes`` over ``pages``."""
    cases, verdicts = [], []
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, path = split_rule(text)
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        cases.append(f"WHEN {fits} THEN '{text}'")
        verdicts.append(f"WHEN {fits} THEN '{what}'")

    def strength(groups: str) -> str:
        return f"""(SELECT CASE WHEN rho > 0 THEN greatest(1.0, least(1000.0, 1 / rho - 1)) ELSE 1000.0 END AS k, coalesce((y + 1) / (n + 2), 0.5) AS m FROM (
  SELECT y, n, CASE WHEN y / n * (1 - y / n) * (n - nn / n - (g - 1)) > 0
    THEN (yy - y * (y / n) - y / n * (1 - y / n) * (g - 1)) / (y / n * (1 - y / n) * (n - nn / n - (g - 1))) END AS rho
  FROM (SELECT sum(good)::DOUBLE AS y, sum(n)::DOUBLE AS n, count(*) AS g, sum(n::DOUBLE * n) AS nn, sum(good::DOUBLE * good / n) AS yy FROM {groups})))"""

    two, labels = f"regexp_matches(host, '{_TWO}')", "array_to_string(list_slice(string_split(host, '.'), {0}, -1), '.')"
    domain = f"CASE WHEN {two} THEN {labels.format(-3)} ELSE {labels.format(-2)} END AS domain"
    suffix = f"CASE WHEN {two} THEN {labels.format(-2)} ELSE {labels.format(-1)} END AS suffix"
    return f"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages),
outcomes AS (SELECT host, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w, length(text) - length(translate(text, '{SYMBOLS}', '')) AS s FROM parsed WHERE text IS NOT NULL),
ruled AS (SELECT *, CASE {' '.join(cases)} END AS rule, CASE {' '.join(verdicts)} END AS rule_verdict FROM parsed),
host AS (SELECT host, {domain}, {suffix},
  sum((w >= {LEAST_WORDS} AND 10 * s <= w)::INT) AS good, count(*) AS n FROM outcomes GROUP BY host),
domain AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM host GROUP BY domain, suffix),
suffix AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM domain GROUP BY suffix),
kh AS {strength('host')}, kd AS {strength('domain')}, ks AS {strength('suffix')},
s AS (SELECT suffix, k * m + good AS a, k * (1 - m) + n - good AS b FROM suffix, ks),
d AS (SELECT domain, k * (s.a / (s.a + s.b)) + good AS a, k * (1 - s.a / (s.a + s.b)) + n - good AS b FROM domain JOIN s USING (suffix), kd),
h AS (SELECT host, k * (d.a / (d.a + d.b)) + good AS a, k * (1 - d.a / (d.a + d.b)) + n - good AS b FROM host JOIN d USING (domain), kh),
asked AS (SELECT DISTINCT host, {domain}, {suffix} FROM ruled WHERE rule IS NULL),
levels AS (SELECT asked.host, coalesce(h.a, d.a, s.a, k * m) AS a, coalesce(h.b, d.b, s.b, k * (1 - m)) AS b
  FROM asked LEFT JOIN h USING (host) LEFT JOIN d ON d.domain = asked.domain LEFT JOIN s ON s.suffix = asked.suffix, ks),
bounds AS (SELECT host, a / (a + b) + {z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM levels)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN rule_verdict WHEN bound < {threshold} THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN round(bound, 6) END AS bound
FROM ruled LEFT JOIN bounds USING (host)
"""
