"""URL filter by rules and empirical-Bayes host reputation, in column expressions only.

Labelled pages give each host a count of outcomes and of bad ones. Beta-binomial priors shrink
them from the top down: a suffix (last label) towards all pages, a registered domain (last two
labels) towards its suffix, a host towards its domain. The strength of each prior is estimated
by moments from how far the children spread beyond binomial noise. A host is blocked when the
lower bound of its posterior share of bad pages is above ``BLOCK_TIMES`` the share of bad pages
among all that are labelled; mean less one deviation stands for the bound. A host without
labels has the prior of its domain. A rule, where one fits, overrides the reputation.

Defined results: a NULL or empty url, or one without ``://``, has an empty host and path; an empty
host is judged like any other. Very long urls are read whole. Of rules that fit the longest wins;
a bound equal to the limit allows. Repeated rows are judged alike. Without labels nothing is
blocked but by rule; an empty table gives no rows. Input columns named like a result give way to
it, in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions.scale_out import lookup_join, settle
from gridcast.llm.common import lower_ascii

Z, BLOCK_TIMES = 1.0, 1.5
STRONGEST = 10_000.0                  # of a prior, in outcomes, where children don't differ
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column | str) -> tuple[Column, Column]:
    """Lower-cased host, and path."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; NULL where none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule, decision in sorted(rules, key=lambda r: len(r[0])):
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | host.endswith("." + rule[:cut])) & path.startswith(rule[cut:])
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def host_levels(host: Column | str = "host") -> dict[str, Column]:
    return {"suffix": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2),
            "host": F.col(host) if isinstance(host, str) else host}


def _strength(children: DataFrame) -> Column:
    """Aggregate: the prior's weight, from children ``(n, k, m)`` whose parent's mean is ``m``."""
    m, n = F.col("m"), F.col("n")
    noise = F.sum(m * (1 - m))
    spread = (F.sum(n * (F.col("k") / n - m) * (F.col("k") / n - m)) - noise) / (F.sum(n) - F.count("*"))
    mean = F.sum(n * m * (1 - m)) / F.sum(n)
    weight = F.when(spread > 0, mean / spread - 1).otherwise(STRONGEST)
    return F.coalesce(F.least(F.greatest(weight, F.lit(1.0)), F.lit(STRONGEST)), F.lit(STRONGEST))


def reputations(outcomes: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], float]:
    """From ``(host, bad)``, one row per labelled page: each labelled host's posterior
    ``(host, a, b)``, the same for suffixes and domains, and the share of bad pages."""
    counts = settle(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k")))
    n, k = counts.agg(F.sum("n"), F.sum("k")).first()
    parent = counts.sparkSession.range(1).select(F.lit("").alias("up"), F.lit((k or 0) / n if n else 0.0).alias("m"))
    out: dict[str, DataFrame] = {}
    columns = host_levels()
    up = F.lit("")
    for level in LEVELS:
        own = counts.groupBy(columns[level].alias(level), up.alias("up")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        own = settle(own.join(parent, "up"))
        weight = own.agg(_strength(own)).first()[0]
        a, b = F.col("k") + F.col("m") * weight, F.col("n") - F.col("k") + (1 - F.col("m")) * weight
        out[level] = settle(own.select(level, a.alias("a"), b.alias("b"), F.lit(weight).alias("weight")))
        parent = out[level].select(F.col(level).alias("up"), (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
        up = columns[level]
    return out["host"], out, (k or 0) / n if n else 0.0


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    """Of a Beta(a, b), by its mean and deviation."""
    n = a + b
    return a / n - z * F.sqrt(a * b / (n * n * (n + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = (), url: str = "url",
          z: float = Z, block_times: float = BLOCK_TIMES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` and ``bad_share`` (the posterior's lower bound)."""
    host, path = url_parts(url)
    rule, decided = match_rule(F.col("host"), F.col("path"), list(rules))
    pages = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict", "bad_share")])
    read = pages.withColumn("host", host).withColumn("path", path) \
        .withColumn("rule", rule).withColumn("verdict", decided)
    _, levels, usual = reputations(outcomes)
    bounds = read.select("host").distinct()
    shares = []
    for level in LEVELS[::-1]:                     # nearest level that has labels; priors of the levels below
        known = levels[level]
        bounds = bounds.withColumn(f"_{level}", host_levels()[level]) \
            .join(known.select(F.col(level).alias(f"_{level}"), F.col("a").alias(f"{level}_a"), F.col("b").alias(f"{level}_b")),
                  f"_{level}", "left").drop(f"_{level}")
        shares.append(lower_bound(F.col(f"{level}_a"), F.col(f"{level}_b"), z))
    bounds = bounds.select("host", F.coalesce(*shares, F.lit(0.0)).alias("bad_share"))
    judged = lookup_join(read, bounds, "host", "left", salt_by=url)
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("bad_share") > F.lit(block_times) * F.lit(usual), "block").otherwise("allow")))


def page_outcomes(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """``(host, bad)`` of pages whose path ends in the number of a labelled document. A page is
    bad if a label calls its document toxic or of low quality."""
    host, path = url_parts(url)
    number = F.expr("try_cast(nullif(regexp_extract(_path, '/([0-9]+)(?:[.]html|/)?$', 1), '') AS BIGINT)")
    seen = pages.select(host.alias("host"), path.alias("_path")).withColumn("doc_id", number).select("host", "doc_id")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
    return seen.join(marks, "doc_id").select("host", "bad")


def allowed(pages: DataFrame, *args, **how) -> DataFrame:
    return judge(pages, *args, **how).filter("verdict = 'allow'").select(*pages.columns)
