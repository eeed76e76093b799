"""URL filters: rules indexed by their rarest literal token.

Two kinds of rules: a host rule (``host/path``) fits its host and all subdomains when the
path of the url starts with its own; a pattern rule holds a regular expression that is
searched in the lower-cased url. Every rule has at least one literal token that any url it
fits must contain as a whole token; the rule is indexed under the one that is rarest in the
urls at hand. The tokens of a url fetch candidate rules, and only those are tested. The
longest fitting host rule decides; else a fitting block pattern blocks; else the url is
allowed.

A null url, or one without ``://``, has empty host and path, fits no rule and is allowed.
Repeated rows are judged alike; an empty table gives an empty result; columns other than
the id and the url are not used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import common as C

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A host rule (``text`` like ``example.net/en/``) or, with ``pattern``, a pattern rule.

    ``tokens`` of a pattern rule are runs of a-z and 0-9 that every match has as whole
    tokens of the url.
    """
    text: str
    verdict: str
    pattern: str | None = None
    tokens: tuple[str, ...] = ()

    def literals(self) -> tuple[str, ...]:
        if self.pattern is not None:
            return self.tokens
        host, _, path = self.text.partition("/")
        whole = path[:path.rfind("/") + 1] if not path.endswith("/") else path
        return tuple(dict.fromkeys(re.findall("[a-z0-9]+", f"{host}/{whole}".lower())))


# The host rules of the registered query.
HOST_RULES = [
    Rule("net/", BLOCK), Rule("example.net/en/", ALLOW),
    Rule("example.com/de/", BLOCK), Rule("org/fr/", ALLOW),
]
# Spam, gambling, adult and tracking names as labels of a host.
PATTERN_RULES = [
    Rule("casino", BLOCK, r"://[^/?#]*\bcasino-win\b", ("casino", "win")),
    Rule("bets", BLOCK, r"://[^/?#]*\bfree-bets\b", ("free", "bets")),
    Rule("pills", BLOCK, r"://[^/?#]*\bcheap-pills\b", ("cheap", "pills")),
    Rule("adult", BLOCK, r"://[^/?#]*\badult-x+\b", ("adult",)),
    Rule("tracker", BLOCK, r"://[^/?#]*\bads?-track\b", ("track",)),
    Rule("farm", BLOCK, r"://[^/?#]*\b(link|spam)-farm\b", ("farm",)),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), C.UPPER, C.LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased url."""
    return F.array_distinct(F.filter(F.split(
        F.translate(url, C.UPPER, C.LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def _rule_rows(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = []
    for i, rule in enumerate(rules):
        host, slash, path = rule.text.partition("/")
        is_host = rule.pattern is None
        rows.append((i, rule.text, rule.verdict, host if is_host else None,
                     slash + path if is_host else None, rule.pattern, list(rule.literals())))
    return spark.createDataFrame(
        rows, "rule_id int, rule string, rule_verdict string, rule_host string, "
              "rule_path string, pattern string, literals array<string>")


def rarest_token(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rules`` with the token they are indexed under; ``tokens`` holds one row per url token.

    Counts only tokens that some rule holds. A rule without literals gets no token.
    """
    wanted = rules.select("rule_id", F.explode("literals").alias("token"))
    seen = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy(
        "token").count()
    best = wanted.join(seen, "token", "left").groupBy("rule_id").agg(F.min(F.struct(
        F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rules.join(best, "rule_id", "left")


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id") -> DataFrame:
    """key, host, path, rule (the deciding host rule or null), pattern_rule, verdict."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(key), "url").select(
        "*", F.monotonically_increasing_id().alias("_row"), host.alias("host"),
        path.alias("path"), F.translate("url", C.UPPER, C.LOWER).alias("_lower"))
    tokens = urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
    indexed = rarest_token(_rule_rows(spark, rules), tokens)
    # rules without any literal are candidates of every url, under the empty token
    indexed = indexed.withColumn("token", F.coalesce("token", F.lit("")))
    asked = urls.withColumn("token", F.explode(F.concat(
        F.array(F.lit("")), F.coalesce(url_tokens(F.col("url")), F.array()))))
    # one row a url and token; the few rules go to every task when Spark finds them small
    candidates = asked.join(indexed, "token", "left")
    fits_host = (F.col("rule_host").isNotNull() & F.startswith("path", "rule_path")
                 & ((F.col("host") == F.col("rule_host"))
                    | F.endswith("host", F.concat(F.lit("."), "rule_host"))))
    fits_pattern = F.coalesce(F.expr("_lower rlike pattern"), F.lit(False))
    best = F.max(F.when(fits_host, F.struct(
        F.length("rule").alias("n"), "rule", "rule_verdict"))).alias("_host")
    worst = F.min(F.when(fits_pattern & (F.col("rule_verdict") == BLOCK), F.col("rule"))).alias(
        "pattern_rule")
    return candidates.groupBy("_row", F.col(key), "host", "path").agg(best, worst).select(
        F.col(key), "host", "path", F.col("_host.rule").alias("rule"), "pattern_rule",
        F.coalesce("_host.rule_verdict", F.when(F.col("pattern_rule").isNotNull(), BLOCK)
                   .otherwise(ALLOW)).alias("verdict"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(c).replace("'", "''") + "'" for c in r) + ")"
                     for r in rows)


_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(url, '{C.UPPER}', '{C.LOWER}') AS lowered,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages), u AS (
  SELECT row_number() OVER () AS n, page_id, lowered,
    translate(regexp_extract(rest, '^[^/?#]*'), '{C.UPPER}', '{C.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
hosts(host, path, verdict) AS (VALUES {_values([
    (r.text.partition("/")[0], "/" + r.text.partition("/")[2], r.verdict) for r in HOST_RULES])}),
patterns(name, pattern) AS (VALUES {_values([(r.text, r.pattern) for r in PATTERN_RULES])}),
fits AS (
  SELECT u.n, arg_max(h.host || h.path, length(h.host || h.path)) AS rule,
    arg_max(h.verdict, length(h.host || h.path)) AS verdict
  FROM u JOIN hosts h ON (u.host = h.host OR ends_with(u.host, '.' || h.host))
    AND starts_with(u.path, h.path) GROUP BY u.n),
bad AS (
  SELECT u.n, min(p.name) AS name FROM u JOIN patterns p
    ON regexp_matches(u.lowered, p.pattern) GROUP BY u.n)
SELECT u.page_id, u.host, u.path, f.rule, b.name AS pattern_rule,
  coalesce(f.verdict, CASE WHEN b.name IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN fits f USING (n) LEFT JOIN bad b USING (n)"""


@C.query("op9_urls", _SQL)
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(C.table(spark, sf_dir, "pages"), HOST_RULES + PATTERN_RULES)
