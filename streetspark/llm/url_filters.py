"""URL filters with a rule index on rarest literal tokens (native).

Each rule is a regular expression over ``host + path`` together with the
literal tokens (runs of letters and digits) that every matching URL must
contain whole. The rule is filed under the one of them that is rarest in the
corpus of URLs. The tokens of a URL fetch candidate rules by an equi-join and
only those run their regular expression. Rules without tokens, if there are any, are tried on every URL.

URLs are judged once per distinct URL and joined back. Nulls: a null URL, or
one without ``://``, has empty host and path and is allowed; an empty rule
table allows everything. Repeated rows get the same verdict; extra columns
stay away, as only page_id and url are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): fits the host and its subdomains where the path starts with the rule's; longest wins.
HOST_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The method's own block rules, for URLs that no host rule fits: families of hosts by the literal tokens that name them, each between
#: dots, hyphens or slashes. A table of the same columns (``rule_table``) may hold any number of others.
FAMILIES = {
    "adult": ["adult", "porn", "xxx", "sex"],
    "pharma": ["pills", "pharma", "viagra", "meds"],
    "gambling": ["casino", "bets", "betting", "poker", "slots", "lottery"],
    "ads": ["ads", "adserver", "adclick", "banner", "doubleclick"],
    "tracking": ["track", "tracker", "pixel", "beacon", "telemetry"],
    "spam": ["spam", "linkfarm", "clickbait", "freebie"],
    "malware": ["malware", "phish", "phishing", "warez", "crack"],
}
PATTERN_RULES = [(f"{family}:{token}", rf"^([^/]*[.-])?{token}[.-]", [token]) for family, tokens in FAMILIES.items() for token in tokens]
PATTERN_RULES += [("spam:link-farm", r"^([^/]*\.)?link-farm\.", ["link", "farm"]), ("gambling:casino-path", r"/casino[./-]", ["casino"]), ("tracking:pixel-path", r"/track/pixel", ["track"])]


def host_rules(rules=HOST_RULES) -> list[tuple]:
    """Rules as (kind, verdict, name, regex, tokens); a path's last token may go on, so it is no whole one."""
    out = []
    for verdict, host, path in rules:
        closed = re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
        out.append(("host", verdict, host + path, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", re.findall("[a-z0-9]+", host) + closed))
    return out


def pattern_rules(rules=PATTERN_RULES) -> list[tuple]:
    return [("pattern", "block", name, regex, tokens) for name, regex, tokens in rules]


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    schema = "array<struct<kind:string,verdict:string,name:string,regex:string,tokens:array<string>>>"
    if not rules:
        return spark.range(0).select(F.explode(F.array().cast(schema)).alias("r")).select("r.*")
    lit = lambda x: F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, list) else F.lit(x)
    rows = F.array(*[F.struct(*[lit(x) for x in r]) for r in rules]).cast(schema)
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def index_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with ``key``: their token that is rarest in ``urls`` (host, path), '' if they have none."""
    tokens = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = url_tokens(urls, "host", "path").join(tokens, "token", "left_semi").groupBy("token").count()
    filed = rules.select("*", F.explode_outer("tokens").alias("token")).join(seen, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token"))
    return filed.groupBy("kind", "verdict", "name", "regex").agg(F.coalesce(rarest, F.lit("")).alias("key"))


def tokenless(rules: DataFrame) -> bool:
    """Whether there are rules without tokens, which every URL has to try."""
    return not rules.where(F.size("tokens") == 0).isEmpty()


def url_tokens(urls: DataFrame, *carry: str) -> DataFrame:
    both = F.lower(F.concat("host", "path"))
    tokens = F.array_remove(F.array_distinct(F.split(both, "[^a-z0-9]+")), "")
    return urls.select(*carry, F.explode(tokens).alias("token"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """Per row: key, host, path, rule (the longest host rule that fits), verdict, patterns (names of the method's that fit)."""
    p = pages.select(pages[key].alias("id"), pages["url"].alias("url"))
    urls = p.select("url").distinct()
    urls = urls.select("url", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"))
    filed = index_rules(urls, rules)
    rule = ["kind", "verdict", "name", "regex"]
    columns = ["url", "host", "path", *rule]
    fits = url_tokens(urls, "url", "host", "path").join(filed.where("key <> ''"), F.col("token") == F.col("key")).select(*columns)
    loose = filed.where("key = ''").select(*rule)
    if tokenless(rules):
        fits = fits.union(urls.join(loose, F.lit(True)).select(*columns))
    fits = fits.where(F.expr("concat(host, path) RLIKE regex"))
    best = F.when(F.col("kind") == "host", F.struct(F.length("name").alias("n"), F.col("name"), F.col("verdict")))
    named = F.when(F.col("kind") == "pattern", F.col("name"))
    hits = fits.groupBy("url").agg(F.max(best).alias("best"), F.array_sort(F.collect_set(named)).alias("patterns"))
    j = p.join(hits, "url", "left")
    other = F.when(F.size("patterns") > 0, "block").otherwise("allow")
    url = F.coalesce("url", F.lit(""))
    return j.select(
        F.col("id").alias(key),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.col("best.name").alias("rule"),
        F.coalesce("best.verdict", other).alias("verdict"),
        F.coalesce(F.array_join("patterns", ","), F.lit("")).alias("patterns"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "pages"), rule_table(spark, host_rules() + pattern_rules()))


def op9_sql() -> str:
    values = ", ".join("('{}', '{}', '{}', '{}')".format(k, v, n, r.replace("'", "''")) for k, v, n, r, _ in host_rules() + pattern_rules())
    return f"""
WITH rules(kind, verdict, name, regex) AS (VALUES {values}),
u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
r AS (SELECT page_id, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    row_number() OVER () AS rn FROM r),
h AS (SELECT rn, max(CASE WHEN kind = 'host' THEN {{'n': length(name), 'name': name, 'verdict': verdict}} END) AS best,
    string_agg(CASE WHEN kind = 'pattern' THEN name END, ',' ORDER BY name) AS patterns
  FROM p JOIN rules ON regexp_matches(p.host || p.path, regex) GROUP BY rn)
SELECT page_id, host, path, best.name AS rule, coalesce(best.verdict, CASE WHEN patterns IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(patterns, '') AS patterns FROM p LEFT JOIN h USING (rn)"""
