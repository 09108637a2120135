"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is compiled to a regular expression; of its literal tokens the one that fewest URLs hold is its index key. A URL's tokens fetch the
rules filed under them, and only those rules' expressions run on the URL. DataFrame functions throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host and path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DEFAULT = "allow"
#: An index of up to this many rules (a few MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_RULES = 20_000
TOKEN = r"[a-z0-9]+"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_pattern(rule: str) -> str:
    """Regular expression of a rule over host and path; the dot of a subdomain or the start stands before the host."""
    return r"^(?:[^/?#]*\.)?" + re.sub(r"([^\w/-])", r"\\\1", rule)


def literal_tokens(rule: str) -> list[str]:
    """Tokens that every URL which the rule fits holds in whole: those of the host and of the path but for an open end."""
    host, slash, path = rule.partition("/")
    tokens = re.findall(TOKEN, host)
    own = slash + path
    return list(dict.fromkeys([*tokens, *(m.group() for m in re.finditer(TOKEN, own.lower()) if m.end() < len(own))]))


def tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.concat(host, F.lower(path)), F.lit(f"({TOKEN})"), F.lit(1)))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages: the longest rule that fits, else null and the default verdict.

    Null URLs and those without :// have an empty host and path and fit no rule; repeated rows give repeated rows; columns
    other than page_id and url are not read. Of rules of equal length the last in order of text wins. Rules without a literal token are refused.
    """
    spark = pages.sparkSession
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    by_rule = [(r, v, rule_pattern(r), literal_tokens(r)) for r, v in dict(rules).items()]
    if any(not x[3] for x in by_rule):
        raise ValueError("a rule has no literal token")
    listed = spark.createDataFrame([(r, v, p, t) for r, v, p, ts in by_rule for t in ts], "rule string, verdict string, pattern string, token string")
    few = len(by_rule) <= BROADCAST_RULES
    hint = F.broadcast if few else (lambda df: df)
    # how many URLs hold each literal token: partial counts, one row a token and task
    held = urls.select(F.explode(tokens(F.col("host"), F.col("path"))).alias("token")).join(hint(listed.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    ranked = listed.join(held, "token", "left").select("rule", "verdict", "pattern", F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token").alias("key"))
    filed = ranked.groupBy("rule", "verdict", "pattern").agg(F.min("key").getField("token").alias("token"))
    index = filed.groupBy("token").agg(F.collect_list(F.struct("rule", "verdict", "pattern")).alias("rules"))
    wide = urls.select("*", F.posexplode_outer(tokens(F.col("host"), F.col("path"))).alias("at", "token"))
    tried = wide.join(hint(index), "token", "left")
    fitting = F.expr("filter(rules, r -> rlike(concat(host, path), r.pattern))")
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("says"))))
    # one row a token: the first token of each row counts how often the row occurs
    judged = tried.groupBy("page_id", "host", "path").agg(F.max(best).alias("best"), F.sum((F.coalesce("at", F.lit(0)) == 0).cast("int")).alias("times"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).drop("time")
