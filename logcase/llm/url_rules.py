"""URL filtering with pattern rules that are indexed by their rarest literal token.

Every rule names literal tokens that any url it fits must hold. The token that fewest urls hold (counted over the
whole table) becomes the rule's entry in the index; a url's tokens fetch candidate rules by an equi-join, and only
candidates run their regular expression. A rule without literals is a candidate for every url. The index is broadcast after its size has been checked against
``MAX_RULES``; url rows are aggregated on a row number with a partial aggregate first, so that no token, host or
page can gather in one task.

Host: what follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: what follows up to ``? #`` or
the end. Defined results: a null url, or one without ``://``, has empty host and path and fits no rule: it is allowed.
Rows that repeat a page give one result each. An empty table gives an empty table. Only the columns asked for are read.
Among the rules that fit, site rules (a host with a path) go before pattern rules; then the longest wins, then block
before allow, then the rule's name.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcase.llm.common import lower_ascii

MAX_RULES = 100_000
#: Index entry of rules without a literal; every url fetches it, if there are such rules.
EVERY_URL = ""
_TOKEN = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against host and path joined; ``literals`` are whole tokens each fitting url holds."""
    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    site: bool = False


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with all its subdomains, for paths that start with ``path``."""
    # The last piece of the path may be the start of a longer token in the url, so it is no literal.
    whole = path[: path.rfind("/") + 1].lower()
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?\Q{host}\E\Q{path}\E", tuple(_TOKEN.findall(host + whole)), True)


def word_rule(word: str) -> Rule:
    """Blocks urls with ``word`` (tokens joined by hyphens) as a whole label or path piece."""
    return Rule(word, "block", rf"(?i)(?:^|[./])\Q{word}\E(?:[./]|$)", tuple(_TOKEN.findall(word)))


SITE_RULES = (
    site_rule("net", "/", "block"), site_rule("example.net", "/en/", "allow"),
    site_rule("example.com", "/de/", "block"), site_rule("org", "/fr/", "allow"),
)
#: Labels of gambling, adult, pharmacy, advertising and link-farm sites.
BLOCKED_WORDS = ("ad-server", "ads-track", "adult", "adult-x", "betting", "casino", "casino-win", "cheap-loans", "cheap-pills",
                 "free-bets", "free-money", "link-farm", "pharmacy-online", "poker", "porn", "replica-watches", "spam-farm",
                 "sportsbook", "xxx")
RULES = SITE_RULES + tuple(word_rule(w) for w in BLOCKED_WORDS)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), "^[^?#]*", 0)
    return lower_ascii(host), path


def tokens(target: Column) -> Column:
    """The distinct tokens of host and path, A-Z lower-cased."""
    return F.array_distinct(F.split(lower_ascii(target), "[^a-z0-9\\x{80}-\\x{10FFFF}]+", -1))


def rule_index(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per rule with the literal that fewest rows of ``urls`` (column ``target``) hold."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    spark = urls.sparkSession
    listed = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, r.site, t) for i, r in enumerate(rules) for t in r.literals or (EVERY_URL,)],
        "id int, name string, verdict string, pattern string, site boolean, token string")
    literals = listed.select("token").distinct()
    held = urls.select(F.explode(tokens(F.col("target"))).alias("token")).join(F.broadcast(literals), "token")
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest")
    return listed.join(counts, "token", "left").groupBy("id", "name", "verdict", "pattern", "site").agg(rarest).select(
        F.col("rarest.token").alias("token"), "name", "verdict", "pattern", "site")


def judge_urls(pages: DataFrame, keys: tuple[str, ...] = (), url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``pages``: its ``keys`` columns, host, path, the winning rule's name, whether that is a site rule, verdict."""
    host, path = split_url(pages[url])
    urls = pages.select(F.struct(*[pages[k] for k in keys], F.lit(0).alias("_")).alias("key"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("target", F.concat("host", "path"))
    index = rule_index(urls, rules)
    rows = urls.withColumn("rid", F.monotonically_increasing_id())
    asked = tokens(F.col("target"))
    if not all(r.literals for r in rules):
        asked = F.array_union(asked, F.array(F.lit(EVERY_URL)))
    asked = rows.select("*", F.explode(asked).alias("token"))
    found = asked.join(F.broadcast(index), "token", "left")
    fits = F.expr("target rlike pattern")
    rank = F.struct("site", F.char_length("name").alias("size"), "verdict", "name")
    best = found.groupBy("rid").agg(F.first("key").alias("key"), F.first("host").alias("host"), F.first("path").alias("path"),
                                    F.max(F.when(fits, rank)).alias("best"))
    return best.select(*[F.col("key").getField(k).alias(k) for k in keys], "host", "path", F.col("best.name").alias("rule"),
                       F.coalesce("best.site", F.lit(False)).alias("site"),
                       F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
