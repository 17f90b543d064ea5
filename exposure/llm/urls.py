"""URL rules: each rule is indexed under its rarest literal token; a URL's tokens fetch candidates, and only those run a regular expression.

Two kinds of rules are written in one syntax. A pattern is literal text with ``*`` (anything) and ``^`` (a separator, or the end); ``||`` in
front ties it to the start of a host label. A path rule (``host/path``) holds for its host, all subdomains, and paths that begin with its path.
All rules see the URL in one form: the host with A-Z lower-cased, followed by the path; patterns ignore the case of A-Z.

A literal token is a run of [a-z0-9] with a fixed character or end on both sides, so every URL that matches has it as a token of its own.
Rarity is counted over all URLs. A rule without any such token is a candidate for every URL (its index token is the empty one).

Defined cases: a null URL or one without ``://`` has an empty host and path, and only rules that match the empty text hold; each row gives one row,
repeated rows too; a null id stays null; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.llm.common import kind_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``regex`` runs on host + path; ``tokens`` are the literal tokens that every match has."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    kind: str


def path_rule(name: str, verdict: str) -> Rule:
    host, slash, path = name.partition("/")
    if not host or not slash:
        raise ValueError(f"a path rule is host/path: {name!r}")
    # what follows the path is free, so a token at its very end may go on in the URL
    tokens = re.findall(f"{TOKEN}(?![a-z0-9]|$)", name.translate(str.maketrans(UPPER, LOWER)))
    return Rule(name, verdict, f"^([^/]*\\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(sorted(set(tokens))), "path")


def pattern_rule(name: str, verdict: str) -> Rule:
    text = name.translate(str.maketrans(UPPER, LOWER))
    anchored = text.startswith("||")
    body = text[2:] if anchored else text
    regex = "".join({"*": ".*", "^": "([^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body)
    fixed = ("/" if anchored else "*") + body + "*"
    tokens = [m[0] for m in re.finditer(TOKEN, fixed) if fixed[m.start() - 1] != "*" and fixed[m.end()] != "*"]
    return Rule(name, verdict, ("^([^/]*\\.)?" if anchored else "") + regex, tuple(sorted(set(tokens))), "pattern")


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), rest


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    if len({(r.kind, r.name) for r in rules}) < len(rules):
        raise ValueError("a rule stands twice")
    return spark.createDataFrame([(i, r.name, r.verdict, r.regex, list(r.tokens), r.kind) for i, r in enumerate(rules)], "rule_no int, rule string, verdict string, regex string, tokens array<string>, kind string")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, ``rule`` (the longest path rule that fits), ``patterns`` (those that match, sorted) and ``verdict``.

    A path rule decides. Else the URL is blocked if a blocking pattern matches and no allowing one does.
    """
    spark = pages.sparkSession
    urls = pages.select(pages[id_col].alias("id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = urls.select("id", "url", host.alias("host"), path.alias("path")).withColumn("whole", F.concat("host", "path"))
    urls = urls.withColumn("folded", F.translate("whole", UPPER, LOWER))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("folded", F.lit(TOKEN), F.lit(0))))
    probes = urls.select("id", "url", "whole", "folded", F.explode(tokens).alias("token"))

    # the rules are a list that the driver holds, so what is broadcast is bounded by that list, not by the URLs
    wanted = rule_table(spark, rules).withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    vocabulary = F.broadcast(wanted.select("token").distinct())
    counts = probes.join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(F.broadcast(counts), "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    index = F.broadcast(rarest.join(F.broadcast(rule_table(spark, rules).drop("tokens")), "rule_no"))

    candidates = probes.join(index, "token")
    seen = F.when(F.col("kind") == "path", F.col("whole")).otherwise(F.col("folded"))
    hits = candidates.where(F.regexp_like(seen, F.col("regex")))
    best = F.max(F.when(F.col("kind") == "path", F.struct(F.length("rule").alias("n"), "rule", "verdict")))
    pattern = F.col("kind") == "pattern"
    found = hits.groupBy("id", "url").agg(
        best.alias("best"),
        F.array_sort(F.collect_set(F.when(pattern, F.col("rule")))).alias("patterns"),  # at most the list of rules
        F.max(F.when(pattern & (F.col("verdict") == "block"), 1)).alias("blocks"),
        F.max(F.when(pattern & (F.col("verdict") == "allow"), 1)).alias("allows"))
    out = urls.alias("u").join(found.alias("f"), F.col("u.id").eqNullSafe(F.col("f.id")) & (F.col("u.url") == F.col("f.url")), "left")
    method = F.when(F.col("blocks").isNotNull() & F.col("allows").isNull(), "block").otherwise("allow")
    return out.select(
        F.col("u.id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"), F.coalesce(F.col("best.verdict"), method).alias("verdict"))


#: The rules of the query op2: path rules, then patterns.
PATH_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
PATTERN_RULES = (
    ("||spam-farm.", "block"), ("||cheap-pills.", "block"), ("||casino^", "block"), ("||ads.", "block"), ("||adserver.", "block"), ("||tracker.", "block"),
    ("/ads/", "block"), ("/banner/*/click", "block"), ("/popunder^", "block"), ("/login^", "block"), ("/cgi-bin/", "block"), ("*viagra*", "block"),
    ("||docs.", "allow"), ("/about^", "allow"),
)


def default_rules() -> list[Rule]:
    return [path_rule(*r) for r in PATH_RULES] + [pattern_rule(*r) for r in PATTERN_RULES]
