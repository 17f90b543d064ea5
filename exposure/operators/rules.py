"""Allow and deny rule lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matcher(entry: Column) -> Column:
    """A rule without its `` — `` note."""
    return F.trim(F.element_at(F.split(entry, " — "), 1))


def core(entry: Column) -> Column:
    return F.replace(matcher(entry), F.lit(":*"), F.lit(" *"))


def rule_conflicts(allow: DataFrame, deny: DataFrame, column: str = "entry") -> DataFrame:
    """Allow entries that equal or begin with a deny rule.

    An entry's prefixes are looked up among the deny rules: an equi-join, linear in entry length.
    Only prefixes as long as some deny rule matter, so the distinct rule lengths are read first.
    """
    entry = F.col(column)
    rules = deny.select(F.explode(F.array(matcher(entry), core(entry))).alias("__rule")).where("__rule <> ''").distinct()
    lengths = [r[0] for r in rules.select(F.length("__rule")).distinct().collect()]
    if not lengths:
        return allow.limit(0)
    heads = F.array_distinct(
        F.flatten(F.transform(
            F.array(*map(F.lit, lengths)), lambda n: F.filter(
                F.array(F.left(matcher(entry), n), F.left(core(entry), n)), lambda p: F.length(p) == n),
        ))
    )
    keyed = allow.withColumn("__row", F.xxhash64(entry))
    hit = keyed.select("__row", entry.alias("__entry"), F.explode(heads).alias("__rule")).join(rules, "__rule", "left_semi")
    return allow.join(hit.select(F.col("__entry").alias(column)).distinct(), column, "left_semi")


def refresh_rules(existing: Column, ours: Column, old: Column) -> Column:
    """A managed rule list brought up to date: user rules stay in place, outdated managed ones go, missing ours follow."""
    stale = F.array_except(old, ours)
    kept = F.filter(existing, lambda rule: ~F.array_contains(stale, rule))
    return F.concat(kept, F.array_distinct(F.filter(ours, lambda rule: ~F.array_contains(kept, rule))))


def rule_coverage(rules: DataFrame, verbs: DataFrame) -> DataFrame:
    """Verbs not in exactly one of allow and deny, and rules for verbs that do not exist.

    ``verbs(label)``; a rule's label is its verb, or verb and nested verb. Options are no verbs and
    a wrapping verb counts as allowed.
    """
    label = F.concat_ws(" ", "verb", "sub")
    effect = F.when(F.col("effect") == "deny", "deny").otherwise("allow")
    real = rules.where(F.col("sub").isNull() | ~F.col("sub").startswith("--"))
    sides = real.groupBy(label.alias("label")).agg(F.countDistinct(effect).alias("n"))
    known = verbs.select("label").distinct().withColumn("__known", F.lit(True))
    problem = (
        F.when(F.col("n").isNull(), "no rule").when(F.col("__known").isNull(), "no such verb").when(F.col("n") > 1, "both")
    )
    return sides.join(known, "label", "full").select("label", problem.alias("problem")).where("problem is not null")
