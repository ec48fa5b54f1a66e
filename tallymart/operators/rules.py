"""Rewrite rules: from a key of columns to new values of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import any_of, all_of, upsert


def apply_rules(rows: DataFrame, rules: DataFrame, key: Sequence[str], rounds: int = 3, text: str = "name") -> DataFrame:
    """rows with the rules applied up to `rounds` times in a chain, and how many were used.

    A rule has if_ and then_ columns for each of key, and rule_id; keys match null-safe, the text column without regard to case, and
    no two rules have the same if_ columns. The rounds are joins, so a cycle of rules ends.
    """
    out = rows.withColumn("used", F.lit(0).cast("long"))
    for _ in range(rounds):
        same = [F.lower(k).eqNullSafe(F.lower(f"if_{k}")) if k == text else F.col(k).eqNullSafe(F.col(f"if_{k}")) for k in key]
        joined = out.join(rules, all_of(same), "left")
        hit = F.col("rule_id").isNotNull()
        new = {k: F.when(hit, F.col(f"then_{k}")).otherwise(F.col(k)) for k in key}
        out = joined.select(*[new[c].alias(c) if c in new else (F.col("used") + hit.cast("long")).alias("used") if c == "used" else F.col(c) for c in out.columns])
    return out


def apply_counted(rows: DataFrame, rules: DataFrame, key: Sequence[str], rounds: int = 3, text: str = "name") -> DataFrame:
    """As apply_rules, with the ids of the rules that a row used, in their order, as `rules_used`."""
    out = rows.withColumn("rules_used", F.array().cast("array<long>"))
    for _ in range(rounds):
        same = all_of(F.lower(f"_r.{k}").eqNullSafe(F.lower(f"if_{k}")) if k == text else F.col(f"_r.{k}").eqNullSafe(F.col(f"if_{k}")) for k in key)
        joined = out.alias("_r").join(rules, same, "left")
        hit = F.col("rule_id").isNotNull()
        new = {k: F.when(hit, F.col(f"then_{k}")).otherwise(F.col(f"_r.{k}")) for k in key}
        ids = F.when(hit, F.array_append("rules_used", F.col("rule_id"))).otherwise(F.col("rules_used")).alias("rules_used")
        out = joined.select(*[new[c].alias(c) if c in new else ids if c == "rules_used" else F.col(f"_r.{c}") for c in out.columns])
    return out


def rule_hits(rows: DataFrame, rules: DataFrame, key: Sequence[str]) -> DataFrame:
    """(rule_id, hits) of one round, rules without hits included."""
    same = all_of(F.col(k).eqNullSafe(F.col(f"if_{k}")) for k in key)
    hits = rows.join(rules, same).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return rules.select("rule_id").join(hits, "rule_id", "left").select("rule_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def changed(*pairs: tuple[str, str]) -> Column:
    """Whether any pair of columns differs, null counting as a value."""
    return any_of(~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs)


def rule_upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rules put in by key, where a new blank or zero keeps the old value."""
    blank = {t: F.lit(0) if t in ("int", "bigint", "double") else F.lit("") for _, t in old.dtypes}
    keep = {c: F.when(F.col(f"new_{c}") != blank[t], F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")) for c, t in old.dtypes if c not in key}
    return upsert(old, new, key, keep)
