"""Regex rule tables: first match, strongest match, and reports on what they hit.

Rules are configuration, so they become ``when`` chains with literal patterns
(compiled once per task) and the text column is neither joined nor repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.evidence import evidence, item, item_when
from sitegauge.operators.ranking import top_per_group


@dataclass(frozen=True)
class Rule:
    pattern: str
    weight: int
    label: str


#: Rules in one chain; longer tables become several chains, tried in order.
CHAIN = 500


def rules_from(table: DataFrame) -> list[Rule]:
    """Rule table ``(pos, pattern, weight, label)`` to rules, all of them: a list that people write."""
    return [Rule(r["pattern"], r["weight"], r["label"]) for r in table.orderBy("pos").collect()]


def first_match(text: Column, rules: Sequence[Rule]) -> Column:
    """``struct(weight, label)`` of the first rule that matches; null if none does."""
    chains = []
    for at in range(0, len(rules), CHAIN):
        out = None
        for r in rules[at : at + CHAIN]:
            value = F.struct(F.lit(r.weight).alias("weight"), F.lit(r.label).alias("label"))
            out = F.when(text.rlike(r.pattern), value) if out is None else out.when(text.rlike(r.pattern), value)
        chains.append(out)
    return F.coalesce(*chains)


def best_match(text: Column, rules: Sequence[Rule]) -> Column:
    """``struct(weight, label)`` of the heaviest rule that matches, the first of equals.

    Rules are tried heaviest first, so the chain stops at the answer.
    """
    return first_match(text, sorted(rules, key=lambda r: -r.weight))


@dataclass(frozen=True)
class TextRules:
    exclusions: Sequence[Rule] = ()
    markers: Sequence[Rule] = ()
    endings: Sequence[Rule] = ()
    script: str | None = None
    script_weight: int = 35
    token_weight: int = 20
    cap: int = 40


def text_signal(df: DataFrame, name: Column, host: Column, rules: TextRules, out: str,
                strong_token: Column | None = None) -> DataFrame:
    """Add ``struct(score, exclusion, evidence)`` of a record's name.

    An exclusion ends it. Otherwise: script of the name, the heaviest marker, the first
    ending, and only without an ending the first word the lexicon is sure of.
    The matches are columns of a projection of their own, so no rule is tried twice.
    """
    null = F.lit(None).cast("struct<weight:int,label:string>")
    hay = F.concat(name, F.lit(" "), F.regexp_replace(F.coalesce(host, F.lit("")), "[.-]", " "))
    staged = (
        df.withColumn("_hay", hay)
        .withColumn("_excluded", first_match(F.col("_hay"), rules.exclusions) if rules.exclusions else null)
        .withColumn("_marker", best_match(F.col("_hay"), rules.markers) if rules.markers else null)
        .withColumn("_ending", first_match(name, rules.endings) if rules.endings else null)
        .withColumn("_script", name.rlike(f"[{rules.script}]") if rules.script else F.lit(False))
    )
    excluded, marker, ending = F.col("_excluded")["label"], F.col("_marker"), F.col("_ending")
    token = F.lit(None).cast("string") if strong_token is None else F.when(ending.isNull(), strong_token)
    parts = (
        (F.col("_script"), "script_in_name", F.lit(rules.script_weight), F.lit("кирилиця в назві бізнесу")),
        (marker.isNotNull(), "brand_marker", marker["weight"], F.concat(F.lit("назва: "), marker["label"])),
        (ending.isNotNull(), "ending_pattern", ending["weight"], ending["label"]),
        (token.isNotNull(), "known_word", F.lit(rules.token_weight), token),
    )
    score = F.lit(0)
    for cond, _, weight, _ in parts:
        score = score + F.when(cond, weight).otherwise(0)
    signal = F.struct(
        F.when(excluded.isNotNull(), 0).otherwise(F.least(F.lit(rules.cap), score)).cast("int").alias("score"),
        excluded.alias("exclusion"),
        F.when(excluded.isNotNull(), evidence(item("name_exclusion", 0, excluded)))
        .otherwise(evidence(*[item_when(*p) for p in parts])).alias("evidence"),
    )
    return staged.withColumn(out, signal).drop("_hay", "_excluded", "_marker", "_ending", "_script")


def category_signal(df: DataFrame, primary_type: Column, rules: Sequence[Rule], out: str) -> DataFrame:
    """Add ``struct(score, exclusion, evidence)`` from prefixes of the category; first rule wins."""
    kind = F.lower(F.coalesce(primary_type, F.lit("")))
    hit = F.col("_category")
    signal = F.struct(
        F.coalesce(hit["weight"], F.lit(0)).alias("score"),
        F.lit(None).cast("string").alias("exclusion"),
        evidence(
            item_when(hit.isNotNull(), "category_type", hit["weight"], F.concat(hit["label"], F.lit(" ("), kind, F.lit(")")))
        ).alias("evidence"),
    )
    return df.withColumn("_category", first_match(kind, rules)).withColumn(out, signal).drop("_category")


def rule_hits(df: DataFrame, key: str, text: Column, rules: Sequence[Rule], samples: int = 6) -> DataFrame:
    """Per rule: how many rows it is the first to match, and the first few keys as samples."""
    labelled = df.select(F.col(key), first_match(text, rules)["label"].alias("rule")).where(
        F.col("rule").isNotNull()
    )
    counts = labelled.groupBy("rule").agg(F.count("*").alias("hits"))
    picked = top_per_group(labelled, ["rule"], [F.col(key)], samples)
    listed = picked.groupBy("rule").agg(
        F.array_join(F.array_sort(F.collect_list(F.col(key))), ",").alias("samples")
    )
    return counts.join(listed, "rule")
