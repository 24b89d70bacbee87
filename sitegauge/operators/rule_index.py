"""Rule tables of any length joined to texts through an inverted index of literal grams.

Every match of a rule holds one of a few literals that its pattern spells out. One gram of three characters of each
literal stands in the index; texts meet rules by gram, and the pattern itself only verifies. Rules whose patterns spell
out too little are kept in one array and tried on every text.
"""

from __future__ import annotations

import warnings
from functools import reduce
from re import _parser as patterns

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.session import BROADCAST_ROWS, reliable, spread, with_package

GRAM = 3
#: A rule of more literals is kept out of the index that is brought to the texts, where a literal knows those before it.
MANY = 32
#: Letters whose lower case depends on their surroundings, or differs between engines.
_UNSURE = frozenset("ΣσςİıK")


def _literals(nodes) -> list[str] | None:
    """Literals of which every match holds at least one; None if nothing is sure. The best choice has the longest shortest."""
    choices: list[list[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            choices.append([run])
        run = ""

    for op, value in nodes:
        if op is patterns.LITERAL and chr(value) not in _UNSURE:
            run += chr(value).lower()
            continue
        end()
        inner = None
        if op is patterns.SUBPATTERN:
            inner = _literals(value[-1])
        elif op in (patterns.MAX_REPEAT, patterns.MIN_REPEAT, patterns.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner = _literals(value[-1])
        elif op is patterns.ATOMIC_GROUP:
            inner = _literals(value)
        elif op is patterns.BRANCH:
            parts = [_literals(branch) for branch in value[1]]
            inner = [x for p in parts for x in p] if all(parts) else None
        if inner:
            choices.append(inner)
    end()
    return max(choices, key=lambda c: min(map(len, c)), default=None)


def literals_of(pattern: str | None) -> list[str]:
    """Lower-case literals of GRAM characters or more, one of which is in the lower-cased text of every match; or none.

    Patterns are of Java; one that Python reads otherwise, or not at all, gives none.
    """
    if not pattern or any(mark in pattern for mark in ("[[", "&&", "\\Q", "(?x")):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            found = _literals(patterns.parse(pattern))
    except (patterns.error, Warning, OverflowError, RecursionError):
        return []
    return found if found and min(map(len, found)) >= GRAM and all(len(x) == len(x.lower()) for x in found) else []


def _with_literals(batches):
    for rows in batches:
        yield rows.assign(literals=[list(dict.fromkeys(literals_of(p))) for p in rows["pattern"]])


def grams(low: Column) -> Column:
    """The different runs of GRAM characters of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def with_literals(rules: DataFrame) -> DataFrame:
    """The rules (pos, pattern, weight, label) with the `literals` that their patterns spell out, stored."""
    rules = rules.select("pos", "pattern", "weight", "label")
    return reliable(with_package(rules).mapInPandas(_with_literals, T.StructType([*rules.schema, T.StructField("literals", T.ArrayType(T.StringType()))])))


def gram_index(read: DataFrame) -> DataFrame:
    """(gram, pos, nth, literal) for each literal of the rules that :func:`with_literals` read.

    Of a literal's grams the one that the fewest other literals of the table hold stands for it.
    """
    each = read.select("pos", F.posexplode("literals").alias("nth", "literal"))
    each = each.select("pos", "nth", F.lower("literal").alias("literal"))
    each = each.select("*", F.explode(grams(F.col("literal"))).alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("n"))
    return each.join(common, "gram").groupBy("pos", "nth", "literal").agg(F.min(F.struct("n", "gram")).alias("best")).select(
        F.col("best.gram").alias("gram"), "pos", "nth", "literal"
    )


def _met_in_place(texts: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Texts meet a short index where they lie; a rule stands for its first literal that is in the text.

    The conditions are ones that Spark compiles with the explosion and the join, so that a text is lower-cased once and
    not copied for each of its grams.
    """
    low = spread(texts.select(key, "_text")).withColumn("_low", F.lower("_text"))
    met = low.select("*", F.explode(grams(F.col("_low"))).alias("gram")).join(F.broadcast(index), "gram")
    first = F.contains("_low", "literal") & (F.col("earlier").isNull() | ~F.rlike("_low", F.col("earlier")))
    return met.where(first & F.rlike("_text", F.col("pattern"))).select(key, "pos", "weight", "label")


def _met_by_shuffle(texts: DataFrame, key: str, index: DataFrame, rules: DataFrame) -> DataFrame:
    """Grams of the texts are joined to an index of any length; a text is joined again to what it may match."""
    spoken = texts.select(key, F.explode(grams(F.lower("_text"))).alias("gram"))
    met = spoken.join(index.select("gram", "pos").distinct(), "gram").select(key, "pos").distinct()
    checked = met.join(texts.select(key, "_text", F.lower("_text").alias("_low")), key).join(rules, "pos")
    spelt = F.exists("literals", lambda x: F.contains(F.col("_low"), F.lower(x)))
    return checked.where(spelt & F.rlike("_text", F.col("pattern"))).select(key, "pos", "weight", "label")


def rule_matches(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, pos, weight, label): every rule of ``rules`` (pos, pattern, weight, label) that matches a text.

    ``pos`` tells rules apart and orders them, ``key`` tells texts apart. Nothing is collected, and the plan does not
    grow with the table. Null texts and null patterns match nothing.

    A rule is tried only where one of its literals is in the text. An index of up to BROADCAST_ROWS literals is brought
    to the texts; that of a longer table, and of rules of more than MANY literals, is joined by shuffle.
    """
    read = with_literals(rules)
    spelt = read.where((F.size("literals") > 0) & F.col("pos").isNotNull())
    known = texts.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, F.col(text).alias("_text"))
    few, many = spelt.where(F.size("literals") <= MANY), spelt.where(F.size("literals") > MANY)
    found = []
    if few.select(F.explode("literals")).limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        found.append(_met_by_shuffle(known, key, gram_index(spelt), spelt))
    else:
        # The literals before one, as a pattern.
        quoted = F.transform(F.slice("literals", F.lit(1), F.col("nth")), lambda x: F.concat(F.lit("\\Q"), F.replace(F.lower(x), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
        earlier = F.when(F.col("nth") > 0, F.array_join(quoted, "|")).alias("earlier")
        found.append(_met_in_place(known, key, gram_index(few).join(few, "pos").select("gram", "pos", "literal", earlier, "pattern", "weight", "label")))
        if not many.isEmpty():
            found.append(_met_by_shuffle(known, key, gram_index(many), many))
    rest = read.where((F.size("literals") == 0) & F.col("pattern").isNotNull())
    others = F.broadcast(rest.agg(F.collect_list(F.struct("pos", "pattern")).alias("_rest")))
    tried = texts.select(key, F.col(text).alias("_text")).join(others).select(
        key, F.explode(F.filter("_rest", lambda r: F.rlike("_text", r["pattern"]))["pos"]).alias("pos")
    )
    found.append(tried.join(rules.select("pos", "weight", "label"), "pos").select(key, "pos", "weight", "label"))
    return reduce(DataFrame.unionByName, found)


def strongest(matches: DataFrame, key: str) -> DataFrame:
    """(key, weight, label) of the heaviest rule that matches, the first of equals."""
    best = F.min_by(F.struct("weight", "label"), F.struct((-F.col("weight")).alias("w"), "pos"))
    return matches.groupBy(key).agg(best.alias("_b")).select(key, "_b.weight", "_b.label")


def earliest(matches: DataFrame, key: str) -> DataFrame:
    """(key, weight, label) of the first rule that matches."""
    return matches.groupBy(key).agg(F.min_by(F.struct("weight", "label"), "pos").alias("_b")).select(key, "_b.weight", "_b.label")


def rule_table(spark, rules) -> DataFrame:
    """Rules written down in a program as a table."""
    rows = pd.DataFrame([(i, r.pattern, r.weight, r.label) for i, r in enumerate(rules)], columns=["pos", "pattern", "weight", "label"])
    return spark.createDataFrame(rows, "pos int, pattern string, weight int, label string")
