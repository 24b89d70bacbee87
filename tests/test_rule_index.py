"""Rule tables joined by grams, and look-ups that measure their hot keys."""

import random
import re

from pyspark.sql import functions as F

from sitegauge.operators import lexicon, rule_index
from sitegauge.operators.rules import Rule


def test_literals_that_every_match_holds():
    of = rule_index.literals_of
    assert of("(?i)Machinery") == ["machinery"] and of(r"\bred\b") == ["red"] and of("ring$") == ["ring"]
    assert sorted(of("(?:deli|bakery)s?")) == ["bakery", "deli"] and of("(abc)+x*") == ["abc"]
    for nothing in ("ab", "[a-z]+", "(abc)?", "abc|.*", "(abc)*", "[[abc]def]", "(?x) a b c", r"\p{L}abc", "", None, "(", "Σίσυφος"[:1]):
        assert of(nothing) == []
    assert of("ab.cde") == ["cde"] and of("abcd.ef") == ["abcd"]


def test_ten_thousand_rules_equal_a_chain(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(3, 6)))
    kinds = ["(?i){}", r"\b{}\b", "{}$", "(?:{}|{})", "{}.*{}", "^{}", "[{}]{{4}}$"]
    made = [(i, rnd.choice(kinds).format(word(), word()), rnd.randrange(40), f"l{i}") for i in range(10_000)]
    texts = [(k, " ".join(word().upper() if rnd.random() < 0.2 else word() for _ in range(8))) for k in range(40)] + [(40, None), (41, "")]
    table = spark.createDataFrame(made, "pos int, pattern string, weight int, label string")
    rows = spark.createDataFrame(texts, "id int, text string")
    found = rule_index.rule_matches(rows, "id", "text", table).cache()
    want = {(k, i) for k, t in texts if t is not None for i, p, _, _ in made if re.search(p, t)}
    assert {(r["id"], r["pos"]) for r in found.collect()} == want and found.count() == len(want)
    best, first = {}, {}
    for k, i in sorted(want):
        first.setdefault(k, i)
        if k not in best or made[i][2] > made[best[k]][2]:
            best[k] = i
    assert {r["id"]: r["label"] for r in rule_index.strongest(found, "id").collect()} == {k: f"l{i}" for k, i in best.items()}
    assert {r["id"]: r["label"] for r in rule_index.earliest(found, "id").collect()} == {k: f"l{i}" for k, i in first.items()}
    plan = rule_index.rule_matches(rows, "id", "text", table)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000  # The plan does not grow with the table.


def test_no_rules_and_no_texts(spark):
    none = rule_index.rule_table(spark, [Rule("abc", 1, "x")]).limit(0)
    texts = spark.createDataFrame([(1, "abc")], "id int, text string")
    assert rule_index.rule_matches(texts, "id", "text", none).collect() == []
    assert rule_index.rule_matches(texts.limit(0), "id", "text", rule_index.rule_table(spark, [Rule("abc", 1, "x"), Rule(".", 1, "y")])).collect() == []


def test_a_hot_key_meets_in_no_single_task(spark):
    """A key of a third of all tokens, a lexicon too long to broadcast: the rows of no task stand out."""
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        n = 48_000
        tokens = spark.range(n).select("id", F.lit(0).alias("pos"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("key"))
        keyed = tokens.select("key").distinct().withColumn("verdict", F.lit("shared"))
        assert {r["key"] for r in lexicon.hot_keys(tokens).collect()} == {"hot"}
        joined = lexicon.lookup(tokens, keyed, most_rows=0)
        by_task = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(by_task) == n and max(by_task) < 3 * n / 16, by_task
        assert joined.select("id").distinct().count() == n
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_texts_meet_a_short_table_where_they_lie(spark, monkeypatch):
    """No text is dealt out by its key; rules of several literals are met once; the shuffled form gives the same rows."""
    rules = [(1, "(?i)(?:deli|bakery)s?", 1, "a"), (2, r"(?:x\\Ey|deli|cafe)", 2, "b"), (3, "(?i)CAFE$", 3, "c"), (4, "[0-9]{3}", 4, "d"), (5, None, 5, "e")]
    texts = [(1, "Deli bakery deli"), (1, "no bakery"), (2, r"cafe x\Ey deli"), (2, "CAFE"), (None, "deli 123"), (3, None)]
    table = spark.createDataFrame(rules, "pos int, pattern string, weight int, label string")
    rows = spark.createDataFrame(texts, "id int, text string")
    want = sorted([(1, 1), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (None, 4)], key=str)
    out = lambda: sorted(((r["id"], r["pos"]) for r in rule_index.rule_matches(rows, "id", "text", table).collect()), key=str)
    assert out() == want
    found = rule_index.rule_matches(rows, "id", "text", table)
    assert "hashpartitioning(id" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rule_index, "MANY", 1)
    assert out() == want
    monkeypatch.setattr(rule_index, "BROADCAST_ROWS", 0)
    assert out() == want
