"""The store of facts by content, and the job that reads from it."""

from pyspark.sql import functions as F

from sitegauge.plans import facts, rescore
from sitegauge.plans.profiles import TRIAL


def pages(spark, rows):
    return spark.createDataFrame(rows, "place_id string, final_url string, html string")


def added(spark, folder):
    return spark.read.parquet(f"{folder}/rules={facts.rules_version(TRIAL)}").count()


def same(a, b):
    columns = sorted(a.columns)
    text = lambda df: sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert sorted(b.columns) == columns and text(a) == text(b)


def test_a_page_is_parsed_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "facts")
    body = "<html lang=fr><title>t{}</title><p>© 2014 éèê a@b.example</p></html>"
    first = pages(spark, [(f"p{i}", f"https://s{i % 3}.example/", body.format(i % 3)) for i in range(9)] + [("p9", "https://x.example/", None)])
    parsed = []
    original = facts.page_facts
    monkeypatch.setattr(facts, "page_facts", lambda df, *a, **k: (parsed.append(df.count()), original(df, *a, **k))[1])
    got = facts.facts_by_content(first, folder, TRIAL)
    same(got, rescore.page_facts(first, TRIAL))
    assert added(spark, folder) == 4
    assert parsed == [4]  # Equal pages of nine places are parsed once each.
    same(facts.facts_by_content(first, folder, TRIAL), got)
    assert parsed == [4] and added(spark, folder) == 4
    # One page changed, one is new, and an old one is gone.
    second = pages(spark, [("p1", "https://s1.example/", body.format("new")), ("p20", "https://n.example/", "<p>n</p>"), ("p2", "https://s2.example/", body.format(2))])
    same(facts.facts_by_content(second, folder, TRIAL), rescore.page_facts(second, TRIAL))
    assert parsed == [4, 2] and added(spark, folder) == 6


def test_other_rules_have_a_table_of_their_own(spark, tmp_path):
    import dataclasses

    folder = str(tmp_path / "facts")
    rows = pages(spark, [("a", "https://a.example/", "<p>x</p>")])
    facts.facts_by_content(rows, folder, TRIAL)
    later = dataclasses.replace(TRIAL, as_of=TRIAL.as_of.replace(year=TRIAL.as_of.year + 1))
    assert facts.rules_version(later) != facts.rules_version(TRIAL)
    same(facts.facts_by_content(rows, folder, later), rescore.page_facts(rows, later))
    assert facts.facts_by_content(rows.limit(0), str(tmp_path / "none"), TRIAL).collect() == []


def test_two_runs_at_once_count_once(spark, tmp_path):
    folder = str(tmp_path / "facts")
    rows = pages(spark, [("a", "https://a.example/", "<p>x</p>"), ("b", "https://b.example/", "<p>y</p>")])
    facts.facts_by_content(rows, folder, TRIAL)
    table = f"{folder}/rules={facts.rules_version(TRIAL)}"
    spark.read.parquet(table).write.mode("append").parquet(table)
    assert facts.facts_by_content(rows, folder, TRIAL).count() == 2


def test_digest_tells_null_from_empty(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("b", "", "x"), ("c", "x", ""), ("d", "=", "x")], "place_id string, final_url string, html string")
    assert rows.select(facts.content_key(rows).alias("k")).distinct().count() == 4


def test_large_tables_are_not_dealt_out(spark, monkeypatch):
    from sitegauge import session

    rows = spark.range(1000).select(F.col("id").cast("string").alias("place_id"))
    assert "Repartition" in session.spread(rows)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(session, "SMALL_SCAN", 100)
    assert "Repartition" not in session.spread(rows)._jdf.queryExecution().optimizedPlan().toString()
