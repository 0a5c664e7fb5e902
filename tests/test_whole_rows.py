"""Queries read whole texts and every row."""

from pyspark.sql import functions as F

from tessella.operators import graph
from tessella.plans import registry

QUERIES = registry.queries()


def test_titles_and_lines_are_whole(spark, tmp_path):
    name = "a title of far more than forty characters before its end zebra"
    spark.createDataFrame([(4, name + ". Rest", "web")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    said = "a turn that goes on beyond thirty characters\nand has a second line"
    spark.createDataFrame([(7, 1, said)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert "zebra" in QUERIES["clean_titles"](spark, str(tmp_path)).first().title.lower()
    assert "zebra" in QUERIES["title_variants"](spark, str(tmp_path)).first().variants.lower()
    lines = {r.line for r in QUERIES["timed_lines"](spark, str(tmp_path)).collect()}
    assert set(said.split("\n")) <= lines


def test_splits_take_the_edges_of_all_customers(spark, tmp_path):
    spark.range(1, 101).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    group = {k: k for k in range(1, 101)}
    for a, b in ((a, a + 1 + a % 37) for a in group):
        if b < 100 and group[a] != group[b]:
            new, old = sorted((group[a], group[b]))
            group = {k: new if v == old else v for k, v in group.items()}
    linked = {x for a in group if a + 1 + a % 37 < 100 for x in (a, a + 1 + a % 37)}
    got = {r.node: r.component for r in QUERIES["leakage_safe_splits"](spark, str(tmp_path)).collect()}
    assert got == {k: group[k] for k in linked}


def test_splits_of_many_customers_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    spark.range(1, 101).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    few = set(map(tuple, QUERIES["leakage_safe_splits"](spark, str(tmp_path)).collect()))
    plans, stored = [], graph.stored
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(graph, "HUB", 20)
    monkeypatch.setattr(graph, "HUBS_MOST", 0)  # hubs, of which the driver gets a bounded number, are joined by a shuffle too
    monkeypatch.setattr(graph, "stored", lambda df, name: stored(plan(df), name))
    many = plan(QUERIES["leakage_safe_splits"](spark, str(tmp_path)))
    assert set(map(tuple, many.collect())) == few
    assert any("SortMergeJoin" in p for p in plans[:-1]) and "SortMergeJoin" in plans[-1]
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_peaks_are_where_the_sql_has_them(spark, tmp_path):
    rows = [(1, 7, "view", 10.01, '{"k": 1}'), (60_001, 7, "view", 10.05, '{"k": 1}'), (5, 8, "view", 1.0, '{"k": 1}'), (3, 8, "view", 1.0, '{"k": 1}')]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_millis(F.lit(1_704_067_200_000)))
    df.write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id: r.peak_at for r in QUERIES["loudness_journeys"](spark, str(tmp_path)).collect()} == {7: 1, 8: 3}
