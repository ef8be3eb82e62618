"""Plan shape and sizing guards."""
from pyspark.sql import functions as F

from logcase.operators import grading as G
from logcase.operators import queries as Q
from logcase.plans.sizing import broadcast_if_small, row_count_at_most


def test_broadcast_guard(spark):
    small = spark.range(10)
    big = spark.range(1000)
    assert row_count_at_most(small, 10) and not row_count_at_most(big, 10)
    j = spark.range(100).join(broadcast_if_small(small, 10), "id")
    assert "BroadcastHashJoin" in j._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j2 = spark.range(100).join(broadcast_if_small(big, 10), "id")
        assert "BroadcastHashJoin" not in j2._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_guard_skips_count_for_large_estimates(spark):
    big = spark.range(10_000_000)
    assert broadcast_if_small(big, 10, max_estimated_bytes=1000) is big    # no count job needed


def test_top_errors_partial_aggregation(spark):
    ev = spark.createDataFrame([("a", "error", "m", i) for i in range(50)], "service string, level string, msg string, line long")
    plan = Q.top_errors(ev, 5)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "TakeOrderedAndProject" in plan


def test_grading_hot_case(spark):
    n = 3000
    hot = spark.range(n).select(F.lit(1).alias("case_id"), F.col("id").cast("string").alias("event_id"))
    cold = spark.range(n, 2 * n).select((F.col("id") % 100 + 2).alias("case_id"), F.col("id").cast("string").alias("event_id"))
    ids = hot.unionByName(cold)
    report = ids.where(F.col("event_id").cast("int") % 2 == 0).withColumn("is_key", F.lit(True))
    truth = ids.where(F.col("event_id").cast("int") % 3 == 0)
    distr = ids.where(F.col("event_id").cast("int") % 7 == 0)
    cases = ids.select("case_id").distinct().select("case_id", F.lit(0.9).alias("confidence"),
                                                      F.lit("submitted").alias("termination_reason"),
                                                      F.lit(True).alias("has_report"))
    g = {r.case_id: r for r in G.grade(cases, G.set_counts(report, truth, distr)).collect()}
    h = g[1]
    assert (h.n_report, h.n_truth, h.n_hits) == (1500, 1000, 500)
    assert h.n_key_distractor_hits == len([i for i in range(n) if i % 2 == 0 and i % 7 == 0])
    assert abs(h.overlap_recall - 0.5) < 1e-12 and h.overlap_ok and not h.passed


def test_spread_deals_the_rows_of_one_row_group(spark, tmp_path):
    """A file cut into as many partitions as there are cores, all rows in one of them."""
    from logcase.plans.sizing import spread
    path, cut = str(tmp_path / "one-group.parquet"), "spark.sql.files.maxPartitionBytes"
    spark.range(20_000, numPartitions=1).write.parquet(path)
    spark.conf.set(cut, "4k")
    try:
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        per_task = spread(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset(cut)
    assert sum(r["count"] for r in per_task) == 20_000
    assert max(r["count"] for r in per_task) <= 2 * 20_000 / spark.sparkContext.defaultParallelism


def test_lines_of_large_files_are_dealt_before_parsing(spark, tmp_path):
    """The files of the ingest queries are one task each; their lines must not be parsed by those few tasks."""
    from logcase.plans.checks import q_ingest_files, q_ingest_manifest
    spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"),
                            F.lit("error").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": 3}').alias("props")) \
        .write.parquet(str(tmp_path / "events.parquet"))
    for query in (q_ingest_files, q_ingest_manifest):
        found = query(spark, str(tmp_path))
        assert "REBALANCE_PARTITIONS" in found._jdf.queryExecution().executedPlan().toString()
    assert q_ingest_files(spark, str(tmp_path)).count() == 400
