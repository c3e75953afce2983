"""Daily counts over a stream: late rows, batches that run again, and sections whose rows are cut before they are shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F
from tidewire.operators import present
from tidewire.streaming.incremental import DailyCounts


def stories(spark, *days):
    return spark.createDataFrame([(f"{d} 12:00:00",) for d in days], "s string").select(F.to_timestamp("s").alias("published_at"))


def test_a_story_a_month_late_is_counted_once(spark, tmp_path):
    counts = DailyCounts(spark, f"file://{tmp_path}/counts")
    batches = [stories(spark, "2026-09-01", "2026-09-02", "2026-09-02"), stories(spark, "2026-10-05"), stories(spark, "2026-09-01"), stories(spark)]
    assert counts.counts().count() == 0
    for number, batch in enumerate(batches):
        for _ in range(2):  # as after a restart
            counts.process(batch, number)
    assert {r["day"]: r["n"] for r in counts.counts().collect()} == {"2026-09-01": 2, "2026-09-02": 2, "2026-10-05": 1}
    assert counts._batches() == [2, 3]


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    counts = DailyCounts(spark, f"file://{tmp_path}/counts", "Asia/Seoul")
    for k, days in enumerate((["2026-09-01"], ["2026-10-01", "2026-09-01"], ["2026-08-01"])):
        stories(spark, *days).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        flow = spark.readStream.schema("published_at timestamp").parquet(f"{tmp_path}/in")
        counts.start(flow, f"{tmp_path}/checkpoint").awaitTermination()
        assert counts.counts().agg(F.sum("n")).first()[0] == (1, 3, 4)[k]
    assert {r["day"]: r["n"] for r in counts.counts().collect()} == {"2026-08-01": 1, "2026-09-01": 2, "2026-10-01": 1}


def test_sections_bound_rows_before_the_shuffle(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("article_id"), F.lit("research").alias("primary_category"), F.lit("research").alias("category"), (F.col("id") % 97).cast("double").alias("priority_score"), F.lit(0.0).alias("score"), F.col("id").alias("position"))
    plan = present.sections(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4
