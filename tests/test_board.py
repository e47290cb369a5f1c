"""The status board over more documents than a report shows."""

from pyspark.sql import functions as F

from quarryline.queries import operations


def test_every_document_is_on_the_board(spark, tmp_path):
    """100,007 users, of whom a limit of 100,000 would leave out the oldest."""
    n = 100_007
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), ts.alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    counts = operations.board_counts(spark, str(tmp_path))
    assert counts.agg(F.sum("n")).first()[0] == n
    board = operations.job_status_board(spark, str(tmp_path))
    assert board.agg(F.count("*"), F.min("position"), F.max("position"), F.count_distinct("position")).first() == (n, 1, n, n)
    lines = board.where("line_no IS NOT NULL").agg(F.count("*"), F.min("line_no"), F.max("line_no"), F.count_distinct("line_no")).first()
    assert lines[0] > 0 and lines[1] == 1 and lines[0] == lines[2] == lines[3]
