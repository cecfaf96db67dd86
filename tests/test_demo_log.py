"""Lines are made in tasks and blocks whose number follows the input."""

from pyspark.sql import functions as F

from workload import demo_log, parsing_queries


def _events(spark, tmp_path, n):
    rows = spark.range(1, n + 1, numPartitions=1).selectExpr(
        "id AS event_id", "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "id % 50 AS user_id",
        "element_at(array('error', 'view', 'click', 'signup', 'purchase'), CAST(id % 5 AS INT) + 1) AS event_type",
        "CAST(id % 13 AS DOUBLE) AS value", "'{}' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_one_row_group_is_dealt_to_many_tasks(spark, tmp_path):
    n = 2 * demo_log.EVENTS + 10
    lines = demo_log.demo_lines(spark, _events(spark, tmp_path, n), "raw_json")
    files = lines.groupBy(F.col("_metadata.file_path")).count().collect()
    assert sum(r["count"] for r in files) == n
    assert len(files) == 3 and max(r["count"] for r in files) <= demo_log.EVENTS
    assert lines.select("line_id").distinct().count() == n


def test_blocks_of_exports_grow_with_the_folder():
    block = parsing_queries.export_block
    assert block(0) == block(1_000_000) == 20_000  # small folders keep the small blocks
    for total in (3 * 10**7, 10**9, 6 * 10**9):
        assert total / block(total) <= 1025
    assert block(6 * 10**9) > 5 * 10**6 and block(10**15) == 64 << 20
