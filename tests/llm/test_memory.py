"""Python workers hold little: batches are bounded in bytes, and what a task has freed goes back to the system."""

import pyarrow as pa

from cinderlog.llm import common


def test_written_bounds_the_bytes_of_a_batch(spark):
    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_pydict({"rows": [part.num_rows], "held": [part.nbytes]})

    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 10000) AS text")  # 40 MB in one partition
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    rows = common.written(texts.mapInArrow(sizes, "rows long, held long"), "batch-sizes").collect()
    assert sum(r.rows for r in rows) == 4000
    assert max(r.held for r in rows) <= 2 * common.BATCH
    assert spark.conf.get(setting) == before


def test_a_task_gives_memory_back_at_its_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    run = common.lean(lambda parts: (p + 1 for p in parts))
    got = run(iter([1, 2]))
    assert next(got) == 2 and not calls
    assert list(got) == [3] and calls == [1]
