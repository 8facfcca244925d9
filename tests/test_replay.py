"""Stored tables as streams: files of a batch, and what a task reads."""

from pyspark.sql import functions as F

from flowsentry.streaming import replay as rp


def test_written_adds_exact_numbers_of_files(spark, tmp_path):
    rows = spark.range(40).repartition(4)
    rp.written(rows, 3, str(tmp_path))
    rp.written(rows.limit(1), 3, str(tmp_path))
    rp.written(rows.limit(0), 3, str(tmp_path))
    found = spark.read.schema(rows.schema).parquet(str(tmp_path))
    assert len(found.inputFiles()) == 9 and found.count() == 41


def test_written_computes_each_row_once_in_the_tasks_that_read_it(spark, tmp_path):
    read, tasks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(frames):
        tasks.add(1)
        for frame in frames:
            read.add(len(frame))
            yield frame

    rp.written(spark.range(0, 40_000, 1, 4).mapInPandas(counted, "id bigint"), 2, str(tmp_path))
    assert (read.value, tasks.value) == (40_000, 4)


def test_replay_has_more_files_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(rp, "FILE_ROWS", 1_000)
    rows = spark.range(20_000).withColumn("seq", F.col("id"))
    stream = rp.replay(rows, "id", slices=4)
    batches = rp.run_to_table(stream)
    assert rp.files_for(5_000) == 5 and rp.files_for(10) == 2
    assert batches.count() == 20_000 and batches.agg(F.countDistinct("id")).first()[0] == 20_000
