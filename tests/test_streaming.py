from pyspark.sql import functions as F

from tessella.streaming.resume import resumable, retried, shard_rows


def test_a_stopped_query_goes_on_and_scores_each_id_once(spark, tmp_path):
    source, output, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def arrive(ids):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(source)

    def run():
        resumable(spark, source, "id long", lambda df: df.withColumn("score", F.col("id") * 2), output, mark).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(output).collect())

    arrive([1, 2, 2])
    assert run() == [1, 2]
    arrive([2, 3])
    assert run() == [1, 2, 3]


def test_failed_rows_come_again(spark):
    scored = spark.createDataFrame([("1", {"a": 1.0}), ("2", None)], "id string, scores map<string,double>")
    assert sorted(r.id for r in retried(spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), scored).collect()) == ["2", "3"]


def test_shards_are_strided(spark):
    rows = spark.range(10).withColumnRenamed("id", "ord")
    assert sorted(r.ord for r in shard_rows(rows, 3, 1).collect()) == [1, 4, 7]
