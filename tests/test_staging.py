import pyarrow as pa

from tessella.staging import BATCH, Scratch


def test_a_cut_hands_small_batches_to_python_and_leaves_the_session_as_it_was(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    before = {k: spark.conf.get(k) for k in BATCH}
    rows = spark.range(0, 9000, 1, 1).mapInArrow(sizes, "n long")
    scratch = Scratch(spark, "small-batches")
    cut = scratch.cut(rows)
    found = [r.n for r in cut.collect()]
    assert sum(found) == 9000 and max(found) <= 2000
    assert {k: spark.conf.get(k) for k in BATCH} == before
    scratch.drop(cut)


def test_a_row_larger_than_a_batch_passes_whole(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(x.as_py()) for x in batch.column("text")])], ["n"])

    rows = spark.range(3).selectExpr("repeat('x', cast(if(id = 1, 20000000, id) as int)) as text").mapInArrow(sizes, "n long")
    scratch = Scratch(spark, "long-row")
    cut = scratch.cut(rows)
    assert sorted(r.n for r in cut.collect()) == [0, 2, 20_000_000]
    scratch.drop(cut)
