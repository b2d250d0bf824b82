"""Tables that are folders of files, as larger ones are."""

from compare import connect, difference

from corvane.plans import ORACLE_SQL, QUERIES


def test_stream_of_a_folder(spark, sf_dir, tmp_path):
    """A stream reads a table's folder as it does its one file."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    name = "g8_embedding_sweep_stream"
    assert difference(QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), ORACLE_SQL[name]) is None
