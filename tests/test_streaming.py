"""Streams over several batches of files."""

from fluxmere.streaming import documents

SCHEMA = "doc string, version long, text string"


def test_older_versions_change_nothing(spark, tmp_path):
    path = f"{tmp_path}/changes"
    batches = [[("a", 1, "a1"), ("b", 5, "b5")], [("a", 3, "a3"), ("b", 4, "b4"), ("c", None, "none")], [("a", 2, "a2"), ("d", 1, None), ("b", 5, "b5 again")]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = documents.arriving(spark, path, 1)
    got = documents.drained(documents.newest(stream, ["doc"], "version", ["text"]), "test")
    assert sorted(map(tuple, got.collect())) == [("a", 3, "a3"), ("b", 5, "b5 again"), ("d", 1, None)]


def test_nothing_arrives(spark, tmp_path):
    path = f"{tmp_path}/none"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert documents.drained(documents.newest(documents.arriving(spark, path), ["doc"], "version", ["text"]), "test").count() == 0
