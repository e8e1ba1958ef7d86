"""File images in JSON: holes, numeric order, and what is no image."""

import json

from pyspark.sql import functions as F

from fluxmere.operators import files


def test_there_and_back(spark):
    rows = [(1, 0, b"ab", 5000), (1, 10, b"\x00\xff", 5000), (1, 2, b"c", 5000), (2, 0, b"z", 1)]
    chunks = spark.createDataFrame([(a, b, bytearray(c), d) for a, b, c, d in rows], "id long, chunk_no long, data binary, eof long")
    images = files.image_json(chunks, "id", "dos", 256, F.lit("A/B"))
    one = json.loads(images.where("id = 1").first()["json"])
    assert list(one["chunks"].items()) == [("0", "6162"), ("2", "63"), ("10", "00FF")] and one["eof"] == "88130000" and one["full_path"] == "A/B" and one["chunk_len"] == 256
    back = files.image_chunks(images, "id", F.col("json")).collect()
    assert sorted((r.id, r.chunk_no, bytes(r.data), r.eof) for r in back) == sorted(rows)


def test_what_is_no_image(spark):
    texts = [None, "", "{}", "[1]", "not json", '{"fimg_version":"2.1.0","file_system":"dos"}', '{"fimg_version":"2.1.0","file_system":"dos","eof":"01","chunks":{"0":"XY","x":"00","1":"0A"}}']
    got = files.image_chunks(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", F.col("t")).collect()
    assert [(r.id, r.chunk_no, bytes(r.data), r.eof) for r in got] == [(6, 1, b"\n", 1)]
    assert files.image_json(spark.createDataFrame([], "id long, chunk_no long, data binary, eof long"), "id", "dos", 256, F.lit("")).count() == 0


def test_nested_leaves(spark):
    rows = [(1, '{"a":{"b":{"c":1,"d":[1,{"e":2}]},"f":"{\\"no\\":1}"},"g":null,"h":{}}'), (2, None), (3, "junk"), (4, "[1]"), (5, '"text"')]
    got = files.leaf_rows(spark.createDataFrame(rows, "id long, t string"), ["id"], F.col("t")).collect()
    assert sorted((r.id, tuple(r.path), r.leaf) for r in got if r.leaf is not None) == [(1, ("a", "b", "c"), "1"), (1, ("a", "b", "d"), '[1,{"e":2}]'), (1, ("a", "f"), '{"no":1}')]
    assert [(r.id, tuple(r.path)) for r in got if r.leaf is None] == [(1, ("g",))]


def test_images_go_to_python_in_small_batches(spark):
    """However many images a task has, a worker holds some 2 MB of them at once."""
    import pandas as pd

    from fluxmere.operators import disks
    from fluxmere.sources import disks as formats

    blank = formats.linked_format()
    rows = spark.range(0, 90, 1, 1).select(F.col("id").alias("image_id"), F.lit(bytes(blank)).alias("image"))
    disks.files(rows)
    sizes = rows.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 90 and max(r.n for r in sizes) * len(blank) < 3 << 20
