"""Byte queries over odd texts, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TEXTS = ["", None, "a", "\x00\x00\x00", "\x00", "ÿé", "€uro", " \n", "abc", "a\r\nb\x1ac\r", "\x1a", "ß\x00\x1f\x7f~ \\x41\\", "\\x4", "é" * 300 + "\x00" + "xyz" * 200, "q" * 127, "q" * 128, "r" * 256, "s" * 512 + "t", "".join(map(chr, range(256))) * 3]


def both(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    sql = entry.oracle_sql()[name].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    return sorted(got, key=repr), sorted(duckdb.connect().execute(sql).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["le_decode_int", "fat12_entries", "nibble_44", "nibble_62", "nibble_53", "nibble_g64", "hex_dump_rows", "cpm_text"])
def test_as_sql(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name)
    assert got == want != []


@pytest.mark.parametrize("name", ["fat12_entries", "nibble_44", "nibble_62", "nibble_53", "nibble_g64", "hex_dump_rows", "cpm_text"])
def test_no_lambda_a_byte(spark, tmp_path, name):
    spark.createDataFrame([(1, "abc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "lambdafunction" not in entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_records_in_one_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(f"{__name__}.TEXTS", [t for t in TEXTS if t and "\x00" not in t])
    got, want = both(spark, tmp_path, "records_from_chunks")
    assert got == want != []
    assert "Join" not in entry.queries()["records_from_chunks"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_escapes_by_distinct_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(f"{__name__}.TEXTS", [t for t in TEXTS if t is not None and "\\x41" not in t])
    for name in ("escape_bytes", "escaped_ascii"):
        got, want = both(spark, tmp_path, name)
        assert got == want != []
        assert "array_distinct" in entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
