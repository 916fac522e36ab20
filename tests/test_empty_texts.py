"""Queries whose SQL says something of empty texts."""

import duckdb
import pytest

import __spark_entry__


def rows_of(spark, folder, name):
    spark.createDataFrame([(i, t) for i, t in enumerate(["", "", "", "Cafe and more words", "x", "ab"])], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = duck.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    return sorted(map(tuple, __spark_entry__.queries()[name](spark, str(folder)).collect()), key=str), sorted(want, key=str)


@pytest.mark.parametrize("name", ["detect_skin_tones", "fn_codepoints"])
def test_empty_texts_as_in_sql(spark, tmp_path, name):
    got, want = rows_of(spark, tmp_path, name)
    assert got == want
