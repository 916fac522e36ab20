"""Registered queries against their SQL in DuckDB, and expressions on small inputs."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import casing, codec, collation, domains, normalize, segments
from glyphloom.operators import detectors
from glyphloom.plans import registry
from glyphloom.sources import delimited
from glyphloom.streaming import monitor

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()
#: Compiling the script classes takes these half a minute each; the driver compares them.
SLOW = {"detect_homoglyphs", "detect_imitated_names", "detect_source_display", "detect_run_all_counts", "detect_hazard_rollup"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_same_rows_as_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    wanted = duck.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=key) == sorted(wanted.fetchall(), key=key)


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_null_and_empty_texts(spark):
    for f in (codec.codepoints, normalize.nfc, segments.word_count, casing.lower, codec.first_forbidden):
        value(spark, f, None)
        value(spark, f, "")
    assert value(spark, codec.codepoints, "") == []


def test_final_sigma(spark):
    assert value(spark, casing.lower, "ΟΔΟΣ ΣΑΣ.") == "οδος σας."


def test_graphemes(spark):
    assert value(spark, segments.graphemes, "é\r\nक्षa") == ["é", "\r\n", "क्ष", "a"]


def test_first_difference(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("ab", "abc"), ("a", "a"), ("", "x")], "a string, b string")
    found = rows.select(detectors.first_difference(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r["v"] for r in found] == [2, 2, None, 0]


def test_to_ascii(spark):
    assert value(spark, domains.to_ascii, "Bücher.example") == "xn--bcher-kva.example"
    assert value(spark, domains.to_ascii, "-bad.example") is None


def test_collation_compares_by_strength(spark):
    row = spark.createDataFrame([("résumé", "Resume")], "a string, b string")
    assert row.select(collation.compare(F.col("a"), F.col("b"), "primary").alias("v")).first()["v"] == 0
    assert row.select(collation.compare(F.col("a"), F.col("b")).alias("v")).first()["v"] != 0


def test_fixture_files(spark, tmp_path):
    (tmp_path / "DemoTest.txt").write_text('# @section First\n# note\n0041 202E; Hazard:Odd; 0, 1; a=1; b="x"; # two\n; Clear; ; # none\n')
    rows = {r["line"]: r for r in delimited.read_fixtures(spark, str(tmp_path)).collect()}
    assert rows[3]["input"] == [0x41, 0x202E] and rows[3]["tag"] == "Odd" and rows[3]["positions"] == [0, 1]
    assert rows[3]["attribution"] == {"a": "1", "b": "x"} and rows[3]["section"] == "First" and rows[3]["family"] == "Demo"
    assert rows[4]["input"] == [] and rows[4]["tag"] is None and rows[4]["positions"] == []


def test_stream_counts_hazards_by_window(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, concat('a', decode(unhex('E280AE'), 'UTF-8')) AS t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = monitor.windowed_hazards(stream, "t", "ts", families=("bidiControlBalance",)).writeStream.format("memory").queryName("found").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["family"], r["n"]) for r in spark.table("found").collect()] == [("bidiControlBalance", 1)]
