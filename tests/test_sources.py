import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from groveline import presets as P
from groveline.operators.persist import materialised
from groveline.sources import scratch
from groveline.sources.csv import read_csv


@pytest.fixture(scope="module")
def csv_path(spark, raw):
    path = scratch.fresh_path(spark, "csv")
    raw.write.option("header", True).csv(path)
    return path


def _same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_declared_schema_round_trip(spark, raw, csv_path):
    back = read_csv(spark, csv_path, P.KEYED_CAMPAIGN_SCHEMA)
    assert back.schema == P.KEYED_CAMPAIGN_SCHEMA
    assert _same(back, raw)


def test_inferred_schema_round_trip(spark, raw, csv_path):
    back = read_csv(spark, csv_path)
    assert back.schema[P.KEY].dataType.simpleString() == "int"
    assert _same(back.withColumn(P.KEY, F.col(P.KEY).cast("bigint")), raw)


def test_malformed_value_fails_unless_allowed(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\nx,3\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_csv(spark, str(tmp_path), "a int, b int").collect()
    lax = read_csv(spark, str(tmp_path), "a int, b int", mode="PERMISSIVE").collect()
    assert sorted(lax, key=lambda r: r.b) == [(1, 2), (None, 3)]


def test_wrong_header_fails(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a\n1,2\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_csv(spark, str(tmp_path), "a int, b int").collect()


def test_separator(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;2\n")
    assert read_csv(spark, str(tmp_path), "a int, b int", sep=";").collect() == [(1, 2)]


def test_shared_dir_is_the_named_one(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch.shared_dir(spark) == named
    assert scratch.fresh_path(spark, "a") != scratch.fresh_path(spark, "a")


def test_remove_takes_only_what_is_in_the_shared_folder(spark, tmp_path):
    path = scratch.fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    scratch.remove(spark, path)
    with pytest.raises(PySparkException):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        scratch.remove(spark, str(tmp_path))


def test_materialised(raw):
    with materialised(raw.select(P.KEY)) as kept:
        assert kept.is_cached and kept.count() == raw.count()
    assert not kept.is_cached
    with materialised(raw.select(P.KEY), "checkpoint") as kept:
        assert _same(kept, raw.select(P.KEY))
        assert "Scan ExistingRDD" in kept._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        with materialised(raw, "other"):
            pass


def test_large_keys_do_not_overflow(spark, tmp_path):
    from groveline.sources.campaign import campaign

    key = 9_000_000_000_000_000_000
    spark.sql(
        f"select {key}L as o_orderkey, 'O' as o_orderstatus, 1.0D as o_totalprice,"
        " timestamp_ntz'2020-02-03 00:00:00' as o_orderdate, '1-URGENT' as o_orderpriority"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    row = campaign(spark, str(tmp_path)).first()
    assert row.age == 18 + (key + 1) * 1226874159 % 2147483647 % 1000003 % 70
    assert (row.month, row.day) == ("feb", 3)
