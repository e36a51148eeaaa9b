import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from groveline import presets as P
from groveline.functions.codes import encode
from groveline.operators import columns
from groveline.sources.csv import read_csv


@pytest.fixture(scope="module")
def csv_file(raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("csv") / "campaign")
    raw.write.option("header", True).csv(path)
    return path


def _words(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def test_every_category_gets_its_position(spark):
    for name, values in P.CATEGORIES.items():
        got = _words(spark, *values).select("word", encode("word", P.codes(values)).alias("code"))
        assert dict(got.collect()) == {v: float(i) for i, v in enumerate(values)}, name


def test_codes_written_out(spark, encoded, raw):
    """Some codes as literals, so that a wrong list of categories shows."""
    codes = {
        ("month", "jan"): 0.0, ("month", "dec"): 11.0, ("poutcome", "failure"): 0.0,
        ("poutcome", "other"): 2.0, ("poutcome", "unknown"): 3.0, ("job", "admin."): 0.0,
        ("job", "unemployed"): 10.0, ("job", "unknown"): 11.0, ("marital", "divorced"): 0.0,
        ("education", "tertiary"): 2.0, ("contact", "telephone"): 1.0, ("deposit", "yes"): 1.0,
    }
    for (name, word), code in codes.items():
        row = raw.where(F.col(name) == word).join(encoded.select(P.KEY, F.col(name).alias("code")), P.KEY)
        assert {r.code for r in row.select("code").distinct().collect()} == {code}, (name, word)


@pytest.mark.parametrize("word,shown", [("x", "unmapped x"), (None, "unmapped NULL")])
def test_strict_encoding_fails_on_what_the_map_lacks(spark, word, shown):
    df = _words(spark, "yes", word).select(encode("word", P.codes(P.YES_NO)))
    with pytest.raises(PySparkException, match=shown):
        df.collect()


def test_lenient_encoding_gives_null(spark):
    df = _words(spark, "yes", "x", None).select(encode("word", P.codes(P.YES_NO), strict=False))
    assert [r[0] for r in df.collect()] == [1.0, None, None]


def test_encoding_keeps_the_column_order_and_drops_one(raw, encoded):
    assert encoded.columns == [c for c in raw.columns if c != P.UNUSED]
    assert encoded.columns[-1] == P.LABEL
    assert {f.name for f in encoded.schema if f.dataType.simpleString() == "double"} == set(
        P.CATEGORIES
    )


def test_encoding_is_native_and_one_projection(spark, csv_file):
    table = read_csv(spark, csv_file, P.KEYED_CAMPAIGN_SCHEMA)
    plan = columns.encode_campaign(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan.upper()
    assert plan.count("Project") == 1


def test_label_declares_its_classes(encoded):
    assert encoded.schema[P.LABEL].metadata["ml_attr"]["vals"] == P.YES_NO


def test_numeric_columns_strict_and_wide(spark):
    df = spark.sql(
        "select 1 as i, 2L as l, 1.5D as d, cast(1 as float) as f, 1.25 as m, 'a' as s, true as b"
    )
    assert columns.numeric_columns(df) == ["i", "d"]
    assert columns.numeric_columns(df, widen=True) == ["i", "l", "d", "f", "m"]


def test_preview_is_the_same_after_repartitioning(raw):
    want = [r[P.KEY] for r in columns.preview(raw, 5, P.KEY).collect()]
    got = [r[P.KEY] for r in columns.preview(raw.repartition(7), 5, P.KEY).collect()]
    assert got == want and len(want) == 5
    plan = columns.preview(raw, 5, P.KEY)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert columns.preview(raw, 5).count() == 5


def test_to_local_refuses_rather_than_cuts(raw):
    assert len(columns.to_local(columns.preview(raw, 5, P.KEY), 5)) == 5
    with pytest.raises(ValueError, match="more than 4"):
        columns.to_local(columns.preview(raw, 5, P.KEY), 4)


def test_schema_profile_counts_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "a int, b string")
    rows = {r["column"]: r for r in columns.schema_profile(df).collect()}
    assert (rows["b"].type, rows["b"].n_values, rows["b"].n_nulls) == ("string", 1, 1)
    assert rows["a"].n_nulls == 0
    assert columns.schema_rows(df) == [(0, "a", "int", True), (1, "b", "string", True)]


def test_map_on_another_table(spark, small):
    customer = spark.read.parquet(f"{small}/customer.parquet")
    segments = sorted(r[0] for r in customer.select("c_mktsegment").distinct().collect())
    coded = columns.encode_columns(customer, {"c_mktsegment": segments})
    want = customer.groupBy("c_mktsegment").count().collect()
    got = dict(coded.groupBy("c_mktsegment").count().collect())
    assert got == {float(segments.index(s)): n for s, n in want}


def test_only_the_columns_used_are_read(spark, csv_file):
    table = read_csv(spark, csv_file, P.KEYED_CAMPAIGN_SCHEMA)
    counted = columns.encode_campaign(table).groupBy("housing").agg(F.count(F.lit(1)).alias("n"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<housing:string>" in plan
