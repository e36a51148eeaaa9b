import subprocess
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from groveline import presets as P
from groveline.functions import batches
from groveline.operators import columns, profile


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [
            (1, 2**60 + 1, 1.5, "b", "7", None, None),
            (2, 2**60 + 3, None, "a", "x", None, None),
            (4, 5, -2.5, None, " 3 ", None, None),
        ],
        "i int, big bigint, d double, s string, t string, none int, flag boolean",
    )


def test_describe_agrees_with_spark(mixed):
    want = {}
    told = mixed.describe().collect()
    for row in told:
        for name, value in row.asDict().items():
            want.setdefault(name, {})[row.summary] = value
    got = {r["column"]: r for r in profile.describe(mixed).collect()}
    assert set(got) == {"i", "big", "d", "s", "t", "none"}
    for name, row in got.items():
        assert row["count"] == int(want[name]["count"]), name
        for ours, theirs in (("mean", "mean"), ("stddev", "stddev")):
            expected = want[name][theirs]
            if expected is None:
                assert row[ours] is None, name
            else:
                assert row[ours] == pytest.approx(float(expected)), name
        assert (row.min_text, row.max_text) == (want[name]["min"], want[name]["max"]), name


def test_describe_keeps_large_integers_exact(mixed):
    row = profile.describe(mixed, ["big"]).first()
    assert (row.min_text, row.max_text) == ("5", str(2**60 + 3))


def test_describe_of_an_empty_table(mixed):
    rows = profile.describe(mixed.where("false")).collect()
    assert len(rows) == 6
    assert all(r["count"] == 0 and r["mean"] is None and r.min_text is None for r in rows)


def test_describe_needs_a_column(mixed):
    with pytest.raises(ValueError):
        profile.describe(mixed.select("flag"))


def test_class_counts(encoded, raw):
    assert {r[0]: r[1] for r in profile.class_counts(raw, P.LABEL).collect()} == {
        "no": 785,
        "yes": 715,
    }
    assert {r[0]: r[1] for r in profile.class_counts(encoded, P.LABEL).collect()} == {
        0.0: 785,
        1.0: 715,
    }


def test_corr_agrees_with_spark(spark, encoded, small):
    lineitem = columns.select_numeric(spark.read.parquet(f"{small}/lineitem.parquet"))
    for df in (encoded.select("age", "duration", "deposit", "balance"), lineitem.repartition(5)):
        got = profile.corr_pairs(df).collect()
        assert len(got) == len(df.columns) * (len(df.columns) - 1) // 2
        want = df.agg(*[F.corr(r.left, r.right) for r in got]).first()
        assert [r["corr"] for r in got] == pytest.approx(list(want), abs=1e-12)


def test_corr_leaves_out_nulls_and_constants(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 7.1, 1e9), (2.0, None, 7.1, 1e9 + 1), (3.0, 5.0, 7.1, 1e9 + 3),
         (4.0, 1.0, 7.1, 1e9 + 2), (None, 4.0, 7.1, 1e9)],
        "a double, b double, c double, far double",
    )
    got = {(r.left, r.right): r["corr"] for r in profile.corr_pairs(df).collect()}
    assert got["a", "b"] == pytest.approx(df.select(F.corr("a", "b")).first()[0])
    assert got["b", "far"] == pytest.approx(df.select(F.corr("b", "far")).first()[0])
    assert got["a", "c"] is None and got["c", "far"] is None


def test_corr_of_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert all(r["corr"] is None for r in profile.corr_pairs(df).collect())


def test_hist_1d_counts_every_value_once(encoded):
    rows = profile.hist_1d(encoded, ["age", "duration"]).collect()
    for name in ("age", "duration"):
        own = [r for r in rows if r["column"] == name]
        assert sum(r.n for r in own) == encoded.count()
        for r in own:
            closed = F.col(name) <= r.upper if r.bin == 9 else F.col(name) < r.upper
            assert encoded.where((F.col(name) >= r.lower) & closed).count() == r.n


def test_hist_of_constant_and_missing_values(spark):
    df = spark.createDataFrame([(3, None, 1), (3, None, None)], "a int, b int, c int")
    rows = {(r["column"], r.bin): (r.lower, r.upper, r.n) for r in profile.hist_1d(df).collect()}
    assert rows == {("a", 5): (3.0, pytest.approx(3.1), 2), ("c", 5): (1.0, pytest.approx(1.1), 1)}
    cells = profile.hist_2d(df).collect()
    assert [(r.left, r.right, r.left_bin, r.right_bin, r.n) for r in cells] == [("a", "c", 5, 5, 1)]


def test_hist_2d_margins_are_hist_1d(encoded):
    names = ["age", "duration", "deposit"]
    one = {(r["column"], r.bin): r.n for r in profile.hist_1d(encoded, names).collect()}
    joint = profile.hist_2d(encoded.repartition(6), names)
    left = joint.groupBy("left", "right", "left_bin").agg(F.sum("n").alias("n")).collect()
    for r in left:
        assert one[r.left, r.left_bin] == r.n
    assert {(r.left, r.right) for r in left} == {
        ("age", "duration"), ("age", "deposit"), ("duration", "deposit")
    }


def test_tiles_of_a_wide_table_hold_every_pair_once(spark):
    tiles = profile._tiles(500, 40_000)
    pairs = [(a, b) for runs in tiles for a, first, stop in runs for b in range(first, stop)]
    assert pairs == [(a, b) for a in range(500) for b in range(a + 1, 500)]
    assert len(tiles) == 4 and all(sum(stop - first for _, first, stop in t) <= 40_000 for t in tiles)
    # 500 columns in several passes; every pair holds every row
    wide = spark.range(60).select([((F.col("id") * (i + 3)) % (11 + i % 5)).alias(f"c{i}") for i in range(500)])
    cells = profile.hist_2d(wide, wide.columns, most_cells=4_000_000)
    found = cells.groupBy("left", "right").agg(F.sum("n").alias("n")).agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(found) == (500 * 499 // 2, 60, 60)


def test_tiles_give_what_one_pass_gives(spark, encoded):
    names = ["age", "duration", "deposit", "balance", "job"]
    holes = encoded.withColumn("age", F.when(F.col("age") % 3 > 0, F.col("age")))
    whole = sorted(map(tuple, profile.hist_2d(holes, names).collect()))
    assert sorted(map(tuple, profile.hist_2d(holes, names, most_cells=300).collect())) == whole
    joint = holes.where("age IS NOT NULL").count()
    assert sum(r[4] for r in whole if r[:2] == ("age", "job")) == joint


def test_values_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1.0, 1.0, nan), (2.0, 5.0, inf), (3.0, 2.0, nan), (nan, 4.0, None), (-inf, None, None)],
        "a double, b double, c double",
    )
    rows = {(r["column"], r.bin): (r.lower, r.n) for r in profile.hist_1d(df, bins=2).collect()}
    assert rows == {
        ("a", 0): (1.0, 1), ("a", 1): (2.0, 2), ("a", None): (None, 2),
        ("b", 0): (1.0, 2), ("b", 1): (3.0, 2), ("c", None): (None, 3),
    }
    cells = {(r.left, r.right, r.left_bin, r.right_bin): r.n for r in profile.hist_2d(df, bins=2).collect()}
    assert cells == {("a", "b", 0, 0): 1, ("a", "b", 1, 1): 1, ("a", "b", 1, 0): 1}
    corr = {(r.left, r.right): r["corr"] for r in profile.corr_pairs(df).collect()}
    assert all(v != v for v in corr.values()) and len(corr) == 3


def test_tables_without_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    for made in (profile.hist_1d(df), profile.hist_2d(df), profile.corr_pairs(df)):
        assert made.collect() == []
    assert profile.hist_2d(spark.createDataFrame([(1.0,)], "a double")).collect() == []


def test_many_columns_take_seconds(spark):
    wide = spark.range(20).select([(F.col("id") * (i % 7 + 1) + i).alias(f"c{i}") for i in range(300)])
    start = time.time()
    assert profile.hist_1d(wide, wide.columns).agg(F.sum("n")).first()[0] == 6000
    assert len(profile.describe(wide.select([F.col(c).cast("int") for c in wide.columns])).collect()) == 300
    assert time.time() - start < 60


def test_task_code_travels_by_value():
    code = cloudpickle.dumps((batches.pair_cells([(0, 1, 3), (1, 2, 3)], [0, 1, 2], 10), batches.pair_moments))
    # a worker without this package
    run = "import pickle, sys; print(len(pickle.load(sys.stdin.buffer)))"
    done = subprocess.run([sys.executable, "-c", run], input=code, capture_output=True, cwd="/")
    assert done.stdout.strip() == b"2", done.stderr
