import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from groveline import presets as P
from groveline.functions import hashing
from groveline.operators import sampling
from groveline.plans import campaign as plans


def _keys(df):
    return sorted(r[0] for r in df.select(P.KEY).collect())


def _u(salt, key):
    return int(hashlib.md5(f"{salt}{key}".encode()).hexdigest()[:8], 16) / 2**32


def test_hash_agrees_with_md5(spark, encoded):
    got = dict(encoded.select(P.KEY, hashing.row_uniform(P.KEY, hashing.SPLIT)).collect())
    assert got == {k: _u("split:", k) for k in got}


def test_split_is_a_partition_of_the_table(encoded):
    parts = sampling.random_split(encoded, (0.5, 0.3, 0.2), key=P.KEY)
    assert sorted(k for p in parts for k in _keys(p)) == _keys(encoded)
    shares = [p.count() / encoded.count() for p in parts]
    assert shares == pytest.approx([0.5, 0.3, 0.2], abs=0.05)


def test_hash_draws_do_not_depend_on_partitioning(encoded):
    moved = encoded.repartition(7)
    for draw in (
        lambda df: sampling.random_split(df, key=P.KEY)[0],
        lambda df: sampling.bernoulli_sample(df, 0.1, key=P.KEY),
        lambda df: sampling.stratified_sample(df, P.LABEL, {0.0: 0.5, 1.0: 1.0}, key=P.KEY),
        lambda df: sampling.with_fold(df, 3, key=P.KEY).where("fold = 1"),
    ):
        assert _keys(draw(encoded)) == _keys(draw(moved))


def test_seeded_draws_repeat(encoded):
    for draw in (
        lambda: sampling.random_split(encoded, seed=3)[1],
        lambda: sampling.bernoulli_sample(encoded, 0.1, seed=3),
        lambda: sampling.stratified_sample(encoded, P.LABEL, {0: 0.5, 1: 1.0}, seed=3),
    ):
        assert _keys(draw()) == _keys(draw())


def test_one_mode_must_be_chosen(encoded):
    with pytest.raises(ValueError):
        sampling.bernoulli_sample(encoded, 0.1)
    with pytest.raises(ValueError):
        sampling.random_split(encoded, key=P.KEY, seed=1)


def test_balance_fractions(spark, encoded):
    counts = dict(encoded.groupBy(P.LABEL).count().collect())
    fractions = sampling.balance_fractions(encoded, P.LABEL)
    assert fractions == {k: min(counts.values()) / n for k, n in counts.items()}
    balanced = dict(plans.balanced(encoded).groupBy(P.LABEL).count().collect())
    assert balanced[1.0] == counts[1.0]
    assert balanced[0.0] == pytest.approx(counts[1.0], rel=0.05)
    with pytest.raises(ValueError, match="more than 3 classes"):
        sampling.balance_fractions(encoded, "age", max_classes=3)
    assert sampling.balance_fractions(encoded.where("age < 0"), P.LABEL) == {}


def test_class_without_fraction_is_dropped(encoded):
    for mode in ({"key": P.KEY}, {"seed": 1}):
        kept = sampling.stratified_sample(encoded, P.LABEL, {1.0: 1.0}, **mode)
        assert {r[0] for r in kept.select(P.LABEL).distinct().collect()} == {1.0}
        assert kept.count() == encoded.where("deposit = 1").count()


def test_null_label_is_dropped(spark):
    df = spark.sql("select 1L as row_id, 'a' as y union all select 2L, null")
    assert sampling.balance_fractions(df, "y") == {"a": 1.0}
    assert _keys(sampling.stratified_sample(df, "y", {"a": 1.0}, key=P.KEY)) == [1]


def test_rows_with_one_key_stay_together(encoded):
    twice = encoded.unionByName(encoded)
    train, test = sampling.random_split(twice, key=P.KEY)
    assert not set(_keys(train)) & set(_keys(test))


def test_folds_are_even_and_typed(encoded):
    folded = sampling.with_fold(encoded, 3, key=P.KEY)
    assert folded.schema["fold"].dataType.simpleString() == "int"
    sizes = [n for _, n in sorted(folded.groupBy("fold").count().collect())]
    assert len(sizes) == 3 and min(sizes) > 0.28 * encoded.count()


def _layout(df, **options):
    return sampling.stable_layout(df, **options).rdd.glom().collect()


def _hot(spark):
    """Three rows in ten share a key, one in a hundred is equal in every column."""
    return spark.range(3000).selectExpr(
        "if(id % 10 < 3, 7, id) as row_id", "if(id % 100 = 0, 0, id) as x"
    )


@pytest.mark.parametrize("spread_copies", [False, True])
def test_stable_layout_depends_on_content_only(spark, encoded, spread_copies):
    for df in (encoded, _hot(spark)):
        want = _layout(df, partitions=6, spread_copies=spread_copies)
        assert len(want) == 6 and sorted(r for p in want for r in p) == sorted(df.collect())
        for moved in (df.repartition(3), df.repartition(5), df.coalesce(1)):
            assert _layout(moved, partitions=6, spread_copies=spread_copies) == want
        assert max(map(len, want)) < 2 * df.count() / 6


def test_copies_spread_when_asked(spark):
    same = spark.range(3000).selectExpr("1L as row_id", "2 as x")
    sizes = [len(p) for p in _layout(same, partitions=6, spread_copies=True)]
    assert sum(sizes) == 3000 and max(sizes) < 1000


def test_draws_are_narrow(encoded):
    train, _ = sampling.random_split(
        sampling.stratified_sample(encoded, P.LABEL, {0.0: 0.9, 1.0: 1.0}, key=P.KEY), key=P.KEY
    )
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "UDF" not in plan


def test_balance_modes(encoded):
    natural = encoded.where("deposit = 0").count() / encoded.count()

    def share(df):
        return df.where("deposit = 0").count() / df.count()

    train, test = plans.train_test(encoded, "train_only")
    assert share(train) == pytest.approx(0.5, abs=0.04)
    assert _keys(test) == _keys(plans.train_test(encoded, "none")[1])
    assert natural > 0.5
    with pytest.raises(ValueError):
        plans.train_test(encoded, "other")


def test_layout_follows_the_row_count():
    sizes = [0, 1, 25_000, 100_000, 10_000_000, 10**9]
    assert [sampling.layout_partitions(n) for n in sizes] == [1, 1, 1, 4, 400, 40_000]
    assert sampling.layout_partitions(10**9, 10**6) == 1000


def test_a_thousand_classes(spark):
    df = spark.range(20_000).selectExpr("id as row_id", "concat('c', id % 1000) as y")
    fractions = sampling.balance_fractions(df, "y")
    assert len(fractions) == 1000 and set(fractions.values()) == {1.0}
    half = {k: 0.5 if k < "c5" else 1.0 for k in fractions}
    kept = sampling.stratified_sample(df, "y", half, key="row_id")
    counts = dict(kept.groupBy(F.col("y") < "c5").count().collect())
    assert counts[False] == df.where("y >= 'c5'").count()
    assert counts[True] == pytest.approx(df.where("y < 'c5'").count() / 2, rel=0.1)


@pytest.mark.parametrize(
    "draw",
    [
        lambda df: sampling.random_split(df, key="k")[0],
        lambda df: sampling.random_split(df, key="k")[1],
        lambda df: sampling.bernoulli_sample(df, 1.0, key="k"),
        lambda df: sampling.stratified_sample(df, "y", {1: 1.0}, key="k"),
        lambda df: sampling.with_fold(df, 3, key="k"),
    ],
)
def test_a_null_key_fails(spark, draw):
    df = spark.createDataFrame([(1, 1), (2, 1), (None, 1)], "k bigint, y int")
    with pytest.raises(PySparkException, match="null in the row key k"):
        draw(df).collect()


def test_deep_trees_get_partitions_by_the_root_of_the_rows():
    sizes = [0, 1, 25_000, 50_000, 1_000_000, 100_000_000]
    assert [sampling.deep_partitions(n) for n in sizes] == [1, 1, 1, 2, 10, 100]
