import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = registered.queries()
ORACLES = registered.oracle_sql()


@pytest.fixture(scope="module")
def medium():
    """The size at which every twin must agree."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{medium}/{table}.parquet'")
    return con


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    names = sorted(frame.columns)
    return frame[names].sort_values(names).reset_index(drop=True)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, medium, duck, name):
    ours = _sorted(QUERIES[name](spark, medium).toPandas())
    theirs = _sorted(duck.execute(ORACLES[name]).fetchdf())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, check_exact=True)


VOTES = [n for n in QUERIES if n.endswith("_votes")]
REPORTS = [n for n in QUERIES if n.split("_")[0] in ("dt", "rf", "gbt") and n not in ORACLES and n not in VOTES]
SEARCHES = [n for n in ("cv_dt", "cv_rf", "cv_gbt") if n in QUERIES]
TUNED = ["best_model_summary", "score_tuned", "auc_tuned"]


@pytest.mark.parametrize("name", REPORTS)
def test_report_of_a_model(spark, small, name):
    rows = QUERIES[name](spark, small).collect()
    assert len(rows) == 5 + 3 * 2
    assert all(0 <= r.value <= 1 for r in rows)
    value = {(r.metric, r.label): r.value for r in rows}
    # guessing is right half of the time
    assert value["accuracy", None] == value["f1_micro", None] > 0.6
    assert min(value[m, y] for m in ("precision", "recall") for y in (0.0, 1.0)) > 0.3


@pytest.mark.parametrize("name", VOTES)
def test_votes_make_the_prediction(spark, small, name):
    """That they equal the model's own is tested beside ``rules``."""
    rows = QUERIES[name](spark, small).collect()
    assert rows and len({len(r.votes) for r in rows}) == 1
    for r in rows:
        assert r.raw[1] == pytest.approx(sum(r.votes)) and sum(r.raw) == pytest.approx(len(r.votes))
        assert r.prediction == float(r.raw[1] > r.raw[0])


@pytest.mark.parametrize("name", SEARCHES)
def test_search_chooses_the_best_depth(spark, small, name):
    rows = sorted(QUERIES[name](spark, small).collect())
    assert [r.max_depth for r in rows] == list(range(2, 13))
    assert all(0.5 < r.avg_auc <= 1 for r in rows)
    best = max(r.avg_auc for r in rows)
    assert [r.max_depth for r in rows if r.chosen] == [r.max_depth for r in rows if r.avg_auc == best][:1]


def test_the_tuned_model(spark, small):
    summary, scored, auc = (QUERIES[n](spark, small).collect() for n in TUNED)
    assert 2 <= summary[0].depth <= 12 and summary[0].num_trees == 1
    assert len({r.row_id for r in scored}) == len(scored)
    assert {r.prediction for r in scored} == {0.0, 1.0}
    rates = []
    for y in (0.0, 1.0):
        own = [r for r in scored if r.deposit == y]
        rates.append(sum(r.prediction == y for r in own) / len(own))
    assert auc[0].auc > 0.7
    assert auc[0].auc == pytest.approx(sum(rates) / 2, abs=1e-12)


LEFT = sorted(set(QUERIES) - set(ORACLES) - set(REPORTS) - set(VOTES) - set(SEARCHES) - set(TUNED))


@pytest.mark.parametrize("name", LEFT)
def test_query_of_the_corpus_gives_rows(spark, small, name):
    """What these hold is tested beside their operators."""
    assert name.startswith("op") or name == "pipeline"
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert len(rows) == 4
