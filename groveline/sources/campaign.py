"""The campaign table, derived row by row from ``orders``.

One order gives one campaign contact. Everything is integer arithmetic on the
order key and a few order columns, so any engine computes the same rows, and the
table grows with ``orders``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline import presets as P

_PRIME = 2147483647
_FOLD = 1000003

# One multiplier per derived column.
MULTIPLIER = {
    "age": 1226874159,
    "job": 742938285,
    "marital": 1343714438,
    "education": 950706376,
    "default": 2027812808,
    "contact": 1323257245,
    "duration": 764261123,
    "campaign": 1078318381,
    "pdays": 1203248318,
    "previous": 397204094,
    "poutcome": 2007237709,
    "noise": 1511192140,
    "flip": 1809766067,
}


def _draw(name: str, n: int) -> Column:
    # reducing the key first keeps the product inside a bigint for any key
    key = (F.col("o_orderkey") + 1) % _PRIME
    return ((key * MULTIPLIER[name]) % _PRIME) % _FOLD % n


def _nth(values: list[str], position: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), position)


def _pick(name: str, values: list[str]) -> Column:
    return _nth(values, _draw(name, len(values)).cast("int"))


def _yes(condition: Column) -> Column:
    return F.when(condition, "yes").otherwise("no")


def campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id`` plus the 17 campaign columns, label last."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    duration = _draw("duration", 1500)
    open_order = F.col("o_orderstatus") == "O"
    label = (
        F.when(_draw("noise", 10) == 0, _yes(_draw("flip", 2) == 0))
        .when(duration >= 900, "yes")
        .otherwise(_yes(~open_order & (F.col("o_totalprice") > 400000)))
    )
    columns = {
        "age": (_draw("age", 70) + 18).cast("int"),
        "job": _pick("job", P.JOB),
        "marital": _pick("marital", P.MARITAL),
        "education": _pick("education", P.EDUCATION),
        "default": _pick("default", P.YES_NO),
        "balance": F.floor(F.col("o_totalprice") / 100).cast("int"),
        "housing": _yes(open_order),
        "loan": _yes(F.col("o_orderpriority") == "1-URGENT"),
        "contact": _pick("contact", P.CONTACT),
        "day": F.dayofmonth("o_orderdate"),
        "month": _nth(P.MONTH, F.month("o_orderdate") - 1),
        "duration": duration.cast("int"),
        "campaign": (_draw("campaign", 8) + 1).cast("int"),
        "pdays": (_draw("pdays", 400) - 1).cast("int"),
        "previous": _draw("previous", 6).cast("int"),
        "poutcome": _pick("poutcome", P.POUTCOME),
        "deposit": label,
    }
    return orders.select(
        F.col("o_orderkey").alias(P.KEY), *[columns[c].alias(c) for c in P.CAMPAIGN_COLUMNS]
    )
