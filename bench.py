"""Time the headline work and print one JSON line.

BENCH_SF_DIR   tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_FULL=1   also the depth searches of the two ensembles
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groveline import presets as P
from groveline.operators import columns, evaluate, models, profile
from groveline.plans import campaign as plans
from groveline.sources.campaign import campaign
from groveline.sources.scratch import fresh_path, remove

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FULL = os.environ.get("BENCH_FULL") == "1"


def _drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def _seconds(work: Callable[[], object], runs: int) -> float:
    """The best of a few runs: the first one also pays for compiling the plan."""
    best = float("inf")
    for _ in range(runs):
        start = time.perf_counter()
        work()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the campaign table as it would be stored; deriving it from orders is not timed
    stored = fresh_path(spark, "campaign")
    campaign(spark, SF_DIR).repartition(int(CPUS)).write.parquet(stored)
    raw = spark.read.parquet(stored)
    rows = raw.count()
    encoded = columns.encode_campaign(raw)
    names = [*P.FEATURES, P.LABEL]

    def fit(kind: str, preset: dict, nominal=None):
        return lambda: plans.train_and_score(encoded, kind, preset[kind], nominal=nominal)

    model, scored = plans.train_and_score(encoded, "dt", models.DEFAULT["dt"])
    everything = models.score(model, encoded)
    counts = evaluate.confusion_counts(scored, P.LABEL)
    train, _ = plans.train_test(encoded, "before_split")

    short = {
        "encode_all": lambda: _drain(encoded),
        "class_counts": lambda: profile.class_counts(raw, P.LABEL).collect(),
        "describe_raw": lambda: profile.describe(raw, P.CAMPAIGN_COLUMNS).collect(),
        "describe_encoded": lambda: profile.describe(encoded, names).collect(),
        "corr_pairs": lambda: profile.corr_pairs(encoded, names).collect(),
        "hist_1d": lambda: profile.hist_1d(encoded, names).collect(),
        "hist_2d": lambda: profile.hist_2d(encoded, names).collect(),
        "stratify_and_split": lambda: _drain(train),
        "dt_depth2": fit("dt", models.SHALLOW, P.NOMINAL),
        "rf_depth2": fit("rf", models.SHALLOW),
        "gbt_iter3": fit("gbt", models.SHALLOW),
        "dt_default": fit("dt", models.DEFAULT),
        "rf_10": fit("rf", models.DEFAULT),
        "gbt_10": fit("gbt", models.DEFAULT),
        "score": lambda: _drain(everything.select(P.KEY, "prediction", "probability")),
        "metric_report": lambda: evaluate.metric_report(counts).collect(),
        "auc_score": lambda: evaluate.auc_score(scored, P.LABEL),
    }
    searches = ["cv_dt"] + (["cv_rf", "cv_gbt"] if FULL else [])
    seconds = {name: _seconds(work, 2) for name, work in short.items()}
    for name in searches:
        kind = name.removeprefix("cv_")
        seconds[name] = _seconds(
            lambda kind=kind: plans.search(encoded, kind, models.DEFAULT[kind], parallelism=8), 1
        )
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "rows_per_sec": {n: round(rows / s) for n, s in seconds.items()},
                "cores": int(CPUS),
            }
        )
    )
    remove(spark, stored)
    spark.stop()


if __name__ == "__main__":
    main()
