"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.llm import kernels
from groveline.llm.columns import kept_table

SAMPLE = 400
DIMS = 4096
CLUSTERS = 3
ROUNDS = 10
SLACK = 0.8
_STEPS = 1 << 30


@dataclass(frozen=True)
class Model:
    """Unit centroids, the language of each and the least cosine it accepts; weights of dimensions."""

    langs: list[str]
    centres: np.ndarray
    least: np.ndarray
    idf: np.ndarray


def held_out(key: Column) -> Column:
    """Whether a document is kept for testing: crc32 of its id as text, modulo 3, is 1.

    A null id is not held out.
    """
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    labelled: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    dims: int = DIMS,
    clusters: int = CLUSTERS,
) -> Model:
    """Fit centroids on about ``sample`` rows of each language; weigh dimensions over all rows.

    The bound is on rows, for each language; it keeps the clustering small whatever the corpus.
    The share drawn follows from the number of rows of each language, over all data, and a
    hash of key, text and row number draws, so that rows with one key are drawn one by
    one. Document frequencies are counted over all rows. The
    driver receives one row per language, per dimension and per centroid. Rows without
    text, language, key or letter teach nothing; without any row the model is empty.
    """
    rows = labelled.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    ).where("key IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = np.ones(dims, dtype=np.float32)
    if not sizes:
        return Model([], np.zeros((0, dims), np.float32), np.zeros(0), idf)
    # the language decides how likely a row is drawn, the row itself whether it is
    limits = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(sample / n * _STEPS))])
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    draw = F.pmod(F.xxhash64(F.lit("language"), "key", "text", "row"), F.lit(_STEPS))
    drawn = kept_table(
        numbered.where(draw < limits[F.col("lang")]).select("lang", "text"), "language-sample"
    )
    met = (
        rows.select("text")
        .mapInPandas(kernels.document_frequencies(dims), "dim int, n bigint")
        .groupBy("dim")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    texts = sum(r["n"] for r in met if r["dim"] < 0)
    frequency = np.zeros(dims)
    for r in met:
        if r["dim"] >= 0:
            frequency[r["dim"]] = r["n"]
    idf = (np.log((1 + texts) / (1 + frequency)) + 1).astype(np.float32)
    fitted = (
        drawn.groupBy("lang")
        .applyInPandas(
            kernels.centroids(idf, clusters, ROUNDS, SLACK),
            "lang string, centre array<float>, least double",
        )
        .collect()
    )
    fitted = sorted(fitted, key=lambda r: (r["lang"], r["centre"]))
    return Model(
        [r["lang"] for r in fitted],
        np.array([r["centre"] for r in fitted], dtype=np.float32).reshape(-1, dims),
        np.array([r["least"] for r in fitted]),
        idf,
    )


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row per input row.

    The text's TF-IDF vector of hashed n-grams is compared with all centroids; the
    language of the one with the greatest cosine is predicted, and that cosine is the
    score. ``rejected`` marks texts that are further from it than its own training texts
    with some slack; a caller may read those as unknown. A null text and one without a
    letter give ``und``, score 0, rejected; so does every text if the model is empty.
    Repeated rows get equal answers. Other columns are left out.
    """
    classify = F.pandas_udf(
        kernels.nearest_centroid(model.langs, model.centres, model.least, model.idf),
        "lang string, score double, rejected boolean",
    )
    return docs.select(
        F.col(f"`{key}`").alias("doc_id"), classify(F.col(f"`{text}`")).alias("found")
    ).select(
        "doc_id",
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.rejected").alias("rejected"),
    )
