import math
import zlib
from collections import Counter

import pytest

from groveline.llm import kernels, language


@pytest.fixture(scope="module")
def fitted(corpus):
    return language.train(corpus.where(~language.held_out(corpus["doc_id"])))


def test_held_out_accuracy(corpus, fitted):
    rows = language.predict(corpus, fitted).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(unseen) > 40
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) >= 0.98 * len(unseen)
    assert all(0 < r["score"] <= 1 for r in rows)


def test_held_out_follows_the_id(spark):
    docs = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id bigint")
    got = {r[0]: r[1] for r in docs.select("doc_id", language.held_out(docs["doc_id"])).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)} | {None: False}


def test_texts_without_letters(spark, fitted, edge, edge_rows):
    rows = language.predict(edge, fitted).collect()
    assert len(rows) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[3]["lang_pred"], by_id[3]["score"], by_id[3]["rejected"]) == ("und", 0.0, True)
    assert by_id[4]["lang_pred"] == by_id[5]["lang_pred"] == "und"
    assert by_id[1]["lang_pred"] == by_id[2]["lang_pred"] == "en"
    digits = spark.createDataFrame([(1, "123 %% 4.5"), (2, "x")], "doc_id int, text string")
    assert [r["lang_pred"] == "und" for r in language.predict(digits, fitted).orderBy("doc_id").collect()] == [True, False]


def test_several_centroids_per_language_and_rejection(spark, fitted):
    assert len(fitted.langs) > len(set(fitted.langs))
    odd = spark.createDataFrame([(1, "щгж цфы " * 40)], "doc_id int, text string")
    assert language.predict(odd, fitted).first()["rejected"]


def test_nothing_to_learn_from(edge, empty, fitted):
    model = language.train(edge.where("lang IS NULL"))
    assert model.langs == []
    assert {r["lang_pred"] for r in language.predict(edge, model).collect()} == {"und"}
    assert language.predict(empty, fitted).collect() == []


def test_ngram_counts_are_whole():
    counts = kernels.ngram_counts("Ab-c", 4096)
    # blank A b blank c blank: six, five and four runs
    assert counts.sum() == 6 + 5 + 4
    assert (counts == kernels.ngram_counts("  aB  C.", 4096)).all()


def plain_grams(text):
    """Counts of 1- to 3-grams of letters, other characters as single blanks, blanks at both ends."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    codes = [0] + [ord(c) if c != " " else 0 for c in " ".join(letters.split())] + [0]
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            key = 0
            for c in codes[i : i + n]:
                key = (key * 0x110001 + c) % 2**64
            found[(key * 0x9E3779B97F4A7C15 % 2**64 >> 33) % language.DIMS] += 1
    return found


def test_predictions_equal_a_plain_nearest_centroid(corpus, fitted):
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    for r in language.predict(corpus, fitted).collect():
        weights = {d: math.log1p(n) * float(fitted.idf[d]) for d, n in plain_grams(texts[r["doc_id"]]).items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * float(c[d]) for d, w in weights.items()) / length for c in fitted.centres]
        best = max(cosines)
        near = [i for i, c in enumerate(cosines) if c > best - 1e-6]
        assert r["lang_pred"] in {fitted.langs[i] for i in near}
        assert r["score"] == pytest.approx(best, abs=1e-5)
        assert r["rejected"] in {r["score"] < fitted.least[i] for i in near}


def test_weights_count_all_training_rows(corpus, fitted):
    texts = [
        r["text"] for r in corpus.collect()
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None
    ]
    met = Counter(d for t in texts for d in plain_grams(t))
    want = [math.log((1 + len(texts)) / (1 + met[d])) + 1 for d in range(language.DIMS)]
    assert fitted.idf.tolist() == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("key", [2, 3, 4, 7])
def test_one_key_for_all_rows_learns_every_language(spark, key):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.withColumn("doc_id", F.lit(key)), sample=40)
    assert set(model.langs) == {r[0] for r in docs.select("lang").distinct().collect() if r[0]}
