import re
from collections import Counter

from groveline.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    met = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if met[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts_equal_plain_python(spark, edge, edge_rows):
    texts = [r[1] for r in edge_rows] + ["a b c d e a b c d e f", "x x x x x x x", "l\nl\n\n l\nl"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in quality.quality(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert len(quality.quality(edge).collect()) == len(edge_rows)


def test_junk_goes_and_prose_stays(corpus, spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    judged = quality.quality(corpus).join(labels, "doc_id").collect()
    for row in judged:
        if row["quality"] == 0:
            assert not row["kept"], row
        elif not row["base_failed"]:
            assert row["kept"], row


def test_rules_are_compiled_from_the_table(edge):
    rules = (quality.Rule("n_words", low=3, high=3), quality.Rule("n_symbols", high=0))
    kept = [r["doc_id"] for r in quality.quality(edge, rules).collect() if not r["failed"]]
    assert kept == [7]


def test_keep_good_returns_whole_rows(edge, empty):
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    assert ids == [1, 2, 2]  # shouted text has no stop word
    assert kept.first()["row"] == "extra row"
    assert len(quality.keep_good(empty).collect()) == 0


def test_plan_has_no_python_and_no_exchange(edge):
    plan = quality.quality(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
