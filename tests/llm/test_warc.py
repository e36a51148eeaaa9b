import base64
import gzip
import hashlib
import os

from groveline.llm import warc, warcfiles

PAGES = [
    (5, "http://a/1", "<p>same</p>"),
    (3, "http://a/2", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (3, "http://a/2", "<p>same</p>"),
    (None, "http://a/n", "<p>same</p>"),
    (None, "http://a/n", "alone"),
    (1, "http://a/b c\r\nX: y", "<p>é€😀</p>" * 400),
    (2, "", ""),
    (4, "u", None),
    (2**62, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (6, "u", "x" * 300_000),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(pages):
    first = {}
    for key, _, html in pages:
        if key is not None:
            at = digest(html)
            first[at] = min(key, first.get(at, key))
    out = []
    for key, _, html in pages:
        holder = first.get(digest(html))
        n = len((html or "").encode())
        if holder is None or holder == key:
            out.append((key, n, digest(html), "response", None))
        else:
            out.append((key, n, digest(html), "revisit", holder))
    return sorted(out, key=repr)


def table(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def test_round_trip(spark):
    got = [tuple(r) for r in warc.round_trip(table(spark)).collect()]
    assert sorted(got, key=repr) == brute(PAGES)


def test_ranges_own_the_records_that_start_in_them(spark):
    files = warc.write_archives(table(spark).coalesce(1))
    whole = {(r["page_id"], r["place"], r["digest"]) for r in warc.read_archives(files).collect()}
    assert len(whole) == len(PAGES)
    for size in (7, 64, 500, 5000):
        rows = warc.read_archives(files, range_bytes=size).collect()
        assert len(rows) == len(PAGES)
        assert {(r["page_id"], r["place"], r["digest"]) for r in rows} == whole


def test_files_are_plain_gzip_and_roll(spark):
    files = warc.write_archives(table(spark).coalesce(1), file_bytes=2000).collect()
    assert len(files) > 1 and sum(f["records"] for f in files) == len(PAGES)
    for f in files:
        path = f["path"].removeprefix("file:")
        data = gzip.open(path).read()
        assert data.startswith(b"WARC/1.1\r\n") and os.path.getsize(path) == f["bytes"]


def test_false_magic_is_passed_over(tmp_path):
    member = warcfiles._record("response", "7", "u", None, b"body", warc.DATE)
    other = gzip.compress(b"not a record at all, but a member of gzip")
    noise = b"\x1f\x8b\x08" + bytes(range(256))
    path = tmp_path / "noisy.warc.gz"
    path.write_bytes(noise + member + other + b"\x1f\x8b" + member + noise[:3])
    places = [p for p, _, _ in warcfiles.records_of(str(path), 0, path.stat().st_size)]
    assert places == [len(noise), len(noise) + len(member) + len(other) + 2]


def test_short_payloads_are_all_responses(spark):
    rows = warc.round_trip(table(spark), least_bytes=12).collect()
    assert {r["record_type"] for r in rows} == {"response"}


def test_empty_table_and_extra_columns(spark):
    assert warc.round_trip(table(spark, PAGES[:0])).collect() == []
    from pyspark.sql import functions as F

    extra = table(spark).withColumns({c: F.lit(1) for c in ("sha1", "n", "first_id", "record_type", "refers_to")})
    assert warc.round_trip(extra).count() == len(PAGES)


def test_reading_tasks_follow_the_ranges(spark):
    files = warc.write_archives(table(spark).coalesce(1))
    size = files.first()["bytes"]
    for n in (1, 24, 172):
        step = -(-size // n)
        read = warc.read_archives(files, range_bytes=step)
        ranges = -(-size // step)
        assert read.rdd.getNumPartitions() == ranges
        assert read.count() == len(PAGES)


def test_a_hot_payload_is_met_by_broadcast(spark):
    pages = [(i, f"http://h/{i}", "<p>everywhere</p>" if i % 3 else f"<p>{i // 6}</p>") for i in range(4500)]
    got = [tuple(r) for r in warc.round_trip(table(spark, pages)).collect()]
    assert sorted(got, key=repr) == brute(pages)
