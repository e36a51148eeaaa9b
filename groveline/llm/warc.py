"""Web archives: pages to gzipped records, and a splittable reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.llm import warcfiles
from groveline.llm.columns import kept_table, left_join_hot
from groveline.sources.scratch import fresh_path

DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 1 << 30
RANGE_BYTES = 16 << 20
# Reading tasks at most; beyond them a task reads several ranges.
MOST_TASKS = 50_000
# The base32 alphabet.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """Hex digits, a multiple of five of them, in base32: each five are four letters."""
    def five(i: Column) -> Column:
        return F.conv(F.substring(hexadecimal, i * 5 + 1, F.lit(5)), 16, 10).cast("int")

    def letters(bits: Column) -> Column:
        return F.concat(
            *[F.substring(F.lit(_BASE32), F.shiftright(bits, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
        )

    n = (F.length(hexadecimal) / 5).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: letters(five(i))), "")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, record_type, refers_to): which page holds a payload, which refer to it.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the
    smallest page_id is the response and the others revisit it; rows that repeat that
    page_id with that payload are responses too. A null html is an empty payload. A
    null page_id is never the smallest; where all are null, all are responses.
    """
    html = F.coalesce("html", F.lit(""))
    body = pages.select(
        "page_id", "url", html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("n")
    )
    # one row per payload that stands more than once; a hot payload is a partial aggregate
    first = kept_table(
        body.where(F.col("n") >= least_bytes)
        .groupBy("sha1")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("first_id"))
        .where("copies > 1 AND first_id IS NOT NULL")
        .select("sha1", "copies", "first_id"),
        "payloads",
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    # a payload with a large share of all rows meets its first page by broadcast
    total = first.agg(F.sum("copies")).first()[0] or 0
    return left_join_hot(body, first, "sha1", "copies", total).select(
        "page_id",
        "url",
        "html",
        F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"),
        refers.alias("refers_to"),
    )


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    *,
    least_bytes: int = 0,
    date: str = DATE,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per page row; gives (path, bytes, records) of the files.

    Each task writes files of its own to the shared folder and each record is a gzip
    member. The list of files is written too, so the archives are those on it, whatever
    tasks had to run twice. Folders are reached through Arrow's file systems.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    store, inner = warcfiles.file_system(folder)
    store.create_dir(inner)
    rows = with_revisits(pages, least_bytes).withColumns(
        # ids travel as text: a column of numbers with nulls would turn into floats
        {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    )
    written = rows.mapInPandas(
        warcfiles.archive_writer(folder, date, file_bytes), "path string, bytes bigint, records bigint"
    )
    return kept_table(written, "warc-files")


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of archives (path, bytes), read in byte ranges.

    (path, place, record_type, page_id, url, refers_to, digest, payload), with ids as
    text and the payload of responses. A file is cut into ranges of ``range_bytes``. A
    task looks for gzip magic in its ranges, of which there is one a task up to ``MOST_TASKS``, takes a place as a record if its decoded
    bytes are a record's header, and owns the records that start in the range, to their
    end. A digest that does not fit its payload fails the job.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    ranges = files.where("bytes > 0").select("path", F.explode(starts).alias("start"))
    cut = ranges.withColumn("stop", F.col("start") + range_bytes)
    # a range's row is small whatever it stands for, so the number of tasks is said: adaptive
    # execution would merge them by the bytes of those rows
    n = files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    spread = cut.repartition(min(int(n), MOST_TASKS))
    return spread.mapInPandas(
        warcfiles.archive_reader(),
        "path string, place bigint, record_type string, page_id string, url string,"
        " refers_to string, digest string, payload binary",
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives read back.

    A revisit's payload is that of the response it refers to. Repeated rows are records
    of their own; an empty table gives no row; other columns are left out.
    """
    files = write_archives(pages, least_bytes=least_bytes)
    kind = pages.schema["page_id"].dataType.simpleString()
    read = kept_table(
        read_archives(files).select(
            F.col("page_id").cast(kind).alias("page_id"),
            "record_type",
            F.col("refers_to").cast(kind).alias("refers_to"),
            "digest",
            F.octet_length("payload").cast("bigint").alias("own_bytes"),
            F.when(F.col("payload").isNotNull(), base32(F.sha1("payload"))).alias("own_digest"),
        ),
        "warc-records",
    )
    # a response that is referred to: one row per page and payload
    held = (
        read.where("record_type = 'response' AND page_id IS NOT NULL")
        .select(F.col("page_id").alias("refers_to"), "digest", "own_bytes", "own_digest")
        .join(read.select("refers_to", "digest").distinct(), ["refers_to", "digest"], "left_semi")
        .distinct()
        .withColumnsRenamed({"own_bytes": "held_bytes", "own_digest": "held_digest"})
    )
    return read.join(held, ["refers_to", "digest"], "left").select(
        "page_id",
        F.coalesce("own_bytes", "held_bytes").alias("payload_bytes"),
        F.coalesce("own_digest", "held_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
