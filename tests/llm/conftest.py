import pytest
from pyspark.sql import functions as F

# Names that the operators use themselves.
CLASHING = "w h g d r fp row lines found kinds part order size start stop spans root rep bin n".split()
PROSE = (
    "The river was low that year, and the boats lay in the mud of the old harbour.\n"
    "Nobody had seen the ferry since spring; it was said that the captain had sold it.\n"
    "We walked along the wall to the mill, where the road turns to the north."
)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    return [
        (1, PROSE, "en", "a", len(PROSE)),
        (2, PROSE, "en", "a", len(PROSE)),
        (2, PROSE, "en", "a", len(PROSE)),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (None, PROSE.upper(), "en", "a", len(PROSE)),
        (None, None, None, None, None),
        (5, " \n\t ", None, "b", 4),
        (6, "no end in sight " * 20_000, "en", "c", 320_000),
        (7, "one two three", "en", "c", 13),
        (2**62, "ä€😀 ñ", "es", "c", 6),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    docs = spark.createDataFrame(
        edge_rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    )
    return docs.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def corpus(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
