"""The campaign schema: column order, category codes, feature list and label."""

from __future__ import annotations

from pyspark.sql import types as T

# Category lists (the code of a category is its position), column orders,
# and the features the shallow decision tree treats as nominal rather than ordered.
YES_NO = ["no", "yes"]
JOB = [
    "admin.", "blue-collar", "entrepreneur", "housemaid", "management", "retired",
    "self-employed", "services", "student", "technician", "unemployed", "unknown",
]
MARITAL = ["divorced", "married", "single"]
EDUCATION = ["primary", "secondary", "tertiary", "unknown"]
CONTACT = ["cellular", "telephone", "unknown"]
MONTH = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
POUTCOME = ["failure", "success", "other", "unknown"]
FEATURES = [
    "age", "job", "marital", "education", "balance", "housing", "loan", "contact",
    "day", "month", "duration", "campaign", "pdays", "previous", "poutcome",
]
LABEL = "deposit"
UNUSED = "default"
CAMPAIGN_COLUMNS = [
    "age", "job", "marital", "education", UNUSED, "balance", "housing", "loan", "contact",
    "day", "month", "duration", "campaign", "pdays", "previous", "poutcome", LABEL,
]
NOMINAL = {"housing": YES_NO, "loan": YES_NO}
# Group start and width of the columns with many values: at most 32 groups each.
GROUPS = {"age": (18, 3), "balance": (0, 180), "duration": (0, 50), "pdays": (-1, 13)}
MOST_GROUPS = 32

KEY = "row_id"

CATEGORIES: dict[str, list[str]] = {
    "job": JOB,
    "marital": MARITAL,
    "education": EDUCATION,
    "housing": YES_NO,
    "loan": YES_NO,
    "contact": CONTACT,
    "month": MONTH,
    "poutcome": POUTCOME,
    "deposit": YES_NO,
}

_TEXT = set(CATEGORIES) | {UNUSED}

CAMPAIGN_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType() if name in _TEXT else T.IntegerType())
        for name in CAMPAIGN_COLUMNS
    ]
)
KEYED_CAMPAIGN_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType()), *CAMPAIGN_SCHEMA.fields]
)


def codes(categories: list[str]) -> dict[str, float]:
    """Category list -> {category: code}."""
    return {name: float(position) for position, name in enumerate(categories)}
