"""Column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_COLUMNS = ("title", "company", "location", "source", "url", "description")

POSTING = T.StructType(
    [T.StructField("seq", T.LongType(), False)]
    + [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS]
    + [
        T.StructField("language", T.StringType()),
        T.StructField("role_type", T.StringType()),
        T.StructField("posted_date", T.StringType()),
    ]
)

PAYLOAD = (
    "title", "company", "location", "source", "description", "language",
    "role_type", "posted_date", "fit_score", "fit_reason",
)

HISTORY = T.StructType([
    T.StructField("url", T.StringType(), False),
    *[T.StructField(c, T.DoubleType() if c == "fit_score" else T.StringType()) for c in PAYLOAD],
    T.StructField("first_seen", T.DateType()),
    T.StructField("last_seen", T.DateType()),
    T.StructField("status", T.StringType()),
])

STATUSES = ("new", "applied", "dismissed", "expired")
HANDLED = ("applied", "dismissed")

# seq keeps the input order in one bigint: source rank, then a position, or a page and an item on it.
_POSITION_BITS = 60
_ITEM_BITS = 24


def pack_seq(source_rank: int, page: Column, item: Column | None = None) -> Column:
    """Order key of a row (60 bits) or of an item on a page (36 and 24 bits); out-of-range parts fail the job instead
    of wrapping."""
    page = page.cast("bigint")
    rank = F.lit(source_rank << _POSITION_BITS).cast("bigint")
    if item is None:
        fits, place = page.between(0, (1 << _POSITION_BITS) - 1), page
    else:
        item = item.cast("bigint")
        fits = page.between(0, (1 << (_POSITION_BITS - _ITEM_BITS)) - 1) & item.between(0, (1 << _ITEM_BITS) - 1)
        place = page * F.lit(1 << _ITEM_BITS) + item
    return F.when(fits, rank + place).otherwise(F.raise_error(F.lit("seq part out of range")).cast("bigint"))


def conform(df: DataFrame, layout: T.StructType = POSTING) -> DataFrame:
    """Select the layout's columns, adding typed nulls for the missing ones."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in layout
    ])


def with_missing(df: DataFrame, layout: T.StructType = POSTING) -> DataFrame:
    """Add typed nulls for absent columns, keeping every column there is."""
    absent = [f for f in layout if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in absent])


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def as_day(value) -> Column:
    """A date literal from a ``date`` or an ISO string."""
    return F.lit(str(value)).cast("date")
