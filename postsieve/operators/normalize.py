"""Normalisation of raw postings: clean fields, one row per canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.fields import canonical_url, clean_title, detect_language, detect_role_type
from postsieve.functions.text import squeeze, strip
from postsieve.policy import Policy
from postsieve.schema import text_or_empty, with_missing


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """First row per key in the given order.

    The rank limit is pushed below the shuffle, so every map task sends at most
    one row per key and a hot key costs no more than the others.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def clean_fields(df: DataFrame) -> DataFrame:
    """Canonical URL and tidy text; rows without title or URL are dropped."""

    def named(column: Column, fallback: str) -> Column:
        return F.coalesce(F.nullif(squeeze(column), F.lit("")), F.lit(fallback))

    # A URL is blank exactly if its canonical form is: test the cheap one.
    return with_missing(df).filter(strip(text_or_empty("url")) != "").withColumns({
        "title": clean_title(F.col("title")),
        "company": named(F.col("company"), "Unknown"),
        "location": named(F.col("location"), "Germany"),
        "description": strip(text_or_empty("description")),
        "url": canonical_url(F.col("url")),
        "posted_date": F.substring(F.nullif("posted_date", F.lit("")), 1, 10),
    }).filter("title <> ''")


def detect(df: DataFrame, policy: Policy) -> DataFrame:
    """Role type and language; an earlier language is kept, a role is replaced if found."""
    text = F.concat_ws("\n", "title", "description")
    return df.withColumns({
        "role_type": detect_role_type(text, policy.role_types, otherwise=F.col("role_type")),
        "language": F.coalesce(F.nullif("language", F.lit("")), detect_language(text)),
    })


def normalize(df: DataFrame, policy: Policy) -> DataFrame:
    """Clean rows, keep the first row per URL, then detect role and language.

    Detection reads whole texts, so it runs after the duplicates are gone.
    """
    return detect(first_by(clean_fields(df), ["url"], "seq"), policy)
