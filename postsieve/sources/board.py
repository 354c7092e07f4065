"""Flat result rows of job boards to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.text import strip
from postsieve.operators.normalize import first_by
from postsieve.policy import Policy
from postsieve.schema import conform, pack_seq

RANK = 0


def filled(column: Column | str) -> Column:
    """Trimmed text, null if nothing is left."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(strip(column), F.lit(""))


def board_location(city: str, state: str, country: str, whole: str, search: str) -> Column:
    """City, state and country that are known, else the board's own text, else the search place."""
    known = lambda c: F.when(F.lower(filled(c)) != "nan", filled(c))
    parts = F.nullif(F.concat_ws(", ", known(city), known(state), known(country)), F.lit(""))
    return F.coalesce(parts, F.nullif(F.col(whole), F.lit("")), F.lit(search))


def board_date(column: str) -> Column:
    """First ten characters, null for the texts that stand for a missing date."""
    c = F.col(column)
    return F.when(~c.isin("", "NaT", "nan", "None"), F.substring(c, 1, 10))


def allowed_board(site: str, policy: Policy) -> Column:
    blocked = [b.lower() for b in policy.blocked_boards]
    return ~F.coalesce(F.lower(F.col(site)).isin(*blocked), F.lit(False)) if blocked else F.lit(True)


def board_rows(rows: DataFrame, policy: Policy) -> DataFrame:
    """Postings of the allowed boards, first row per raw URL.

    Reads ``seq, site, job_url, job_url_direct, title, company, city, state,
    country, location, description, date_posted``.
    """
    first_url = F.coalesce(F.nullif(F.col("job_url"), F.lit("")), F.col("job_url_direct"))
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    postings = rows.filter(allowed_board("site", policy)).select(
        pack_seq(RANK, F.col("seq")).alias("seq"),
        text("title").alias("title"),
        text("company").alias("company"),
        board_location("city", "state", "country", "location", policy.search_location).alias("location"),
        F.concat(F.lit("jobspy:"), F.coalesce(F.nullif("site", F.lit("")), F.lit("unknown"))).alias("source"),
        strip(first_url).alias("url"),
        F.coalesce("description", F.lit("")).alias("description"),
        board_date("date_posted").alias("posted_date"),
    ).filter("url <> ''")
    return conform(first_by(postings, ["url"], "seq"))
