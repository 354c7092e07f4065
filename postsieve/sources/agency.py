"""Nested result pages of the agency interface to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.text import any_match, strip
from postsieve.operators.normalize import first_by
from postsieve.policy import Policy
from postsieve.schema import conform, pack_seq

RANK = 1
JOB_PAGE = "https://www.arbeitsagentur.de/jobsuche/jobdetail/"

# Title words worth a detail lookup, and field names in order of trust.
TITLE_HINTS = (
    "praktikum", "praktikant", "praktikantin", "werkstudent", "werkstudentin",
    "internship", "intern", "trainee", "hiwi", "shk", "hilfskraft",
    "working student", "studentische", "student", "abschlussarbeit",
    "masterarbeit", "bachelorarbeit", "thesis", "research assistant",
    "machine learning", "deep learning", "data science", "data scientist",
    "künstliche intelligenz", "ki", "ai", "nlp", "llm", "computer vision",
    "mlops", "devops", "data engineer", "data analyst", "python",
)
_LISTS = ("ergebnisliste", "stellenangebote", "jobs")
_IDS = ("referenznummer", "refnr", "hashId")
_TITLES = ("stellenangebotsTitel", "titel", "beruf", "hauptberuf")
_COMPANIES = ("firma", "arbeitgeber")
_TEXTS = ("stellenangebotsBeschreibung", "stellenbeschreibung", "jobBeschreibung", "beschreibung")
_URLS = ("externeUrl", "url")
_DATES = ("datumErsteVeroeffentlichung", "aktuelleVeroeffentlichungsdatum", "aenderungsdatum")
_PLACES = ("arbeitsort", "ort")
_RANGE = "veroeffentlichungszeitraum"

# A field read as string keeps the JSON text of an object, so one schema serves
# fields that are sometimes a string and sometimes an object.
_PAGE = "struct<" + ",".join(f"`{k}`:array<string>" for k in _LISTS) + ">"
_ITEM = (
    "struct<" + ",".join(f"`{k}`:string" for k in (*_IDS, *_TITLES, *_COMPANIES, *_DATES, *_PLACES, _RANGE))
    + ",stellenlokationen:array<struct<adresse:struct<ort:string,region:string,land:string>>>>"
)
_DETAIL = "struct<" + ",".join(f"`{k}`:string" for k in (*_TEXTS, *_URLS, *_COMPANIES, *_DATES, _RANGE)) + ">"


def _filled(c: Column) -> Column:
    return F.when(~c.isin("", "{}", "[]"), c)


def _first(record: str, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[_filled(F.col(f"{record}.{n}")) for n in names])


def _text_or(value: Column, key: str) -> Column:
    """A plain text, or the named field where the value is an object."""
    return F.when(value.startswith("{"), _filled(F.get_json_object(value, f"$.{key}"))).otherwise(value)


def _place(record: str, fallback: str) -> Column:
    address = F.get(F.col(f"{record}.stellenlokationen"), F.lit(0))["adresse"]
    parts = F.nullif(
        F.concat_ws(", ", *[_filled(address[k]) for k in ("ort", "region", "land")]), F.lit("")
    )
    return F.coalesce(parts, _text_or(_first(record, _PLACES), "ort"), F.lit(fallback))


def _published(record: str) -> Column:
    range_start = _filled(F.get_json_object(F.col(f"{record}.{_RANGE}"), "$.von"))
    return F.coalesce(_first(record, _DATES), range_start)


def agency_items(pages: DataFrame, policy: Policy) -> DataFrame:
    """Items of result pages (``page`` in fetch order, JSON ``body``), first per reference number."""
    parsed = pages.select("page", F.from_json("body", _PAGE).alias("p"))
    filled = lambda c: F.when(F.size(c) > 0, c)
    items = parsed.select(
        "page", F.posexplode(F.coalesce(*[filled(F.col(f"p.{k}")) for k in _LISTS])).alias("pos", "item")
    ).select("page", "pos", F.from_json("item", _ITEM).alias("i"))
    rows = items.select(
        "page",
        pack_seq(RANK, F.col("page"), F.col("pos")).alias("seq"),
        _first("i", _IDS).alias("refnr"),
        strip(F.coalesce(_first("i", _TITLES), F.lit(""))).alias("title"),
        _text_or(_first("i", _COMPANIES), "name").alias("item_company"),
        strip(_place("i", policy.search_location)).alias("location"),
        _published("i").alias("item_posted"),
    ).filter("refnr is not null")
    return first_by(rows, ["refnr"], "seq")


def hinted(items: DataFrame) -> DataFrame:
    """Items whose title is worth a detail lookup."""
    return items.filter(any_match(F.col("title"), TITLE_HINTS))


def cap_pages(items: DataFrame, cap: int) -> DataFrame:
    """Stop reading pages once the earlier ones gave ``cap`` items.

    The limit is tested per page, so the last page read may overshoot it.  Each
    page that counts gives at least one item: the first ``cap`` such pages
    decide where to stop, however many pages there are.
    """
    if cap <= 0:
        return items.limit(0)
    leading = items.groupBy("page").count().orderBy("page").limit(cap)
    upto = F.sum("count").over(Window.orderBy("page"))
    stop = (
        leading.select("page", upto.alias("upto")).filter(F.col("upto") >= cap)
        .agg(F.coalesce(F.min("page"), F.lit((1 << 63) - 1)))
    )
    return items.filter(F.col("page") <= stop.scalar())


def agency_json(pages: DataFrame, details: DataFrame, policy: Policy) -> DataFrame:
    """Postings from result pages and detail records (``refnr``, JSON ``body``).

    Titles are tested before the lookup, so only hinted items meet the details;
    an item without a detail record is kept.
    """
    items = hinted(agency_items(pages, policy))
    if policy.max_raw_per_source is not None:
        items = cap_pages(items, policy.max_raw_per_source)
    found = details.select("refnr", F.from_json("body", _DETAIL).alias("d"))
    rows = items.join(found, "refnr", "left")
    description = _text_or(_first("d", _TEXTS), "text")
    company = F.coalesce("item_company", _text_or(_first("d", _COMPANIES), "name"))
    return conform(rows.select(
        "seq", "title", "location",
        strip(F.coalesce(company, F.lit(""))).alias("company"),
        F.lit("arbeitsagentur").alias("source"),
        F.coalesce(_first("d", _URLS), F.concat(F.lit(JOB_PAGE), F.col("refnr"))).alias("url"),
        F.coalesce(description, F.lit("")).alias("description"),
        F.substring(F.coalesce(_published("d"), F.col("item_posted")), 1, 10).alias("posted_date"),
    ))
