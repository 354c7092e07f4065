"""Posting-shaped views over the driver's tables.

Each view is one SELECT that Spark SQL and DuckDB both run, so an operator and
its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from postsieve.schema import conform

AS_OF = "2024-01-10"

POSTINGS = """
select doc_id as seq,
 case doc_id % 7 when 0 then 'Machine Learning Internship' when 1 then 'Senior ML Engineer' when 2 then 'Werkstudent Data Science'
  when 3 then 'HiWi Computer Vision' when 4 then 'E-commerce Intern' when 5 then 'Praktikum DevOps' else 'Office Clerk' end as title,
 source as company,
 case doc_id % 5 when 0 then 'Berlin, Germany' when 1 then 'München' when 2 then 'Remote' when 3 then 'London' else 'KÖLN' end as location,
 case doc_id % 3 when 0 then 'custom:site' when 1 then 'jobspy:indeed' else 'arbeitsagentur' end as source,
 'https://www.' || source || '.example.com/jobs/' || cast(doc_id - doc_id % 40 + doc_id % 20 as string) || '/?utm_source=feed&id=' || cast(doc_id - doc_id % 40 + doc_id % 20 as string) as url,
 case doc_id % 11 when 0 then 'Deutschkenntnisse mindestens C1. ' when 1 then 'German B1. ' when 2 then 'German is a plus. C1. '
  when 3 then 'English working language. ' when 4 then 'fließend Deutsch. ' when 5 then 'Python, deep-learning and data. ' when 6 then 'Permanent role, 5+ years. '
  when 7 then 'UK only. ' else 'We use AI and e-mail. ' end || text as description,
 case when doc_id % 17 = 0 then null else cast(date '2024-01-01' + cast(doc_id % 14 as int) as string) end as posted_date
from documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = ("documents", "pages", "embeddings", "events", "labels")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the view texts on the tables of a folder."""

    def bound(m: re.Match) -> str:
        if m[1] not in TABLES:
            return m[0]
        table(spark, sf_dir, m[1]).createOrReplaceTempView(f"input_{m[1]}")
        return f"from input_{m[1]}"

    return spark.sql(re.sub(r"\bfrom (\w+)", bound, sql))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(view(spark, sf_dir, POSTINGS))


# What the runs of the history queries find: the postings by their date. The first two hold every row between them.
DAYS = {
    0: "(posted_date is null or posted_date <= '2024-01-05')",
    1: "(posted_date >= '2024-01-05')",
    2: "(posted_date >= '2024-01-11')",
    3: "(posted_date = '2024-01-14')",
}

FIRST_LINE = "split_part(text, chr(10), 1)"

TITLES = f"""
select doc_id as seq,
 case doc_id % 5 when 0 then '  ' || {FIRST_LINE} || '  -  Apply Now ' when 1 then '| ' || {FIRST_LINE} || ' · Details'
  when 2 then {FIRST_LINE} || ' – jetzt  bewerben' when 3 then '— ' || {FIRST_LINE} || ' -' else {FIRST_LINE} || ' | view jobs' end as raw
from documents
"""

URLS = """
select page_id,
 case page_id % 6 when 0 then url
  when 1 then '  ' || upper(split_part(url, '/', 1)) || '//WWW.' || split_part(url, '/', 3) || '/Jobs//?b=2&a=%C3%A4+x&gclid=1&empty=&~=*&UTM_x=1#frag'
  when 2 then url || '#x' when 3 then split_part(url, '#', 1) || '/' when 4 then 'no-scheme/' || cast(page_id as string)
  else split_part(split_part(url, '#', 1), '?', 1) || '?id=' || cast(page_id as string) || '&ref=a&from=b&k=1,2' end as raw
from pages
"""

DATES = """
select doc_id as seq,
 case doc_id % 7 when 0 then '2024-01-' || cast(1 + doc_id % 28 as string) || '  ' when 1 then cast(1 + doc_id % 28 as string) || '.12.2023'
  when 2 then '2024/01/05T10:00' when 3 then 'yesterday' when 4 then null when 5 then '2024-13-01' else '2023-11-0' || cast(1 + doc_id % 9 as string) end as raw
from documents
"""

NEAR = f"""
select doc_id as seq, lang as company, {FIRST_LINE} as title, source as location, text as description,
 case when doc_id % 3 = 0 then null else '2024-01-05' end as posted_date
from documents
"""

BOARD = """
select doc_id as seq, case doc_id % 5 when 0 then 'LinkedIn' when 1 then 'indeed' when 2 then 'google' when 3 then null else 'glassdoor' end as site,
 case doc_id % 4 when 0 then '' when 1 then null else ' https://jobs.example.com/' || source || '/' || cast(doc_id - doc_id % 40 + doc_id % 20 as string) || ' ' end as job_url,
 case when doc_id % 9 = 0 then null else 'https://direct.example.com/' || cast(doc_id - doc_id % 2 as string) end as job_url_direct,
 ' ' || source || ' intern ' as title, lang as company,
 case doc_id % 6 when 0 then 'Berlin' when 1 then 'nan' when 2 then '' else null end as city,
 case doc_id % 4 when 0 then ' BE ' when 1 then 'NaN' else null end as state,
 case doc_id % 3 when 0 then 'Germany' else null end as country,
 case doc_id % 2 when 0 then 'Remote' else null end as location, text as description,
 case doc_id % 5 when 0 then 'NaT' when 1 then '2024-01-03 00:00:00' when 2 then 'None' when 3 then null else '2024-01-04' end as date_posted
from documents
"""


def _item(k: int) -> str:
    n = f"(doc_id * 3 + {k})"
    return (
        f"'{{' || case {n} % 4 when 0 then '\"referenznummer\":\"R' when 1 then '\"referenznummer\":\"\",\"refnr\":\"R' "
        f"when 2 then '\"hashId\":\"R' else '\"refnr\":\"R' end || cast({n} - {n} % 2 as string) || '\",' || "
        f"case {n} % 5 when 0 then '\"stellenangebotsTitel\":\" Praktikum KI ' when 1 then '\"titel\":\"Werkstudent ' "
        f"when 2 then '\"beruf\":\"Koch ' when 3 then '\"hauptberuf\":\"Data Engineer ' else '\"titel\":\"\",\"beruf\":\"Kindergarten ' end || source || '\",' || "
        f"case {n} % 3 when 0 then '\"firma\":\"' || source || '\"' when 1 then '\"arbeitgeber\":{{\"name\":\"' || lang || '\"}}' else '\"firma\":\"\"' end || ',' || "
        f"case {n} % 6 when 0 then '\"stellenlokationen\":[{{\"adresse\":{{\"ort\":\"Berlin\",\"region\":\"\",\"land\":\"DE\"}}}}]' "
        f"when 1 then '\"stellenlokationen\":[],\"arbeitsort\":{{\"ort\":\"Bonn\"}}' when 2 then '\"ort\":\"Kiel\"' "
        f"when 3 then '\"stellenlokationen\":[{{\"adresse\":null}}]' else '\"arbeitsort\":{{}}' end || ',' || "
        f"case {n} % 4 when 0 then '\"datumErsteVeroeffentlichung\":\"2024-01-02T08:00\"' when 1 then '\"aenderungsdatum\":\"2024-01-03\"' "
        f"when 2 then '\"veroeffentlichungszeitraum\":{{\"von\":\"2024-01-04\"}}' else '\"x\":1' end || '}}'"
    )


AGENCY_PAGES = (
    "select doc_id as page, '{\"' || case doc_id % 3 when 0 then 'ergebnisliste' when 1 then 'ergebnisliste\":[],\"stellenangebote' "
    f"else 'jobs' end || '\":[' || {_item(0)} || ',' || {_item(1)} || ',' || {_item(2)} || ']}}' as body from documents"
)

AGENCY_DETAILS = """
select 'R' || cast(doc_id as string) as refnr,
 '{' || case doc_id % 3 when 0 then '"stellenangebotsBeschreibung":"quality ' || cast(quality as string) || '"' when 1 then '"beschreibung":{"text":"toxic ' || cast(toxic as string) || '"}' else '"stellenbeschreibung":""' end || ',' ||
 case doc_id % 4 when 0 then '"externeUrl":"https://ext.example.com/' || cast(doc_id as string) || '"' when 1 then '"url":"https://int.example.com/' || cast(doc_id as string) || '"' else '"url":""' end || ',' ||
 case doc_id % 2 when 0 then '"arbeitgeber":{"name":"Detail AG"}' else '"firma":"Detail GmbH"' end || ',' ||
 case doc_id % 5 when 0 then '"aktuelleVeroeffentlichungsdatum":"2024-01-06"' else '"y":2' end || '}' as body
from labels
"""

# Site pages: the raw page with posting-like cards ahead of its own content.
_FLAT_CARDS = """'<div class="card"><a href="/jobs/' || cast(page_id % 40 as string) || '?x=1">Machine learning internship</a><span class="firm">Firm ' || cast(page_id % 7 as string) || '</span><span class="city">Berlin</span></div>' ||
 '<ul><li><a href="https://other.example.org/p/' || cast(page_id as string) || '">Apply here now</a> for this data science role</li>' ||
 '<li><a href="/about-us">About this company</a></li><li><a href="mailto:jobs@example.org">Werkstudent per mail</a></li><li><a href="/jobs/x">Short</a></li></ul>'"""
# Nested cards, a quoted sign, a card without a hint of its own, character references, open rows.
_NESTED_CARDS = """case page_id % 5
  when 0 then '<section><li><a href="/p/' || cast(page_id as string) || '">Apply here now</a><div class="firm">Nested ' || cast(page_id as string) || '</div><div>data <b>science</b> role</div></li></section>'
  when 1 then '<a title="a>b" href="/y/' || cast(page_id as string) || '">Machine learning internship</a>'
  when 2 then '<div><div><a href="/z/' || cast(page_id as string) || '">Open position</a></div><div class="firm">Far off</div><div>hiwi</div></div>'
  when 3 then '<div><a href="../q/./r?x=' || cast(page_id as string) || '">Offene Stelle</a><p class="big firm">K&uuml;hl &#38; S&#xF6;hne<span class=city>K&ouml;ln</span><script>x("hiwi")</script> Praktikum</div>'
  else '<table><tr><td><a href="/t/' || cast(page_id as string) || '">Apply here now</a><td>shk ' || cast(page_id as string) || '<tr><td><a href="/u/1">Apply here now</a></table>' end"""
FLAT_PAGES = f"select page_id, 'site' || cast(page_id % 3 as string) as site, url, {_FLAT_CARDS} || html as html from pages"
LISTING_PAGES = f"select page_id, 'site' || cast(page_id % 3 as string) as site, url, {_FLAT_CARDS} || {_NESTED_CARDS} || html as html from pages"

OWN_PAGES = "select page_id, 'site0' as site, url, html from pages"

ODD = """
select doc_id as seq, case doc_id % 4 when 0 then ' - | ' when 1 then null else lang || ' intern ' || cast(doc_id as string) end as title,
 case doc_id % 3 when 0 then '  ' || source || '   ' || lang || ' ' when 1 then '   ' else null end as company,
 case doc_id % 5 when 0 then ' Köln   am Rhein ' when 1 then '' else lang end as location, source,
 case doc_id % 7 when 0 then '' when 1 then '   ' else 'https://odd.example.com/' || cast(doc_id as string) end as url,
 text as description, case doc_id % 2 when 0 then '2024-01-05T10:00:00' else '05.01.2024 ' end as posted_date
from documents
"""

LISTING_MARKDOWN = """
select page_id, 'site' || cast(page_id % 3 as string) as site, url,
 '# Jobs\n* [ Praktikum Data Science ](https://a.example.org/' || cast(page_id % 50 as string) || ') [About this company](https://a.example.org/about)\n* [See the open job](/jobs/' || cast(page_id as string) || ') [short](/jobs/1) [Impressum here](/imprint)\n* [Any open position](https://b.example.org/JOBS/1)\n' || html as md
from pages
"""

FETCH_LOG = "select user_id, ts, event_id, event_type <> 'error' as ok from events"
