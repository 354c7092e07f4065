"""Dated sheets and the daily digest, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.numbers import whole_text
from postsieve.functions.text import age_days
from postsieve.policy import Policy
from postsieve.schema import as_day

# Score bands, cut lengths and the message limit.
BANDS = ((80, "strong"), (65, "good"), (50, "worth a look"))
MESSAGE_CHARS = 4000


def is_new(as_of) -> Column:
    return F.coalesce(F.col("first_seen") == as_day(as_of), F.lit(False))


def band(score: Column) -> Column:
    """Name of the highest band the score reaches, null below all."""
    return F.coalesce(*[F.when(score >= least, F.lit(name)) for least, name in BANDS])


def sheet(rows: DataFrame, as_of) -> DataFrame:
    """The eleven published columns and the band that tints the row."""
    return rows.select(
        F.when(is_new(as_of), "NEW").otherwise("").alias("new"),
        "fit_score", "title", "company", "location", "source", "language",
        F.coalesce("posted_date", F.lit("")).alias("posted_date"),
        age_days(F.col("posted_date"), as_day(as_of)).alias("age_days"),
        "fit_reason",
        F.col("url").alias("apply_link"),
        band(F.col("fit_score")).alias("band"),
    )


def sheets(open_rows: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """All open rows and those first seen today, both best first."""
    order = (F.desc("fit_score"), F.asc("url"))
    everything = sheet(open_rows.orderBy(*order), as_of)
    return everything, sheet(open_rows.filter(is_new(as_of)).orderBy(*order), as_of)


def dated_sheets(open_rows: DataFrame, as_of) -> DataFrame:
    """Both views in one table, ready to be written by run_date and sheet."""
    both, one = F.array(F.lit("All Open"), F.lit("New Today")), F.array(F.lit("All Open"))
    return sheet(open_rows, as_of).withColumns({
        "run_date": as_day(as_of),
        "sheet": F.explode(F.when(F.col("new") == "NEW", both).otherwise(one)),
    })


def write_sheets(open_rows: DataFrame, as_of, path: str, fmt: str = "parquet") -> None:
    """Write a run's sheets, best first inside each file, replacing only that run."""
    (
        dated_sheets(open_rows, as_of)
        .sortWithinPartitions(F.desc("fit_score"), F.asc("apply_link"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date", "sheet").format(fmt).save(path)
    )


def keep_newest(published: DataFrame, keep: int, date: str = "run_date") -> DataFrame:
    """Rows of the newest ``keep`` dates; 0 or less removes nothing.

    At most ``keep`` dates are broadcast, and no row is sorted.
    """
    if keep <= 0:
        return published
    newest = published.select(date).distinct().orderBy(F.desc(date)).limit(keep)
    return published.join(F.broadcast(newest), date, "left_semi")


def digest_pick(open_rows: DataFrame, policy: Policy, as_of, by: Sequence[str] = ()) -> DataFrame:
    """First ``top_n`` rows, today's finds before older ones; ``rk`` is the place.

    Per key of ``by`` if given.  The rank limit acts before the shuffle.
    """
    order = (F.desc(is_new(as_of)), F.desc("fit_score"), F.asc("url"))
    if not by:
        open_rows = open_rows.orderBy(*order).limit(policy.top_n)
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return open_rows.withColumn("rk", F.row_number().over(window)).filter(F.col("rk") <= policy.top_n)


def headline(new_count: Column, total_open: Column) -> Column:
    return F.when(
        new_count > 0,
        F.concat(new_count.cast("string"), F.lit(" new internship match(es) today · "),
                 total_open.cast("string"), F.lit(" open in total")),
    ).otherwise(F.concat(F.lit("No new matches today · "), total_open.cast("string"), F.lit(" still open")))


def escape(text: Column) -> Column:
    """HTML-escape the five special characters."""
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _cut(name: str, chars: int) -> Column:
    return escape(F.substring(F.coalesce(name, F.lit("")), 1, chars))


def message_line(as_of) -> Column:
    return F.concat(
        F.lit("\n"), F.col("rk").cast("string"), F.lit(". "),
        F.when(is_new(as_of), "🆕 ").otherwise(""),
        F.lit("<b>"), whole_text(F.col("fit_score")), F.lit('</b> · <a href="'), escape(F.col("url")),
        F.lit('">'), _cut("title", 90), F.lit("</a>\n    "), _cut("company", 50), F.lit(" — "),
        _cut("location", 40),
    )


def table_row(as_of) -> Column:
    return F.concat(
        F.lit("<tr><td align='right'><b>"), whole_text(F.col("fit_score")), F.lit("</b></td><td>"),
        F.when(is_new(as_of), "NEW ").otherwise(""),
        F.lit('<a href="'), escape(F.col("url")), F.lit('">'), _cut("title", 110), F.lit("</a></td><td>"),
        _cut("company", 60), F.lit("</td><td>"), _cut("location", 40), F.lit("</td></tr>"),
    )


def fit_message(text: Column) -> Column:
    """Cut a long message at its last line break inside the limit."""
    head = F.substring(text, 1, MESSAGE_CHARS)
    before = F.when(F.contains(head, F.lit("\n")), F.regexp_extract(head, r"(?s)\A(.*)\n", 1)).otherwise(head)
    return F.when(F.length(text) > MESSAGE_CHARS, F.concat(before, F.lit("\n…"))).otherwise(text)


def digest(
    open_rows: DataFrame, policy: Policy, as_of, by: Sequence[str] = (), sheet_path: str = ""
) -> DataFrame:
    """One digest row per key of ``by`` (one row in all without it).

    Counts and the at most ``top_n`` lines of a key meet in one aggregation, so
    only those lines are ever collected into an array.
    """
    keys = list(by)
    counted = open_rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_open"), F.count_if(is_new(as_of)).alias("new_count")
    ).withColumn("item", F.lit(None).cast("struct<rk:int,line:string,row:string>"))
    picked = digest_pick(open_rows, policy, as_of, by).select(
        *keys, F.lit(0).cast("bigint").alias("total_open"), F.lit(0).cast("bigint").alias("new_count"),
        F.struct("rk", message_line(as_of).alias("line"), table_row(as_of).alias("row")).alias("item"),
    )
    joined = counted.unionByName(picked).groupBy(*keys).agg(
        F.sum("total_open").alias("total_open"), F.sum("new_count").alias("new_count"),
        F.array_sort(F.collect_list("item")).alias("items"),
    ).withColumn("headline", headline(F.col("new_count"), F.col("total_open")))
    if policy.skip_when_empty:
        joined = joined.filter("new_count > 0")
    title = F.concat(F.lit("<b>"), escape(F.col("headline")), F.lit("</b>"))
    lines = F.concat(F.array(title), F.transform("items", lambda i: i["line"]))
    table = F.concat(
        F.lit("<p>"), title, F.lit("</p><table cellpadding='6' cellspacing='0' border='0'>"
                                   "<tr><th align='right'>Fit</th><th align='left'>Role</th>"
                                   "<th align='left'>Company</th><th align='left'>Location</th></tr>"),
        F.array_join(F.transform("items", lambda i: i["row"]), ""),
        F.lit("</table><p style='color:#666;font-size:12px'>Full sheet: "), escape(F.lit(sheet_path)),
        F.lit("</p>"),
    )
    return joined.select(
        *keys, "total_open", "new_count", "headline",
        F.concat(F.lit("Internships: "), F.col("new_count").cast("string"), F.lit(" new today")).alias("subject"),
        fit_message(F.array_join(lines, "\n")).alias("message"),
        table.alias("html"),
    )
