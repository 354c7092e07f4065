"""Mixing sources to target weights by capped water-filling (operator 6).

Targets: the budget is shared by weight; a source is clamped at ``max_epochs`` times its words, and what it leaves is
shared again by weight among the others until none is above its clamp. With the sources ordered by clamp over weight
this needs no loop: the clamped ones are a prefix of that order.

Sampling: a source's quota is its target in whole words. Every document is taken ``quota div words`` times whole; for
the rest, the documents of a source are put in the order of a seeded hash and taken until the rest is used up, the
last one in part. A source is never in one task: sums go by source and leading hash digits, and only the bucket in
which the rest ends is ordered row by row.

Cases: a null text has no words; null is a source of its own, last in order; a source without words has target 0; an
empty table gives an empty result; rows that repeat an id are taken as rows of their own; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postsieve.llm.common import row_key
from postsieve.plans.durable import written

WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Hash digits (hexadecimal) by which a source's documents are dealt into buckets for the running sum.
DIGITS = 3


def words(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float, max_epochs: int, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, target) from rows (source, size). One row per source passes the ordering."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = total.withColumn("rank", F.row_number().over(by_name) - 1).select(
        "source", "source_size", "rank",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(max_epochs)).cast("double").alias("clamp"),
        (F.sum("source_size").over(every) * F.lit(share)).alias("budget"),
    )
    filling = Window.orderBy(F.col("clamp") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    clamped = ranked.withColumn("full", F.col("weight") * (F.col("budget") - F.coalesce(F.sum("clamp").over(filling), F.lit(0.0)))
                                >= F.col("clamp") * (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("clamp")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    return clamped.select(
        "source", "source_size",
        F.when(F.col("full"), F.col("clamp")).otherwise(F.col("weight") * left / open_weight).alias("target"),
    )


def mix(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, weights: tuple[float, ...] = (3.0, 1.0, 2.0),
        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keyed: bool = False) -> DataFrame:
    """One row per document: id, source, size, source_size, target, ``copies`` (whole ones), ``part`` (words of one
    more, partial copy) and ``taken`` (all words taken). ``part`` is below ``size``. With ``keyed`` also ``row_key`` of id, text and source."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"), key.alias("key"),
            *([row_key(id_col, text_col, source_col).alias("row_key")] if keyed else []))
        .withColumn("bucket", F.substring("key", 1, DIGITS)))
    goals = written(targets(rows, share, max_epochs, weights)).withColumn("quota", F.floor(F.col("target") + 0.5).cast("bigint"))
    goals = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)).cast("bigint"))
    goals = goals.withColumn("rest", F.col("quota") - F.col("copies") * F.col("source_size"))
    # sums by source and bucket; a source's rows meet in no task, its buckets are dealt out one by one
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
        .withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    )
    plan = buckets.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        "s.source", "bucket", "before", "source_size", "target", "copies", "rest",
        F.when(F.col("before") + F.col("held") <= F.col("rest"), "all").when(F.col("before") >= F.col("rest"), "none")
        .otherwise("cut").alias("share"))
    dealt = rows.alias("s").join(plan.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")) & (F.col("s.bucket") == F.col("g.bucket"))).select(
        *(["row_key"] if keyed else []), "s.doc_id", "s.source", "size", "key", "before", "source_size", "target", "copies", "rest", "share")
    whole = dealt.where("share <> 'cut'").withColumn("extra", F.when(F.col("share") == "all", F.col("size")).otherwise(F.lit(0)))
    # only the bucket in which the rest ends is ordered row by row
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = dealt.where("share = 'cut'").withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("so_far")))).drop("so_far")
    every = whole.unionByName(cut)
    full = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    return every.select(
        *(["row_key"] if keyed else []), F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        (F.col("copies") + full.cast("bigint")).alias("copies"),
        F.when(full, F.lit(0)).otherwise(F.col("extra")).cast("bigint").alias("part"),
        (F.col("copies") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"),
    )


#: The same rows in DuckDB; sources need not be named, so that null stays one of them.
GOALS_SQL = r"""
sizes as (
  select doc_id, source, md5('42:' || coalesce(cast(doc_id as varchar), '')) as key,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from {documents}),
per as (select source, cast(sum(size) as bigint) as source_size from sizes group by source),
ranked as (
  select *, row_number() over (order by source nulls last) - 1 as rank from per),
weighed as (
  select *, case rank % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight,
    cast(source_size * 2 as double) as clamp, cast(sum(source_size) over () as double) * 1.5::double as budget from ranked),
filled as (
  select *, weight * (budget - coalesce(sum(clamp) over w, 0)) >= clamp * (sum(weight) over () - coalesce(sum(weight) over w, 0)) as is_full
  from weighed window w as (order by clamp / weight, rank rows between unbounded preceding and 1 preceding)),
goals as (
  select source, source_size,
    case when is_full then clamp else weight * (budget - sum(case when is_full then clamp else 0 end) over ())
      / sum(case when is_full then 0 else weight end) over () end as target
  from filled),
quotas as (
  select *, cast(floor(target + 0.5) as bigint) as quota,
    case when source_size > 0 then cast(floor(target + 0.5) as bigint) // source_size else 0 end as copies from goals),
mixed as (
  select s.doc_id, s.source, s.size, q.source_size, q.target, q.copies,
    greatest(0, least(s.size, q.quota - q.copies * q.source_size - cast(coalesce(sum(s.size) over (
      partition by s.source order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as bigint))) as extra
  from sizes s join quotas q on s.source is not distinct from q.source)
"""
ORACLE = "with " + GOALS_SQL.format(documents="documents") + """
select doc_id, size, source_size, target, cast(copies * size + extra as bigint) as taken from mixed
"""


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed corpus: each document with all its columns as often as it is taken whole, and the partial copy of a
    source's last document with its first words, joined by single spaces. Rows that repeat id, text and source are
    taken as copies of one of them. The documents are shuffled once, by a key."""
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, keyed=True, **settings)
    plan = taken.groupBy("row_key").agg(F.sum("copies").alias("copies"), F.sum("part").alias("part")).where("copies > 0 or part > 0")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col, source_col).alias("row_key"))
    rows = whole.join(plan, "row_key").dropDuplicates(["row_key"])
    parts = F.concat(F.array_repeat(F.lit(-1).cast("bigint"), F.col("copies").cast("int")),
                     F.when(F.col("part") > 0, F.array("part")).otherwise(F.expr("cast(array() as array<bigint>)")))
    cut = F.array_join(F.slice(F.filter(F.split(F.col(f"row.`{text_col}`"), WORD_GAP), lambda w: w != ""), F.lit(1), F.col("part").cast("int")), " ")
    text = F.when(F.col("taken") < 0, F.col(f"row.`{text_col}`")).otherwise(cut)
    return rows.withColumn("taken", F.explode(parts)).select(
        *(text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
