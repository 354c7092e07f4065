"""Near-duplicate removal with leaders.

In input order, a posting joins the earliest leader of its block that is similar
enough, else it becomes a leader.  The sequential rule is met exactly, in rounds:

1. postings with the same block and word set are one record (they are similar to
   the same leaders), so exact copies cost one map-side aggregation;
2. the first records of every block form a batch; pairs are made inside it only,
   and the leaders among them follow from the pairs;
3. all later records of the block are compared with these new leaders only, and
   the similar ones are settled, so a large group of near copies is gone after
   the round that finds its leader.

Records of a block are dealt into tiles, and each two tiles that meet are one
cell: a group of one shuffle, whose pairs are compared in memory.  Two records can
be similar in two ways, and each is sought by itself:

* one nearly contains the other: it asks for its rarest words, of which the other
  must hold one, and meets the records listed under them;
* the unshared words differ by few characters: the records are of like size, and
  their counts of letters and of neighbouring characters differ by few.

Only similar pairs leave a cell, and of a later record only its first leader.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.similarity import (
    COMPARED,
    SKETCH,
    WORD_CLASSES,
    block_key,
    fingerprint,
    joined,
    letter_counts,
    similar_pairs,
    sketch,
    tokens,
    word_sketch,
)
from postsieve.plans.durable import cut, shared_folder, written

THRESHOLD = 90
_FIRST_BATCH = 1000  # Spark limits ranks before the shuffle up to this many by default
_GROWTH = 4  # of a batch
_TILE_ROWS = 8192
_MOST_PAIRS = 1_000_000  # of a cell; more than a tile of _FIRST_BATCH records can have
_PART_ROWS = 50_000
_MAX_HOT = 50_000
_LEAST_COUNTED = 64  # records of a tile from which on their neighbouring characters are counted
_LANES = 64


def records(df: DataFrame, block: Column | None = None) -> DataFrame:
    """One row per block and word set: its first ``seq`` and number of postings."""
    words = df.select(
        "seq",
        (block_key(F.col("company")) if block is None else block).alias("block"),
        tokens(fingerprint(F.col("company"), F.col("title"), F.col("location"))).alias("words"),
    )
    return words.groupBy("block", "words").agg(
        F.min("seq").alias("id"), F.count(F.lit(1)).alias("copies")
    )


def _features(recs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Records with their text and its sketches, which serve any threshold."""
    text = recs.withColumn("text", joined(F.col("words")))
    text = text.withColumn("letters", letter_counts(F.col("text")))
    return cut(text.select(
        "id", "block", "text", F.length("text").alias("size"), *sketch(F.col("letters")), *word_sketch(F.col("words")),
    ))


def _tiles(recs: DataFrame, name: str) -> DataFrame:
    """How many tiles the records of a block make, for blocks of several: at most one row for each ``_TILE_ROWS`` records."""
    tiles = F.ceil(F.count(F.lit(1)) / _TILE_ROWS).cast("int").alias(name)
    return recs.groupBy("block").agg(tiles).filter(F.col(name) > 1)


def _cells(left: DataFrame, right: DataFrame, n_right: int, within: bool) -> DataFrame:
    """One row for each two tiles of a block that meet, with their records as arrays ``left`` and ``right``.

    A record goes to each cell of its tile. ``within``: left and right are the same records; a tile that meets itself is
    in ``left`` alone, and ``right`` is null.
    """
    tiles = _tiles(left, "n_left")
    tiles = tiles.withColumn("n_right", F.col("n_left")) if within else tiles.join(_tiles(right, "n_right"), "block", "full")
    tiles = cut(tiles.fillna(1))
    met = tiles.agg(F.sum(F.col("n_left") * F.col("n_right"))).first()[0] or 0
    parts = max(right.sparkSession.sparkContext.defaultParallelism, min(2 * met, _MAX_HOT), n_right // _PART_ROWS)

    def dealt(recs: DataFrame, own: str, other: str) -> DataFrame:
        rows = recs.join(F.broadcast(tiles), "block", "left")
        number = lambda n: F.coalesce(n, F.lit(1))
        return rows.select(
            "block", F.struct(*COMPARED).alias("rec"), F.pmod(F.hash("id"), number(own)).alias("own"),
            F.explode(F.sequence(F.lit(0), number(other) - 1)).alias("other"),
        )

    if within:
        x, y = F.least("own", "other"), F.greatest("own", "other")
        rows = dealt(left, "n_left", "n_left").select("block", x.alias("x"), y.alias("y"), (F.col("own") == x).alias("is_left"), "rec")
    else:
        rows = dealt(left, "n_left", "n_right").select("block", F.col("own").alias("x"), F.col("other").alias("y"), F.lit(True).alias("is_left"), "rec")
        rows = rows.union(dealt(right, "n_right", "n_left").select("block", "other", "own", F.lit(False), "rec"))
    cells = rows.repartition(parts, "block", "x", "y").groupBy("block", "x", "y").agg(
        F.collect_list(F.when(F.col("is_left"), F.col("rec"))).alias("left"),
        F.collect_list(F.when(~F.col("is_left"), F.col("rec"))).alias("right"),
    )
    return cells.withColumn("right", F.when(F.col("x") != F.col("y"), F.col("right"))) if within else cells


def _similar(
    left: DataFrame, right: DataFrame, threshold: float, n_right: int, ordered: bool, most: int | None = None
) -> DataFrame:
    """Pairs (a, b) of similar records of one block.

    ``ordered``: left and right are the same records, and a pair comes with the lesser id as a, maybe more than once.
    Else a is from left and b from right, and a right record comes with the least of its similar left ones, once for each
    tile that holds one. A cell of more pairs than ``most`` gives one row of nulls in their place.
    """
    most = 2**31 - 2 if most is None else most
    cells = _cells(left, right, n_right, ordered)
    pairs = similar_pairs(right.sparkSession, F.col("left"), F.col("right"), threshold, ordered, _LEAST_COUNTED, most)
    pairs = F.coalesce(pairs, F.array(F.struct(F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))))
    return cells.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b")


def _settle(edges: DataFrame) -> DataFrame | None:
    """Records of a batch that are not leaders, from its similar pairs (a before b).

    A record without an open earlier neighbour leads; its later neighbours do
    not and block nobody.  Repeat on what is left.
    """
    members, live = None, edges
    while not live.isEmpty():
        heads = live.select("a").distinct().join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        hit = cut(live.join(heads, "a", "left_semi").select("b").distinct())
        live = cut(live.join(hit.withColumnRenamed("b", "a"), "a", "left_anti").join(hit, "b", "left_anti"))
        members = hit if members is None else members.union(hit)
    return members


def _last_of_batch(recs: DataFrame, size: int) -> DataFrame:
    """(block, last): the id at place ``size`` of every block that has so many records.

    Keys alone are ranked, in lanes before blocks as a whole, so even a block that
    holds most records brings at most ``_LANES * size`` keys to one task.
    """
    keys = recs.select("block", "id", F.pmod(F.hash("id"), F.lit(_LANES)).alias("_lane"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    keys = keys.withColumn("_n", place("block", "_lane")).filter(F.col("_n") <= size)
    return keys.withColumn("_n", place("block")).filter(F.col("_n") == size).select("block", F.col("id").alias("last"))


def record_leaders(recs: DataFrame, threshold: float = THRESHOLD, first_batch: int = _FIRST_BATCH) -> DataFrame:
    """(id, leader) for every record of :func:`records`.

    What a round settles is written beside what the rounds before it did, so no plan grows with the rounds.

    With a column ``leader`` the records that have one are settled already; within a block they must all come before
    those that have none. Open records then meet the known leaders first, and only what is left goes through the rounds.
    """
    spark, folder, turn = recs.sparkSession, shared_folder(recs.sparkSession), 0
    known = leading = None
    if "leader" in recs.columns:
        known = recs.filter("leader is not null").select("id", "leader")
        if recs.filter("leader is null").isEmpty():
            return known
        standing = recs.filter("leader = id").join(recs.filter("leader is null").select("block").distinct(), "block", "left_semi")
        found = _features(recs.filter("leader is null").unionByName(standing), threshold)
        leading = cut(found.join(known.select("id"), "id", "left_semi"))
        open_ = cut(found.join(known.select("id"), "id", "left_anti"))
    else:
        open_ = _features(recs, threshold)
    n_open, size = open_.count(), first_batch

    def settle(part: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/round={turn}-{name}"
        part.write.mode("overwrite").parquet(path)
        return spark.read.schema(part.schema).parquet(path)

    if not n_open:
        return recs.select("id", F.col("id").alias("leader"))
    if leading is not None:
        near = _similar(leading, open_, threshold, n_open, ordered=False)
        absorbed = settle(near.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader")), "known")
        open_ = cut(open_.join(absorbed.select("id"), "id", "left_anti"))
        n_open = open_.count()
    while n_open:
        turn += 1
        split = open_.join(cut(_last_of_batch(open_, size)), "block", "left")
        first = F.coalesce(F.col("id") <= F.col("last"), F.lit(True))
        batch, rest = cut(split.filter(first).drop("last")), split.filter(~first).drop("last")
        n_batch = batch.count()
        edges = cut(_similar(batch, batch, threshold, n_batch, ordered=True, most=_MOST_PAIRS if size > _FIRST_BATCH else None))
        if size > _FIRST_BATCH and not edges.filter("a is null").isEmpty():
            size = _FIRST_BATCH  # many copies: their leaders are found in a narrow batch, and they go with its round
            continue
        members = _settle(edges)
        if members is None:
            leaders = batch
            settled = batch.select("id", F.col("id").alias("leader"))
        else:
            members = cut(members)
            leaders = cut(batch.join(members.withColumnRenamed("b", "id"), "id", "left_anti"))
            to_leader = edges.join(leaders.select(F.col("id").alias("a")), "a", "left_semi")
            settled = leaders.select("id", F.col("id").alias("leader")).union(
                to_leader.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
            )
        settle(settled, "batch")
        if n_batch == n_open:
            break
        near = _similar(leaders, rest, threshold, n_open - n_batch, ordered=False)
        absorbed = settle(near.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader")), "rest")
        open_ = cut(rest.join(absorbed.select("id"), "id", "left_anti"))
        n_open = open_.count()
        # Widen while most of a batch leads; after a batch of copies, go narrow.
        size = size * _GROWTH if 2 * leaders.count() >= n_batch else max(first_batch, size // 2)
    led = spark.read.schema("id bigint, leader bigint").parquet(f"{folder}/round=*")
    return led if known is None else led.unionByName(known)


def leaders(df: DataFrame, threshold: float = THRESHOLD, block: Column | None = None, **kw) -> DataFrame:
    """(seq, leader_seq) for every posting; a leader points to itself."""
    block = block_key(F.col("company")) if block is None else block
    recs = cut(records(df, block))
    led = recs.join(record_leaders(recs, threshold, **kw), "id").select("block", "words", "copies", "leader")
    words = tokens(fingerprint(F.col("company"), F.col("title"), F.col("location")))
    rows = df.select("seq", block.alias("block"), words.alias("words"))
    return _join_copies(rows, led, recs).select("seq", F.col("leader").alias("leader_seq"))


def keyed(df: DataFrame, block: Column | None = None) -> DataFrame:
    """Postings with what dedup needs of them: ``block``, ``words`` and ``rich``, which is least for the richest copy."""
    return df.withColumns({
        "block": block_key(F.col("company")) if block is None else block,
        "words": tokens(fingerprint(F.col("company"), F.col("title"), F.col("location"))),
        "rich": _rich(),
    })


def relead(rows: DataFrame, changed: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """Leaders after a change: ``rows`` (:func:`keyed`, all there are now) with ``leader_seq`` brought up to date.

    Rows that are new have no ``leader_seq``, the others that of the last time; ``changed`` holds (block, seq) of every
    row that came or went. The rule goes through a block in order of ``seq``, so what precedes its first change keeps
    its leader; only the records behind it are compared, with the leaders before them and with each other. Blocks
    without a change are passed through.
    """
    border = changed.groupBy("block").agg(F.min("seq").alias("border"))
    tagged = rows.join(border, "block", "left")
    touched = written(tagged.filter("border is not null"))
    recs = touched.groupBy("block", "words", "border").agg(
        F.min("seq").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("leader_seq").alias("leader"))
    recs = cut(recs.withColumn("leader", F.when(F.col("id") < F.col("border"), F.col("leader"))).drop("border"))
    led = recs.drop("leader").join(record_leaders(recs, threshold, **kw), "id").select("block", "words", "copies", "leader")
    anew = _join_copies(touched.drop("leader_seq", "border"), led, recs).withColumnRenamed("leader", "leader_seq")
    same = tagged.filter("border is null").select(*rows.columns)
    return same.unionByName(anew.select(*rows.columns))


def _join_copies(rows: DataFrame, led: DataFrame, recs: DataFrame) -> DataFrame:
    """Join postings to their records; the copies of a hot record go to several tasks.

    A record is hot above ``part`` copies, so at most total / part records are,
    and ``part`` grows with the total to keep their table small.
    """
    total = recs.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    part = max(_PART_ROWS, math.ceil(total / _MAX_HOT))
    split = F.when(F.col("copies") > part, F.ceil(F.col("copies") / part).cast("int")).otherwise(1)
    hot = recs.filter(F.col("copies") > part).select("block", "words", split.alias("_split"))
    rows = rows.join(F.broadcast(hot), ["block", "words"], "left")
    rows = rows.withColumn("_salt", F.pmod(F.hash("seq"), F.coalesce("_split", F.lit(1))))
    led = led.withColumn("_salt", F.explode(F.sequence(F.lit(0), split - 1)))
    return rows.join(led, ["block", "words", "_salt"])


def _rich() -> Column:
    return F.struct(
        (-F.length(F.coalesce("description", F.lit("")))).alias("chars"),
        F.when(F.coalesce("posted_date", F.lit("")) != "", 0).otherwise(1).alias("undated"),
        F.col("seq").alias("seq"),
    )


def representatives(df: DataFrame, groups: DataFrame) -> DataFrame:
    """(seq, leader_seq) of the copy to keep per group.

    Longest description, then one with a date, then the earliest.  A map-side
    aggregation, so the size of a group does not matter.
    """
    rich = df.select("seq", _rich().alias("rich"))
    return (
        rich.join(groups, "seq").groupBy("leader_seq").agg(F.min("rich").alias("rich"))
        .select(F.col("rich.seq").alias("seq"), "leader_seq")
    )


def fuzzy_dedup(df: DataFrame, threshold: float = THRESHOLD, block: Column | None = None, **kw) -> DataFrame:
    """Richest copy of every group, whole rows, in the order the groups began."""
    best = representatives(df, leaders(df, threshold, block, **kw))
    rest = [c for c in df.columns if c != "seq"]
    return df.join(best, "seq").select(F.col("leader_seq").alias("seq"), *rest)
