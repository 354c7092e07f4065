"""One query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as I
from postsieve.functions import fields, numbers, similarity, text
from postsieve.operators import dedup, gates, history, normalize, publish, recheck, score
from postsieve.plans import daily, publication
from postsieve.plans.deltas import DeltaTable
from postsieve.plans.durable import SnapshotTable, cut, shared_folder
from postsieve.policy import Policy
from postsieve.schema import as_day, conform, with_missing
from postsieve.sources import agency, board, listings, union
from postsieve.streaming import incremental, streaks

P = Policy()
B1 = P.but(german_max_level="B1")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def detected(spark: SparkSession, sf: str) -> DataFrame:
    """Postings with role and language, before any row is dropped."""
    return normalize.detect(I.postings(spark, sf), P)


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize(I.postings(spark, sf), P)


def similarity_of(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Cosine of each posting's vector with the profile vector (number 0)."""
    vectors = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")
    profile = vectors.filter("seq = 0").first()["embedding"]
    sims = vectors.select("seq", score.dot_with(F.col("embedding"), profile).alias("sim"))
    return rows.join(sims, "seq", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def ranked_slice(spark: SparkSession, sf: str, day: int) -> DataFrame:
    """A day's selection, one row per URL: the postings whose dates that day's run finds."""
    rows = normalize.clean_fields(I.postings(spark, sf).filter(I.DAYS[day]))
    return normalize.first_by(rows, ["url"], "seq").select(
        "url", "title", "company", "location", "source", "description",
        F.lit("").alias("language"), F.lit("").alias("role_type"), "posted_date",
        (F.col("seq") % 101).cast("double").alias("fit_score"), F.lit("").alias("fit_reason"), "seq",
    )


def dismissals(spark: SparkSession, sf: str) -> DataFrame:
    """URLs of the first day's rows whose document is labelled toxic."""
    toxic = I.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("seq"))
    return ranked_slice(spark, sf, 0).join(toxic, "seq", "left_semi").select("url", F.lit("dismissed").alias("status"))


def first_history(spark: SparkSession, sf: str) -> DataFrame:
    start = history.merge(history.empty_history(spark), ranked_slice(spark, sf, 0), "2024-01-10")
    return history.set_status(start.drop("action"), dismissals(spark, sf))


def shown(rows: DataFrame, *extra: str) -> DataFrame:
    day = lambda c: F.col(c).cast("string").alias(c)
    return rows.select("url", "title", "fit_score", day("first_seen"), day("last_seen"), "status", *extra)


# Text, dates and normalisation


@query
def text_keywords(spark, sf):
    blob, listed = gates.body_text(), (*P.domains, *P.must_have_any, "e-mail", "5+ years")
    rows = I.postings(spark, sf).withColumn("words", text.words_present(blob, listed))
    words = F.col("words")
    return rows.select(
        "seq",
        text.contains(blob, "ai", words).alias("has_ai"),
        text.any_match(blob, P.must_have_any, words).alias("has_any"),
        F.array_join(text.matched(blob, listed, words), ",").alias("hits"),
        F.array_join(text.matched(F.col("location"), P.locations), ",").alias("places"),
    )


@query
def text_quotes(spark, sf):
    blob = gates.body_text()
    return I.postings(spark, sf).select(
        "seq",
        text.quote_around(blob, "ai", 30).alias("quote_ai"),
        text.quote_around(blob, "deep learning", 12).alias("quote_dl"),
        text.snippet(*score._ENGLISH_QUOTE, blob).alias("english"),
        text.snippet(*score._GERMAN_QUOTE, blob).alias("german"),
    )


@query
def text_dates(spark, sf):
    rows = I.view(spark, sf, I.DATES)
    return rows.select(
        "seq", text.parse_date(F.col("raw")).cast("string").alias("posted_on"),
        text.age_days(F.col("raw"), as_day(I.AS_OF)).cast("bigint").alias("age"),
    )


@query
def clean_title(spark, sf):
    return I.view(spark, sf, I.TITLES).select("seq", fields.clean_title(F.col("raw")).alias("title"))


@query
def canonical_url(spark, sf):
    return I.view(spark, sf, I.URLS).select("page_id", fields.canonical_url(F.col("raw")).alias("url"))


@query
def role_and_language(spark, sf):
    own = I.table(spark, sf, "documents").select(
        (F.col("doc_id") + 1_000_000_000).alias("seq"), F.lit("").alias("title"), F.col("text").alias("description")
    )
    return normalize.detect(with_missing(I.postings(spark, sf).unionByName(with_missing(own))), P).select(
        "seq", "role_type", "language"
    )


@query
def normalize_postings(spark, sf):
    return normalized(spark, sf).select(
        "seq", "title", "company", "location", "source", "url", "role_type", "language", "posted_date",
        F.length("description").cast("bigint").alias("chars"),
    )


# Deduplication


@query
def dedup_features(spark, sf):
    return I.view(spark, sf, I.NEAR).select(
        "seq", similarity.block_key(F.col("location")).alias("block"),
        similarity.fingerprint(F.col("company"), F.col("title"), F.col("location")).alias("fingerprint"),
    )


@query
def dedup_leaders(spark, sf):
    return dedup.leaders(I.view(spark, sf, I.NEAR))


@query
def dedup_kept(spark, sf):
    kept = dedup.fuzzy_dedup(I.view(spark, sf, I.NEAR))
    return kept.select("seq", "title", "location", F.length("description").cast("bigint").alias("chars"), "posted_date")


@query
def dedup_richest_copy(spark, sf):
    rows = I.view(spark, sf, I.NEAR)
    groups = rows.select("seq", F.min("seq").over(dedup.Window.partitionBy("title")).alias("leader_seq"))
    return dedup.representatives(rows, groups)


# Gates


@query
def gate_flags(spark, sf):
    flags = gates.gate_flags(P, I.AS_OF)
    return detected(spark, sf).select("seq", *[flags[g].alias(g) for g in gates.GATES])


@query
def gate_reasons(spark, sf):
    rows = gates.with_reason(detected(spark, sf), P, I.AS_OF)
    return rows.select("seq", F.coalesce("reject_reason", F.lit("passed")).alias("reason"))


@query
def gate_dropoff(spark, sf):
    return gates.dropoff(detected(spark, sf), P, I.AS_OF)


@query
def gate_survivors(spark, sf):
    return gates.gate(normalized(spark, sf), P, I.AS_OF).select("seq", "title", "url")


@query
def gate_german_level(spark, sf):
    blob = gates.body_text()
    return I.postings(spark, sf).select(
        "seq", *[gates.german_too_high(blob, m).alias(f"over_{m.lower()}") for m in ("A2", "B1", "C1", "C2", "none")]
    )


@query
def gate_empty_lists(spark, sf):
    bare = P.but(domains=(), must_have_any=(), role_types=(), exclude_words=())
    return gates.dropoff(detected(spark, sf), bare, I.AS_OF)


# Scores


@query
def rank_semantic(spark, sf):
    vectors = I.table(spark, sf, "embeddings")
    profile = vectors.filter("vec_id = 0").first()["embedding"]
    sim = score.dot_with(F.col("embedding"), profile)
    w = P.weights
    return vectors.select(
        "vec_id", F.round(sim, 6).alias("sim"),
        F.round(numbers.rescale(sim, w.sim_floor, w.sim_ceil), 6).alias("semantic"),
        F.round(score.cosine(F.col("embedding"), F.col("embedding")), 6).alias("self"),
    )


@query
def rank_encoded(spark, sf):
    """The caller's batch encoder: here the shares of five letters, as a vector of length 1."""
    @F.pandas_udf("array<double>")
    def letter_shares(texts: pd.Series) -> pd.Series:
        counts = np.stack([texts.str.count(letter).to_numpy(float) for letter in "aeiou"], axis=1)
        lengths = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return pd.Series(list(np.divide(counts, lengths, out=np.zeros_like(counts), where=lengths > 0)))

    profile = [0.5, 0.5, 0.5, 0.5, 0.0]
    rows = score.with_similarity(detected(spark, sf), letter_shares, profile)
    r = lambda c: F.round(c, 6).alias(c)
    return score.components(rows, P, I.AS_OF, F.col("sim")).select("seq", r("sim"), r("semantic"))


@query
def rank_components(spark, sf):
    rows = score.components(detected(spark, sf), P, I.AS_OF)
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select("seq", r("role"), r("domain"), r("recency"), r("language_fit"))


@query
def rank_scores(spark, sf):
    return score.score(detected(spark, sf), P, I.AS_OF).select("seq", "fit_score")


@query
def rank_scores_with_vectors(spark, sf):
    rows = similarity_of(spark, sf, detected(spark, sf))
    return score.score(rows, P, I.AS_OF, F.col("sim")).select("seq", "fit_score")


@query
def rank_reasons(spark, sf):
    return score.score(detected(spark, sf), P, I.AS_OF).select("seq", "fit_reason")


@query
def rank_spread(spark, sf):
    return score.spread(score.score(detected(spark, sf), P, I.AS_OF))


@query
def rank_select(spark, sf):
    rows = score.score(gates.gate(normalized(spark, sf), P, I.AS_OF), P, I.AS_OF)
    return score.select_top(rows, P).select("seq", "fit_score")


@query
def rank_select_by_company(spark, sf):
    policy = P.but(min_fit_score=80.0, max_per_day=5, min_results=8, floor_fit_score=40.0)
    rows = score.score(detected(spark, sf), policy, I.AS_OF)
    return score.select_top(rows, policy, by=["company"]).select("company", "seq", "fit_score")


# History


@query
def store_merge(spark, sf):
    merged = history.merge(first_history(spark, sf), ranked_slice(spark, sf, 1), "2024-01-11")
    return shown(merged, F.coalesce("action", F.lit("untouched")).alias("action"))


@query
def store_merge_small(spark, sf):
    """One day's new postings against a history that holds them all."""
    merged = history.merge(second_history(spark, sf), ranked_slice(spark, sf, 3), "2024-01-14")
    return shown(merged, F.coalesce("action", F.lit("untouched")).alias("action"))


@query
def store_actions(spark, sf):
    merged = history.merge(first_history(spark, sf), ranked_slice(spark, sf, 1), "2024-01-11")
    return history.action_counts(merged)


def second_history(spark, sf):
    return history.merge(first_history(spark, sf), ranked_slice(spark, sf, 1), "2024-01-11").drop("action")


@query
def store_expire(spark, sf):
    return shown(history.expire(second_history(spark, sf), 21, "2024-02-01"))


@query
def store_prune(spark, sf):
    return shown(history.prune(history.expire(second_history(spark, sf), 21, "2024-02-10"), 30, "2024-02-10"))


@query
def store_set_status(spark, sf):
    changes = ranked_slice(spark, sf, 2).select("url", F.lit("applied").alias("status"), "seq")
    return shown(history.set_status(second_history(spark, sf), changes, order="seq"))


@query
def store_list_active(spark, sf):
    rows = history.list_active(
        second_history(spark, sf), source="AGENTUR", city="köln", new_today=True, min_score=30, limit=40,
        as_of="2024-01-11",
    )
    return shown(rows, "source", "location")


@query
def store_list_by_score(spark, sf):
    return shown(history.list_active(second_history(spark, sf), min_score=60, limit=25, as_of="2024-01-11"), "source", "location")


@query
def store_list_clustered(spark, sf):
    """The best open rows of a stored history that is laid out by status and score."""
    store = SnapshotTable(spark, shared_folder(spark), partition_by=("status",), range_by=("fit_score",))
    stored = store.write(second_history(spark, sf), 1)
    return shown(history.list_active(stored, min_score=60, limit=25, as_of="2024-01-11"), "source", "location")


@query
def store_list_by_place(spark, sf):
    rows = history.list_active(second_history(spark, sf), source="indeed", city="M_nchen", as_of="2024-01-11")
    return shown(rows, "source", "location")


@query
def store_counts(spark, sf):
    return history.counts(second_history(spark, sf), "2024-01-11")


@query
def store_last_run(spark, sf):
    log = I.table(spark, sf, "events").select("event_type", F.col("ts").cast("string").alias("run_ts"), "event_id")
    found = history.last_value(log.filter("event_type = 'error'"), "run_ts", "event_id", "never")
    return found.unionByName(history.last_value(log.filter("event_type = 'none'"), "run_ts", "event_id", "never"))


@query
def store_upgrade(spark, sf):
    return shown(history.upgrade(second_history(spark, sf).drop("last_seen")))


REPLAY = (("2024-01-10", 0), ("2024-01-11", 1), ("2024-02-10", 2), ("2024-02-11", 0), ("2024-09-01", None))


@query
def store_replay(spark, sf):
    """Five days of merge, expire (21) and prune (180) with their counts."""
    state, days = history.empty_history(spark), []
    for day, (as_of, chosen) in enumerate(REPLAY, start=1):
        new = ranked_slice(spark, sf, chosen) if chosen is not None else ranked_slice(spark, sf, 0).limit(0)
        merged = cut(history.merge(state, new, as_of))
        expired = history.expire(merged, 21, as_of)
        stale, gone = history.goes_stale(21, as_of), history.outlives(180, as_of)
        kept = history.prune(expired, 180, as_of)
        days.append(
            merged.agg(
                *[F.count_if(F.col("action") == a).alias(a) for a in history.ACTIONS],
                F.count_if(stale).alias("expired"),
            ).withColumns({"day": F.lit(day).cast("bigint"), "_k": F.lit(1)}).join(
                expired.agg(F.count_if(gone).alias("pruned"), F.count_if(~gone).alias("rows_after"))
                .withColumn("_k", F.lit(1)), "_k",
            ).drop("_k")
        )
        state = kept.drop("action")
        if day == 1:
            state = history.set_status(state, dismissals(spark, sf))
    return reduce(lambda a, b: a.unionByName(b), days)


@query
def store_delta_replay(spark, sf):
    """The same five days on a history of a base and deltas; two of the commits fold them into a base."""
    store, days, version = DeltaTable(spark, shared_folder(spark), compact_after=2, buckets=4), [], 0
    for day, (as_of, chosen) in enumerate(REPLAY, start=1):
        new = ranked_slice(spark, sf, chosen) if chosen is not None else ranked_slice(spark, sf, 0).limit(0)
        version += 1
        counts = store.commit(cut(new), as_of, version, 21, 180)
        days.append({**counts, "day": day, "rows_after": store.read().count()})
        if day == 1:
            version += 1
            store.set_status(dismissals(spark, sf), as_of, version)
    return spark.createDataFrame([tuple(d.values()) for d in days], ", ".join(f"{k} bigint" for k in days[0]))


# Publication


def open_rows(spark, sf):
    rows = score.score(detected(spark, sf), P, I.AS_OF)
    seen = F.date_sub(as_day(I.AS_OF), (F.col("seq") % 4).cast("int"))
    return rows.withColumns({"first_seen": seen, "last_seen": seen, "status": F.lit("new"),
                             "url": F.concat("url", F.lit("&n="), F.col("seq").cast("string"))})


@query
def sheet_all_open(spark, sf):
    rows = publish.sheets(open_rows(spark, sf), I.AS_OF)[0]
    return rows.drop("fit_reason").withColumns({
        "age_days": F.col("age_days").cast("bigint"), "band": F.coalesce("band", F.lit("")),
    })


@query
def sheet_new_today(spark, sf):
    return publish.sheets(open_rows(spark, sf), I.AS_OF)[1].select("new", "fit_score", "title", "apply_link")


@query
def sheet_dated(spark, sf):
    rows = publish.dated_sheets(open_rows(spark, sf), I.AS_OF)
    return rows.groupBy(F.col("run_date").cast("string").alias("run_date"), "sheet", F.coalesce("band", F.lit("")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("fit_score"), 1).alias("total")
    )


@query
def keep_newest(spark, sf):
    published = I.postings(spark, sf).select("seq", F.col("posted_date").alias("run_date")).filter("run_date is not null")
    return publish.keep_newest(published, 5)


@query
def digest_pick(spark, sf):
    return publish.digest_pick(open_rows(spark, sf), P, I.AS_OF).select(
        F.col("rk").cast("bigint").alias("rk"), "seq", "fit_score"
    )


@query
def digest_message(spark, sf):
    return publish.digest(open_rows(spark, sf), P.but(top_n=40), I.AS_OF, sheet_path="a&b.parquet")


@query
def digest_by_company(spark, sf):
    return publish.digest(open_rows(spark, sf), P.but(top_n=3, skip_when_empty=True), I.AS_OF, by=["company"]).select(
        "company", "total_open", "new_count", "headline", "message"
    )


# Recheck


def recheck_base(spark, sf):
    return open_rows(spark, sf).withColumns({
        "status": F.when(F.col("seq") % 10 == 0, "applied").otherwise("new"),
        "fit_score": (F.col("seq") % 101).cast("double"), "fit_reason": F.lit("old"),
    }).drop("seq")


def rechecked(spark, sf):
    return recheck.recheck(recheck_base(spark, sf), P, "2024-01-12")


@query
def recheck_report(spark, sf):
    return rechecked(spark, sf)[0]


@query
def recheck_history(spark, sf):
    return shown(rechecked(spark, sf)[1], (F.col("fit_reason") == "old").alias("old_reason"))


@query
def recheck_store(spark, sf):
    """A stored history after a recheck has committed the next one."""
    store = SnapshotTable(spark, shared_folder(spark))
    store.write(recheck_base(spark, sf), 1)
    publication.recheck_store(spark, P, store, "2024-01-12", 2)
    return shown(store.read(), (F.col("fit_reason") == "old").alias("old_reason"))


@query
def recheck_published(spark, sf):
    """The sheets that a recheck of a stored history leaves behind."""
    folder = shared_folder(spark)
    store = SnapshotTable(spark, f"{folder}/history")
    store.write(recheck_base(spark, sf), 1)
    publication.recheck_store(spark, P, store, "2024-01-12", 2, f"{folder}/out")
    rows = spark.read.parquet(f"{folder}/out/sheets")
    return rows.select(F.col("run_date").cast("string").alias("run_date"), "sheet", "title", "apply_link", "fit_score")


# Sources


@query
def board_rows(spark, sf):
    return board.board_rows(I.view(spark, sf, I.BOARD), P).select(
        "title", "company", "location", "source", "url", "posted_date", F.length("description").cast("bigint").alias("chars")
    )


@query
def agency_items(spark, sf):
    return agency.agency_items(I.view(spark, sf, I.AGENCY_PAGES), P).select(
        "page", "refnr", "title", F.coalesce("item_company", F.lit("")).alias("company"), "location",
        F.substring("item_posted", 1, 10).alias("posted"),
    )


@query
def agency_postings(spark, sf):
    return agency.agency_json(
        I.view(spark, sf, I.AGENCY_PAGES), I.view(spark, sf, I.AGENCY_DETAILS), P
    ).select("title", "company", "location", "source", "url", "description", "posted_date")


@query
def agency_cap(spark, sf):
    items = agency.hinted(agency.agency_items(I.view(spark, sf, I.AGENCY_PAGES), P))
    return agency.cap_pages(items, 100).groupBy("page").agg(F.count(F.lit(1)).alias("n"))


def site_rows(spark):
    near = {"company": ".card > span.firm, div.firm, p.big", "location": ".city"}
    policy = P.but(sites=(
        {"url": "https://s0.example.org", "name": "site0", "selectors": near},
        {"url": "https://s1.example.org", "name": "site1", "selectors": {}},
    ))
    return listings.site_table(spark, policy)


@query
def page_links(spark, sf):
    pages = listings.of_sites(I.view(spark, sf, I.LISTING_PAGES), site_rows(spark))
    return listings.page_links(pages, site_rows(spark)).select(
        "page_id", "site", "title", "url", "company", "location", "snippet"
    )


OWN_HINTS = (r"(tion|ment|heit)", r"(ciónes|erth)")


@query
def page_own_links(spark, sf):
    """The pages' own links, by hints that fit their words."""
    pages = I.view(spark, sf, I.OWN_PAGES)
    sites = listings.site_table(spark, P.but(sites=({"url": "https://s0.example.org", "name": "site0"},)))
    return listings.page_links(pages, sites, *OWN_HINTS).select("page_id", "title", "url")


@query
def normalize_odd(spark, sf):
    """Blank titles and URLs, padded names and long dates."""
    rows = normalize.normalize(conform(I.view(spark, sf, I.ODD)), P)
    return rows.select("seq", "title", "company", "location", "url", "posted_date")


@query
def rank_nothing(spark, sf):
    """A day on which every posting is rejected: counts stay, nothing is selected."""
    rows = score.score(gates.gate(normalized(spark, sf), P.but(domains=()), I.AS_OF), P, I.AS_OF)
    chosen = score.select_top(rows, P).agg(F.count(F.lit(1)).alias("chosen"))
    return chosen.join(I.postings(spark, sf).agg(F.count(F.lit(1)).alias("postings")))


@query
def markdown_links(spark, sf):
    return listings.markdown_links(I.view(spark, sf, I.LISTING_MARKDOWN)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "site", "title", "url", "snippet"
    )


@query
def listing_postings(spark, sf):
    links = listings.markdown_links(I.view(spark, sf, I.LISTING_MARKDOWN))
    return listings.listings_to_postings(links).select("title", "company", "location", "source", "url", "description")


def all_sources(spark, sf):
    pages = listings.of_sites(I.view(spark, sf, I.LISTING_PAGES), site_rows(spark))
    return [
        board.board_rows(I.view(spark, sf, I.BOARD), P),
        agency.agency_json(I.view(spark, sf, I.AGENCY_PAGES), I.view(spark, sf, I.AGENCY_DETAILS), P),
        listings.listings_to_postings(listings.page_links(pages, site_rows(spark))),
    ]


@query
def source_counts(spark, sf):
    return union.source_counts(union.union_sources(all_sources(spark, sf)))


# Streaks, streams and whole runs


def _log(spark, sf):
    return I.view(spark, sf, I.FETCH_LOG)


@query
def failure_streaks(spark, sf):
    rows = streaks.failure_streaks(_log(spark, sf), "user_id", F.col("ok"), ("ts", "event_id"))
    return rows.select("event_id", "user_id", "streak", "tripped")


@query
def failure_streak_state(spark, sf):
    return streaks.end_state(_log(spark, sf), "user_id", F.col("ok"), ("ts", "event_id"))


def _in_parts(rows: DataFrame, parts: int, order: str, start) -> str:
    """Write rows one part after the other; after each, let a stream over the folder take in what has come."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.floor((F.col(order) - low) * parts / (high - low + 1))
    for i in range(parts):
        rows.filter(part == i).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return folder


@query
def failure_streak_stream(spark, sf):
    folder = _in_parts(_log(spark, sf), 3, "event_id", lambda stream, folder: streaks.start_streaks(
        stream, "user_id", F.col("ok"), ("ts", "event_id"), None,
        SnapshotTable(spark, f"{folder}/state"), f"{folder}/out", f"{folder}/checkpoint",
    ))
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "streak", "tripped")


@query
def incremental_history(spark, sf):
    """A day's postings in three micro-batches; the history must be that of one run over all of them."""
    folder = _in_parts(I.postings(spark, sf), 3, "seq", lambda stream, folder: incremental.start_incremental(
        stream, P, SnapshotTable(spark, f"{folder}/history"), I.AS_OF, f"{folder}/checkpoint"))
    return shown(SnapshotTable(spark, f"{folder}/history").read())


@query
def daily_run_summary(spark, sf):
    folder = shared_folder(spark)
    result = daily.run(spark, P, [I.postings(spark, sf)], SnapshotTable(spark, folder), I.AS_OF, 1)
    return result.summary_row(spark)


def _published_day(spark, sf) -> str:
    folder = shared_folder(spark)
    result = daily.run(spark, P, [I.postings(spark, sf)], SnapshotTable(spark, f"{folder}/history"), I.AS_OF, 1)
    publication.publish(spark, result, P, folder)
    return folder


@query
def run_published(spark, sf):
    """The sheets a day's run leaves behind."""
    rows = spark.read.parquet(f"{_published_day(spark, sf)}/sheets")
    return rows.select(F.col("run_date").cast("string").alias("run_date"), "sheet", "title", "apply_link", "fit_score")


@query
def run_log(spark, sf):
    """The log after a day's run, and the day that the next run finds there."""
    folder = _published_day(spark, sf)
    last = publication.last_run(spark, folder).select(F.col("run_date").alias("last_run"))
    return publication.run_log(spark, folder).join(last, F.col("run_date") == F.col("last_run"))
