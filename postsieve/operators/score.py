"""Fit score from 0 to 100, its quoted reason, and the selection of the best."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.fields import role_outputs
from postsieve.functions.numbers import clamp, rescale, round_tenth, whole_text
from postsieve.functions.text import age_days, any_match, contains, matched, quote_around_any, snippet, words_present
from postsieve.operators.gates import body_text, german_too_high
from postsieve.policy import Policy
from postsieve.schema import as_day, text_or_empty

COMPONENTS = ("semantic", "role", "domain", "recency", "language")

# Snippets quoted for the two languages.
_ENGLISH_QUOTE = (r"(english|working\s*language)", 40)
_GERMAN_QUOTE = (r"(verhandlungssicher|flie[sß]end|deutschkenntnisse|german\s*(b2|c1|c2))", 30)
_REASON_CHARS = 400


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equally long vectors, summed in double."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero vector gives 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def dot_with(vector: Column, profile: Sequence[float]) -> Column:
    """Dot product with one known vector of any length."""
    return dot(vector, F.lit([float(p) for p in profile]))


def embedding_text() -> Column:
    """The text a batch encoder is given for one posting; the encoder decides how much of it it reads."""
    return F.concat_ws("\n", "title", "company", "location", text_or_empty("description"))


def with_similarity(
    df: DataFrame, encode: Callable[[Column], Column], profile: Sequence[float]
) -> DataFrame:
    """Add ``sim`` from a user-supplied vectorised encoder (a ``pandas_udf`` that
    returns L2-normalised vectors) and the encoded profile."""
    return df.withColumn("sim", dot_with(encode(embedding_text()), profile))


def hits(df: DataFrame, policy: Policy) -> DataFrame:
    """Keyword hits and language facts that scores and reasons share."""
    title, description = text_or_empty("title"), text_or_empty("description")
    text = body_text()
    # each text is read once for all lists; title and description are parted by a space, which parts words as well
    lists = (policy.role_types, policy.domains, policy.exclude_words, ("english",))
    df = df.withColumns({"_words_title": words_present(title, *lists), "_words_body": words_present(description, *lists)})
    in_title, in_body = F.col("_words_title"), F.col("_words_body")
    df = df.withColumn("_words", F.array_union(in_title, in_body))
    df = df.withColumns({
        "_role_title": matched(title, policy.role_types, in_title),
        "_role_body": matched(description, policy.role_types, in_body),
        "_domain_title": matched(title, policy.domains, in_title),
        "_domain_body": matched(description, policy.domains, in_body),
        "_english": (text_or_empty("language") == "en") | contains(text, "english", F.col("_words")),
        "_german": german_too_high(text, policy.german_max_level),
        "_excluded": any_match(text, policy.exclude_words, F.col("_words")),
    })
    role_type = text_or_empty("role_type")
    return df.withColumns({
        "_role_hits": F.when(F.size("_role_title") > 0, F.col("_role_title"))
        .when(F.size("_role_body") > 0, F.col("_role_body"))
        .when(role_type != "", F.array(role_type))
        .otherwise(F.array().cast("array<string>")),
        "_domain_hits": F.array_union("_domain_title", "_domain_body"),
    })


def components(df: DataFrame, policy: Policy, as_of, sim: Column | None = None) -> DataFrame:
    """Add the five component scores, each between 0 and 1."""
    w = policy.weights
    df = hits(df, policy).withColumn("_age", age_days(F.col("posted_date"), as_day(as_of)))
    age = F.col("_age")
    limit = policy.freshness_days
    known_age = F.lit(1.0) if limit <= 0 else F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(float(limit)))
    domain_base = F.when(F.size("_domain_title") > 0, 0.7).otherwise(0.25)
    domain_depth = F.least(F.lit(0.3), F.lit(0.1) * F.size("_domain_hits"))
    language = (
        F.when(F.col("_english"), 1.0).when(F.col("language") == "de", 0.2).otherwise(0.5)
        if policy.prefer_english
        else F.lit(0.5)
    )
    return df.withColumns({
        "semantic": F.lit(0.0) if sim is None else rescale(sim, w.sim_floor, w.sim_ceil),
        "role": F.when(F.size("_role_title") > 0, 1.0)
        .when(F.size("_role_body") > 0, 0.5)
        .when(text_or_empty("role_type") != "", 0.4)
        .otherwise(0.0),
        "domain": F.when(F.size("_domain_hits") == 0, 0.0)
        .otherwise(F.least(F.lit(1.0), domain_base + domain_depth)),
        "recency": F.when(age.isNull(), 0.5).otherwise(known_age),
        "language_fit": language,
    })


def score(
    df: DataFrame, policy: Policy, as_of, sim: Column | None = None, reason: bool = True
) -> DataFrame:
    """Add ``fit_score`` and, unless switched off, ``fit_reason``.

    ``sim`` is a cosine column.  Without one the semantic weight is 0 for the
    whole batch, so scores still span the full range.
    """
    w = policy.weights
    keep = df.columns
    weights = {name: getattr(w, name) for name in COMPONENTS}
    if sim is None:
        weights["semantic"] = 0.0
    total = sum(weights.values()) or 1.0
    sources = {name: "language_fit" if name == "language" else name for name in COMPONENTS}

    df = components(df, policy, as_of, sim)
    if sim is not None:
        df = df.withColumn("_sim", sim)
    df = df.withColumns({f"_pt_{n}": F.col(sources[n]) * F.lit(weights[n]) for n in COMPONENTS})
    points = F.lit(0.0)
    for name in COMPONENTS:
        points = points + F.col(f"_pt_{name}")
    raw = F.lit(100.0) * points / F.lit(total)
    raw = raw - F.when(F.col("_german"), w.german_penalty).otherwise(0.0)
    raw = raw - F.when(F.col("_excluded"), w.exclude_penalty).otherwise(0.0)
    df = df.withColumn("_raw", clamp(raw, 0.0, 100.0)).withColumn("fit_score", round_tenth(F.col("_raw")))
    added = ["fit_score"]
    if reason:
        df = _with_reason(df, policy, sim is not None)
        added.append("fit_reason")
    return df.select(*[c for c in keep if c not in added], *added)


def _with_reason(df: DataFrame, policy: Policy, with_sim: bool) -> DataFrame:
    """Add ``fit_reason``.  Quotes are columns of their own: each is used twice
    and would else be written into the plan, and run, twice."""
    text = F.concat_ws(". ", text_or_empty("title"), text_or_empty("description"))
    known_roles = [*policy.role_types, *[label for _, label in role_outputs(policy.role_types)]]
    df = df.withColumns({
        "_text": text,
        "_role_hit": F.get("_role_hits", F.lit(0)),
        "_domain_hit": F.get("_domain_hits", F.lit(0)),
        "_say_english": F.col("_english") & F.lit(policy.prefer_english),
    })
    text = F.col("_text")
    df = df.withColumns({
        "_q_role": F.when(
            F.col("_role_hit").isNotNull(), quote_around_any(text, F.col("_role_hit"), known_roles, 20)
        ),
        "_q_domain": F.when(
            F.col("_domain_hit").isNotNull(), quote_around_any(text, F.col("_domain_hit"), policy.domains, 25)
        ),
        "_q_english": F.when(F.col("_say_english"), snippet(*_ENGLISH_QUOTE, text)),
        "_q_german": F.when(F.col("_german"), snippet(*_GERMAN_QUOTE, text)),
    })

    def part(label: str, quote: str, bare: Column) -> Column:
        quoted = F.concat(F.lit(f"{label}: «"), F.col(quote), F.lit("»"))
        return F.when(F.col(quote) != "", quoted).when(F.col(quote) == "", bare)

    shown = [
        F.when(F.col(f"_pt_{n}") != 0, F.concat(F.lit(f"{n}="), whole_text(F.col(f"_pt_{n}"))))
        for n in COMPONENTS
    ]
    if with_sim:
        shown.append(F.concat(F.lit("sim="), F.format_string("%.2f", F.col("_sim"))))
    full = F.concat_ws(
        " · ",
        part("Role", "_q_role", F.concat(F.lit("Role: "), F.col("_role_hit"))),
        part("Domain", "_q_domain", F.concat(
            F.lit("Domain: "), F.array_join(F.slice("_domain_hits", 1, 3), ", ")
        )),
        part("English", "_q_english", F.lit("English working language detected")),
        part("German bar (penalty)", "_q_german", F.lit("German above A2 required")),
        F.concat(F.lit("["), F.concat_ws(" ", *shown), F.lit("]")),
    )
    return df.withColumn("fit_reason", F.substring(full, 1, _REASON_CHARS))


def spread(df: DataFrame) -> DataFrame:
    """Top, middle and bottom score in one aggregation.

    The middle is the element at position n // 2 of the descending list.
    """
    return df.agg(
        F.max("fit_score").alias("top"),
        F.expr("percentile_disc(0.5) within group (order by fit_score)").alias("median"),
        F.min("fit_score").alias("bottom"),
    )


def select_top(df: DataFrame, policy: Policy, by: Sequence[str] | None = None) -> DataFrame:
    """Best rows above the minimum, topped up to ``min_results`` above the floor.

    Without ``by`` only the first K = max(max_per_day, min_results) rows of a
    distributed top-k reach one task.  With ``by`` the same rule holds per key
    and the rank limit is applied before the shuffle.
    """
    k = max(policy.max_per_day, policy.min_results, 0)
    order = [F.desc("fit_score"), F.asc("seq")]
    if by:
        ranked = df.withColumn("_rk", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        everything = Window.partitionBy(*by)
    else:
        df = df.orderBy(*order).limit(k)
        ranked = df.withColumn("_rk", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
        everything = Window.partitionBy(F.lit(0))
    ranked = ranked.filter(F.col("_rk") <= k)
    above = F.count_if(F.col("fit_score") >= policy.min_fit_score).over(everything)
    ranked = ranked.withColumn("_n", F.least(above, F.lit(policy.max_per_day)))
    topped_up = (
        F.lit(policy.min_results > 0)
        & (F.col("_n") < policy.min_results)
        & (F.col("_rk") <= policy.min_results)
        & (F.col("fit_score") >= policy.floor_fit_score)
    )
    return ranked.filter((F.col("_rk") <= F.col("_n")) | topped_up).drop("_rk", "_n")
