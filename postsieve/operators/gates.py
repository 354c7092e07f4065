"""Rule gates: the first gate a posting fails is its reject reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.text import age_days, any_match, pattern
from postsieve.policy import Policy
from postsieve.schema import as_day, text_or_empty

GATES = (
    "senior", "role", "domain", "location", "freshness", "exclude", "german",
    "must_have", "thin",
)

# Patterns and word lists of the gates.
_SENIOR = (
    r"\b(senior|sr\.?|lead|principal|staff|head\s+of|director|manager|architect|"
    r"chief|vp|expert|teamleiter|abteilungsleiter)\b"
)
_ABROAD_ONLY = (
    r"\b(us\s*only|usa\s*only|united\s*states\s*only|uk\s*only|india\s*only|"
    r"canada\s*only|must\s*be\s*(located|based)\s*in\s*the\s*(us|usa|uk|india))\b"
)
_REMOTE = r"\b(remote|homeoffice|home\s*office|hybrid|telearbeit)\b"
_HOME_REGION = ("germany", "deutschland", "europe", "eu")
_GERMAN_FINE = (
    r"german\s*(is\s*)?(optional|a\s*plus|nice\s*to\s*have|not\s*required)",
    r"deutsch\s*(von\s*vorteil|wünschenswert|optional|nicht\s*erforderlich)",
    r"(no|kein)\s*(german|deutsch)\s*(required|nötig|erforderlich)",
    r"english\s*(only|speaking|working\s*language)",
)
# Patterns that ask for strong German as such, and patterns that name a level
# together with the group holding it.
_GERMAN_STRONG = (
    r"verhandlungssicher",
    r"flie[sß]end\s*(in\s*)?(deutsch|german)",
    r"deutsch\s*(muttersprach|native)",
    r"sehr\s*gute\s*Deutschkenntnisse",
)
_GERMAN_LEVEL = (
    (r"(german|deutsch)\s*(level|kenntnisse|skills)?\s*:?\s*(B1|B2|C1|C2)", 3),
    (r"(mindestens|at\s*least|min\.?)\s*(B1|B2|C1|C2)", 2),
    (r"Deutschkenntnisse\s*(mindestens\s*)?(B1|B2|C1|C2)", 2),
)
_LEVELS = {"A1": 1, "A2": 2, "B1": 3, "B2": 4, "C1": 5, "C2": 6}


def body_text() -> Column:
    """Title and description as one text."""
    return F.concat_ws(" ", text_or_empty("title"), text_or_empty("description"))


def senior_title(title: Column) -> Column:
    return title.rlike(pattern(_SENIOR, "slphdmacvet"))


def german_too_high(text: Column, german_max: str) -> Column:
    """True where the text asks for more German than the maximum level.

    The leftmost match of each level pattern counts.  When every level those
    patterns can name is above the maximum, one scan over all of them is enough.
    """
    limit = _LEVELS.get(german_max.upper(), 2)
    above = [level for level, rank in _LEVELS.items() if rank > limit]
    either = lambda bodies, starts: text.rlike(pattern("|".join(bodies), starts))
    if {"B1", "B2", "C1", "C2"} <= set(above):
        high = either(_GERMAN_STRONG + tuple(b for b, _ in _GERMAN_LEVEL), "vfdsgma")
    else:
        named = [
            F.upper(F.regexp_extract(text, pattern(b), group)).isin(*above)
            for b, group in _GERMAN_LEVEL
            if above
        ]
        high = reduce(lambda a, b: a | b, named, either(_GERMAN_STRONG, "vfds"))
    return high & ~either(_GERMAN_FINE, "gdnke")


def location_ok(location: Column, description: Column, source: Column, policy: Policy) -> Column:
    place = F.concat_ws(" ", location, description)
    trusted = source.startswith("arbeitsagentur") | source.startswith("custom:")
    return (
        F.when(place.rlike(pattern(_ABROAD_ONLY, "uicm")), False)
        .when(any_match(place, policy.locations), True)
        .when(place.rlike(pattern(_REMOTE, "rht")) & any_match(place, _HOME_REGION), True)
        .otherwise(trusted)
    )


def gate_flags(policy: Policy, as_of) -> dict[str, Column]:
    """One column per gate, true where the gate rejects."""
    text = body_text()
    title, source = text_or_empty("title"), text_or_empty("source")
    description = text_or_empty("description")
    age = age_days(F.col("posted_date"), as_day(as_of))
    must_have = any_match(text, policy.must_have_any) if policy.must_have_any else F.lit(True)
    return {
        "senior": senior_title(title),
        "role": (text_or_empty("role_type") == "") & ~any_match(text, policy.role_types),
        "domain": ~any_match(text, policy.domains),
        "location": ~location_ok(text_or_empty("location"), description, source, policy),
        "freshness": F.coalesce(age > policy.freshness_days, F.lit(False)),
        "exclude": any_match(text, policy.exclude_words),
        "german": german_too_high(text, policy.german_max_level),
        "must_have": ~must_have,
        "thin": source.startswith("custom:") & (F.length(description) < policy.min_description_chars),
    }


def reject_reason(policy: Policy, as_of) -> Column:
    """Name of the first gate that rejects the row, null if it passes.

    A row stops at its first failing gate: later patterns are not evaluated.
    """
    flags = gate_flags(policy, as_of)
    return F.coalesce(*[F.when(flags[g], F.lit(g)) for g in GATES])


def with_reason(df: DataFrame, policy: Policy, as_of) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(policy, as_of))


def gate(df: DataFrame, policy: Policy, as_of) -> DataFrame:
    """Rows that pass every gate; ``seq`` keeps the input order."""
    return with_reason(df, policy, as_of).filter("reject_reason is null").drop("reject_reason")


def dropoff_counts() -> list[Column]:
    """Counting columns over ``reject_reason``; usable in ``agg`` and ``observe``."""
    reason = F.col("reject_reason")
    return [
        F.count(F.lit(1)).alias("input"),
        *[F.count_if(reason == g).alias(g) for g in GATES],
        F.count_if(reason.isNull()).alias("passed"),
    ]


def dropoff(df: DataFrame, policy: Policy, as_of) -> DataFrame:
    """One row: input, rejects per gate, passed.  A single map-side aggregation."""
    return with_reason(df, policy, as_of).select("reject_reason").agg(*dropoff_counts())
