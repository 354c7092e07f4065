"""Clean-up and detection expressions for single posting fields."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions.text import pattern, strip

# Query parameters that only track where a click came from.
_TRACKING = (
    r"^(utm_\w+|gclid|fbclid|msclkid|mc_[ce]id|ref|referrer|source|src|campaign|"
    r"trk|trkCampaign|origin|from|sessionid|_ga)$"
)
# Scheme, authority, path, query; the fragment is matched and left out.
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?\z"
# A path whose last segment carries ;parameters.
_PARAMS = r"^((?:[\s\S]*/)?[^/;]*);([^/]*)\z"
_PARAM_SCHEMES = (
    "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip",
    "sips", "mms", "sftp", "tel",
)

# Characters around a title, and link texts that follow it.
_TITLE_EDGE = " -–—|·\t\n"
_CALL_TO_ACTION = (
    r"\s*[-–—|·]\s*(apply\s*now|jetzt\s*bewerben|mehr\s*erfahren|read\s*more|"
    r"details?|view\s*job)\s*$"
)

# Role labels in order of preference, with the text that shows
# them and the letters that text begins with.
_ROLES = (
    ("internship", r"\bintern(ship|s)?\b", "i"),
    ("praktikum", r"\bpraktikum\b|\bpraktikant\w*\b", "p"),
    ("werkstudent", r"\bwerkstudent\w*\b|\bworking\s*student\b", "w"),
    ("research assistant", r"\bresearch\s*assistant\b", "r"),
    ("studentische hilfskraft", r"studentische\s*hilfskraft", "s"),
    ("hiwi", r"\bhiwi\b|\bhi-wi\b", "h"),
    ("shk", r"\bshk\b", "s"),
)

# Phrases and words that show the working language.
_ENGLISH = (
    r"(working\s*language\s*:?\s*english|english\s*(speaking|required|preferred)|"
    r"fluent\s*english|business\s*english|language\s*:?\s*english|"
    r"english\s*is\s*(the\s*)?(main|working)|jobs?\s*in\s*english)"
)
_GERMAN = (
    r"(deutsch\s*(als\s*)?(arbeitssprache|erforderlich)|verhandlungssicher|"
    r"flie[sß]end\s*deutsch|deutschkenntnisse\s*(mindestens\s*)?(b2|c1|c2)|"
    r"german\s*(at\s*least\s*)?(b2|c1|c2)|native\s*(german|deutsch))"
)
_ENGLISH_WORDS = r"\b(the|and|with|you|will|team)\b"
_GERMAN_WORDS_VETO = r"\b(und|mit|wir|sie|gesucht)\b"
_GERMAN_WORDS = r"\b(und|mit|wir|gesucht|kenntnisse)\b"


def _unquote(part: Column) -> Column:
    """Percent-decoded text; a percent sign without two hex digits stays."""
    valid = F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(valid), F.translate(part, "+", " "))


def _quote(part: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it uses more than once but that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kept_query(query: Column) -> Column:
    """The query without blank values and tracking parameters, encoded anew."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: F.instr(p, "=") > 0),
        lambda p: F.struct(
            _unquote(F.substring_index(p, "=", 1)).alias("name"),
            _unquote(F.substr(p, F.instr(p, "=") + 1)).alias("value"),
        ),
    )
    kept = F.filter(pairs, lambda p: (p["value"] != "") & ~p["name"].rlike(pattern(_TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(_quote(p["name"]), F.lit("="), _quote(p["value"]))), "&")


def _rebuilt(p: Column) -> Column:
    has_params = p["scheme"].isin(*_PARAM_SCHEMES) & p["path"].rlike(_PARAMS)
    stem = F.when(has_params, F.regexp_extract(p["path"], _PARAMS, 1)).otherwise(p["path"])
    params = F.when(has_params, F.regexp_extract(p["path"], _PARAMS, 2)).otherwise("")
    lead = lambda mark, c: _let(c, lambda v: F.when(v != "", F.concat(F.lit(mark), v)).otherwise(""))
    return F.concat(
        p["scheme"], F.lit("://"), F.regexp_replace(p["host"], r"^www\.", ""),
        _let(F.regexp_replace(stem, r"/+\z", ""), lambda v: F.when(v == "", "/").otherwise(v)),
        lead(";", params), lead("?", _kept_query(p["query"])),
    )


def canonical_url(url: Column) -> Column:
    """One spelling per page: no tracking, fragment, ``www.`` or trailing slash."""

    def parts(flat: Column) -> Column:
        part = lambda i: F.regexp_extract(flat, _URL, i)
        return F.struct(
            F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("host"),
            part(3).alias("path"), part(4).alias("query"),
        )

    def whole(url: Column) -> Column:
        # Parts of a text that is no absolute URL are empty.
        return _let(parts(F.translate(url, "\t\r\n", "")), lambda p: F.when(
            (p["host"] != "") & (F.contains(p["host"], F.lit("[")) == F.contains(p["host"], F.lit("]"))),
            _rebuilt(p),
        ).otherwise(url))

    return _let(strip(F.coalesce(url, F.lit(""))), whole)


def clean_title(title: Column) -> Column:
    """Trim separators, collapse white space, drop one trailing call to action."""
    edged = F.btrim(F.coalesce(title, F.lit("")), F.lit(_TITLE_EDGE))
    flat = F.regexp_replace(edged, pattern(r"\s+"), " ")
    return strip(F.regexp_replace(flat, pattern(_CALL_TO_ACTION), ""))


def role_outputs(configured: Iterable[str]) -> list[tuple[str, str]]:
    """(pattern, label) pairs that the configured role phrases switch on."""
    phrases = [c.lower() for c in configured]
    out = []
    for label, body, starts in _ROLES:
        related = [label] if label in phrases else [p for p in phrases if p in label or label in p]
        if related:
            out.append((pattern(body, starts), related[0]))
    return out


def detect_role_type(text: Column, configured: Iterable[str], otherwise: Column | None = None) -> Column:
    """First role the text shows, else the first phrase it holds, else the given value or empty."""
    phrases = [c.lower() for c in configured]
    by_pattern = [F.when(text.rlike(shown), F.lit(out)) for shown, out in role_outputs(phrases)]
    low = F.lower(text)
    by_phrase = [F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases]
    rest = [F.lit("")] if otherwise is None else [otherwise, F.lit("")]
    return F.coalesce(*by_pattern, *by_phrase, *rest)


def detect_language(text: Column) -> Column:
    """``en``, ``de`` or ``unknown`` from explicit phrases, then from stop words."""
    has = lambda body, starts: text.rlike(pattern(body, starts))
    return (
        F.when(has(_ENGLISH, "wefblj"), "en")
        .when(has(_GERMAN, "dvfgn"), "de")
        .when(has(_ENGLISH_WORDS, "tawy") & ~has(_GERMAN_WORDS_VETO, "umwsg"), "en")
        .when(has(_GERMAN_WORDS, "umwgk"), "de")
        .otherwise("unknown")
    )
