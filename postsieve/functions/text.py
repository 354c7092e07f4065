"""Keyword, quote and date expressions.  All are built-in column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s, even in Unicode mode, leaves out the four ASCII separators that
# count as white space in the rules this library follows.
_SPACE = r"[\s\x1c-\x1f]"
_FLAGS = "(?iuU)"
_DOT_FLAGS = "(?isuU)"
_GAP = rf"[{_SPACE}\-_/]+"
_NEVER = r"(?!x)x"


def pattern(body: str, starts: str = "", dot_all: bool = False) -> str:
    """A case-blind, Unicode-aware Java pattern from a plain body.

    ``starts`` names the letters a match can begin with.  The engine then skips
    every other position on one cheap test, which makes a scan of a long text
    several times faster.
    """
    ahead = f"(?=[{starts}])" if starts else ""
    body = body.replace(r"\s", _SPACE)
    return (_DOT_FLAGS if dot_all else _FLAGS) + (f"{ahead}(?:{body})" if starts else body)


def keyword_body(keyword: str) -> str | None:
    """Pattern body of a whole-word phrase, or None for a keyword without text.

    White space, hyphen, underscore and slash may stand for one another, and a
    word boundary is asked for only next to a letter or digit.
    """
    phrase = keyword.strip().lower()
    words = [re.escape(word) for word in re.split(r"[\s\-_/]+", phrase) if word]
    if not words:
        return None
    starts_word, ends_word = phrase[0].isalnum(), phrase[-1].isalnum()
    return r"\b" * starts_word + _GAP.join(words) + r"\b" * ends_word


def keywords_pattern(keywords: Iterable[str]) -> str | None:
    """One pattern for a keyword list, or None if no keyword has text.

    Phrases that begin with a letter or digit share one leading boundary test
    behind a look-ahead for their first letters.
    """
    bodies = list(dict.fromkeys(b for b in map(keyword_body, keywords) if b))
    bounded = [b.removeprefix(r"\b") for b in bodies if b.startswith(r"\b")]
    branches = [b for b in bodies if not b.startswith(r"\b")]
    if bounded:
        starts = "".join(sorted({b[0] for b in bounded}))
        branches.append(rf"(?=[{starts}])\b(?:" + "|".join(bounded) + ")")
    return _FLAGS + "(?:" + "|".join(branches) + ")" if branches else None


# Words that are looked up as they are: letters whose only other forms are their capitals, and these characters, which
# a case-blind pattern takes for i and s.
_PLAIN = re.compile(r"[a-z0-9äöüß]+")
_FOLDED = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"))
#: What parts words, and underscores, which words of a phrase may be joined by.
_PARTS = r"(?U)[\W_]+"


def _whole_words(keyword: str) -> list[str]:
    """Words that stand whole in any text that holds the keyword, as far as they can be looked up."""
    phrase = keyword.strip().lower()
    runs = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+", phrase)]
    # separators at an end of the keyword are not part of its pattern, and no boundary is asked for there
    loose = [bool(re.fullmatch(r"[\s\-_/]+", x)) for x in ((phrase[:runs[0][0]], phrase[runs[-1][1]:]) if runs else ())]
    held = runs[any(loose[:1]):len(runs) - any(loose[1:])]
    return [w for _, _, w in held if _PLAIN.fullmatch(w)]


def words_present(text: Column, *lists: Iterable[str]) -> Column:
    """Which words of the keywords in some lists stand in the text, as an array, by one reading of the text.

    Given to the functions below, it takes the place of a scan of the text for each keyword.
    """
    sought = sorted({w for keywords in lists for kw in keywords for w in _whole_words(kw)})
    if not sought:
        return F.array().cast("array<string>")
    folded = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), _FOLDED, text)
    words = F.split(F.lower(folded), _PARTS)
    return F.coalesce(F.array_intersect(words, F.array(*[F.lit(w) for w in sought])), F.array().cast("array<string>"))


def _holds(text: Column, keyword: str, present: Column) -> Column | None:
    """Whether the keyword stands in the text; the text is read only if all its words are there and that does not
    settle it. None for a keyword without text."""
    found = keywords_pattern([keyword])
    if found is None:
        return None
    words = _whole_words(keyword)
    there = reduce(lambda x, y: x & y, [F.array_contains(present, w) for w in dict.fromkeys(words)], F.lit(True))
    read = F.coalesce(text.rlike(found), F.lit(False))
    if words == [keyword.strip().lower()]:
        # the word itself; only next to an underscore it is part of a longer one
        return there & (~F.contains(text, F.lit("_")) | read)
    return there & read


def contains(text: Column, keyword: str, present: Column | None = None) -> Column:
    """True where the keyword stands in the text as a whole word or phrase."""
    return any_match(text, [keyword], present)


def any_match(text: Column, keywords: Iterable[str], present: Column | None = None) -> Column:
    """True where at least one keyword is present: one scan for the whole list, or none but for phrases where the
    words present are known."""
    if present is not None:
        each = [h for kw in dict.fromkeys(keywords) if (h := _holds(text, kw, present)) is not None]
        return reduce(lambda x, y: x | y, each, F.lit(False))
    found = keywords_pattern(keywords)
    return F.lit(False) if found is None else F.coalesce(text.rlike(found), F.lit(False))


def with_words(text: Column, keywords: Iterable[str], use: Callable[[Column], Column]) -> Column:
    """A column made from the words present, which are found once for all its parts."""
    return F.transform(F.array(words_present(text, keywords)), use)[0]


def matched(text: Column, keywords: Iterable[str], present: Column | None = None) -> Column:
    """Array of the keywords present, distinct, in the order of the list, by one reading of the text for all."""
    keywords = list(dict.fromkeys(keywords))
    if present is None:
        return with_words(text, keywords, lambda words: matched(text, keywords, words))
    hits = [F.when(h, F.lit(kw)) for kw in keywords if (h := _holds(text, kw, present)) is not None]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def squeeze(text: Column) -> Column:
    """Collapse runs of white space and trim both ends."""
    return strip(F.regexp_replace(text, pattern(r"\s+"), " "))


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks, from both ends."""
    return F.regexp_extract(text, rf"(?sU)\A{_SPACE}*(.*[^\s\x1c-\x1f])", 1)


def _before_first(text: Column, found: Column) -> Column:
    """Length of the text before the first match (of all of it without one)."""
    return F.length(F.get(F.split(text, found, 2), F.lit(0)))


def _from(text: Column, before: Column, window: int) -> Column:
    """The text from ``window`` characters before a place on.

    One plain scan finds the place; patterns with a long optional prefix then
    apply at the start instead of being tried at every position of the text.
    """
    return F.substr(text, F.greatest(F.lit(1), before - window + 1))


def _quote(text: Column, body: Column, window: int) -> Column:
    before = _before_first(text, F.concat(F.lit(_DOT_FLAGS), body))
    # A full window of text before the match is skipped by its exact length: the
    # cut may have freed a part of a word that looks like the keyword.
    skip = F.when(before >= window, f".{{{window}}}").otherwise(f".{{0,{window}}}?")
    span = F.concat(F.lit(rf"{_DOT_FLAGS}\A"), skip, body, F.lit(f".{{0,{window}}}"))
    near = _from(text, before, window)
    return squeeze(F.coalesce(F.call_function("regexp_extract", near, span, F.lit(0)), F.lit("")))


def quote_around(text: Column, keyword: str, window: int = 30) -> Column:
    """First match of the keyword with up to ``window`` characters on each side."""
    return _quote(text, F.lit(keyword_body(keyword) or _NEVER), window)


def quote_around_any(text: Column, keyword: Column, known: Iterable[str], window: int) -> Column:
    """``quote_around`` for a keyword that differs by row.

    The pattern is looked up for known keywords and built in the row from the
    same rules for any other value.
    """
    kw = F.lower(strip(keyword))
    edge = lambda cut: F.when(cut.rlike(r"(?U)[\p{L}\p{N}]"), F.lit(r"\b")).otherwise(F.lit(""))
    words = F.filter(F.split(kw, pattern(r"[\s\-_/]+")), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1"))
    own = F.when(F.size(words) > 0, F.concat(
        edge(F.substring(kw, 1, 1)), F.array_join(quoted, _GAP), edge(F.substring(kw, -1, 1))
    )).otherwise(F.lit(_NEVER))
    listed = {kw: keyword_body(kw) or _NEVER for kw in known}
    if not listed:
        return _quote(text, own, window)
    table = F.create_map(*[F.lit(x) for pair in listed.items() for x in pair])
    return _quote(text, F.coalesce(F.try_element_at(table, keyword), own), window)


def snippet(core: str, window: int, text: Column) -> Column:
    """First match of a fixed phrase in the text read as one line, with up to
    ``window`` characters on each side, trimmed.  The span is as long as it can
    be: it may reach to a later phrase that lies inside the window."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    near = _from(line, _before_first(line, F.lit(pattern(core, dot_all=True))), window)
    span = pattern(rf"\A.{{0,{window}}}(?:{core}).{{0,{window}}}", dot_all=True)
    return strip(F.regexp_extract(near, span, 0))


# Year-month-day, day.month.year and year/month/day; one or two digits for day and month.
_MONTH, _DAY = r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])"
_DATE_FORMATS = (
    (rf"^\d{{4}}-{_MONTH}-{_DAY}\z", "yyyy-M-d"),
    (rf"^{_DAY}\.{_MONTH}\.\d{{4}}\z", "d.M.yyyy"),
    (rf"^\d{{4}}/{_MONTH}/{_DAY}\z", "yyyy/M/d"),
)


def parse_date(value: Column) -> Column:
    """Date from the first ten characters, null where no format fits."""
    head = F.substring(value, 1, 10)
    return F.coalesce(*[
        F.when(head.rlike(shape), F.try_to_date(head, fmt)) for shape, fmt in _DATE_FORMATS
    ])


def age_days(value: Column, as_of: Column) -> Column:
    """Whole days since the posted date, never negative, null if unknown."""
    posted = parse_date(value)
    return F.when(posted.isNotNull(), F.greatest(F.lit(0), F.datediff(as_of, posted)))
