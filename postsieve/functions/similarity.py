"""Token-set similarity of two short texts, as columns.

The ratio compares the distinct words two texts share with the words only one
of them has.  Bounds on letter counts and word sets, held as bit sets in a few
longs, rule out most pairs and never a similar one.  Tiles of records are
compared inside Spark's own tasks, by ``SimilarPairs.java`` beside this file.
"""

from __future__ import annotations

import hashlib
import sys
import tempfile
import zipfile
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.functions.text import pattern

# Executors need not have this library installed for the function below.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letter counts are kept as unary codes: 28 groups (a-z, digits, the rest) of
# up to 14 characters each, four groups to a long.  A count above 14 is stored
# as 14, which can only make the bounds below looser.
_UNARY, _PER_LONG = 14, 4
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
N_SKETCH = 7
SKETCH = tuple(f"s{i}" for i in range(N_SKETCH))
# Word sketches: column -> (shortest, longest, least length + 1) of its words.
WORD_CLASSES = {"w0": (1, 3, 2), "w1": (4, 6, 5), "w2": (7, 1 << 30, 8)}


def fingerprint(company: Column, title: Column, location: Column) -> Column:
    """The text that near-duplicate postings share."""
    parts = [F.coalesce(c, F.lit("")) for c in (company, title, location)]
    return F.btrim(F.lower(F.concat_ws(" | ", *parts)))


def block_key(company: Column) -> Column:
    """First six characters of the first plain word of the company name."""
    plain = F.regexp_replace(F.lower(F.coalesce(company, F.lit(""))), "[^a-z0-9 ]+", "")
    return F.substring(F.substring_index(F.trim(plain), " ", 1), 1, 6)


def tokens(text: Column) -> Column:
    """Distinct words, sorted."""
    words = F.filter(F.split(text, pattern(r"\s+")), lambda w: w != "")
    return F.array_sort(F.array_distinct(words))


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def letter_counts(text: Column) -> Column:
    """How often each of the 28 groups of letters occurs in a text."""
    size = F.length(text)
    counts = [size - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _LETTERS]
    counts.append(size - F.length(F.regexp_replace(text, "[0-9]", "")))
    counts.append(F.length(F.regexp_replace(text, "[a-z0-9 ]", "")))
    return F.array(*counts)


def sketch(letters: Column) -> list[Column]:
    """The letter counts of a text as ``N_SKETCH`` longs."""
    longs = []
    for k in range(N_SKETCH):
        group = [letters[i] for i in range(k * _PER_LONG, (k + 1) * _PER_LONG)]
        codes = [
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(c, F.lit(_UNARY))) - F.lit(1)
            for c in group
        ]
        longs.append(reduce(
            lambda a, b: a.bitwiseOR(b),
            [F.shiftleft(code, _UNARY * i) for i, code in enumerate(codes)],
        ).alias(SKETCH[k]))
    return longs


def word_sketch(words: Column) -> list[Column]:
    """Words as hashed bit sets, one long per length class."""
    bit = lambda w: F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(w), F.lit(64))
    )
    longs = []
    for name, (low, high, _) in WORD_CLASSES.items():
        some = F.filter(words, lambda w: F.length(w).between(low, high))  # noqa: B023
        longs.append(
            F.aggregate(some, F.lit(0).cast("bigint"), lambda acc, w: acc.bitwiseOR(bit(w))).alias(name)
        )
    return longs


def _only(x: str, y: str, name: str) -> Column:
    """Number of bits set in one side's sketch and not in the other's."""
    return F.bit_count(F.col(f"{x}.{name}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{name}"))))


def _total(terms: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, terms)


def edit_budget(a: str, b: str, threshold: float) -> Column:
    """The most characters by which the unshared words of two similar records may differ in edit form."""
    return (F.col(f"{a}.size") + F.col(f"{b}.size")) * F.lit(1.0 - threshold / 100.0) + F.lit(1e-6)


def unshared_budget(size: Column, threshold: float) -> Column:
    """The most that the unshared words of a record may weigh (length + 1 each) if the other one nearly contains it."""
    e = 1.0 - threshold / 100.0
    return size * F.lit(2 * e / (1 + e)) + F.lit(1e-6)


def may_be_edited(a: str, b: str, threshold: float) -> Column:
    """Necessary condition, on sketches, for a ratio of at least ``threshold`` in edit form.

    ``a`` and ``b`` are the prefixes of two records that carry ``size`` (length of the joined words) and the sketches.
    Shared words cancel out, so the letters only one side has are at most the distance of the unshared words, and
    that is at most (1 - threshold / 100) * (size_a + size_b).
    """
    letters = _total([_only(x, y, s) for x, y in ((a, b), (b, a)) for s in SKETCH])
    budget = edit_budget(a, b, threshold)
    return (F.abs(F.col(f"{a}.size") - F.col(f"{b}.size")) <= budget) & (letters <= budget)


def may_be_inside(a: str, b: str, threshold: float) -> Column:
    """Necessary condition, on word sketches, for a ratio of at least ``threshold`` as b nearly contains a.

    With e = 1 - threshold / 100 and u the joined length of a's unshared words, that is u = 0 or
    1 + u <= 2 * e * size / (1 + e), where 1 + u is the sum of (length + 1) over the unshared words.
    """
    weight = _total([_only(a, b, n) * F.lit(w) for n, (_, _, w) in WORD_CLASSES.items()])
    return weight <= unshared_budget(F.col(f"{a}.size"), threshold)


def may_be_similar(a: str, b: str, threshold: float) -> Column:
    """Necessary condition, on sketches, for a ratio of at least ``threshold`` in any form."""
    return may_be_edited(a, b, threshold) | may_be_inside(a, b, threshold) | may_be_inside(b, a, threshold)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step per character."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_ = full
    for ch in b:
        hit = open_ & where.get(ch, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


# The batch form keeps up to this many 64-bit words a text and this many words of match masks at once.
_KERNEL_WORDS, _KERNEL_MASKS = 16, 1 << 20
# In a band around the diagonal the kernel is faster up to this many.
_BAND_WORDS = 64


def _points(texts: list[str], width: int) -> np.ndarray:
    """Code points of texts, one row each, -1 behind their end."""
    rows = np.full((len(texts), width), -1, np.int64)
    for row, text in zip(rows, texts):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return rows


def _common_in_step(left: list[str], right: list[str], needed: np.ndarray | None = None) -> np.ndarray:
    """:func:`common_length` of many pairs at once: a row of 64-bit words a pair, all pairs one character at a time.

    With ``needed``, the result is exact where it is at least that much and otherwise no more than the truth: an
    alignment that leaves so much in common stays near the diagonal, so only the words around it are brought up to date,
    and pairs that can no longer reach it are left out.
    """
    n, words = len(left), -(-max(map(len, left)) // 64)
    points = _points(left, max(map(len, left))), _points(right, max(map(len, right)))
    letters = np.unique(points[0])
    letters = letters[letters >= 0]
    kinds = len(letters) + 1  # the last kind stands for a character that the left text cannot have
    place = np.minimum(np.searchsorted(letters, points[1]), kinds - 2)
    coded = np.where(letters[place] == points[1], place, kinds - 1)
    row = np.arange(n) * kinds
    masks = np.zeros((words, n * kinds), np.uint64)
    for i in range(points[0].shape[1]):
        here = points[0][:, i] >= 0
        masks[i // 64, row[here] + np.searchsorted(letters, points[0][here, i])] |= np.uint64(1 << (i % 64))
    open_ = np.full((words, n), ~np.uint64(0))
    sizes = np.array([list(map(len, left)), list(map(len, right))], np.int64)
    # how far an alignment may stray to either side: what either text may leave unmatched
    above, below = (words * 64, words * 64) if needed is None else (int(x) for x in (sizes - needed).max(axis=1))
    found, live = np.zeros(n, np.int64), np.arange(n)
    for j in range(coded.shape[1]):
        at = row + coded[:, j]
        carry = np.zeros(len(at), np.uint64)
        for w in range(max(0, j - below) // 64, min(words - 1, (j + above) // 64) + 1):
            hits, before = masks[w, at], open_[w]
            added = before & hits
            total = before + added
            over = total < added
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            open_[w] = total | (before & ~hits)
        if needed is not None and j % 64 == 63:
            common = np.cumsum(64 - np.bitwise_count(open_).astype(np.int64), axis=0)
            starts = 64 * np.arange(words)[:, None]
            still = np.minimum(sizes[0, live] - starts, sizes[1, live] - j - 1).clip(0) + common
            alive = still.max(axis=0) >= needed[live]
            if 4 * alive.sum() <= 3 * len(alive):
                found[live] = common[-1]
                live, row, coded, open_ = live[alive], row[alive], coded[alive], open_[:, alive]
                if not len(live):
                    return found
    found[live] = 64 * words - np.bitwise_count(open_).sum(axis=0, dtype=np.int64)
    return found


def common_lengths(left: list[str], right: list[str], needed: np.ndarray | None = None) -> np.ndarray:
    """:func:`common_length` of each pair; with ``needed``, exact where it is at least that much and else no more than
    the truth.

    Pairs of like length share the steps of one NumPy kernel; texts above 1,024 characters take the big integers,
    which are as fast there if all of the pair is compared.
    """
    found = np.zeros(len(left), np.int64)
    short, width = [], 64 * (_KERNEL_WORDS if needed is None else _BAND_WORDS)
    for k, (a, b) in enumerate(zip(left, right)):
        if a and b:
            if max(len(a), len(b)) <= width:
                short.append(k)
            else:
                found[k] = common_length(a, b)
    short.sort(key=lambda k: (-(-len(left[k]) // 64), len(right[k])))
    while short:
        words = -(-len(left[short[-1]]) // 64)
        size = max(1, _KERNEL_MASKS // (words * 128))
        part, short = short[-size:], short[:-size]
        found[part] = _common_in_step(
            [left[k] for k in part], [right[k] for k in part], None if needed is None else needed[part])
    return found


def ratios(left: list[str], right: list[str], least: float | None = None) -> np.ndarray:
    """Token-set ratios of pairs of texts of distinct words; white space separates words.

    With ``least``, those below it may come out lower than they are.
    """
    best, pairs, sizes, split = np.zeros(len(left)), [], [], {}
    for text in {*left, *right}:
        split[text] = frozenset(text.split())
    for k, (a, b) in enumerate(zip(left, right)):
        words_a, words_b = split[a], split[b]
        if not words_a or not words_b:
            continue
        only_a, only_b = sorted(words_a - words_b), sorted(words_b - words_a)
        n_shared = len(words_a) - len(only_a)
        if n_shared and not (only_a and only_b):
            best[k] = 100.0
            continue
        only_a, only_b = " ".join(only_a), " ".join(only_b)
        shared = sum(map(len, words_a)) + len(words_a) - 1 - len(only_a) - 1 if n_shared else 0
        pairs.append((k, only_a, only_b))
        sizes.append((shared, 1 if shared else 0, len(only_a), len(only_b)))
    if not pairs:
        return best
    at, only_a, only_b = (list(part) for part in zip(*pairs))
    shared, gap, n_a, n_b = np.array(sizes, np.int64).T
    whole_a, whole_b = shared + gap + n_a, shared + gap + n_b
    needed = None
    if least is not None:
        # one less than asked for, so that no rounding decides
        needed = np.floor((n_a + n_b - (1 - least / 100) * (whole_a + whole_b)) / 2).astype(np.int64) - 1
    distance = n_a + n_b - 2 * common_lengths(only_a, only_b, needed)
    found = 100.0 - 100.0 * distance / (whole_a + whole_b)
    with_a = 100.0 - 100.0 * (gap + n_a) / (shared + whole_a)
    with_b = 100.0 - 100.0 * (gap + n_b) / (shared + whole_b)
    best[at] = np.where(gap > 0, np.maximum(found, np.maximum(with_a, with_b)), found)
    return best


@F.pandas_udf(T.DoubleType())
def token_set_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Token-set ratio from 0 to 100 of two text columns.

    Kept for the pairs that the bounds leave open; the distance behind it has no
    built-in counterpart (it counts a substitution as two).
    """
    return pd.Series(ratios(left.fillna("").tolist(), right.fillna("").tolist()), dtype="float64")


#: What :func:`similar_pairs` reads of a record.
COMPARED = ("id", "text", *SKETCH, *WORD_CLASSES)
_PAIRS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _pair_function(spark: SparkSession) -> str:
    """Name of the function of ``SimilarPairs.java`` in a session.

    Spark's own compiler makes the class, and a jar that Spark brings to its executors holds it, so neither they nor the
    driver need any tool besides Spark.
    """
    source, jvm, session = Path(__file__).with_name("SimilarPairs.java").read_text("utf-8"), spark._jvm, spark._jsparkSession
    name = f"SimilarPairs{hashlib.sha256(source.encode()).hexdigest()[:12]}"
    loader = session.sharedState().jarClassLoader()
    try:
        found = jvm.java.lang.Class.forName(name, True, loader)
    except Py4JJavaError:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source.replace("class SimilarPairs", f"class {name}"))
        jar = f"{tempfile.mkdtemp(prefix='postsieve-')}/{name}.jar"
        with zipfile.ZipFile(jar, "w") as classes:
            for path, code in compiler.getBytecodes().items():
                classes.writestr(f"{path.replace('.', '/')}.class", bytes(code))
        spark.sql(f"ADD JAR '{jar}'")
        found = jvm.java.lang.Class.forName(name, True, loader)
    none = lambda kind: spark.sparkContext._gateway.new_array(kind, 0)
    made = found.getDeclaredConstructor(none(jvm.java.lang.Class)).newInstance(none(jvm.java.lang.Object))
    session.udf().register(name, made, jvm.org.apache.spark.sql.types.DataType.fromJson(_PAIRS.json()))
    return name


def similar_pairs(
    spark: SparkSession, left: Column, right: Column, threshold: float, within: bool, least: int, most: int
) -> Column:
    """Pairs (a, b) of similar records of two tiles: arrays of structs of ``COMPARED``.

    ``within``: all similar pairs, the lesser id as a; ``right`` is null where a tile meets itself. Else a is left and b
    right, and each right record comes with the least id of a similar left one only.
    ``least``: neighbouring characters are counted first where a tile holds so many records; where few are met, counting
    costs more than the ratios it saves. ``most``: the answer is null if there are more pairs than this.
    """
    args = F.lit(float(threshold)), F.lit(within), F.lit(least), F.lit(most)
    return F.call_udf(_pair_function(spark), left, right, *args)
