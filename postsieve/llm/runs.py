"""Periodic runs of words by longest common extensions over a difference cover (operator 13).

A run is a stretch of words with smallest period q, at least twice as long as q, that no neighbouring word extends.
Every run of period p meets the grid 0, p, 2p, ... of its document at a place i with equal words at i and i + p, so the
grids of all periods, about n log n places together, find every run: the common extensions of (i, i + p) to both sides
are the run that holds them.

An extension compares the words of both sides until both stand on sampled places: for any two places there is a step
below ``MODULUS`` that brings both into the difference cover. Only sampled suffixes are sorted (by blocks of ``MODULUS``
words, ranks of doubled lengths); neighbours in that order get their common length, and a sparse table gives the least
of any stretch of the order. Documents of a piece are searched together, with a word of its own behind each.
Stretches shorter than ``MODULUS`` on both sides are known by comparison; only documents with longer ones are sorted.

Documents are independent, so nothing is shuffled. Memory follows the longest document; the grids are gone through in
blocks of ``BLOCK`` places.

Cases: null texts and texts without words have no run; repeated rows are answered each; rows without an id are
answered; an empty table gives an empty result; other columns are passed on, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from postsieve.llm.common import pieces

#: Any two residues differ by the difference of two members (fixed values).
COVER, MODULUS = (0, 1, 3, 9), 13
#: Shortest run reported.
LEAST = 12
#: Characters searched together, and places of the grids looked at together.
PIECE = 1_000_000
BLOCK = 250_000

#: The step that brings two places into the cover, by their residues.
STEP = np.array([[min(s for s in range(MODULUS) if (i + s) % MODULUS in COVER and (j + s) % MODULUS in COVER)
                  for j in range(MODULUS)] for i in range(MODULUS)])


class Extensions:
    """Length of the longest common stretch that begins at two places of a line of word numbers.

    Behind the line come numbers that occur nowhere else; samples are sorted when a query first needs them.
    """

    def __init__(self, line: np.ndarray):
        self.line = np.concatenate([line, -1 - np.arange(2 * MODULUS)])
        self.size = len(line)
        self._common: list[np.ndarray] | None = None

    def compared(self, left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from both places on, at most so many."""
        common, active = np.zeros(len(left), np.int64), np.arange(len(left))
        for k in range(MODULUS):
            active = active[most[active] > k]
            active = active[self.line[left[active] + k] == self.line[right[active] + k]]
            if not len(active):
                break
            common[active] += 1
        return common

    def sort_samples(self) -> None:
        """Order of the sampled suffixes, and for every width 2^k the least common length of neighbours in it."""
        places = np.concatenate([np.arange(c, self.size + MODULUS, MODULUS) for c in COVER])
        last = len(places)  # stands for what follows the last block of a residue
        number = np.full(self.size + 2 * MODULUS, last)
        number[places] = np.arange(last)
        after = np.minimum(places + MODULUS, len(number) - 1)
        jump = np.append(np.where(places + MODULUS < len(number), number[after], last), last)
        rank = np.append(_ranks(*(self.line[places + k] for k in range(MODULUS))) + 1, 0)
        levels = [(rank, jump)]
        while rank.max() < last:
            rank = np.append(_ranks(rank[:-1], rank[jump[:-1]]) + 1, 0)
            jump = jump[jump]
            levels.append((rank, jump))
        order = np.argsort(rank[:-1])
        self._number, self._position = number, rank[:-1] - 1
        left, right = order[:-1], order[1:]
        common = np.zeros(len(left), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            rank, jump = levels[level]
            same = rank[left] == rank[right]
            common += (same << level) * MODULUS
            left, right = np.where(same, jump[left], left), np.where(same, jump[right], right)
        left, right = places[order[:-1]] + common, places[order[1:]] + common
        common += self.compared(left, right, np.full(len(left), MODULUS))
        self._common = [common]
        while 2 * (width := 1 << (len(self._common) - 1)) <= len(common):
            held = self._common[-1]
            self._common.append(np.minimum(held[:-width], held[width:]))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For two different places each."""
        step = STEP[left % MODULUS, right % MODULUS]
        common = self.compared(left, right, step)
        through = np.flatnonzero(common == step)
        if len(through):
            if self._common is None:
                self.sort_samples()
            x = self._position[self._number[left[through] + step[through]]]
            y = self._position[self._number[right[through] + step[through]]]
            low, wide = np.minimum(x, y), np.abs(x - y)
            level = np.frexp(wide)[1] - 1
            for k in np.unique(level).tolist():
                now, held = level == k, self._common[k]
                common[through[now]] += np.minimum(held[low[now]], held[low[now] + wide[now] - (1 << k)])
        return common


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 0 of rows of keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        held = k[order]
        new[1:] |= held[1:] != held[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def grid_places(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of every grid of every document, a bounded block at a time."""
    halves = sizes // 2
    first = 0
    counted = np.concatenate([[0], np.cumsum(halves)])
    while first < counted[-1]:
        # periods, in order of documents; each has size // period - (size % period == 0) places
        last = min(first + BLOCK // 4, int(counted[-1]))
        each = np.arange(first, last)
        doc = np.searchsorted(counted, each, "right") - 1
        period = each - counted[doc] + 1
        count = (sizes[doc] - 1) // period
        ends = np.cumsum(count)
        at = 0
        while at < len(each):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            held = count[at:stop]
            of = np.repeat(np.arange(at, stop), held)
            nth = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
            yield doc[of], nth * period[of], period[of]
            at = stop
        first = last


class _Line:
    """Some documents behind each other, to be read in both directions."""

    def __init__(self, documents: list[np.ndarray], chosen: np.ndarray):
        self.chosen = chosen
        sizes = np.array([len(documents[i]) for i in chosen], np.int64)
        self.line = np.concatenate([np.empty(0, np.int64), *(x for i in chosen for x in (documents[i], [-1 - 2 * MODULUS - i]))])
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.ahead, self.behind = Extensions(self.line), Extensions(self.line[::-1].copy())

    def places(self, doc: np.ndarray, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both places, then the same two read backwards."""
        left = self.first[np.searchsorted(self.chosen, doc)] + place
        return left, left + period, len(self.line) - 1 - left, len(self.line) - 1 - left - period


def find_runs(documents: list[np.ndarray], least: int = LEAST) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, in order of document, start and period; a document is an
    array of word numbers from 0 on."""
    sizes = np.array([len(d) for d in documents], np.int64)
    whole, some, found = _Line(documents, np.arange(len(documents))), None, [np.empty((0, 4), np.int64)]
    for doc, place, period in grid_places(sizes):
        at = whole.first[doc] + place
        equal = whole.line[at] == whole.line[at + period]
        doc, place, period = doc[equal], place[equal], period[equal]
        left, right, mirror, other = whole.places(doc, place, period)
        # short stretches are known at once; both counts hold the place itself
        most = np.full(len(left), MODULUS)
        ahead, behind = whole.ahead.compared(left, right, most), whole.behind.compared(mirror, other, most)
        far = np.flatnonzero((ahead == MODULUS) | (behind == MODULUS))
        if len(far):
            if some is None or not np.isin(doc[far], some.chosen).all():
                some = _Line(documents, np.unique(doc[far]))
            left, right, mirror, other = some.places(doc[far], place[far], period[far])
            ahead[far], behind[far] = some.ahead(left, right), some.behind(mirror, other)
        length = ahead + behind - 1 + period
        good = (length >= 2 * period) & (length >= least)
        found.append(_smallest(np.stack([doc, place - behind + 1, length, period], 1)[good]))
    rows = _smallest(np.concatenate(found))
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period; the multiples of that period give the same stretch."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return rows[new]


def _batch(piece: pa.RecordBatch, text: str, least: int) -> dict[str, pa.Array]:
    split = [(t or "").encode().split() for t in piece.column(text).to_pylist()]
    known: dict[bytes, int] = {}
    numbers = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in split]
    runs = find_runs(numbers, least)
    first = np.searchsorted(runs[:, 0], np.arange(len(split) + 1))
    found, collapsed = [], []
    for i, words in enumerate(split):
        own = runs[first[i]:first[i + 1], 1:]
        found.append([{"start": s, "length": n, "period": p} for s, n, p in own.tolist()])
        if len(own):
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, own[:, 0] + own[:, 2], 1)
            np.add.at(change, own[:, 0] + own[:, 1], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(words).decode())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return {"runs": pa.array(found, kind), "collapsed": pa.array(collapsed, pa.string())}


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The documents with ``runs`` (start, length, period, in words, ordered by start and period) and ``collapsed``:
    the words that no run repeats, joined by single spaces. A word is ASCII-space separated; each run keeps its first
    period."""
    rows = docs.drop("runs", "collapsed")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col, PIECE):
            own = _batch(piece, text_col, least)
            yield pa.RecordBatch.from_arrays([*piece.columns, *own.values()], names=[*piece.schema.names, *own])

    run = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    return rows.mapInArrow(search, StructType([*rows.schema, StructField("runs", ArrayType(run)), StructField("collapsed", StringType())]))
