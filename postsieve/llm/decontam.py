"""Benchmark decontamination by the q-gram lemma (operator 5).

Both sides are reduced to lower-case letters and digits with single spaces. A benchmark item is searched in windows of
``WINDOW`` characters that start every ``STEP``, so a part of it is found as well: one of ``WINDOW + STEP - 1`` characters
(73) or more holds a whole window wherever it starts. A text within k edits of a window of m characters shares at
least m + 1 - q(k + 1) q-grams with it, all of them in a band of k + 1 diagonals: hits are counted in overlapping
diagonal bands, bands that reach the bound are kept, and each is verified by a banded alignment.

The benchmark is the stated query set. It is gone through in blocks of a fixed size, each sent to the executors, so
what is sent has a bound whatever the benchmark's size; documents are scanned where they lie, nothing is shuffled.

Cases: null and empty texts hold nothing; benchmark items with fewer than ``LEAST`` characters are searched as exact
whole words; items without a letter or digit are in no text; equal items are reported one by one; repeated documents are reported as often;
an empty table on either side gives an empty result; long texts are searched whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import pieces

Q = 10
WINDOW = 64
STEP = Q
LEAST = 40
#: Edits allowed for each character of a window.
RATE = 0.08
#: Benchmark characters searched at a time.
BLOCK_CHARS = 1_000_000
#: Document characters scanned at a time; the arrays of hashes take about 60 bytes for each.
SCANNED_CHARS = 1_000_000
#: Bits of the table that most q-grams of a text are looked up in first.
SIEVE_BITS = 22
#: Bands verified at a time.
ALIGNED = 512
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_ALNUM: list[np.ndarray] = []


def normalised(text: str) -> np.ndarray:
    """Code points of the lower-case letters and digits, all else as single spaces (32)."""
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _ALNUM[0][codes]
    return np.where(kept, codes, 32)[kept | np.append(True, kept[:-1])]


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram, put together from those of 2, 4 and 8 characters."""
    c = codes.astype(np.uint64)
    two = c[:-1] * np.uint64(MULTIPLIERS[0]) + c[1:]
    four = two[:-2] * np.uint64(MULTIPLIERS[1]) + two[2:]
    eight = four[:-4] * np.uint64(MULTIPLIERS[2]) + four[4:]
    return eight[:-2] * np.uint64(MULTIPLIERS[0]) + two[8:]


@dataclass
class Windows:
    """The windows of a block of the benchmark, and where each q-gram occurs in them."""

    items: np.ndarray  # item of each window
    codes: np.ndarray  # (windows, WINDOW), filled up with 0
    sizes: np.ndarray
    edits: np.ndarray
    least: np.ndarray  # shared q-grams
    sieve: np.ndarray
    hashes: np.ndarray  # sorted
    first: np.ndarray
    window: np.ndarray
    place: np.ndarray
    short: list[tuple[int, np.ndarray]]  # items that are searched as whole words, numbered behind the windows

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Windows | None:
        items, cuts, short = [], [], []
        for item, text in rows:
            codes = normalised(text or "")
            if len(codes) < LEAST:
                if (shown := np.flatnonzero(codes != 32)).size:
                    short.append((item, codes[shown[0]:shown[-1] + 1]))
                continue
            for at in {*range(0, max(len(codes) - WINDOW, 0) + 1, STEP), max(len(codes) - WINDOW, 0)}:
                items.append(item)
                cuts.append(codes[at:at + WINDOW])
        if not cuts and not short:
            return None
        sizes = np.array([len(c) for c in cuts], np.int64)
        edits = np.minimum((RATE * sizes).astype(np.int64), (sizes - Q) // Q)
        filled = np.zeros((len(cuts), WINDOW), np.uint32)
        for i, c in enumerate(cuts):
            filled[i, :len(c)] = c
        grams = [gram_hashes(c) for c in cuts]
        every = np.concatenate([np.empty(0, np.uint64), *grams])
        window = np.repeat(np.arange(len(cuts)), np.array([len(g) for g in grams], np.int64))
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(every, kind="stable")
        hashes, first = np.unique(every[order], return_index=True)
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[hashes >> np.uint64(64 - SIEVE_BITS)] = True
        return Windows(np.array(items, np.int64), filled, sizes, edits, sizes + 1 - Q * (edits + 1), sieve, hashes,
                       np.append(first, len(every)), window[order], place[order], short)

    def item(self, window: int) -> int:
        return int(self.items[window]) if window < len(self.items) else self.short[window - len(self.items)][0]


def search(texts: list[str | None], by: Windows) -> list[tuple[int, int, int, int]]:
    """(row, window, edits, end in the normalised text) of every window found."""
    codes = [normalised(t) if t else np.empty(0, np.uint32) for t in texts]
    # texts follow each other with q zeros between, which no window holds
    gap = np.zeros(WINDOW * 2, np.uint32)
    sizes = np.array([len(c) + len(gap) for c in codes])
    starts = np.cumsum(sizes) - sizes
    line = np.concatenate([x for c in codes for x in (c, gap)])
    if len(line) < Q:
        return []
    hashes = gram_hashes(line)
    at = np.flatnonzero(by.sieve[hashes >> np.uint64(64 - SIEVE_BITS)])
    slot = np.searchsorted(by.hashes, hashes[at])
    known = by.hashes[np.minimum(slot, len(by.hashes) - 1)] == hashes[at]
    at, slot = at[known], slot[known]
    count = by.first[slot + 1] - by.first[slot]
    spot = np.arange(count.sum()) + np.repeat(by.first[slot] - np.cumsum(count) + count, count)
    window, diagonal = by.window[spot], np.repeat(at, count) - by.place[spot] + WINDOW
    # each hit counts in two bands, so any k + 1 diagonals next to each other lie in one of them
    width = by.edits[window] + 1
    band = diagonal // width
    key = np.concatenate([window * (len(line) + 2 * WINDOW) + band, window * (len(line) + 2 * WINDOW) + np.maximum(band - 1, 0)])
    bands, hits = np.unique(key, return_counts=True)
    window, band = bands // (len(line) + 2 * WINDOW), bands % (len(line) + 2 * WINDOW)
    enough = hits >= by.least[window]
    window, band, hits = window[enough], band[enough], hits[enough]
    low = band * (by.edits[window] + 1) - WINDOW
    row = np.searchsorted(starts, np.clip(low + by.sizes[window] // 2, 0, len(line) - 1), "right") - 1
    # the fullest band of a text and window first; the others only where it fails
    order = np.lexsort((low, -hits, window, row))
    row, window, low = row[order], window[order], low[order]
    pair = row * len(by.items) + window
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
    rank = np.arange(len(pair)) - np.repeat(first, np.diff(np.append(first, len(pair))))
    found, least, most = whole_words(line, starts, by), 0, 1
    while len(pair):
        now = np.flatnonzero((rank >= least) & (rank < most))
        if not len(now):
            break
        done = []
        for i in range(0, len(now), ALIGNED):
            at = now[i:i + ALIGNED]
            w = window[at]
            edits, end = aligned(line, by.codes[w], by.sizes[w], low[at] - by.edits[w], 4 * int(by.edits[w].max()) + 2)
            good = edits <= by.edits[w]
            done.append(pair[at][good])
            found += zip(row[at][good].tolist(), w[good].tolist(), edits[good].tolist(), (end - starts[row[at]])[good].tolist(), strict=True)
        left = ~np.isin(pair, np.concatenate(done))
        row, window, low, pair, rank = row[left], window[left], low[left], pair[left], rank[left]
        least, most = most, most * 4
    return found


def whole_words(line: np.ndarray, starts: np.ndarray, by: Windows) -> list[tuple[int, int, int, int]]:
    """(row, number, 0, end) of every place of a short item, between spaces or ends of a text."""
    found = []
    wide = np.concatenate([[0], line, np.zeros(LEAST + 1, line.dtype)]).astype(np.uint64)
    bound = (wide == 0) | (wide == 32)
    for size in sorted({len(c) for _, c in by.short}):
        held: dict[int, list[int]] = {}
        for n, (_, codes) in enumerate(by.short):
            if len(codes) == size:
                held.setdefault(int(_polynomial(codes.astype(np.uint64), size)[0]), []).append(n)
        known = np.sort(np.fromiter(held, np.uint64, len(held)))
        # a text's first letter is at 1, behind the bound at 0
        at = np.flatnonzero(bound[:len(line)] & bound[size + 1:size + 1 + len(line)]) + 1
        hashes = _polynomial(wide, size)[at]
        slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        for a, h in zip(at[known[slot] == hashes].tolist(), hashes[known[slot] == hashes].tolist(), strict=True):
            row = int(np.searchsorted(starts, a - 1, "right")) - 1
            found += [(row, len(by.items) + n, 0, a - 1 + size - int(starts[row])) for n in held[h] if np.array_equal(wide[a:a + size], by.short[n][1])]
    return found


def _polynomial(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every stretch of so many codes."""
    out = np.zeros(len(codes) - size + 1, np.uint64)
    for i in range(size):
        out = out * np.uint64(MULTIPLIERS[0]) + codes[i:i + len(out)]
    return out


def aligned(line: np.ndarray, patterns: np.ndarray, sizes: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits that turn each pattern into a stretch of the line, on the diagonals from ``start`` on, ``width`` of
    them; and where that stretch ends."""
    offsets = np.arange(width)
    cost = np.zeros((len(patterns), width), np.int64)
    best, end = np.full(len(patterns), 1 << 30), np.zeros(len(patterns), np.int64)
    for i in range(int(sizes.max(initial=0))):
        spot = start[:, None] + i + offsets
        here = np.where((spot >= 0) & (spot < len(line)), line[np.clip(spot, 0, len(line) - 1)], 0)
        swap = cost + (here != patterns[:, i:i + 1])
        drop = np.append(cost[:, 1:] + 1, np.full((len(cost), 1), 1 << 30), axis=1)
        step = np.minimum(swap, drop)
        cost = np.minimum.accumulate(step - offsets, axis=1) + offsets
        last = sizes == i + 1
        if last.any():
            best[last] = cost[last].min(1)
            end[last] = start[last] + i + cost[last].argmin(1) + 1
    return best, end


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Windows]:
    """The benchmark's windows, a bounded part at a time."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // BLOCK_CHARS)
    for part in range(parts):
        held = rows.where(F.pmod(F.xxhash64("item", "text"), parts) == part).collect()
        if windows := Windows.of(sorted((r.item if r.item is not None else -1, r.text) for r in held)):
            yield windows


def _hits(batches: Iterable[pa.RecordBatch], by: Windows) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, chars=SCANNED_CHARS):
        ids, best = piece.column("doc_id").to_pylist(), {}
        for row, window, edits, end in search(piece.column("text").to_pylist(), by):
            best.setdefault((row, by.item(window)), {}).setdefault(window, []).append((edits, end))
        rows = [(ids[row], item, len(found), *min(min(x) for x in found.values())) for (row, item), found in sorted(best.items())]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "item_id", "windows", "edits", "end"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: windows found, edits in the fullest of the nearest
    bands, end of that stretch (in normalised characters)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "doc_id bigint, item_id bigint, windows bigint, edits bigint, end bigint"
    found = [_with(rows, spark.sparkContext.broadcast(b), _hits, kind) for b in blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kind)


def _with(docs: DataFrame, shared, work, schema) -> DataFrame:
    return docs.mapInArrow(lambda batches: work(batches, shared.value), schema)


def _clean(batches: Iterable[pa.RecordBatch], by: Windows) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, chars=SCANNED_CHARS):
        keep = np.ones(piece.num_rows, bool)
        keep[[row for row, *_ in search(piece.column("text").to_pylist(), by)]] = False
        yield piece.filter(pa.array(keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no part of the benchmark."""
    shared = docs.sparkSession.sparkContext
    return reduce(lambda kept, b: _with(kept, shared.broadcast(b), _clean, docs.schema), blocks(benchmark), docs)
