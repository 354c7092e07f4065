"""Passages of words that occur more than once, by fixed-block anchors (operator 12).

Each document is cut into blocks of half a window, one behind the other; any window of ``words`` words in a row holds a
whole block. The blocks of all documents are the index. Every stretch of a block's length, at every word, is looked up
in it: a stretch that is a block elsewhere is a hit, and two equal windows are sure to hit each other's blocks. Hits are
then extended to both sides for as long as the whole windows around them occur elsewhere, which gives the maximal exact
repeats; no pair of documents is ever listed, so a passage with thousands of copies costs as much as its words.

The documents are dealt into chunks once. A chunk sends the sorted 32-bit prints of its stretches and its blocks to the
buckets of their hash and gets a bit back for each print; then it sends 96-bit hashes of the windows around its hits and
gets a bit back for each of them. Prints only propose, the wide hashes decide. A hot passage is sent once by each chunk.
Buckets follow the measured size of the text, so that neither a chunk nor a bucket outgrows a task.

Cases: null texts and texts of fewer words than a window lose nothing; rows that repeat an id and a text are documents
of their own and lose their windows to each other; an empty table gives an empty result; words are compared as they
are, split at ASCII white space; other columns are passed on, but for those named like a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from postsieve.llm.chunks import in_chunks
from postsieve.llm.common import sorted_set

WORDS = 35
#: Prints of a bucket, by an estimate of six bytes a word.
BUCKET_PRINTS = 4_000_000
#: Buckets of a small table, unless its shuffles have fewer partitions; each chunk sends a row to every bucket.
LEAST_BUCKETS = 64
#: Bits of a print, besides those of its bucket.
PRINT_BITS = 32
#: Bytes hashed together.
HASHED_BYTES = 500_000
FACTOR = 0x9E3779B97F4A7C15

SENT = "bucket int, chunk int, prints binary, more binary"
BITS = "chunk int, step int, bucket int, bits binary"


def _powers(factor: int, size: int) -> np.ndarray:
    out = np.full(size, factor, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Hash:
    """A 64-bit hash of stretches of bytes: random values of the bytes times powers of an odd factor, summed."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.values = draw.integers(1, 1 << 64, 256, np.uint64)
        self.factor = int(draw.integers(1 << 62, 1 << 63)) * 2 + 1
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, line: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(line):
            self.up, self.down = (_powers(f, 2 * len(line) + 1) for f in (self.factor, pow(self.factor, -1, 1 << 64)))
        sums = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(self.values[line] * self.up[:len(line)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.down[starts]
        # sums of powers are even in too regular a way; words are to look drawn at random
        found = (found ^ found >> np.uint64(31)) * np.uint64(FACTOR)
        return found ^ found >> np.uint64(29)


#: Two hashes of words that have nothing in common, and the bytes that part words.
_HASHES = (_Hash(1), _Hash(2))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


class Line:
    """The words of a chunk's documents behind each other, as hashes."""

    def __init__(self, texts: list[str | None], hashes: int = 2):
        sizes, words, held, used = [np.empty(0, np.int64)], [np.empty((0, hashes), np.uint64)], [], 0
        for text in texts:
            held.append((text or "").encode())
            used += len(held[-1])
            if used > HASHED_BYTES:
                self._add(held, sizes, words)
                held, used = [], 0
        if held:
            self._add(held, sizes, words)
        self.sizes, self.words = np.concatenate(sizes), np.concatenate(words)
        self.ends = np.cumsum(self.sizes)

    @staticmethod
    def _add(texts: list[bytes], sizes: list[np.ndarray], words: list[np.ndarray]) -> None:
        line = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        space = _SPACE[line]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        before = np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in texts]))
        sizes.append(np.diff(before))
        words.append(np.stack([h(line, starts, ends) for h in _HASHES[:words[0].shape[1]]], 1))

    def starts(self, size: int) -> np.ndarray:
        """Where a stretch of so many words of one document begins."""
        n = int(self.ends[-1]) if len(self.ends) else 0
        left = np.repeat(self.ends, self.sizes) - np.arange(n)
        return np.flatnonzero(left >= size)

    def within(self, at: np.ndarray) -> np.ndarray:
        """Place in its document of each place of the line."""
        doc = np.searchsorted(self.ends, at, "right")
        return at - (self.ends - self.sizes)[doc]

    def rolled(self, column: int, size: int, at: np.ndarray) -> np.ndarray:
        """A hash of the stretch of so many words from each place on."""
        powers, back = _powers(FACTOR, len(self.words) + 1), _powers(pow(FACTOR, -1, 1 << 64), len(self.words) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words[:, column] * powers[:-1])])
        return (sums[at + size] - sums[at]) * back[at]


class Search:
    """What each chunk and each bucket does."""

    def __init__(self, words: int, bucket_bits: int, print_bits: int = PRINT_BITS):
        self.words, self.block, self.bucket_bits, self.print_bits = words, (words + 1) // 2, bucket_bits, print_bits

    def prints(self, line: Line) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all stretches, their prints with bucket, and which of them are blocks."""
        at = line.starts(self.block)
        held = line.rolled(0, self.block, at) >> np.uint64(64 - self.print_bits - self.bucket_bits)
        return at, held, line.within(at) % self.block == 0

    def cut(self, buckets: np.ndarray) -> list[tuple[int, slice]]:
        """Each bucket's part of sorted rows."""
        found, first = np.unique(buckets, return_index=True)
        ends = np.append(first, len(buckets))[1:]
        return [(int(b), slice(int(a), int(z))) for b, a, z in zip(found, first, ends, strict=True)]

    def probe(self, table: pa.Table) -> pa.Table:
        """First step of a chunk: the prints of all its stretches, and those of its blocks."""
        chunk, line = _chunk(table, 1)
        _, held, block = self.prints(line)
        held, blocks, low = sorted_set(held), sorted_set(held[block]), np.uint64(self.print_bits)
        rows, own = [], {b: cut for b, cut in self.cut(blocks >> low)}
        for bucket, cut in self.cut(held >> low):
            sent = blocks[own[bucket]] if bucket in own else blocks[:0]
            rows.append((bucket, chunk, held[cut].astype(np.uint32).tobytes(), sent.astype(np.uint32).tobytes()))
        return _table(rows, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), ("bucket", "chunk", "prints", "more"))

    def meet_blocks(self, table: pa.Table) -> pa.Table:
        """A bucket's reply to the first step: which prints are blocks of other chunks."""
        bucket, chunks, prints, blocks = _received(table, np.uint32)
        owner = np.repeat(chunks, [len(b) for b in blocks])
        every = np.concatenate(blocks)
        order = np.argsort(every, kind="stable")
        known, first = np.unique(every[order], return_index=True)
        low, high = (f.reduceat(owner[order], first) if len(first) else owner for f in (np.minimum, np.maximum))
        rows = []
        for chunk, held in zip(chunks.tolist(), prints, strict=True):
            slot = np.minimum(np.searchsorted(known, held), max(len(known) - 1, 0))
            hit = (known[slot] == held) & ((low[slot] != chunk) | (high[slot] != chunk)) if len(known) else np.zeros(len(held), bool)
            rows.append((chunk, 1, bucket, np.packbits(hit).tobytes()))
        return _table(rows, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), ("chunk", "step", "bucket", "bits"))

    def around_hits(self, line: Line, bits: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows that hold a hit, and both parts of their hashes."""
        at, held, block = self.prints(line)
        known, number, count = np.unique(held, return_inverse=True, return_counts=True)
        hit = _unpacked(self.cut(known >> np.uint64(self.print_bits)), bits, len(known))
        local = np.zeros(len(known), bool)
        local[number[block]] = True
        flag = np.zeros(len(line.words) + 1, np.int64)
        flag[at + 1] = (hit | (local & (count > 1)))[number]
        before = np.cumsum(flag)
        start = line.starts(self.words)
        start = start[before[start + self.words - self.block + 1] > before[start]]
        return start, line.rolled(0, self.words, start), line.rolled(1, self.words, start).astype(np.uint32)

    def extend(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        """Second step of a chunk: the hashes of its windows around hits."""
        chunk, line = _chunk(table, 2)
        _, wide, more = self.around_hits(line, _bits(replies, 1))
        order, new, _ = _distinct(wide, more)
        wide, more = wide[order][new], more[order][new]
        rows = [(bucket, chunk, wide[cut].tobytes(), more[cut].tobytes()) for bucket, cut in self.cut(wide >> np.uint64(64 - self.bucket_bits))]
        return _table(rows, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), ("bucket", "chunk", "prints", "more"))

    def meet_windows(self, table: pa.Table) -> pa.Table:
        """A bucket's reply to the second step: which windows other chunks hold as well."""
        bucket, chunks, wide, more = _received(table, np.uint64)
        sizes = [len(x) for x in wide]
        order, new, group = _distinct(np.concatenate(wide), np.concatenate(more))
        again = np.bincount(group, minlength=1)[group] > 1  # a chunk sends a window once
        shared = np.empty(len(order), bool)
        shared[order] = again
        rows = [(chunk, 2, bucket, np.packbits(x).tobytes()) for chunk, x in zip(chunks.tolist(), np.split(shared, np.cumsum(sizes)[:-1]), strict=True)]
        return _table(rows, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), ("chunk", "step", "bucket", "bits"))

    def repeats(self, line: Line, replies: pa.Table) -> list[list[tuple[int, int]]]:
        """Last step of a chunk: the maximal repeats (start, length) of each document."""
        start, wide, more = self.around_hits(line, _bits(replies, 1))
        order, new, group = _distinct(wide, more)
        shared = _unpacked(self.cut(wide[order][new] >> np.uint64(64 - self.bucket_bits)), _bits(replies, 2), int(new.sum()))
        shared |= np.bincount(group, minlength=len(shared)) > 1
        start = np.sort(start[order][shared[group]])
        out: list[list[tuple[int, int]]] = [[] for _ in line.sizes]
        if not len(start):
            return out
        doc = np.searchsorted(line.ends, start, "right")
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + self.words)))
        last = np.append(first[1:], len(start)) - 1
        own = start - (line.ends - line.sizes)[doc]
        for d, a, z in zip(doc[first].tolist(), own[first].tolist(), own[last].tolist(), strict=True):
            out[d].append((a, z + self.words - a))
        return out


def _chunk(table: pa.Table, hashes: int) -> tuple[int, Line]:
    return table.column("chunk")[0].as_py(), Line(_texts(table), hashes)


def _texts(table: pa.Table) -> list[str | None]:
    return [t for part in table.column("row").chunks for t in part.field("text").to_pylist()]


def _table(rows: list[tuple], kinds: tuple[pa.DataType, ...], names: tuple[str, ...]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=list(names))


def _received(table: pa.Table, kind: type) -> tuple[int, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    prints = [np.frombuffer(x, kind) for x in table.column("prints").to_pylist()]
    return table.column("bucket")[0].as_py(), table.column("chunk").to_numpy(), prints, [np.frombuffer(x, np.uint32) for x in table.column("more").to_pylist()]


def _bits(replies: pa.Table, step: int) -> dict[int, bytes]:
    return {b: bits for s, b, bits in zip(*(replies.column(c).to_pylist() for c in ("step", "bucket", "bits")), strict=True) if s == step}


def _unpacked(cuts: list[tuple[int, slice]], bits: dict[int, bytes], size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    for bucket, cut in cuts:
        out[cut] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=cut.stop - cut.start)
    return out


def _distinct(wide: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by both parts, which rows of that order are the first of their kind, and the number of each row's kind."""
    order = np.lexsort((more, wide))
    new = np.ones(len(order), bool)
    a, b = wide[order], more[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new, np.cumsum(new) - 1


def find_repeats(docs: DataFrame, words: int = WORDS, text_col: str = "text", print_bits: int = PRINT_BITS) -> DataFrame:
    """The documents with ``n_words``, ``repeats`` (start, length in words) and ``kept``, the words outside of all
    repeats joined by single spaces. A word is in a repeat if a window of ``words`` words that holds it starts anywhere
    else as well."""
    held = docs.drop("n_words", "repeats", "kept").withColumnRenamed(text_col, "text")
    dealt = in_chunks(held)
    bits = max(int(max(dealt.text_bytes / 6 / BUCKET_PRINTS, min(dealt.parts, LEAST_BUCKETS) - 1)).bit_length(), 1)
    search = Search(words, min(bits, 64 - print_bits), print_bits)
    rows = dealt.rows.groupBy("chunk")
    hits = rows.applyInArrow(lambda t: search.probe(t), SENT).groupBy("bucket").applyInArrow(lambda t: search.meet_blocks(t), BITS)
    windows = rows.cogroup(hits.groupBy("chunk")).applyInArrow(lambda t, r: search.extend(t, r), SENT).groupBy("bucket").applyInArrow(
        lambda t: search.meet_windows(t), BITS)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts = _texts(table)
        line = Line(texts)
        found, kept = search.repeats(line, replies), []
        for text, spans in zip(texts, found, strict=True):
            own = text.encode().split() if text else []
            for start, length in reversed(spans):
                del own[start:start + length]
            kept.append(b" ".join(own).decode())
        spans = [[{"start": s, "length": n} for s, n in own] for own in found]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.table([table.column("row"), pa.array(line.sizes), pa.array(spans, kind), pa.array(kept, pa.string())],
                        names=["row", "n_words", "repeats", "kept"])

    span = StructType([StructField("start", LongType()), StructField("length", LongType())])
    result = StructType([dealt.rows.schema["row"], StructField("n_words", LongType()), StructField("repeats", ArrayType(span)), StructField("kept", StringType())])
    found = rows.cogroup(hits.unionAll(windows).groupBy("chunk")).applyInArrow(cut, result)
    return found.select("row.*", "n_words", "repeats", "kept").withColumnRenamed("text", text_col)


__all__ = ["Line", "Search", "find_repeats"]
