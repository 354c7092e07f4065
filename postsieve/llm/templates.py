"""Line deduplication by a log-template tree (operator 9).

A line's words with digits are variable fields. Lines go down a tree of fixed depth, by their number of words and
their first words, and in a leaf they are merged into templates: a line joins the template with the largest share of
equal words, if that is ``ALIKE`` or more, and words that differ become variable fields of it. Templates that occur in
``LEAST_DOCS`` documents or more are recurring; their lines are dropped from every document.

Shuffled are hashes, and the lines of recurring leaves once. Which leaves recur is exact; the scan that fetches their
lines looks them up in a bitmap of fixed size, which lets a few more pass and none less. Equal lines are merged before
they are shuffled. A leaf is merged whole, as its templates follow from its lines in order: its task holds templates, not
lines, and compares a line only with the templates that agree with it in one of so many blocks of words that every
template alike does.

Cases: null and empty texts have no lines to drop; lines of fewer than ``LEAST_WORDS`` words stay; a line that a
document repeats counts once for it; rows that repeat id and text count as documents of their own and get equal
answers; an empty table gives an empty result; extra columns are ignored; long texts are used whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import pieces, row_key
from postsieve.plans.durable import written

DEPTH = 3
ALIKE = 0.75
LEAST_DOCS = 2
LEAST_WORDS = 3
#: Merged lines that are handed on together.
LEAF_LINES = 8192
#: Bits of the bitmap of recurring leaves: 512 parts of 32,768.
LEAF_BITS = 1 << 24
FIELD = "<*>"
VARIABLE = re.compile(r"\S*[0-9]\S*")
DIGIT = re.compile(r"[0-9]")


def parse(text: str) -> Iterator[tuple[int, int, int, list[str]]]:
    """(line number, leaf, pattern, words) of every line that takes part."""
    for number, line in enumerate(text.split("\n")):
        if DIGIT.search(line):
            line = VARIABLE.sub(FIELD, line)
        words = line.split()
        if len(words) >= LEAST_WORDS:
            yield (number, _hash(f"{len(words)} {' '.join(words[:DEPTH])}"), _hash(" ".join(words)), words)


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 9)
    return value - (1 << 64) if value >> 63 else value


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for piece in pieces(batches):
        rows = []
        for key, text in zip(piece.column("key").to_pylist(), piece.column("text").to_pylist(), strict=True):
            seen: set[int] = set()
            row += 1
            for number, leaf, pattern, _ in parse(text or ""):
                rows.append((key, row, number, leaf, pattern, leaf not in seen))
                seen.add(leaf)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)],
                names=["key", "row", "number", "leaf", "pattern", "first"])


def _lines(batches: Iterable[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        found: dict[int, tuple[int, str]] = {}
        for text in piece.column("text").to_pylist():
            for _, leaf, pattern, words in parse(text or ""):
                bit = leaf % LEAF_BITS
                if bitmap[bit >> 3] >> (bit & 7) & 1 and pattern not in found:
                    found[pattern] = (leaf, " ".join(words))
        if found:
            leaf, line = zip(*found.values(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int64()), pa.array(found.keys(), pa.int64()), pa.array(line, pa.string())],
                names=["leaf", "pattern", "line"])


class Leaf:
    """The templates of lines of one length that share their first words, which come in order."""

    def __init__(self, size: int):
        self.names: dict[str, int] = {FIELD: 0}
        self.templates, self.opened = np.zeros((4, size), np.int64), []
        # a template alike differs in so many words at most, all behind the shared ones: one block is equal
        apart, start = size - math.ceil(ALIKE * size), min(DEPTH, size)
        cuts = [start + (size - start) * i // (apart + 1) for i in range(apart + 2)]
        self.blocks = [slice(a, z) for a, z in zip(cuts, cuts[1:])]
        self.found: dict[tuple[int, bytes], list[int]] = {}

    def add(self, pattern: int, words: list[str]) -> int:
        """The pattern that opened the line's template."""
        row = np.array([self.names.setdefault(w, len(self.names)) for w in words])
        keys = self._keys(row)
        at = np.fromiter(set().union(*(self.found.get(k, ()) for k in keys)), np.int64)
        if at.size:
            at.sort()
            equal = (self.templates[at] == row).mean(1)
            best = int(equal.argmax())
            if equal[best] >= ALIKE:
                best = int(at[best])
                old = self._keys(self.templates[best])
                self.templates[best] = np.where(self.templates[best] == row, row, 0)
                for was, now in zip(old, self._keys(self.templates[best]), strict=True):
                    if was != now:
                        self.found[was].remove(best)
                        self.found.setdefault(now, []).append(best)
                return self.opened[best]
        if len(self.opened) == len(self.templates):
            self.templates = np.concatenate([self.templates, np.zeros_like(self.templates)])
        self.templates[len(self.opened)] = row
        for k in keys:
            self.found.setdefault(k, []).append(len(self.opened))
        self.opened.append(pattern)
        return pattern

    def _keys(self, row: np.ndarray) -> list[tuple[int, bytes]]:
        return [(i, row[b].tobytes()) for i, b in enumerate(self.blocks)]

    def rows(self) -> Iterator[tuple[None, int, str]]:
        names = list(self.names)
        for pattern, template in zip(self.opened, self.templates):
            yield None, pattern, " ".join(names[w] for w in template)


def _templates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by leaf, lines in order. First a row for each line, then one for each template, with its words."""

    def merged() -> Iterator[tuple[int | None, int, str | None]]:
        leaf, place = None, None
        for batch in batches:
            for now, size, pattern, line in zip(*(batch.column(c).to_pylist() for c in ("leaf", "size", "pattern", "line")), strict=True):
                # two leaves with one hash differ in their number of words
                if (now, size) != place:
                    if leaf:
                        yield from leaf.rows()
                    leaf, place = Leaf(size), (now, size)
                yield pattern, leaf.add(pattern, line.split(" ")), None
        if leaf:
            yield from leaf.rows()

    rows = merged()
    while some := list(islice(rows, LEAF_LINES)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*some, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)],
            names=["pattern", "template", "words"])


def _bitmap(leaves: DataFrame) -> np.ndarray:
    """One bit for each recurring leaf: at most 512 parts of 4 KiB reach the driver."""
    bit = F.pmod("leaf", F.lit(LEAF_BITS))
    parts = leaves.groupBy((bit / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(32768))).alias("bits")).collect()
    bitmap = np.zeros(LEAF_BITS // 8, np.uint8)
    for r in parts:
        bitmap[r.part * 4096:(r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return bitmap


def recurring(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (key, text): the recurring templates (template, words, documents), and the lines to drop
    (key, number)."""
    spark = docs.sparkSession
    marks = written(docs.mapInArrow(_marks, "key binary, row bigint, number int, leaf bigint, pattern bigint, first boolean"))
    leaves = marks.groupBy("leaf").agg(F.count_if("first").alias("documents")).where(F.col("documents") >= LEAST_DOCS)
    bitmap = spark.sparkContext.broadcast(_bitmap(leaves))
    lines = docs.select("text").mapInArrow(lambda batches: _lines(batches, bitmap.value), "leaf bigint, pattern bigint, line string")
    distinct = lines.groupBy("pattern", "leaf", "line").agg(F.lit(1).alias("one"))
    sized = distinct.select("leaf", F.size(F.split("line", " ")).alias("size"), "pattern", "line")
    ordered = sized.repartition("leaf", "size").sortWithinPartitions("leaf", "size", "line")
    templates = written(ordered.mapInArrow(_templates, "pattern bigint, template bigint, words string"))
    seen = marks.join(templates.where(F.col("pattern").isNotNull()).select("pattern", "template"), "pattern").select("template", "key", "row", "number")
    # rows may repeat a key, and are documents of their own
    counted = seen.groupBy("template", "row").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("documents"))
    often = written(counted.where(F.col("documents") >= LEAST_DOCS))
    named = templates.where(F.col("pattern").isNull()).join(often, "template").select("template", "words", "documents")
    return named, seen.join(often, "template").select("key", "number")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``text`` without recurring lines, ``n_lines``, ``dropped`` (line numbers from 0)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), row_key(id_col, text_col).alias("key"))
    _, drops = recurring(rows.select("key", "text"))
    by_key = drops.groupBy("key").agg(F.array_sort(F.collect_set("number")).alias("dropped"))
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    return rows.join(by_key, "key", "left").withColumn("lines", lines).select(
        F.col("doc_id").alias(id_col),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")).alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"), F.coalesce("dropped", F.expr("cast(array() as array<int>)")).alias("dropped"))
