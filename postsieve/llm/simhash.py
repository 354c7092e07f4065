"""Near duplicates by SimHash and BK-trees (operator 1).

A fingerprint has 64 bits, each the majority over the hashes of a text's word shingles. Fingerprints within ``radius``
bits are linked and linked documents form components.

Search: of ``radius + 3`` bit bands, two fingerprints within the radius agree in three at least, so each distinct
fingerprint goes to one shard per choice of three bands (for 3 bits: 20 shards of about 32 shared bits). A shard whose
key two fingerprints share gets a BK-tree (children keyed by their Hamming distance to the parent), and a search
follows only edges within the radius of a node's own distance. The trees of all shards grow with the input, so they
are not broadcast to every executor: a shard's queries and its tree meet in one task. A shard of more than
``TREE_NODES`` fingerprints is divided into several trees and its queries are sent to each of them, so no task ever
holds more than one such tree. What leaves a shard is a spanning set of links, never all pairs.

Cases: null and empty texts and texts without a word have fingerprint zero, linked like any other; fewer words than a
shingle form one shingle; rows that repeat an id are rows of their own; a null id is never the smallest of a component
unless it has no other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import pieces, row_key
from postsieve.llm.graph import components
from postsieve.plans.durable import written

SEED = 42
#: Most fingerprints in one BK-tree, apart from chance, and queries that search it at a time.
TREE_NODES = 4096
QUERIES = 256
#: Shingles hashed at a time, which bounds the memory for long texts.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text as an unsigned number."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return digest(line, SEED)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:len(found) - words + 1], ends[words - 1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        cuts = zip(starts[at:at + BLOCK].tolist(), ends[at:at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(line[a:z], SEED) for a, z in cuts], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        found = np.array([fingerprint(text, words) for text in piece.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), piece.column("key"), pa.array(found.view(np.int64))], names=["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp) with the fingerprint as a signed bigint and a key of id and text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _fingerprints(batches, words), "doc_id bigint, key binary, fp bigint")


class BKTree:
    """A BK-tree over distinct 64-bit points, built and searched a level at a time."""

    def __init__(self, points: np.ndarray):
        self.points = points
        keys, children = [], []
        left, parent = np.arange(1, len(points)), np.zeros(max(len(points) - 1, 0), np.int64)
        while left.size:
            edge = parent * 65 + np.bitwise_count(points[left] ^ points[parent])
            own, first, place = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(own)
            children.append(left[first])
            parent = left[first][place]
            left, parent = left[parent != left], parent[parent != left]
        # children in order of (parent, distance): the edges within a range are neighbours
        order = np.argsort(edges := np.concatenate([np.empty(0, np.int64), *keys]), kind="stable")
        self.edges, self.children = edges[order], np.concatenate([np.empty(0, np.int64), *children])[order]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) within the radius, as positions."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        hits = []
        while query.size:
            distance = np.bitwise_count(queries[query] ^ self.points[node]).astype(np.int64)
            near = distance <= radius
            hits.append((query[near], node[near]))
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0), "left")
            count = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), "right") - low
            query = np.repeat(query, count)
            node = self.children[np.arange(len(query)) + np.repeat(low - np.cumsum(count) + count, count)]
        return np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])


class _Shard:
    """One tree and the links found with it so far."""

    def __init__(self, points: np.ndarray, radius: int):
        self.points, self.radius, self.tree = points, radius, BKTree(points)
        self.label = np.arange(len(points))  # smallest position of a point's component within the tree

    def own_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A spanning set of links among the tree's own points."""
        for at in range(0, len(self.points), QUERIES):
            query, node = self.tree.search(self.points[at:at + QUERIES], self.radius)
            ties = self._between(self.label[query + at], self.label[node])
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while (up := root.get(x, x)) != x:
                    x = up
                return x

            kept = []
            for a, b in ties.tolist():
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    kept.append((a, b))
            if kept:
                moved = np.arange(len(self.points))
                for x in root:
                    moved[x] = find(x)
                self.label = moved[self.label]
                pairs = np.array(kept)
                yield self.points[pairs[:, 0]], self.points[pairs[:, 1]]

    def links_to(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From other points, one link to each component of the tree that they reach."""
        for at in range(0, len(queries), QUERIES):
            some = queries[at:at + QUERIES]
            query, node = self.tree.search(some, self.radius)
            if len(query):
                ties = self._unique(query, self.label[node])
                yield some[ties[:, 0]], self.points[ties[:, 1]]

    def _unique(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.unique(a * len(self.points) + b)
        return np.stack([both // len(self.points), both % len(self.points)], axis=1)

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = a != b
        return self._unique(a[apart], b[apart])


def _links(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of shard, a shard's tree points before its other queries."""
    run, own, shard = None, [], None

    def search(now, points, mine):
        nonlocal run, own, shard
        if now != run:
            yield from finish()
            run, own, shard = now, [], None
        own.append(points[mine])
        if not mine.all():
            if shard is None:
                yield from finish()
            yield from shard.links_to(points[~mine])

    def finish():
        nonlocal shard
        if shard is None and own and sum(map(len, own)):
            shard = _Shard(np.concatenate(own), radius)
            yield from shard.own_links()

    def batch_of(links):
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*links, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        band, key, part, fp, mine = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key", "part", "fp", "own"))
        points = fp.view(np.uint64)
        edges = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        found, held = [], 0
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)], strict=True):
            for link in search((band[a], key[a], part[a]), points[a:z], mine[a:z]):
                found.append(link)
                held += len(link[0])
            if held > 100_000:
                yield batch_of(found)
                found, held = [], 0
        if found:
            yield batch_of(found)
    if found := list(finish()):
        yield batch_of(found)


def band_masks(radius: int) -> list[int]:
    """The bits of every choice of three out of ``radius + 3`` bands, as signed numbers."""
    cuts = [round(64 * i / (radius + 3)) for i in range(radius + 4)]
    bands = [((1 << z) - 1) ^ ((1 << a) - 1) for a, z in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b | c for a, b, c in combinations(bands, 3))]


def fingerprint_links(points: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints ``fp`` exactly as all pairs within the radius would."""
    shards = ", ".join(f"struct({i} as band, fp & {m}L as key)" for i, m in enumerate(band_masks(radius)))
    keyed = points.selectExpr("fp", f"inline(array({shards}))")
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("held")).where("held > 1")
    parts = keyed.join(shared, ["band", "key"]).withColumn("parts", F.ceil(F.col("held") / TREE_NODES).cast("int"))
    sent = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "band", "key", "part", "fp", (F.pmod(F.xxhash64("fp"), F.col("parts")) == F.col("part")).alias("own"))
    placed = sent.repartition("band", "key", "part").sortWithinPartitions("band", "key", "part", F.desc("own"))
    return placed.mapInArrow(lambda batches: _links(batches, radius), "a bigint, b bigint").distinct()


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """Rows with a fingerprint ``fp``, and their component's ``root`` and ``component_id``."""
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(fingerprint_links(points, radius))
    rooted = points.join(joined, points.fp == joined.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable)."""
    return _grouped(written(fingerprints(docs, words, id_col, text_col).drop("key")), radius).select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which one of each component stays: that with the smallest id, and
    of several with that id or none the one with the smallest key of id and text. Rows that repeat both are one.

    Keys alone are grouped; the documents are shuffled once, by that key.
    """
    grouped = _grouped(written(fingerprints(docs, words, id_col, text_col)), radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    stay = grouped.groupBy("root").agg(first.alias("first")).select(F.col("first.key").alias("key"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("key"))
    return whole.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
