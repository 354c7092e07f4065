"""Scoring by cross-entropy difference (operator 8).

Two bigram models with one smoothing: the target model counts the documents labelled good, the background model counts
all documents. A document's score is the mean over its tokens of the target's loss less the background's: the lower,
the more it is like the target.

Every word and every pair of words is counted, whatever their number, and nothing of them is gathered anywhere. Documents
are dealt into chunks by their id once, and the good ids go to the same chunks. A chunk numbers its words, counts its
distinct pairs and sends both to the buckets of their hash, 64 bits each besides those of the bucket, so that in a
corpus of 10^12 pairs about one in ten such runs mistakes a single pair. A bucket adds up what it holds and answers only
for what several chunks hold: a chunk's own counts are the totals of the rest, which are most. The chunk then reads its
texts again from the same shuffle and takes each document's mean. A frequent word or pair is sent once by each chunk.

Cases: null and empty texts have no tokens, null losses and a null score; documents without a label are background
only; several labels for one id count as good if any is; rows without an id are background; without target documents
the target model is uniform; repeated rows count as often; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.repeats import Line

#: Words that the smoothing allows for, if the corpus has no more.
VOCABULARY = 1 << 16
#: Share of the bigram estimate where its first word is known, and what is added to word counts.
BIGRAM_WEIGHT = 0.6
SMOOTHING = 0.5
#: Bytes of text of a chunk, and of the text that a bucket answers for.
CHUNK_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000
LEAST_BUCKETS = 128
#: Chunks that rows of one id are spread over, by the part of the input they come from.
LANES = 4
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

#: Kinds of rows that pass between chunks and buckets: good ids, words, pairs, and how many words a bucket knows.
GOOD, WORDS, PAIRS, SIZES = range(4)
SENT = "bucket int, kind int, chunk int, keys binary, n binary, good binary"
REPLY = "chunk int, kind int, bucket int, bits binary, n binary, good binary, words bigint, tokens bigint, good_tokens bigint"
_REPLY_KINDS = (*[pa.int32()] * 3, *[pa.binary()] * 3, *[pa.int64()] * 3)


def _packed(counts: np.ndarray, kind: type) -> bytes:
    """Counts as all their lowest bytes, then all their next ones: the higher ones are zeros, which shuffles compress."""
    return counts.astype(kind).view(np.uint8).reshape(len(counts), np.dtype(kind).itemsize).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(kind).ravel()


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ keys >> np.uint64(32)) * np.uint64(FACTORS[1])
    return keys ^ keys >> np.uint64(29)


class _Counts:
    """Distinct keys of a chunk in the order in which they are sent, with their counts."""

    def __init__(self, keys: np.ndarray, spread: np.ndarray, n: np.ndarray, good: np.ndarray, bits: int):
        self.bucket = spread >> np.uint64(64 - bits)
        self.order = np.lexsort((keys, self.bucket))
        self.keys, self.n, self.good = keys, n, good

    def parts(self) -> list[tuple[int, np.ndarray]]:
        """Each bucket and the keys sent to it, by number."""
        found, first = np.unique(self.bucket[self.order], return_index=True)
        return list(zip(found.tolist(), np.split(self.order, first[1:]), strict=True)) if len(found) else []


class _Chunk:
    """A chunk's documents, its words and its pairs of words; the word before the first of a document has number 0."""

    def __init__(self, table: pa.Table, good_ids: np.ndarray, bits: int):
        self.ids = table.column("doc_id")
        texts = [" ".join(t.lower().split()) if t else "" for t in table.column("text").to_pylist()]
        line = Line(texts)
        self.sizes, self.ends = line.sizes, line.ends
        known, number, count = np.unique(line.words[:, 0], return_inverse=True, return_counts=True)
        first = np.empty(len(known), np.int64)
        first[number] = np.arange(len(number))
        seconds = line.words[first, 1]
        ids = np.array([-1 if i is None else i for i in self.ids.to_pylist()], np.int64)
        labelled = np.isin(ids, good_ids) & ~self.ids.is_null().to_numpy()
        of_good = np.repeat(labelled, self.sizes)
        self.words = _Counts(known, seconds, count, np.bincount(number[of_good], minlength=len(known)), bits)
        before = np.append(0, number + 1)[:-1]
        before[(self.ends - self.sizes)[self.sizes > 0]] = 0
        pairs, self.pair, count = np.unique(before << 32 | number, return_inverse=True, return_counts=True)
        self.before, self.word = pairs >> 32, pairs & 0xFFFFFFFF
        hashes = (np.append(np.uint64(0), x) for x in (known, seconds))
        keys, spread = (_mixed(h[self.before] * np.uint64(f) + h[self.word + 1]) for h, f in zip(hashes, FACTORS, strict=True))
        self.pairs = _Counts(keys, spread, count, np.bincount(self.pair[of_good], minlength=len(pairs)), bits)


def _good(replies: pa.Table) -> np.ndarray:
    return replies.column("good_id").drop_null().to_numpy().astype(np.int64)


def send(table: pa.Table, replies: pa.Table, bits: int) -> pa.Table:
    """A chunk's words and pairs with their counts, by bucket."""
    chunk = table.column("chunk")[0].as_py() if table.num_rows else -1
    held = _Chunk(table, _good(replies), bits)
    rows = [(bucket, kind, chunk, c.keys[at].tobytes(), _packed(c.n[at], np.uint32), _packed(c.good[at], np.uint32))
            for kind, c in ((WORDS, held.words), (PAIRS, held.pairs)) for bucket, at in c.parts()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "kind", "chunk", "keys", "n", "good"])


def meet(table: pa.Table) -> pa.Table:
    """A bucket's answers: which keys of a chunk others hold as well, and the totals of these; and how many words and
    tokens it knows."""
    bucket, kind = table.column("bucket")[0].as_py(), table.column("kind")[0].as_py()
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    n, good = ([_unpacked(x, np.uint32) for x in table.column(c).to_pylist()] for c in ("n", "good"))
    every = np.concatenate(keys)
    order = np.argsort(every)
    first = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
    group = np.empty(len(every), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(every))))
    shared = np.diff(np.append(first, len(every))) > 1
    totals = [np.add.reduceat(np.concatenate(x)[order].astype(np.int64), first) for x in (n, good)]
    rows, at = [], 0
    for chunk, own in zip(table.column("chunk").to_pylist(), keys, strict=True):
        mine = group[at:at + len(own)]
        told = mine[shared[mine]]
        rows.append((chunk, kind, bucket, np.packbits(shared[mine]).tobytes(), *(_packed(t[told], np.int64) for t in totals), None, None, None))
        at += len(own)
    if kind == WORDS:
        rows.append((-1, SIZES, bucket, None, None, None, len(first), int(totals[0].sum()), int(totals[1].sum())))
    names = [c.split(" ")[0] for c in REPLY.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(_REPLY_KINDS)], names=names)


def _totals(counts: _Counts, kind: int, replies: dict[tuple[int, int], tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    n, good = counts.n.astype(np.float64), counts.good.astype(np.float64)
    for bucket, at in counts.parts():
        bits, all_n, all_good = replies[kind, bucket]
        told = at[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)]
        n[told], good[told] = _unpacked(all_n, np.int64), _unpacked(all_good, np.int64)
    return n, good


def _losses(pair: np.ndarray, of: np.ndarray, before: np.ndarray, size: int, words: int) -> np.ndarray:
    """Losses of pairs that a model counts ``pair`` times, their second words ``of`` and their first ``before`` times."""
    alone = (of + SMOOTHING) / (size + SMOOTHING * max(VOCABULARY, words))
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.log(np.where(before > 0, alone * (1 - BIGRAM_WEIGHT) + pair * BIGRAM_WEIGHT / before, alone))


def finish(table: pa.Table, replies: pa.Table, bits: int) -> pa.Table:
    """A chunk's documents with their mean losses."""
    held = _Chunk(table, _good(replies), bits)
    known = replies.column("sizes").drop_null()
    sizes = tuple(known[0].as_py().values()) if len(known) else (0, 0, 0)
    told = {(kind, bucket): x for kind, bucket, *x in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "bits", "n", "good")), strict=True)}
    words, pairs = (_totals(c, kind, told) for c, kind in ((held.words, WORDS), (held.pairs, PAIRS)))
    columns = []
    for model, size in ((1, sizes[2]), (0, sizes[1])):
        before = np.append(0.0, words[model])[held.before]
        loss = _losses(pairs[model], words[model][held.word], before, size, sizes[0])[held.pair]
        sums = np.append(0.0, np.cumsum(loss))
        with np.errstate(invalid="ignore"):
            columns.append((sums[held.ends] - sums[held.ends - held.sizes]) / held.sizes)
    empty = held.sizes == 0
    near, far = columns
    return pa.table([held.ids, pa.array(held.sizes), *(pa.array(x, mask=empty) for x in (near, far, near - far))],
                    names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(2 * least, -(-total // CHUNK_BYTES))
    parts = max(least, -(-chunks // 2))
    bits = max(int(max(total / BUCKET_BYTES, min(parts, LEAST_BUCKETS) - 1)).bit_length(), 1)
    lane = f"pmod(spark_partition_id(), {LANES})"
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select(F.expr(f"int(pmod(if(doc_id is null, xxhash64(text, {lane}), xxhash64(doc_id, {lane})), {chunks}))").alias("chunk"), "doc_id", "text")
    dealt = rows.repartition(parts, "chunk").groupBy("chunk")
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("bigint").alias("good_id")).where("good_id is not null").distinct()
    good = good.select("good_id", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"))
    ids = good.select(F.expr(f"int(pmod(xxhash64(good_id, lane), {chunks}))").alias("chunk"), "good_id")
    sent = dealt.cogroup(ids.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(lambda t, r: send(t, r, bits), SENT)
    told = sent.groupBy("kind", "bucket").applyInArrow(lambda t: meet(t), REPLY)
    sizes = told.where(F.col("kind") == SIZES).agg(F.struct(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "tokens", "good_tokens"))).alias("sizes"))
    back = told.where(F.col("kind") != SIZES).select("chunk", "kind", "bucket", "bits", "n", "good", sizes.scalar().alias("sizes"))
    back = back.unionByName(ids.withColumn("kind", F.lit(GOOD)), allowMissingColumns=True)
    return dealt.cogroup(back.groupBy("chunk")).applyInArrow(
        lambda t, r: finish(t, r, bits), "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double")


__all__ = ["score"]
