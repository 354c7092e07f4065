"""Language identification by multilingual mixture inference (operator 3).

Per language a letter-trigram model is counted over every training document. A text is then a mixture: expectation
maximisation finds its language proportions, and of the nested sets of its heaviest languages the one with the best
penalised likelihood is selected. Texts are handled in batches, all their distinct trigrams in one array.

The model is a table of ``2 ** GRAM_BITS`` buckets for each language, so its size depends on the number of languages
alone; its counts cover all training rows and are summed by Spark.

Cases: null, empty and letterless texts give ``und`` with score 0; so does everything when no row can be learned from;
a null id counts as an empty one for the fold; repeated rows are predicted alike; long texts are used whole; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import pieces

GRAM_BITS = 15
GRAMS = 1 << GRAM_BITS
#: Added to every count.
SMOOTHING = 0.5
ROUNDS = 10
#: A language joins the set if it adds this many times log(trigrams) to the log-likelihood.
PENALTY = 3.0
#: Languages with less of a text than this are not tried in a set.
LEAST_SHARE = 0.02
#: Languages whose counts a training task holds before it passes them on.
HELD = 64
UNKNOWN = "und"

_IS_LETTER: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Trigram counts by bucket; None if the text has no letter. What is no letter separates words."""
    if not text:
        return None
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letter_table()[codes], codes, 0)
    codes = codes[np.append(True, (codes[1:] | codes[:-1]) != 0)]
    if len(codes) < 3:
        return None
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    return np.bincount(mixed >> np.uint32(32 - GRAM_BITS), minlength=GRAMS)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for piece in pieces(batches):
        for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
            if (counts := gram_counts(text)) is not None:
                if lang in held:
                    held[lang] += counts
                else:
                    held[lang] = counts
        if len(held) > HELD:
            yield from _sums(held)
            held = {}
    yield from _sums(held)


def _sums(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        grams = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int32()), pa.array(counts[grams], pa.int64())],
            names=["lang", "gram", "n"])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray  # (GRAMS, languages)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count trigrams over all given rows with a language. One number per language and bucket reaches the driver."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(set(counted.column("lang").to_pylist())))
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.full((GRAMS, len(languages)), SMOOTHING)
    at = np.fromiter((place[x] for x in counted.column("lang").to_pylist()), np.int64, counted.num_rows)
    counts[counted.column("gram").to_numpy(), at] += counted.column("n").to_numpy()
    return Model(languages, np.log(counts / counts.sum(0)).astype(np.float32) if languages else counts.astype(np.float32))


def _proportions(p: np.ndarray, count: np.ndarray, starts: np.ndarray, owner: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation from ``share``; also the log-likelihood of the result, relative to the best language
    of each trigram."""
    total = np.add.reduceat(count, starts)[:, None]
    for _ in range(rounds):
        ratio = count / np.einsum("ij,ij->i", p, share[owner])
        share = share * np.add.reduceat(p * ratio[:, None], starts) / total
    return share, np.add.reduceat(count * np.log(np.einsum("ij,ij->i", p, share[owner])), starts)


def infer(texts: list[str | None], model: Model) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """Per text: language, its share of the text under all languages, and the selected set with its shares."""
    found: list[tuple[str, float, list[tuple[str, float]]]] = [(UNKNOWN, 0.0, [])] * len(texts)
    grams, counts, rows = [], [], []
    for row, text in enumerate(texts):
        if model.languages and (c := gram_counts(text)) is not None:
            grams.append(np.flatnonzero(c))
            counts.append(c[grams[-1]])
            rows.append(row)
    if not rows:
        return found
    sizes = np.array([len(g) for g in grams])
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)
    log_p = model.log_p[np.concatenate(grams)]
    p = np.exp(log_p - log_p.max(1, keepdims=True))
    count = np.concatenate(counts).astype(np.float32)
    k = len(model.languages)
    share, _ = _proportions(p, count, starts, owner, np.full((len(rows), k), 1 / k, np.float32), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    single = np.add.reduceat(count[:, None] * np.log(np.maximum(p, 1e-30)), starts)
    cost = PENALTY * np.log(np.maximum(np.add.reduceat(count, starts), 2))
    best_set = np.zeros((len(rows), k), np.float32)
    first = single.argmax(1)
    best_set[np.arange(len(rows)), first] = 1
    best = single.max(1)
    for size in range(2, k + 1):
        heavy = np.take_along_axis(share, order[:, size - 1:size], 1)[:, 0] >= LEAST_SHARE
        if not heavy.any():
            break
        tried = np.flatnonzero(heavy)
        inside = np.zeros((len(tried), k), np.float32)
        np.put_along_axis(inside, order[tried, :size], np.take_along_axis(share[tried], order[tried, :size], 1), 1)
        inside /= inside.sum(1, keepdims=True)
        some = heavy[owner]
        some_sizes = sizes[tried]
        mixed, likely = _proportions(
            p[some], count[some], np.cumsum(some_sizes) - some_sizes, np.repeat(np.arange(len(tried)), some_sizes), inside, ROUNDS)
        gain = likely - (size - 1) * cost[tried]
        better = gain > best[tried]
        best[tried[better]], best_set[tried[better]] = gain[better], mixed[better]
    for i, row in enumerate(rows):
        top = int(best_set[i].argmax())
        chosen = [(model.languages[j], float(best_set[i, j])) for j in np.argsort(-best_set[i], kind="stable") if best_set[i, j] > 0]
        found[row] = (model.languages[top], min(1.0, float(share[i, top])), chosen)
    return found


def _predict(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        lang, score, chosen = zip(*infer(piece.column("text").to_pylist(), model), strict=True)
        mixture = [",".join(f"{name}:{part:.3f}" for name, part in x) for x in chosen]
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), piece.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.string())],
            names=["doc_id", "held_out", "lang_pred", "score", "mixture"])


def held_out(id_col: str = "doc_id", folds: int = 5):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, mixture (selected languages with their shares)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _predict(batches, shared.value), "doc_id bigint, held_out boolean, lang_pred string, score double, mixture string")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the training fold of ``documents`` and predict all of it."""
    return predict(docs, train(docs.where(~held_out())))


def _accepted(batches: Iterable[pa.RecordBatch], model: Model, least: float) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        keep = [lang != UNKNOWN and score >= least for lang, score, _ in infer(piece.column("text").to_pylist(), model)]
        yield piece.filter(pa.array(keep, pa.bool_()))


def accept(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose language is known and makes up ``least`` of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda batches: _accepted(batches, shared.value, least), docs.schema)
