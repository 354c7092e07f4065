"""Personal data: proposed spans, scored by gradient-boosted trees (operator 2).

Fixed patterns give the base spans, which always stay. Beside them, high-recall generators propose overlapping spans:
the parts of longer digit runs, numbers without a plus, addresses with spelled-out signs. Each candidate has features
of its format and of the characters around it. Trees are boosted on candidates whose truth a rule settles (base spans
against candidates that break their kind's rule): on all those of half of the documents, equal ones as one row with a
weight; the rest are scored. The probability from which on a kind is redacted is the lowest one that keeps the wanted
precision on all those of the other half.
Candidates that overlap a base span are left out, and of overlapping candidates the likeliest stays.

Python scans a text once, by piece; training, scoring and choosing are Spark operations over the candidates.

Cases: a null text is empty and has no span; documents without spans give zeros, the digest of nothing and an empty
list; rows that repeat an id are rows of their own; without candidates of both sorts nothing is added; long texts are
scanned whole, in linear time; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postsieve.llm.common import pieces
from postsieve.plans.durable import written

KINDS = ("email", "ip", "card", "phone")
#: Wanted share of true candidates among those redacted, on the calibration part.
PRECISION = 0.98
TREES, DEPTH = 12, 4
#: Distinct labelled candidates a training task takes, from four tasks on, and ranges of probability for calibration.
TASK_ROWS, RANGES = 50_000, 1024

# The base patterns. Digit patterns run on stretches of digits and the signs between them only, and
# never look back into what they have read.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
STRETCH = re.compile(r"[0-9+][0-9 ().+\-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Fixed values end.
DIGITS = re.compile(r"[0-9]+")
NO_DIGIT = re.compile(r"[^0-9]")
SPELLED = re.compile(r"(?i)[a-z0-9._%+-]{1,64} ?[\[(](?:at|@)[\])] ?[a-z0-9-]{1,63}(?: ?(?:\.|[\[(](?:dot|\.)[\])]) ?[a-z0-9-]{1,63}){1,8}")

CANDIDATE = pa.struct([
    ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("truth", pa.int32()), ("free", pa.bool_()),
    ("features", pa.list_(pa.float64()))])
SCHEMA = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.list_(pa.struct(
        [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))), ("candidates", pa.list_(CANDIDATE))])
SPANS_TYPE = ("uid bigint, doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
              "base array<struct<kind:int,start:int,end:int>>, "
              "candidates array<struct<kind:int,start:int,end:int,truth:int,free:boolean,features:array<double>>>")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def is_card(text: str) -> bool:
    digits = NO_DIGIT.sub("", text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    return all(len(part) < 12 and int(part) <= 255 or not part.strip("0") or int(part.lstrip("0")[:4]) <= 255 and len(part.lstrip("0")) <= 3
               for part in text.split("."))


def is_phone(text: str) -> bool:
    return 8 <= len(NO_DIGIT.sub("", text)) <= 15


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping: the local part is the run of allowed characters before the sign."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
            last = domain.end()
        else:
            last = max(last, at)  # a local part cannot reach over the sign
        at = text.find("@", max(at + 1, last))
    return found


def stretches(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in STRETCH.finditer(text) if len(m[0]) > 2]


def base_spans(text: str, runs: list[tuple[int, str]]) -> list[Span]:
    """All base spans, by kind and start."""
    found = emails(text)
    for kind, (pattern, holds) in enumerate(((IP, is_ip), (CARD, is_card), (PHONE, is_phone)), 1):
        for at, run in runs:
            found += [(kind, at + m.start(), at + m.end()) for m in pattern.finditer(run) if holds(m[0])]
    return found


def proposals(text: str, runs: list[tuple[int, str]]) -> Iterator[tuple[Span, int | None]]:
    """Candidates with what a rule says: 1 true, 0 false, None open."""
    at = text.find("@")
    while at >= 0:
        before = text[max(0, at - 64):at]
        start = at - (len(before) - len(before.rstrip(LOCAL)))
        end = at + 1
        while end < len(text) and end - at < 256 and (text[end].isalnum() or text[end] in ".-"):
            end += 1
        if start < at and end > at + 1 and not DOMAIN.match(text, at):
            yield (0, start, end), 0  # no domain
        at = text.find("@", at + 1)
    if "(" in text or "[" in text:
        for m in SPELLED.finditer(text):
            yield (0, m.start(), m.end()), None
    for offset, run in runs:
        yield from _windows(offset, run, [m.span() for m in DIGITS.finditer(run)])


def _windows(offset: int, run: str, groups: list[tuple[int, int]]) -> Iterator[tuple[Span, int | None]]:
    """Windows of neighbouring digit groups inside a stretch: four dotted ones; groups of three digits or more with
    single gaps; groups of two or more after a plus or bracket. None has more than 19 digits, so their number is in
    proportion to the stretch."""
    for first, (a, z) in enumerate(groups):
        digits, dotted, single, least, place = z - a, True, True, z - a, first
        mark = run[a - 1] if a and run[a - 1] in "+(" else ""
        while digits <= 19:
            end = groups[place][1]
            if dotted and place - first == 3:
                yield (1, offset + a, offset + end), None if is_ip(run[a:end]) else 0
            if single and least >= 3 and digits >= 16:
                if is_card(run[a:end]):
                    yield (2, offset + a, offset + end), None
                elif first == 0 or place == first:
                    yield (2, offset + a, offset + end), 0
            if mark and least >= 1 and 7 <= digits <= 15 and place > first:
                yield (3, offset + a - 1, offset + end), None if digits >= 10 else 0
            place += 1
            if place == len(groups) or groups[place][0] - end > 3:
                break
            gap = run[end:groups[place][0]]
            dotted, single = dotted and gap == ".", single and gap in (" ", "-")
            least = min(least, groups[place][1] - groups[place][0])
            digits += groups[place][1] - groups[place][0]


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    inner = text[start:end]
    digits = NO_DIGIT.sub("", inner)
    groups = DIGITS.findall(inner)
    left, right = text[max(0, start - 20):start], text[end:end + 20]
    near = left[-1:], right[:1]
    words = left.split()
    around = left + right
    return [
        *(float(kind == k) for k in range(4)), float(len(inner)), float(len(digits)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(luhn(digits)) if digits else 0.0,
        float(all(len(g) <= 3 and int(g) <= 255 for g in groups)) if groups else 0.0,
        float(inner[:1] == "+"), float(inner.count("(")), float(inner.count(".")), float(inner.count("-")), float(inner.count(" ")),
        float(len(inner.rpartition("@")[2].rpartition(".")[2])), *(float(c.isspace() or not c) for c in near),
        *(float(c.isalnum()) for c in near), sum(c.isdigit() for c in around) / max(1, len(around)),
        float(words[-1].isalpha()) if words else 0.0, float(words[-1].endswith((":", "="))) if words else 0.0,
    ]


def scan(text: str) -> tuple[list[Span], list[tuple[Span, int | None, bool]]]:
    """Base spans, and candidates with the rule's word and whether they are free of base spans."""
    runs = stretches(text)
    base = base_spans(text, runs)
    known = set(base)
    found: dict[Span, tuple[int | None, bool]] = {s: (1, False) for s in base}
    taken: list[tuple[int, int]] = []  # base spans as disjoint stretches
    for _, a, z in sorted(base, key=lambda s: s[1]):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(z, taken[-1][1])
        else:
            taken.append((a, z))
    for span, truth in proposals(text, runs):
        if span not in known and span not in found:
            free = not _overlaps(taken, span[1], span[2])
            # an open candidate inside a base span says nothing either way
            if free or truth == 0:
                found[span] = (truth, free)
    return base, [(s, truth, free) for s, (truth, free) in found.items()]


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a stretch meets one of disjoint stretches in order."""
    at = bisect_left(taken, (end,))
    return at > 0 and taken[at - 1][1] > start


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 40
    for piece in pieces(batches):
        rows = []
        for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
            text = text or ""
            base, candidates = scan(text)
            counts = [sum(s[0] == k for s in base) for k in range(4)]
            rows.append((uid, doc_id, *counts, [dict(zip(("kind", "start", "end"), s)) for s in base], [
                {"kind": s[0], "start": s[1], "end": s[2], "truth": truth, "free": free, "features": features(text, s)}
                for s, truth, free in candidates]))
            uid += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base counts by kind, ``base`` and ``added`` spans (kind, start, end; code points)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = written(rows.mapInArrow(_scan, SPANS_TYPE))
    every = scanned.select("uid", F.explode("candidates").alias("c")).select("uid", "c.*")
    chosen = _chosen(every)
    if chosen is None:
        return scanned.select("doc_id", *(f"n_{k}" for k in KINDS), "base", F.slice("base", 1, 0).alias("added"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), (F.col("start") - F.col("end")).alias("size"), "kind", "start", "end")))
    added = chosen.groupBy("uid").agg(ranked.alias("ranked")).mapInArrow(_best, "uid bigint, added array<struct<kind:int,start:int,end:int>>")
    return scanned.drop("candidates").join(added, "uid", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base", F.coalesce("added", F.slice("base", 1, 0)).alias("added"))


def _chosen(every: DataFrame) -> DataFrame | None:
    """Open candidates that the boosted trees take, with their probability."""
    settled = every.where("truth is not null")
    # the part that trains and the part that calibrates are different documents
    part = F.pmod(F.xxhash64("uid"), 2)
    labelled = written(
        settled.groupBy(part.alias("part"), "features", F.col("truth").cast("double").alias("y"), "kind")
        .agg(F.count(F.lit(1)).cast("double").alias("weight")).sortWithinPartitions("part", "features", "y")
    ).withColumn("x", array_to_vector("features"))
    train = labelled.where("part = 0")
    seen = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    if len(seen) < 2:
        return None
    rows = sum(seen.values())
    # with as many bins, the trees look for their splits in all rows; with fewer, in a sample of them
    bins = max(32, math.isqrt(rows) + 1)
    trees = GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=bins, stepSize=0.3, seed=42)
    model = trees.fit(train.coalesce(max(4, rows // TASK_ROWS)))
    chance = vector_to_array("probability")[1]
    bounds = _bounds(model.transform(labelled.where("part = 1")).select("kind", "y", "weight", chance.alias("p")))
    if not bounds:
        return None
    scored = model.transform(every.where("truth is null and free").withColumn("x", array_to_vector("features"))).withColumn("p", chance)
    least = F.coalesce(*(F.when(F.col("kind") == k, F.lit(b)) for k, b in bounds.items()))
    return scored.where(F.col("p") >= least).select("uid", "kind", "start", "end", "p")


def _bounds(checked: DataFrame) -> dict[int, float]:
    """By kind the lowest probability from which on the wanted precision holds; at least an even chance.

    Equal probabilities are one row; what lies above a row is summed over ranges of probability, then inside its own.
    """
    counts = [F.sum(F.when(F.col("y") > 0, F.col("weight")).otherwise(0.0)).alias("good"), F.sum("weight").alias("all")]
    level = checked.where("p >= 0.5").groupBy("kind", "p").agg(*counts).withColumn("range", F.floor(F.col("p") * RANGES))
    higher = Window.partitionBy("kind").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    above = level.groupBy("kind", "range").agg(F.sum("good").alias("good"), F.sum("all").alias("all")).select(
        "kind", "range", *(F.coalesce(F.sum(c).over(higher), F.lit(0.0)).alias(f"{c}_above") for c in ("good", "all")))
    inside = Window.partitionBy("kind", "range").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    total = {c: F.col(f"{c}_above") + F.sum(c).over(inside) for c in ("good", "all")}
    held = level.join(F.broadcast(above), ["kind", "range"]).select("kind", "p", (total["good"] >= PRECISION * total["all"]).alias("holds"))
    return {r.kind: r.p for r in held.where("holds").groupBy("kind").agg(F.min("p").alias("p")).collect()}


def _best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of overlapping spans the likeliest, longest, first one."""
    kind = SCHEMA.field("base").type
    for batch in batches:
        kept = []
        for ranked in batch.column("ranked").to_pylist():
            taken: list[tuple[int, int]] = []
            kept.append([])
            for x in ranked:
                if not _overlaps(taken, x["start"], x["end"]):
                    insort(taken, (x["start"], x["end"]))
                    kept[-1].append({k: x[k] for k in ("kind", "start", "end")})
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(kept, kind)], names=["uid", "added"])


def as_text(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans, all spans as text."""
    return find(docs).select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
