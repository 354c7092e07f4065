"""Alignment of two tokenizers' tokens by their bytes (operator 11).

Both tokenizers' tokens cover the same bytes. Where a token of each ends at one byte the text can be cut for both, and
the stretches between such cuts that hold none themselves are the leaf groups. Cuts are found by divide and conquer: of
an interval the common end nearest to its middle is located, each candidate by a bisection among the other side's ends;
both halves follow, and an interval without a common end is a leaf. All intervals of one depth are worked on together.

Two tokens are linked where their bytes overlap. A pair of ids counts as many documents as hold it linked, and what a
link is worth follows from its pair's count, against the highest count of its first id's pairs.

Documents are dealt into chunks once. Each chunk sends its distinct pairs with their documents; Spark sums them by pair,
so a frequent pair is one row for each chunk, and sends the counts back to the chunks that hold it. Nothing of the
corpus is gathered in one place; a vocabulary bounds the pairs of one id.

Stretches from white space to white space are tokenized and aligned once per worker and remembered: both tokenizers cut
at their borders (checked for the piece vocabulary when it is loaded). Texts with white space or marks for which that
does not hold are tokenized whole.

Cases: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens, zeros and an
empty ``groups``; repeated rows count as documents of their own; rows without an id are answered; an empty table gives
an empty result; long texts are taken whole; other columns are passed on, but for those named like a result.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from postsieve.llm.chunks import in_chunks
from postsieve.llm.common import sorted_set
from postsieve.llm.tokens import _byte_letters

#: Characters of the stretches that one Python worker remembers.
KNOWN_CHARS = 4_000_000
#: Characters of text worked on together, and of a line that is tokenized.
LEARNT_CHARS = 1_000_000
LINE_CHARS = 1_000
#: How byte-level vocabularies of this kind part texts (a fixed value).
PARTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

_SPACE = "\u2581"


def leaf_groups(ends_a: np.ndarray, ends_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> np.ndarray:
    """Rows (first token, end) of side a and of side b for every leaf, in order.

    ``ends_*`` are the byte ends of all tokens, rising; ``cuts_*`` how many tokens of a side stand before each cut that
    is known already, from 0 to their number.
    """
    spans = np.stack([cuts_a[:-1], cuts_a[1:], cuts_b[:-1], cuts_b[1:]], 1)
    leaves = [np.empty((0, 4), np.int64)]
    while len(spans):
        low, high = spans[:, 0], spans[:, 1] - 1  # ends within the interval; its own end is a cut already
        middle = (low + high) // 2
        at_a, at_b = np.full(len(spans), -1), np.full(len(spans), -1)
        open_, step = np.flatnonzero((high > low) & (spans[:, 3] - spans[:, 2] > 1)), 0
        while len(open_):
            for place in (middle[open_] - step, middle[open_] + step)[: 1 + (step > 0)]:
                inside = (place >= low[open_]) & (place < high[open_]) & (at_a[open_] < 0)
                who, place = open_[inside], place[inside]
                other = np.searchsorted(ends_b, ends_a[place])
                good = ends_b[other] == ends_a[place]
                at_a[who[good]], at_b[who[good]] = place[good] + 1, other[good] + 1
            step += 1
            left = (at_a[open_] < 0) & ((middle[open_] - step >= low[open_]) | (middle[open_] + step < high[open_]))
            open_ = open_[left]
        leaves.append(spans[at_a < 0])
        s, a, b = spans[at_a >= 0], at_a[at_a >= 0], at_b[at_a >= 0]
        spans = np.concatenate([np.stack([s[:, 0], a, s[:, 2], b], 1), np.stack([a, s[:, 1], b, s[:, 3]], 1)])
    found = np.concatenate(leaves)
    return found[np.argsort(found[:, 0])]


class _Numbers(dict[str, int]):
    """Numbers of stretches in order of arrival; the new ones are kept to be learnt."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, stretch: str) -> int:
        self[stretch] = n = len(self)
        self.new.append(stretch)
        return n


class Tokenizers:
    """A byte-level BPE (a) and a piece BPE with byte fallback (b), and the stretches aligned so far."""

    _stretch = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    #: White space other than space and line end, control characters, and the mark that stands for a space.
    _odd = re.compile(f"[^\\S \\n]|[\x00-\x09\x0b-\x1f\x7f-\x9f\u180e{_SPACE}]")

    #: Characters about whose kind two versions of Unicode may differ.
    _beyond = re.compile("[^\x00-\u024f]")

    def __init__(self, byte_level: str, piece_model: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        self.a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=piece_model)
        self.a.encode_special_tokens = True
        stand_in = {ord(c): i for i, c in enumerate(_byte_letters())}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            known = all(ord(c) in stand_in for c in entry)
            self.bytes_a[i] = bytes(stand_in[ord(c)] for c in entry) if known else entry.encode()
        self.ranked = self._by_rank()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        #: Whether no piece goes on over a border of stretches.
        self.parted = not any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in pieces)
        #: Ids as text with what follows them: "," or "|" for a, "," or ";" for b.
        self.signs = [f"{i}{c}" for side, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for c in marks for i in range(len(side))]
        self.sign_sizes = np.array([len(x) for x in self.signs], np.int64)
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.forget()

    def _by_rank(self):
        """The vocabulary of side a for the library that merges by rank, several times faster: the same tokens if the
        nth merge makes the nth id behind the single bytes. None if that does not hold or the library is absent."""
        try:
            import tiktoken
        except ImportError:
            return None
        made = json.loads(self.a.to_str())
        merges = [x.split(" ") if isinstance(x, str) else x for x in made["model"]["merges"]]
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        ranks = {self.bytes_a[i]: i for entry, i in vocabulary.items() if i < 256 + len(merges)}
        ordered = all(vocabulary.get(x + y) == 256 + n for n, (x, y) in enumerate(merges))
        if not ordered or len(ranks) != 256 + len(merges) or sum(len(x) == 1 for x in self.bytes_a[:256]) != 256:
            return None
        if made["normalizer"] is not None or made["pre_tokenizer"].get("type") != "ByteLevel" or made["pre_tokenizer"].get("add_prefix_space"):
            return None
        return tiktoken.Encoding("ranked", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        self.known = _Numbers()
        self.chars = 0
        self.groups: list[str] = []
        #: By stretch: tokens of a, of b and groups (a is -1 if the bytes are not given back), and where its links end.
        self.counts, self.ends, self.links = [np.empty((0, 3), np.int64)], [np.zeros(1, np.int64)], [np.empty(0, np.int64)]

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """The stretches of each text by number; numbers hold until the next call."""
        if self.chars > KNOWN_CHARS:
            self.forget()
        out, held, used = [], [], 0
        for text in texts:
            held.append(text)
            used += len(text or "")
            if used > LEARNT_CHARS:
                out += self._numbers(held)
                held, used = [], 0
        return out + self._numbers(held)

    def _numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        number, out = self.known.__getitem__, []
        for text in texts:
            parts = []
            if text:
                if self.parted and not self._odd.search(text):
                    parts = self._stretch.findall(f" {text}")
                if not parts or parts[-1][-1] in " \n":
                    parts = [f" {text}"]
                    if parts[0] not in self.known:
                        self._learn_new()
                        number(parts[0])
                        self._learn_new()
            out.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        self._learn_new()
        return out

    def _learn_new(self) -> None:
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []

    def _encoded(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides for the stretches behind each other, a line of them at a time."""
        lines, first, used = [], 0, 0
        for i, stretch in enumerate(stretches):
            used += len(stretch)
            if used > LINE_CHARS or i + 1 == len(stretches):
                lines.append("".join(stretches[first:i + 1]))
                first, used = i + 1, 0
        left: list[int] = []
        for line in lines:
            if self.ranked is not None and not self._beyond.search(line):
                left += self.ranked.encode_ordinary(line)
            else:
                left += self.a.encode_batch_fast([line], add_special_tokens=False)[0].ids
        # the piece tokenizer adds a space to a text; where the line has none, that token goes
        right: list[int] = []
        for line, ids in zip(lines, self.b.encode([x[1:] if x[0] == " " else x for x in lines], num_threads=1), strict=True):
            right += ids if line[0] == " " else ids[1:]
        return np.array(left, np.int64), np.array(right, np.int64)

    def _learn(self, stretches: list[str]) -> None:
        """Tokenize and align stretches, as one text if there are several."""
        alone = len(stretches) == 1
        ids_a, ids_b = self._encoded(stretches)
        sizes = [len(s.encode()) for s in stretches]
        whole = "".join(stretches).encode()
        if any(b"".join(map(side.__getitem__, ids.tolist())) != whole for side, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            if alone:
                self._add(stretches, np.array([[-1, 0, 0]]), [""], np.zeros(1, np.int64), np.empty(0, np.int64))
            else:
                self._learn(stretches[:len(stretches) // 2])
                self._learn(stretches[len(stretches) // 2:])
            return
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts = np.cumsum([0, *sizes])
        cuts_a, cuts_b = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
        leaves = leaf_groups(ends_a, ends_b, cuts_a, cuts_b)
        # every byte range between neighbouring ends is the overlap of one pair
        ends = sorted_set(np.concatenate([ends_a, ends_b]))
        links = ids_a[np.searchsorted(ends_a, ends)] << 32 | ids_b[np.searchsorted(ends_b, ends)]
        shown, places = self._shown(ids_a, ids_b, leaves)
        of_leaf, of_link = np.searchsorted(leaves[:, 0], cuts_a), np.searchsorted(ends, cuts, "right")
        counts = np.stack([np.diff(cuts_a), np.diff(cuts_b), np.diff(of_leaf)], 1)
        bounds = places[of_leaf].tolist()
        groups = [shown[i:j - 1] for i, j in zip(bounds, bounds[1:], strict=False)]
        self._add(stretches, counts, groups, of_link[1:], links)

    def _shown(self, ids_a: np.ndarray, ids_b: np.ndarray, leaves: np.ndarray) -> tuple[str, np.ndarray]:
        """All leaves as text, with a semicolon behind each, and where each begins in it."""
        size_a, size_b = leaves[:, 1] - leaves[:, 0], leaves[:, 3] - leaves[:, 2]
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        signs = np.empty(len(ids_a) + len(ids_b), np.int64)
        signs[np.arange(len(ids_a)) + np.repeat(leaves[:, 2], size_a)] = ids_a
        signs[np.arange(len(ids_b)) + np.repeat(leaves[:, 1], size_b)] = ids_b + 2 * n_a
        last = leaves[:, 1] + leaves[:, 3]
        signs[last - size_b - 1] += n_a
        signs[last - 1] += n_b
        places = np.cumsum(np.append(0, self.sign_sizes[signs]))[np.append(0, last)]
        return "".join(map(self.signs.__getitem__, signs.tolist())), places

    def _add(self, stretches: list[str], counts: np.ndarray, groups: list[str], ends: np.ndarray, links: np.ndarray) -> None:
        self.chars += sum(map(len, stretches))
        self.groups += groups
        self.counts.append(counts)
        self.ends.append(ends + self.ends[-1][-1])
        self.links.append(links)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each stretch, where its links begin and the last ones end, and all links."""
        for held in (self.counts, self.ends, self.links):
            held[:] = [np.concatenate(held)]
        return self.counts[0], self.ends[0], self.links[0]


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(paths: tuple[str, str]) -> Tokenizers:
    if paths not in _TOKENIZERS:
        _TOKENIZERS[paths] = Tokenizers(*paths)
    return _TOKENIZERS[paths]


def _texts(table: pa.Table) -> list[str | None]:
    return [t for part in table.column("row").chunks for t in part.field("text").to_pylist()]


def _usable(numbers: list[np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    """Without the stretches of texts that are not given back."""
    return [n if (counts[n, 0] >= 0).all() else n[:0] for n in numbers]


def _gathered(stretches: np.ndarray, first: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links of the stretches behind each other, and how many each has."""
    count = first[stretches + 1] - first[stretches]
    return links[np.arange(count.sum()) + np.repeat(first[stretches] - np.cumsum(count) + count, count)], count


def _pairs(table: pa.Table, paths: tuple[str, str]) -> pa.Table:
    """A chunk's distinct pairs; ``held`` is the chunk and how many of its documents hold the pair."""
    known = _tokenizers(paths)
    numbers = known.numbers(_texts(table))
    counts, first, links = known.tables()
    each = [sorted_set(_gathered(sorted_set(n), first, links)[0]) for n in _usable(numbers, counts)]
    pairs, docs = np.unique(np.concatenate([np.empty(0, np.int64), *each]), return_counts=True)
    held = table.column("chunk")[0].as_py() << 32 | docs
    return pa.table([(pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), held], names=["a", "b", "held"])


def _results(table: pa.Table, replies: pa.Table, paths: tuple[str, str]) -> pa.Table:
    """A chunk's documents with what their links are worth."""
    known = _tokenizers(paths)
    numbers = known.numbers(_texts(table))
    counts, first, links = known.tables()
    pairs = replies.column("a").to_numpy().astype(np.int64) << 32 | replies.column("b").to_numpy().astype(np.int64)
    order = np.argsort(pairs)
    pairs, docs, best = pairs[order], replies.column("docs").to_numpy()[order], replies.column("best").to_numpy()[order]
    numbers = _usable(numbers, counts)
    held = sorted_set(np.concatenate([np.empty(0, np.int64), *numbers]))
    found, size = _gathered(held, first, links)
    at, of = np.searchsorted(pairs, found), np.repeat(np.arange(len(held)), size)
    worth = np.zeros((len(counts), 6), np.int64)
    worth[:, :3] = counts
    worth[held, 3] = size
    worth[held, 4] = np.bincount(of, best[at], len(held)).astype(np.int64)
    sums = np.zeros(len(held), np.int64)
    np.add.at(sums, of, docs[at])
    worth[held, 5] = sums
    rows = np.array([worth[n].sum(0) for n in numbers]).reshape(-1, 6)
    groups = [";".join(map(known.groups.__getitem__, n.tolist())) for n in numbers]
    return pa.table([table.column("row"), *(pa.array(rows[:, i]) for i in range(6)), pa.array(groups, pa.string())],
                    names=["row", *RESULTS, "groups"])


def align(docs: DataFrame, byte_level: str, piece_model: str, text_col: str = "text") -> DataFrame:
    """The documents with ``n_a``, ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best`` (links whose pair has the
    highest count of its first id), ``count_sum`` (counts over all links) and ``groups`` (``a1,a2|b1;a3|b2,b3``).
    Side a encodes a space and the text, side b the text, to which it adds a space itself."""
    paths = (byte_level, piece_model)
    dealt = in_chunks(docs.drop(*RESULTS, "groups").withColumnRenamed(text_col, "text"))
    rows = dealt.rows.groupBy("chunk")
    # the sums and the join back read one shuffle: both need all of its columns (chunk and documents share one) and
    # the filter that the join would add to its side alone
    pairs = rows.applyInArrow(lambda t: _pairs(t, paths), "a int, b int, held bigint").where(
        "a is not null and b is not null").repartition("a", "b")
    counts = pairs.groupBy("a", "b").agg(F.sum(F.col("held").bitwiseAND(0xFFFFFFFF)).alias("docs"))
    counts = counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))
    replies = pairs.join(counts, ["a", "b"]).select(F.shiftright("held", 32).cast("int").alias("chunk"), "a", "b", "docs", "best")
    kind = StructType([dealt.rows.schema["row"], *(StructField(c, LongType()) for c in RESULTS), StructField("groups", StringType())])
    found = rows.cogroup(replies.groupBy("chunk")).applyInArrow(lambda t, r: _results(t, r, paths), kind)
    return found.select("row.*", *RESULTS, "groups").withColumnRenamed("text", text_col)


__all__ = ["Tokenizers", "align", "leaf_groups"]
